"""The corpus operators on small tables with nulls, empty and long texts, repeated
rows, clashing column names and empty tables, against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import common, decontaminate, graph, jaccard, language, lm, packing, sharding, threads, token_files, topk, toxicity
from docloom.llm.tokenizing import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int, length long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")


def words_of(x):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(x)) if w]


def texts():
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(WORDS, 60)) for _ in range(12)]
    out = [None, "", " \t\n", "One", "one two", "Élan vital 42", base[0], base[0], base[0].upper(), base[0] + " more", " ".join(base), "x" * 5000 + " é" * 300]
    out += base[1:] + [b.replace("alpha", "omega", 1) for b in base[1:5]] + ["a\nb\r\nc  d e <|endoftext|> f's 12 1234, (x)"]
    return out


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    lang = lambda k: None if k % 9 == 0 else "en" if k % 2 else "fr"
    return spark.createDataFrame([(k, x, lang(k), "s", 0, 0.5, 1, 2) for k, x in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).repartition(3).cache()


# ---------------------------------------------------------------- hashing and tokens


def test_word_hashes_follow_words():
    rows = [x for x in texts() if x is not None]
    seen = {}
    for first, end, data, starts in common.chunks(pa.array(rows), 300):
        a, b, at = common.word_spans(data, starts)
        h = common.word_hashes(data, a, b).tolist()
        for k in range(end - first):
            want = words_of(rows[first + k])
            got = h[at[k] : at[k + 1]]
            assert len(got) == len(want)
            for w, x in zip(want, got, strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_tokenizer(name):
    rows = [x or "" for x in texts()] + ["   lead", "tail   ", "a  b   c", "don't 'x' l'été ÀÉ ΣΑΣ", "éa", "x \n\n y\t\tz", "<|endoftext|>", "日本語 text。"]
    path = public_tokenizers.path(name)
    got = []
    for remember in (600_000, 3):
        enc = Encoder(path, remember=remember)
        got = []
        for _, ids, ends in enc.encode(pa.array(rows)):
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(rows, add_special_tokens=False)]


def test_token_files_round_trip(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    doubled = docs.select("doc_id", "text", "length").unionByName(spark.createDataFrame([(None, "nobody", 1), (3, "One", 1)], "doc_id long, text string, length long"))
    manifest = token_files.write_token_files(doubled, path, 2, common.shared_dir(spark, "t"), files=3, frame_ids=64)
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    rows = sorted([(k, x) for k, x in enumerate(texts())] + [(3, "One")])
    want = [(None, "nobody"), *rows]
    ids = [e.ids + [2] for e in Tokenizer.from_file(path).encode_batch([x or "" for _, x in want], add_special_tokens=False)]
    start = 0
    for g, (k, _), i in zip(got, want, ids, strict=True):
        assert (g.doc_id, g.start, g.ids, g.ids_crc32) == (k, start, i, zlib.crc32(np.array(i, "<u4").tobytes()))
        start += len(i)
    some = token_files.read_token_files(manifest, doc_ids=[5, 10]).collect()
    assert {(x.doc_id, x.start) for x in some} == {(x.doc_id, x.start) for x in got if x.doc_id in (5, 10)}
    wide = token_files.write_token_files(docs.limit(20), path, 70_000, common.shared_dir(spark, "t"))  # an end id beyond 16 bits
    assert {x.ids[-1] for x in token_files.read_token_files(wide).collect()} == {70_000}
    ties = spark.createDataFrame([(None, f"text {k % 7}") for k in range(300)], "doc_id long, text string")
    tied = token_files.write_token_files(ties, path, 2, common.shared_dir(spark, "t"), files=4)
    assert tied.count() > 1 and token_files.read_token_files(tied).count() == 300
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), path, 2, common.shared_dir(spark, "t"))).count() == 0


def test_token_file_damage(tmp_path):
    import zstandard

    with open(tmp_path / "f", "wb") as f:
        w = token_files.TokenWriter(f, 2, 4, 1)
        for k in range(5):
            w.add(k, np.full(3, k, np.uint32))
        w.close()
    raw = bytearray((tmp_path / "f").read_bytes())
    reader = token_files.TokenReader(pa.BufferReader(bytes(raw)))
    assert len(reader.frames) == 5 and [list(i) for _, i in reader.documents({3})] == [[3, 3, 3]]
    at, size = int(reader.starts[2]), reader.frames[2][0]
    for k in range(size):  # any byte of the frame
        bad = bytearray(raw)
        bad[at + k] ^= 0x55
        try:
            got = token_files.TokenReader(pa.BufferReader(bytes(bad))).load(2)
        except (ValueError, zstandard.ZstdError, MemoryError):
            continue
        assert got.tolist() == [2, 2, 2], k  # a byte that does not matter (frame header flags)
    other = zstandard.ZstdCompressor(level=1, write_content_size=False).compress(np.full(3, 9, "<u2").tobytes())
    bad = raw[:at] + other.ljust(size, b"\0") + raw[at + size :]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.TokenReader(pa.BufferReader(bytes(bad))).load(2)
    with pytest.raises(ValueError, match="65536"):
        w = token_files.TokenWriter(pa.BufferOutputStream(), 2, 4, 1)
        w.add(1, np.array([65536], np.uint32))
        w.flush()


# ---------------------------------------------------------------- packing


def test_best_two_fit_replaces_the_smallest():
    plan = packing.best_two_fit({60: 1, 30: 1, 22: 1, 17: 1}, 100)
    # greedy takes 60 + 30, then 30 leaves for 22 + 17, which fill 39 of the 40 left
    assert plan[0] == ([60, 22, 17], 1) and plan[1] == ([30], 1)


def test_packing_plan_is_complete():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = Counter(rng.integers(1, 65, 300).tolist())
        plan = packing.best_two_fit(dict(counts), 64)
        used = Counter()
        for items, n in plan:
            assert sum(items) <= 64
            used.update({k: v * n for k, v in Counter(items).items()})
        assert used == counts
        assert sum(n for _, n in plan) <= math.ceil(sum(k * v for k, v in counts.items()) / 64) * 1.03 + 1


def test_packed_documents(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, capacity=100, with_ids=True).collect()
    want = {k: e.ids + [0] for k, e in enumerate(Tokenizer.from_file(path).encode_batch([x or "" for x in texts()], add_special_tokens=False))}
    parts, bins = {}, {}
    for x in got:
        assert x.length == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        assert want[x.doc_id][x.start : x.start + x.length] == x.ids and x.start == 100 * x.piece
        parts[x.doc_id] = parts.get(x.doc_id, 0) + x.length
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert parts == {k: len(v) for k, v in want.items()}
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 100
    assert packing.pack_documents(docs.limit(0), path).count() == 0


# ---------------------------------------------------------------- classifiers


def test_toxicity_learns_words_and_stems(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice(WORDS, 40)) + (" Scum!" if k % 8 == 0 else " badness badly" if k % 8 == 4 else "")) for k in range(800)] + [(9000, None), (9001, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(800)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(d, labels, l1=2.0)
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(d, model, ["doc_id"]).collect()}
    held = [k for k in range(800) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in held)
    assert got[9000] == got[9001] < 0.5
    kept = toxicity.drop_toxic(d, labels, 0.5)
    assert kept.columns == d.columns and kept.filter("doc_id < 800 AND doc_id % 4 = 0").count() < 10
    none = toxicity.fit_toxicity(d, labels.limit(0))
    assert toxicity.score_toxicity(d, none, ["doc_id"]).filter("score >= 0.5").count() == 0


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    ex = [(np.append(rng.integers(0, 1000, 20), 1024), np.ones(21)) for _ in range(400)]
    y = [int(k % 2) for k in range(400)]
    ex = [(np.append(k, 7) if t else k, np.ones(22 if t else 21)) for (k, _), t in zip(ex, y, strict=True)]
    m = toxicity.ftrl(ex, y, 10, 0.5, 1.0, 6.0, 1.0, 3)
    assert 7 in m.index and len(m.index) < 200


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9):
        code = language.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= 1


def test_language(spark):
    rng = np.random.default_rng(4)
    voc = {"en": ["the", "and", "with", "house"], "fr": ["être", "où", "avec", "maison"], "de": ["über", "straße", "und", "haus"]}
    rows = [(k, " ".join(rng.choice(voc[n], 30)), n) for k in range(300) for n in [list(voc)[k % 3]]]
    rows += [(900, None, "en"), (901, "123 ***", "en"), (902, "", None), (903, "日本", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    train = common.fold(F.col("doc_id"), 4) != 2
    got = {x.doc_id: x for x in language.identify(d, language.fit_language(d, train), ["doc_id"]).collect()}
    assert all(got[k].lang_pred == list(voc)[k % 3] and 0 <= got[k].score <= 1 for k in range(300))
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in voc
    one = language.identify(d, language.fit_language(d, F.col("lang") == "fr"), ["doc_id"]).filter("doc_id < 300").select("lang_pred").distinct().collect()
    assert [x.lang_pred for x in one] == ["fr"]
    assert {x.lang_pred for x in language.identify(d, language.fit_language(d, F.lit(False)), ["doc_id"]).collect()} == {"und"}
    kept = language.keep_known_languages(d)
    assert kept.columns == d.columns and kept.filter("doc_id < 300").count() == 300 and kept.filter("doc_id IN (900, 901, 902)").count() == 0
    assert language.identify(d.limit(0), language.fit_language(d, train), ["doc_id"]).count() == 0


# ---------------------------------------------------------------- decontamination


def brute_hits(texts_, items):
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    out = {}
    for k, x in enumerate(texts_):
        w, hit, ids = cut(x), set(), set()
        for i, y in items:
            v = cut(y)
            n = min(10, len(v))
            runs = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else ():
                if tuple(w[p : p + n]) in runs:
                    hit.update(range(p, p + n))
                    ids.add(str(i))
        out[k] = (len(w), len(hit), len(ids))
    return out


def test_decontamination(spark):
    rng = np.random.default_rng(6)
    voc = [f"w{k}" for k in range(25)]
    rows = [" ".join(rng.choice(voc, rng.integers(0, 80))) for _ in range(60)] + [None, "", "w1 " * 300, "W1, (w2) w3!"]
    source = " ".join(x or "" for x in rows).split()
    items = [(k, " ".join(source[k * 30 : k * 30 + n])) for k, n in enumerate([10, 11, 25, 9, 3, 1, 40, 12, 10, 10])] + [(77, None), (78, "..."), (79, "w1 " * 30), (0, " ".join(source[:10]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for few in (100_000, 0):
        got = {x.doc_id: (x.n_words, x.n_hit, x.n_items) for x in decontaminate.contamination(table(spark, rows), bench, broadcast_rows=few).collect()}
        assert got == brute_hits(rows, items)
    shared = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"
    many = [f"x{k} {shared} y{k}" for k in range(200)]
    for few in (100_000, 0):
        got = {x.doc_id: (x.n_words, x.n_hit, x.n_items) for x in decontaminate.contamination(table(spark, many), spark.createDataFrame([(1, shared), (2, shared + " z")], "item_id long, text string"), broadcast_rows=few).collect()}
        assert got == {k: (14, 12, 2) for k in range(200)}
    clean = decontaminate.contamination(table(spark, rows), bench.limit(0))
    assert clean.filter("contaminated").count() == 0 and clean.count() == len(rows)
    kept = decontaminate.drop_contaminated(table(spark, rows), bench)
    assert {x.doc_id for x in kept.collect()} == {k for k, v in brute_hits(rows, items).items() if not v[1]}
    assert kept.columns == table(spark, rows).columns
    assert decontaminate.contamination(table(spark, []), bench).count() == 0


def test_contaminated_rows_go_by_their_own_text(spark):
    """Rows without an id, or with that of a contaminated row, stay."""
    passage = "a b c d e f g h i j k"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(None, f"x {passage} y", "p"), (None, "clean words", "q"), (5, passage, "r"), (5, "more clean words", "s"), (6, None, "t"), (None, None, "u"), (7, passage, "v"), (7, passage, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_docloom_x` string")
    for most in (100_000, 0):
        kept = decontaminate.drop_contaminated(docs, bench, broadcast_rows=most)
        assert sorted(x["_docloom_x"] for x in kept.collect()) == ["q", "s", "t", "u"]
    # beyond the broadcast bound: rows without a passing fingerprint never meet in the join
    by = lambda **limits: sorted(map(tuple, decontaminate.contamination(docs, bench, **limits).collect()), key=str)
    assert by(broadcast_rows=0) == by()


def test_decontamination_is_native(spark):
    out = decontaminate.contamination(table(spark, ["a b"]), spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


# ---------------------------------------------------------------- search


def test_top_k(spark):
    rng = np.random.default_rng(5)
    v = [(k, (rng.integers(-3, 3, 4) / 8).tolist()) for k in range(230)]
    rows = v + [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (None, [1.0] * 4), (350, [1.0, 2.0]), (400, [3.0, 1.0]), (7, v[7][1])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    clean = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, e in clean:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), i) for i, f in clean if i != q and len(f) == len(e))[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    for kw in ({}, {"tile": 2, "cells": 70}, {"tile": 2, "cells": 1, "shard_rows": 50}):
        got = [tuple(x) for x in topk.top_k(d, F.col("vec_id") % 50 == 0, **kw).select("query_id", "rank", "vec_id", "score").collect()]
        assert sorted(got) == sorted(want)
    assert topk.top_k(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_beyond_exact_doubles(spark):
    big = float(2**20 + 1)
    rows = [(0, [big, big]), (1, [big, big - 2**-8]), (2, [big, big - 2**-7]), (3, [1e15, 1e15])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clean = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = sorted(((i, min(2**63 - 1, sum(a * b for a, b in zip(clean[0], v, strict=True)))) for i, v in clean.items() if i), key=lambda x: -x[1])
    assert [(x.vec_id, x.score) for x in topk.top_k(d, F.col("vec_id") == 0).orderBy("rank").collect()] == want


# ---------------------------------------------------------------- sharding


def test_shards(spark, docs):
    many = docs.unionByName(docs.limit(5)).withColumn("shard", F.lit(9))
    out = sharding.write_shards(many, 7, common.shared_dir(spark, "s"), seed=3, bucket_bytes=2000).cache()
    n = many.count()
    sizes = {x.shard: (x.n, x.slots) for x in out.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots")).collect()}
    assert sum(a for a, _ in sizes.values()) == n and all(a == b for a, b in sizes.values())
    assert max(a for a, _ in sizes.values()) - min(a for a, _ in sizes.values()) <= 1
    assert out.groupBy("shard").agg(F.max("slot").alias("m"), F.count("*").alias("n")).filter("m <> n - 1").count() == 0
    key = lambda r: (r.doc_id, r.text)
    assert Counter(key(x.record) for x in out.collect()) == Counter(key(x) for x in many.collect())
    assert out.first().record.shard == 9
    other = sharding.shuffled(many, 7, seed=4, bucket_bytes=2000)
    assert {(x.record.doc_id, x.shard, x.slot) for x in other.collect()} != {(x.record.doc_id, x.shard, x.slot) for x in out.collect()}
    assert sharding.shuffled(docs.limit(0), 7).count() == 0
    nobody = spark.createDataFrame([(None, f"text {k}") for k in range(500)], "doc_id long, text string")
    parts = sharding.placed(nobody, seed=3, bucket_bytes=500).groupBy("bucket").agg(F.count("*").alias("n")).collect()
    assert len(parts) > 5 and max(x.n for x in parts) < 200
    # brute force: buckets end to end, each in the order of its permutation, cut in runs
    rows = sharding.placed(many, seed=3, bucket_bytes=2000).collect()
    places, at = {}, 0
    for b in sorted({x.bucket for x in rows}):
        inside = sorted((x for x in rows if x.bucket == b), key=lambda x: x.rank)
        assert [x.rank for x in inside] == list(range(1, len(inside) + 1)) and sorted(inside[0].order) == list(range(len(inside)))
        assert [x.begin for x in inside] == [at] * len(inside)
        for x in inside:
            places.setdefault(at + x.order[x.rank - 1], []).append((x.record.doc_id, x.record.text))
        at += len(inside)
    sizes_ = [n // 7 + (k < n % 7) for k in range(7)]
    want = [(k, j) for k, m in enumerate(sizes_) for j in range(m)]
    got_rows = sorted(sharding.shuffled(many, 7, seed=3, bucket_bytes=2000).collect(), key=lambda x: (x.shard, x.slot))
    assert [(x.shard, x.slot) for x in got_rows] == want and [len(places[k]) for k in range(n)] == [1] * n
    assert [key(x.record) for x in got_rows] == [places[k][0] for k in range(n)]
    assert not re.search("Python|Pandas|Arrow", other._jdf.queryExecution().executedPlan().toString())


# ---------------------------------------------------------------- near duplicates


def sets_of(rows):
    out = []
    for x in rows:
        w = words_of(x)
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(rows):
    s, up = sets_of(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = up[a], up[b]
                if x != y:
                    up = [min(x, y) if u in (x, y) else u for u in up]
    return [(k, len(s[k]), up[k]) for k in range(len(rows))]


def near_copies(seed, n=80):
    rng = np.random.default_rng(seed)
    rows = [" ".join(rng.choice(WORDS + [f"v{k}" for k in range(60)], rng.integers(5, 90))) for _ in range(12)]
    out = list(rows)
    while len(out) < n:
        w = out[rng.integers(len(out))].split()
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(len(w))] = f"x{rng.integers(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("tile,fan_out", [(2_000_000, 4096), (300, 4096), (300, 3)])
def test_jaccard_components(spark, tile, fan_out, monkeypatch):
    rows = texts() + near_copies(tile)
    if fan_out == 3:  # some regions, in two levels
        monkeypatch.setattr(jaccard, "REGION", 200)
    got = sorted(tuple(x) for x in jaccard.similar_components(table(spark, rows).repartition(5), tile_elements=tile, broadcast_rows=1_000_000 if tile > 300 else 0, fan_out=fan_out).collect())
    assert got == brute_components(rows)


def test_jaccard_edges(spark):
    assert jaccard.similar_components(table(spark, [])).count() == 0
    d = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.component_id) for x in jaccard.similar_components(d).collect())
    assert got == [(-1, 4), (4, 4), (4, 4), (9, 9)]
    same = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (1, "another text of some words"), (None, None), (None, None), (7, "")]
    kept = jaccard.keep_one_of_each(spark.createDataFrame(same, "doc_id long, text string").withColumn("key", F.lit("clash")))
    assert sorted(((x.doc_id, x.text, x.key) for x in kept.collect()), key=str) == sorted([(1, same[0][1], "clash"), (1, same[4][1], "clash"), (None, None, "clash"), (None, None, "clash"), (7, "", "clash")], key=str)
    kept = jaccard.keep_one_of_each(table(spark, ["a b c d e f"] * 3 + [None, ""]))
    assert sorted(x.doc_id for x in kept.collect()) == [0, 3, 4] and len(kept.columns) == 8


@pytest.mark.parametrize("seed", range(6))
def test_trie_finds_every_link(seed):
    sets = [jaccard.np.array(sorted(hash(g) % 2**63 for g in s), np.uint64) for s in sets_of(near_copies(seed, 60))]
    low = jaccard.ordered(sets)
    want = [c for _, _, c in brute_components(near_copies(seed, 60))]
    assert jaccard.join_sets(low, None, 80) == want


def test_large_blocks_of_near_copies(monkeypatch):
    """A set is compared with few of a large block: neither with what its own elements exclude nor with all of a component."""
    rng, base = np.random.default_rng(3), np.arange(400)
    rows = []
    for k in range(400):
        w = base.copy()
        at = rng.permutation(400)[: rng.integers(0, 30)]
        w[at] = 1000 + 400 * k + np.arange(len(at))
        rows.append(" ".join(map(str, w)))
    sets = jaccard.ordered(list(jaccard.shingle_sets(pa.array(rows), 5)))
    seen, real = [], jaccard.needed
    monkeypatch.setattr(jaccard, "needed", lambda *a: seen.append(a) or real(*a))
    got = jaccard.join_sets(sets, None, 80)
    assert got == [c for _, _, c in brute_components(rows)] and len(set(got)) > 100
    assert len(seen) < 2000 < 400 * 399 // 2  # sets asked for the overlap that they need


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(1, 1), (None, 3)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in up if any(n in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- language model


def test_lm_base_and_counts(spark):
    rng = np.random.default_rng(9)
    voc = {0: WORDS, 1: ["un", "deux", "trois", "quatre", "cinq", "six"]}
    rows = [" ".join(rng.choice(voc[k % 2], 40)) for k in range(200)] + [None, "", "new words here", "new words here"]
    d = table(spark, rows)
    got = {x.doc_id: x for x in lm.lm_scores(d, common.fold(F.col("doc_id"), 7) == 2, rounds=2).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(rows))}
    toks = {k: words_of(x) + [0] for k, x in enumerate(rows)}
    c = Counter(t for k, ts in toks.items() if not held[k] for t in ts)
    total, types = sum(c.values()), len(c)
    for k, ts in toks.items():
        base = sum(math.log10((c[t] + 1) / (total + types + 1)) for t in ts)
        assert (got[k].held_out, got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (held[k], len(ts), sum(c[t] > 0 for t in ts), total)
        assert got[k].base_score == pytest.approx(base) and got[k].score < 0
    tests = [k for k in range(200) if held[k]]
    assert sum(got[k].score for k in tests) > sum(got[k].base_score for k in tests)


def tiny_vocabulary():
    counts = np.array([50, 40, 30, 20, 10, 8, 6])
    h = np.sort(np.random.default_rng(1).integers(1, 2**62, 7).astype(np.uint64))
    symbol = np.array([0, 1, 2, 3, 4, 5, 5])
    return lm.Vocabulary(h, counts, symbol, np.zeros(7), 5, 7, np.array([0, 0, 0, 0, 0, 1, 2]), np.log(np.array([0.8, 0.15, 0.05])), 164, 7, 1.0, 1, 0.5)


def test_gru_probabilities_and_gradients():
    gru = lm.Gru(tiny_vocabulary(), 6)
    rng = np.random.default_rng(2)
    for k in gru.w:
        gru.w[k] = gru.w[k].astype(np.float64) + rng.standard_normal(gru.w[k].shape) * 0.3
    h = rng.standard_normal((1, 6))
    assert sum(math.exp(gru.log_probs(h, np.array([s]))[0][0]) for s in range(7)) == pytest.approx(1)
    batch = np.array([[0, 1, 4, 5, 2, 6], [3, 2, 6, -1, -1, -1]])
    start = rng.standard_normal((2, 6))

    def loss():
        h, total = start, 0.0
        for t in range(5):
            h = gru.step(np.maximum(batch[:, t], 0), h)[0]
            live = batch[:, t + 1] >= 0
            total -= gru.log_probs(h[live], batch[live, t + 1])[0].sum() if live.any() else 0.0
        return total

    kept = {k: v.copy() for k, v in gru.w.items()}
    squares = {k: np.zeros_like(v) for k, v in gru.w.items()}
    gru.learn(batch, start, squares, 0.0)
    for k in gru.w:
        gru.w[k] = kept[k].copy()
    norm = {k: np.sqrt(v) for k, v in squares.items()}  # |gradient| up to one common factor
    ratio = []
    for k in ("x", "u", "b", "c", "o"):
        at = np.unravel_index(norm[k].argmax(), norm[k].shape)
        e = 1e-5
        gru.w[k][at] += e
        up = loss()
        gru.w[k][at] -= 2 * e
        down = loss()
        gru.w[k][at] += e
        ratio.append(abs(up - down) / (2 * e) / norm[k][at])
    assert np.allclose(ratio, ratio[0], rtol=1e-3)


def test_gru_scores_do_not_depend_on_lanes():
    gru = lm.Gru(tiny_vocabulary(), 6)
    rng = np.random.default_rng(3)
    texts_ = [np.append(rng.integers(1, 7, n), 0).astype(np.int32) for n in (0, 1, 5, 200, 33, 64, 63)]
    one = np.array([gru.score([t], 0)[0] for t in texts_])
    for lanes, window in ((1, 64), (3, 7), (50, 64)):
        assert np.allclose(gru.score(texts_, 0, lanes, window), one, atol=1e-4)


# ---------------------------------------------------------------- chat


def test_quotation_links(spark):
    rows = [
        (1, 0, "a", "Hello there\nHow are you?"), (1, 1, "b", "Fine, thanks.\nAnd you?"), (1, 2, "c", "A said:\n> hello   THERE\n> How are you?\nWell."),
        (1, 3, "a", "B wrote:\n> Fine, thanks.\n>> gone\n\nGood."), (1, 4, "b", None), (1, 5, "c", "> > Hello there\n> nothing known"), (2, 0, "a", "> Hello there"), (2, 1, "b", "x"), (2, 1, "b", "x"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(7)).withColumn("body", F.lit("clash"))
    got = {(x.conv_id, x.turn): x for x in threads.linked(d).collect()}
    assert len(got) == 8
    assert {k: v.reply_to for k, v in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 3, (1, 5): 4, (2, 0): None, (2, 1): 0}
    assert got[1, 2].body == "A said:\n\nWell.".replace("\n\n", "\n") and got[1, 3].body == "Good." and got[1, 4].body == ""
    assert (got[1, 2].n_quoted, got[1, 2].n_linked) == (1, 1) and (got[1, 3].n_quoted, got[1, 3].n_linked, got[1, 3].max_level) == (2, 1, 2)
    assert got[1, 5].n_linked == 1 and [got[1, k].position for k in range(6)] == [0, 1, 5, 2, 3, 4]
    assert threads.linked(d.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", threads.linked(d)._jdf.queryExecution().executedPlan().toString())


# ---------------------------------------------------------------- queries


def test_sql_of_queries(spark):
    import duckdb

    from docloom.llm.queries import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        want, got = c.sql(sql).df(), QUERIES[name](spark, d).toPandas()
        one = lambda v: "null" if pd.isna(v) else str(round(float(v), 5)) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
        key = lambda f: sorted(tuple(map(one, r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False, name=None))
        assert key(got) == key(want), name


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, d), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert packed.select("doc_id").distinct().count() == n
