"""The classifiers against plain versions, and their tables' odd cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import common, language, toxicity

TEXTS = ["One two three two ONE", "", "x", "Élan—vital 42! a.b", " lead  and trail ", "αβγ δε", "tab\tnew\nline", "repeat " * 9, "日本語 text"]


def plain_words(text):
    out, word = [], b""
    for b in text.encode():
        if b >= 128 or chr(b).isalnum():
            word += bytes([b + 32 if 65 <= b <= 90 else b])
        else:
            out += [word] if word else []
            word = b""
    return out + ([word] if word else [])


def places(text, bits):
    for _, _, data, rows in common.chunks(pa.array([text])):
        return toxicity.features(data, rows, bits)


def test_toxicity_features():
    bits = 20

    def place_of(kind, *words):
        """By the shortest text that has it."""
        between = {"word": "", "pair": " ", "skip1": " q ", "skip2": " q q "}
        if kind.startswith("stem"):
            _, out, n = places(words[0].decode(errors="ignore"), bits)
            return int(out[-3 + int(kind[4:]) - 5]) if n[0] == 1 else None
        text = between[kind].join(w.decode() for w in words)
        _, out, n = places(text, bits)
        m = int(n[0])
        return int(out[{"word": 0, "pair": m, "skip1": m + (m - 1), "skip2": m + (m - 1) + (m - 2)}[kind]])

    for text in TEXTS:
        w = plain_words(text)
        want = Counter(place_of("word", x) for x in w)
        for gap, kind in enumerate(("pair", "skip1", "skip2"), 1):
            want += Counter(place_of(kind, a, b) for a, b in zip(w, w[gap:]))
        want += Counter(place_of(f"stem{n}", x) for x in w for n in (5, 6, 7))
        row, got, n = places(text, bits) if text else (np.empty(0, int), np.empty(0, int), np.zeros(1, int))
        assert Counter(got.tolist()) == want and int(n[0]) == len(w), text
        if len(w):
            r, p, x = toxicity.distinct(row, got, n, bits)
            assert sorted(p.tolist()) == sorted(want)
            for place, strength in zip(p.tolist(), x.tolist()):
                assert strength == pytest.approx(1.0 if place < 1 << (bits - 1) else min(1.0, 64 * want[place] / (len(w) + 16)))


def test_ftrl_against_dicts():
    rng = np.random.default_rng(1)
    bits, alpha, beta, l1, l2, epochs = 6, 0.5, 1.0, 0.7, 1.0, 3
    examples = [(np.append(rng.choice(64, 6, replace=False), 64), np.append(rng.random(6), 1.0)) for _ in range(60)]
    labels = [int(7 in k) for k, _ in examples]
    z, n = Counter(), Counter()

    def weight(i):
        lam = 0.0 if i == 64 else l1
        return 0.0 if abs(z[i]) <= lam else -(z[i] - math.copysign(lam, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for epoch in range(epochs):
        for e in np.random.default_rng(epoch).permutation(len(examples)):
            k, x = examples[e]
            w = {int(i): weight(int(i)) for i in k}
            p = 1 / (1 + math.exp(-sum(w[int(i)] * v for i, v in zip(k, x))))
            for i, v in zip(k.tolist(), x.tolist()):
                g = (p - labels[e]) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    m = toxicity.ftrl(examples, labels, bits, alpha, beta, l1, l2, epochs)
    got = dict(zip(m.index.tolist(), m.weight.tolist()))
    for i in range(64):
        assert got.get(i, 0.0) == pytest.approx(weight(i), abs=1e-5)
    assert m.bias == pytest.approx(weight(64), abs=1e-9) and 0 < len(got) < 64


def test_toxicity_scores_and_odd_tables(spark):
    long = "calm words only " * 60_000
    rows = [(k, ("vile scum " if k % 4 == 0 else "kind people ") * 5 + f"text {k}") for k in range(200)] + [(300, None), (301, ""), (302, long), (None, "vile scum vile"), (4, "vile scum again"), (4, "vile scum again")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(4, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(d, labels)
    got = toxicity.score_toxicity(d, model, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    weight = dict(zip(model.index.tolist(), model.weight.tolist()))
    for x in got:
        total = model.bias
        if x.text:
            row, place, n = places(x.text, model.bits)
            for p, v in zip(*toxicity.distinct(row, place, n, model.bits)[1:]):
                total += weight.get(int(p), 0.0) * v
        assert x.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)
    assert len({x.score for x in got if x.doc_id == 4 and x.text == "vile scum again"}) == 1
    assert next(x.score for x in got if x.doc_id is None) > 0.5 > next(x.score for x in got if x.doc_id == 302)
    empty = d.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels), ["doc_id"]).count() == 0


def plain_trigrams(text, bits):
    data, seq = text.encode(), []
    letter = lambda b: b >= 128 or 65 <= b <= 90 or 97 <= b <= 122
    for k, b in enumerate(data):
        if letter(b):
            seq.append(b + 32 if 65 <= b <= 90 else b)
        elif k == 0 or letter(data[k - 1]):
            seq.append(32)
    out = []
    for a, b, c in zip(seq, seq[1:], seq[2:]):
        h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        out.append(h >> (32 - bits))
    return out


def test_trigrams_against_plain_version():
    rows = [*TEXTS, None, "ab", "a1b2c3", "  12  "]
    for limit in (8, 1 << 20):
        got = []
        for _, _, data, at in common.chunks(pa.array(rows), limit):
            h, first = language.trigrams(data, at, 14)
            got += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        assert got == [plain_trigrams(x or "", 14) for x in rows]


def test_decoding_against_a_loop_over_codewords(spark):
    rng = random.Random(5)
    voc = {"en": "the and with house".split(), "fr": "être où avec maison".split(), "de": "über straße und haus".split(), "es": "niño casa con está".split(), "it": "perché città della con".split(), "pl": "źdźbło że się dom".split()}
    rows = [(k, " ".join(rng.choices(voc[n], k=20)), n) for k in range(240) for n in [list(voc)[k % 6]]] + [(900, None, "en"), (901, "??", None), (902, "the " * 100_000, None), (3, rows_text := "the house", None), (3, rows_text, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("x"))
    m = language.fit_language(d, F.lit(True))
    got = language.identify(d, m, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for x in got:
        grams = Counter(plain_trigrams(x.text or "", m.places))
        if not any(c.isalpha() for c in x.text or ""):
            assert (x.lang_pred, x.score, x.ambiguous) == ("und", 0.0, False)
            continue
        size = math.sqrt(sum(grams.values()))
        out = [m.bias[b] + sum(math.sqrt(n) * float(m.weights[p, b]) for p, n in grams.items()) / size for b in range(m.code.shape[1])]
        loss = [sum(t * math.log1p(math.exp(-c * o)) for t, c, o in zip(m.trust, word, out)) for word in m.code.tolist()]
        best = min(range(len(loss)), key=loss.__getitem__)
        assert x.lang_pred == m.names[best]
        assert x.score == pytest.approx(1 / sum(math.exp(-m.code.shape[1] * (v - loss[best])) for v in loss), abs=1e-5)
        second = sorted(loss)[1]
        assert x.ambiguous == (second - loss[best] < m.margin) or abs(second - loss[best] - m.margin) < 1e-6
    assert sum(x.lang_pred == rows[x.doc_id][2] for x in got if x.doc_id < 240) >= 240



def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    passage = " ".join(rng.choices(words, k=14))
    rows = [(k, x, "en" if k % 2 else "fr", "s", len(x)) for k, x in enumerate(texts)]
    rows += [(None, texts[0], None, None, None), (5, texts[5], "en", "s", 1), (5, "other text " + texts[7][:90], "en", "s", 1), (70, None, None, None, 0), (71, "", None, None, 0), (72, passage, "en", "s", 3), (73, texts[1] + " end", "en", "s", 3), (74, texts[2] + " " + "vile scum " * 20, "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k == 74)) for k in range(75)], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    clash = docs.withColumn("score", F.lit("x")).withColumn("key", F.lit("y")).withColumn("_h", F.lit("z"))
    for name in list(stage)[:-1]:
        out = stage[name](spark, clash, str(tmp_path))
        assert out.columns == clash.columns
        kept = Counter(tuple(x) for x in out.collect())
        assert all(n <= Counter(tuple(x) for x in clash.collect())[x] for x, n in kept.items()), name
        assert stage[name](spark, clash.limit(0), str(tmp_path)).count() == 0
    kept = stage["near_duplicates"](spark, docs, str(tmp_path))
    ids = Counter((x.doc_id, x.text) for x in kept.collect())
    assert ids[0, texts[0]] == 1 and (None, texts[0]) not in ids and ids[5, texts[5]] == 1 and (73, texts[1] + " end") not in ids
    assert ids[70, None] == ids[71, ""] == 1 and sum(ids.values()) == len(rows) - 4
    clean = {x.doc_id for x in stage["decontamination"](spark, docs, str(tmp_path)).collect()}
    assert 72 not in clean and clean == {x[0] for x in rows} - {72}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert packed and {x.doc_id for x in packed} <= {x[0] for x in rows}
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_toxicity_sample_bounds(spark):
    """Rows equal in id and text teach once; bounds in bytes and of rows of one id thin the sample."""
    rows = [(k, ("awful words " if k % 2 else "kind words ") + f"number{k}") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = lambda docs, **x: toxicity.fit_toxicity(docs, labels, bits=14, l1=0.1, **x)
    one, many = model(d), model(d.unionByName(d).unionByName(d))
    assert one.index.tolist() == many.index.tolist() and one.weight.tolist() == many.weight.tolist() and one.bias == many.bias
    few = model(d, max_bytes=300)
    assert 0 < len(few.index) < len(one.index)
    hot = spark.createDataFrame([(1, f"awful word{k}") for k in range(500)], "doc_id long, text string")
    assert len(model(d.unionByName(hot), max_rows=60).index) < len(model(d.unionByName(hot), max_rows=600).index)
