"""Operator 11 against a plain version of its contract."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from docloom.llm import spelling
from docloom.llm.common import TO_LOWER, chunks

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n.x", T.LongType())])


def lowered(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


def plain_counts(docs, damage):
    out = Counter()
    for d, text, *_ in docs:
        for run in map(lowered, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += len(run) >= 6
    return +out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(docs, damage, least=5, times=5):
    n = {w: c for w, c in plain_counts(docs, damage).items() if c >= least}
    around, by_less = defaultdict(set), defaultdict(set)
    for w in n:  # words that are near share a word or a word less a letter
        for k in range(len(w)):
            by_less[w[:k] + w[k + 1 :]].add(w)
        by_less[w].add(w)
    for group in by_less.values():
        for a in group:
            around[a] |= {b for b in group if b != a and near(a, b)}
    form = {}
    for w in n:
        if around[w]:
            best = min(around[w], key=lambda x: (-n[x], x))
            if n[best] >= times * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(around[w]), n[form[w]] if w in form else None))
    return sorted(out)


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def made(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["Straße" * 2, "ÀÿÀÿÀÿ", "x×÷yyy", "a" * 300]
    words = list(base)
    for w in base:
        for _ in range(3):
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "c" + w[k + 1 :]]))
    weights = [rng.choice([1, 1, 8, 60]) for _ in words]
    between = [" ", ", ", "\n", "-", " 7 ", "漢", "ā", "🙂"]
    chain = "chainedx " * 6 + "chained " * 40 + "chaines " * 250 + "chaine " * 1300
    return [(k, "".join(w + rng.choice(between) for w in rng.choices(words, weights, k=rng.choice([0, 5, 400]))), "w", 1) for k in range(n)] + [(n, chain, None, None)]


@pytest.mark.parametrize(("damage", "limits"), [(None, {}), (3, {}), (199, {"cell_words": 8}), (3, {"cell_words": 2, "sample": 40})])
def test_equals_a_plain_version(spark, damage, limits):
    docs = made(5, 60)
    want = plain(docs, damage)
    assert len([r for r in want if r[1]]) > 5 and any(r[1] and r[2] != r[1] for r in want)  # chains too
    assert rows(spelling.variants(spark.createDataFrame(docs, DOCS).repartition(3), damage=damage, **limits)) == want


def test_words_of_equal_letters_are_dealt_over_tiles(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.sample("abcdefgh", 8)) for _ in range(400)} | {"abcdefgx", "abcdefghh"})
    docs = [(0, " ".join(w for w in words for _ in range(5)), None, None)]
    assert rows(spelling.variants(spark.createDataFrame(docs, DOCS), cell_words=4)) == plain(docs, None)


def test_odd_rows(spark):
    docs = [(None, "letters " * 6, None, None), (1, None, "a", 1), (1, "", "a", 1), (2, "letter " * 30, "b", 2), (2, "letter " * 30, "b", 2), (3, "short tiny " * 9, "c", 3), (4, "ab" * 40_000 + " " + ("ba" * 40_000 + " ") * 6, "d", 4)]
    frame = spark.createDataFrame(docs, DOCS)
    for damage in (None, 2):
        assert rows(spelling.variants(frame, damage=damage)) == plain(docs, damage)
    assert rows(spelling.variants(frame.limit(0))) == []


def test_runs_and_checksums():
    texts = ["Aé-b", "", "é", "ÉÀ ÿ", "xé", "éx", "漢é漢", "ā÷z×", "A", "é" * 9]
    for limit in (1, 1 << 20):
        got = []
        for first, _, data, edges in chunks(pa.array(texts), limit):
            data = np.ascontiguousarray(TO_LOWER[data])
            starts, ends, row = spelling.runs(data, edges)
            crc = spelling.crc_on(data, starts, ends, np.array([zlib.crc32(f"{first + r}:".encode()) for r in row], np.uint32))
            got += [(first + r, data[a:b].tobytes().decode(), int(c)) for a, b, r, c in zip(starts, ends, row.tolist(), crc, strict=True)]
        assert got == [(k, lowered(w), zlib.crc32(f"{k}:{lowered(w)}".encode())) for k, t in enumerate(texts) for w in RUN.findall(t)]


def test_reach_finds_every_box_in_range():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 4, (400, spelling.LETTERS)).astype(np.int32) * (np.arange(spelling.LETTERS) < 6)
    tree = spelling.Splits(counts[::3], 20)
    own = np.zeros(len(counts), int)
    for cell, at in tree.reach(counts, 0):
        own[at] = cell
    assert len(set(own.tolist())) == tree.cells > 10
    for radius in (1, 2):
        there = {(cell, k) for cell, at in tree.reach(counts, radius) for k in at.tolist()}
        far = np.abs(counts[:, None] - counts[None]).sum(2)
        assert {(own[j], i) for i, j in zip(*np.nonzero(far <= radius), strict=True)} <= there
        assert len(there) < len(counts) * tree.cells / 2  # boxes are pruned


def test_query_equals_a_plain_version(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(spelling.op11_spelling_tree(spark, d)) == plain(docs, 199)
