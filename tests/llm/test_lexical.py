"""Operator 12 against a plain scorer and against SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from docloom.llm.lexical import OP12_SQL, Best, Tree, op12_document_trie, parts, ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.StringType())])
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("a.b", T.LongType())])


def words(text):
    return TERM.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def plain(docs, items, k):
    """[(item, rank, doc, score)]"""
    counted = [(d, Counter(words(t))) for d, t, *_ in docs]
    counted = [(d, c) for d, c in counted if c]
    nn, ll = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t, *_ in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in counted:
            m = 50 + 50 * sum(c.values()) * nn // ll
            s = sum(math.floor(1000 * math.log((2 * nn + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def made(rng, n):
    vocabulary = [f"w{k}" for k in range(40)] + ["Élan", "é", "日本", "x1"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 3, 8, 30, 200]))) for _ in range(n)]
    return [(k, t, "s", k) for k, t in enumerate(texts + texts[: n // 3] + [texts[0]] * (n // 3))]


@pytest.mark.parametrize("limits", [{}, {"tree_docs": 7, "tree_entries": 40}, {"block_terms": 20}])
def test_equals_a_plain_scorer(spark, limits):
    rng = random.Random(11)
    docs = made(rng, 120)
    items = [(i, " ".join(rng.choices([f"W{k}" for k in range(45)] + ["élan", "日本"], k=rng.choice([1, 4, 20]))), "r") for i in range(12)]
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    assert rows(ranked_search(frame, spark.createDataFrame(items, ITEMS), 10, **limits)) == plain(docs, items, 10)


def test_odd_rows(spark):
    docs = [(1, None, "a", 1), (None, "one two", "b", 2), (2, "one two", None, None), (2, "one two", None, None), (3, "", "c", 3), (4, "... !", "c", 3), (5, "ONE " * 50_000 + "three", "d", 4)]
    items = [(7, "one"), (7, "three three"), (None, "two"), (8, None), (9, "?!"), (10, "absent")]
    items = [(*i, None) for i in items]
    got = rows(ranked_search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), 3))
    assert got == plain(docs, items, 3)
    assert [r[2] for r in got if r[0] is None] == [2, 2, None]  # equal scores: by doc_id, null last
    some, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)
    assert rows(ranked_search(some, none)) == [] and ranked_search(some, none).columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(ranked_search(some.limit(0), spark.createDataFrame(items, ITEMS))) == []


def test_trie_shares_paths_bounds_hold_and_searches_skip():
    rng = np.random.default_rng(2)
    docs = [np.sort(rng.choice(30, rng.integers(1, 12), replace=False, p=np.arange(30, 0, -1) / 465)) for _ in range(3000)] + [np.arange(5)] * 500
    tf = [rng.integers(1, 40, len(d)) for d in docs]
    at = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    m = rng.integers(50, 400, len(docs))
    tree = Tree(np.concatenate(docs), np.concatenate(tf), at, m, leaf=16)
    w = rng.integers(1, 5000, 30)
    asked = np.array([0, 3, 17, 29])
    right = np.array([sum(parts(np.array([f]), np.array([m[k]]), w[t : t + 1])[0] for t, f in zip(docs[k], tf[k], strict=True) if t in asked) for k in range(len(docs))])

    seen = [0]

    def below(node):
        """Largest score under each child; no bound may be less."""
        seen[0] += 1
        bounds = node.bounds(asked, w[asked])
        if not isinstance(node.below[0], type(tree.root)):
            assert len(node.below) <= 16 and (bounds == right[tree.order[node.below]]).all()
            return int(bounds.max())
        most = [below(c) for c in node.below]
        assert all(b >= x for b, x in zip(bounds.tolist(), most, strict=True))
        return max(most)

    assert below(tree.root) == right.max()
    assert seen[0] < 2 * len(docs) / 16 * 3  # paths are shared
    calls = []
    bounds_of = type(tree.root).bounds
    try:
        type(tree.root).bounds = lambda self, a, x: calls.append(1) or bounds_of(self, a, x)
        best = Best(5)
        best.ids, best.missing = np.arange(len(docs)), np.zeros(len(docs), bool)
        tree.search(asked, w[asked], best)
    finally:
        type(tree.root).bounds = bounds_of
    assert best.docs.tolist() == np.lexsort((np.arange(len(docs)), -right))[:5].tolist()
    assert len(calls) < seen[0] / 2  # half of the tree and more is left out


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{d}/{name}.parquet')")
    assert rows(op12_document_trie(spark, d)) == sorted(con.execute(OP12_SQL).fetchall(), key=str)
