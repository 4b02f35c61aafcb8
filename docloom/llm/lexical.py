"""Ranked lexical search over tries of documents, by branch and bound.

A document is restricted to the terms of the items; its terms stand in the order of
falling document frequency. Documents of a task, at most `tree_docs` at a time, are sorted
by these term sequences, so that documents that share the beginning of their sequence
share a path of a trie and lie side by side. A node holds, for each term, the largest tf
below it, and the smallest m below it: as a term's part of the score grows with tf and falls
with m, the sum over an item's terms is an upper bound for every document below. An item's
search goes depth first, best bound first, and leaves out what cannot reach its list of
the best `k` so far, which it takes from tree to tree within a task. Bounds are worked out for
all children of a node at once; the children of a last node are documents, whose bounds
are their scores. Lists of tasks are merged in two levels.

The tree splits a node along the trie until every child has at most half of its
documents; small neighbours share a child, and documents with equal sequences are cut by
number. So all nodes of a tree together hold at most log2(tree_docs) entries for each
entry of a document.

Items are taken in blocks of about `block_terms` (item, term) pairs, counted first, which bounds
what is broadcast: one pass over the documents a block. Null texts, and texts without terms,
are no documents. Rows of one item_id are one item with the terms of all; a null
item_id is an item too. Repeated rows of documents are ranked each; equal scores
go by doc_id, a null one last. Items without a document above 0, and empty tables, give no rows.
Other columns, whatever their names, are not read."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import LOWER, MARKS, TO_LOWER, UPPER, appended, chunks, give_back, slots, small_batches, staged, word_spans

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BELOW = np.iinfo(np.int64).max


def parts(tf: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A term's part of the score: grows with tf, falls with m."""
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Node:
    """Entries (child, tf) by term, and m and the subtree of each child; documents have no subtree."""

    def __init__(self, terms: np.ndarray, child: np.ndarray, tf: np.ndarray, m: np.ndarray, below: list):
        order = np.argsort(terms, kind="stable")
        self.child, self.tf, self.m, self.below = child[order], tf[order], m, below
        self.terms, self.at = np.unique(terms[order], return_index=True)
        self.at = np.append(self.at, len(terms))

    def bounds(self, asked: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For every child: the most that a document below can score."""
        k = np.searchsorted(self.terms, asked)
        k[k == len(self.terms)] = 0
        hit = self.terms[k] == asked if len(self.terms) else np.zeros(len(asked), bool)
        k, w = k[hit], w[hit]
        n = self.at[k + 1] - self.at[k]
        ends = np.cumsum(n)
        where = np.repeat(self.at[k] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        child = self.child[where]
        out = np.zeros(len(self.m), np.int64)
        np.add.at(out, child, parts(self.tf[where], self.m[child], np.repeat(w, n)))
        return out


class Tree:
    """The trie of some documents: `terms` and `tf` of all end to end, `at` where each
    starts (one more closes), their m and ids. Terms are numbers in the order of paths."""

    def __init__(self, terms: np.ndarray, tf: np.ndarray, at: np.ndarray, m: np.ndarray, leaf: int = 64):
        path = terms.astype(">u4")
        order = sorted(range(len(m)), key=lambda k: path[at[k] : at[k + 1]].tobytes())
        self.order = np.array(order, np.int64)
        n = np.diff(at)[self.order]
        ends = np.cumsum(n)
        where = np.repeat(at[:-1][self.order] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        self.terms, self.tf, self.at, self.m, self.leaf = terms[where], tf[where], np.concatenate(([0], ends)), m[self.order], leaf
        self.root = self._node(0, len(m))

    def _split(self, lo: int, hi: int) -> list[int]:
        """Ends of the children of the documents lo to hi."""
        most = max(self.leaf, (hi - lo) // 2)
        out, todo = [], [(lo, hi, 0)]
        while todo:
            a, b, depth = todo.pop()
            if b - a <= most:
                out.append(b)
                continue
            # go down the path that all of them share
            start, size = self.at[a:b], np.diff(self.at[a : b + 1])
            while True:
                there = size > depth
                step = np.where(there, self.terms[np.minimum(start + depth, len(self.terms) - 1)], -1)
                cut = np.flatnonzero(np.diff(step)) + 1
                if len(cut) or step[0] < 0:
                    break
                depth += 1
            if not len(cut):  # equal paths
                cut = np.arange(most, b - a, most)
            edges = [a, *(a + cut).tolist(), b]
            todo += [(x, y, depth + 1) for x, y in zip(edges[-2::-1], edges[:0:-1], strict=True)]
        packed, first = [], lo
        for k, end in enumerate(out):  # small neighbours share a child
            if k + 1 == len(out) or out[k + 1] - first > self.leaf:
                packed.append(end)
                first = end
        return packed

    def _node(self, lo: int, hi: int) -> Node:
        own = slice(self.at[lo], self.at[hi])
        if hi - lo <= self.leaf:
            child = np.repeat(np.arange(hi - lo), np.diff(self.at[lo : hi + 1]))
            return Node(self.terms[own], child, self.tf[own], self.m[lo:hi], list(range(lo, hi)))
        ends = self._split(lo, hi)
        starts = [lo, *ends[:-1]]
        child = np.repeat(np.arange(len(ends)), np.diff(self.at[[*starts, hi]]))
        key = child * (int(self.terms[own].max(initial=0)) + 1) + self.terms[own]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        most = np.maximum.reduceat(self.tf[own][order], first) if len(first) else np.empty(0, np.int64)
        least = np.minimum.reduceat(self.m[lo:hi], np.array(starts) - lo)
        return Node(self.terms[own][order][first], child[order][first], most, least, [self._node(a, b) for a, b in zip(starts, ends, strict=True)])

    def search(self, asked: np.ndarray, w: np.ndarray, found: Best) -> None:
        todo = [(self.root, BELOW)]
        while todo:
            node, bound = todo.pop()
            if bound < found.least:
                continue
            bounds = node.bounds(asked, w)
            if node.below and not isinstance(node.below[0], Node):
                keep = np.flatnonzero((bounds > 0) & (bounds >= found.least))
                if len(keep):
                    found.take(bounds[keep], self.order[node.below[0] + keep])
                continue
            for c in np.argsort(bounds, kind="stable").tolist():  # the best is taken first
                if bounds[c] > 0 and bounds[c] >= found.least:
                    todo.append((node.below[c], int(bounds[c])))


class Best:
    """An item's k best documents so far, in order; `ids` names the documents of the tree at hand."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.docs, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.ids, self.missing = self.docs, self.null

    def take(self, scores: np.ndarray, at: np.ndarray) -> None:
        s, d, n = np.concatenate((self.scores, scores)), np.concatenate((self.docs, self.ids[at])), np.concatenate((self.null, self.missing[at]))
        order = np.lexsort((d, n, -s))[: self.k]
        self.scores, self.docs, self.null = s[order], d[order], n[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def vectors(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs): the number of all terms of each document, and its terms
    that are in `words` by their place there, with how often they occur."""
    known = {w: k for k, w in enumerate(words)}
    size = max(1, len(words))

    def count(column: pa.Array):
        totals, at, terms, tfs = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], [], []
        for _, _, data, rows in chunks(column):
            data = TO_LOWER[data]
            starts, ends, first = word_spans(data, rows, MARKS)
            n = np.diff(first)
            edges = np.empty(2 * len(starts) + 1, np.int64)
            edges[:-1:2], edges[1::2], edges[-1] = starts, ends, len(data)
            runs = pa.LargeStringArray.from_buffers(2 * len(starts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
            number = np.fromiter((known.get(t, -1) for t in runs.dictionary.to_pylist()), np.int64, len(runs.dictionary))
            term = number[runs.indices.to_numpy()[::2]] if len(starts) else np.empty(0, np.int64)
            row = np.repeat(np.arange(len(n)), n)
            key, tf = np.unique((row * size + term)[term >= 0], return_counts=True)
            totals.append(n)
            at.append(at[-1][-1] + np.searchsorted(key // size, np.arange(len(n)), side="right"))
            terms.append((key % size).astype(np.int32))
            tfs.append(tf.astype(np.int64))
        where = pa.array(np.concatenate(at), pa.int32())
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return [pa.array(np.concatenate(totals), pa.int64()), pa.ListArray.from_arrays(where, flat(terms, pa.int32())), pa.ListArray.from_arrays(where, flat(tfs, pa.int64()))]

    fields = [("n", "bigint", pa.int64()), ("terms", "array<int>", pa.list_(pa.int32())), ("tfs", "array<bigint>", pa.list_(pa.int64()))]
    return appended(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fields, count, ["doc_id"])


def _searched(found: DataFrame, rank: np.ndarray, weight: np.ndarray, asked: list[np.ndarray], n_docs: int, n_terms: int, k: int, tree_docs: int, tree_entries: int) -> DataFrame:
    """(item, doc_id, score): each task's k best for each of the items in `asked`."""
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        best = [Best(k) for _ in asked]

        def plant(rows: list[pa.RecordBatch]) -> None:
            col = lambda name: pa.concat_arrays([r.column(name) for r in rows])
            ids, n, lists, tfs = col("doc_id"), col("n").to_numpy(), col("terms"), col("tfs").values.to_numpy()
            at = lists.offsets.to_numpy().astype(np.int64)
            path = rank[lists.values.to_numpy()]
            row = np.repeat(np.arange(len(n)), np.diff(at))
            order = np.lexsort((path, row))
            m = np.array([50 + 50 * x * n_docs // n_terms for x in n.tolist()], np.int64)
            tree = Tree(path[order], tfs[order], at - at[0], m)
            missing, docs = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for terms, b in zip(asked, best, strict=True):
                b.ids, b.missing = docs, missing
                tree.search(terms, weight[terms], b)

        held, docs, entries = [], 0, 0
        for batch in batches:
            start = 0
            ends = batch.column("terms").offsets.to_numpy().astype(np.int64)
            while start < batch.num_rows:
                most = int(np.searchsorted(ends, ends[start] + tree_entries - entries, side="right")) - 1
                stop = min(batch.num_rows, start + tree_docs - docs, max(most, start + (not held)))
                if stop > start:
                    part = batch.slice(start, stop - start)
                    # a copy, so that offsets begin at 0
                    held.append(part.take(pa.array(np.arange(stop - start))))
                    docs, entries = docs + stop - start, entries + int(ends[stop] - ends[start])
                start = stop
                if start < batch.num_rows or docs >= tree_docs:
                    plant(held)
                    held, docs, entries = [], 0, 0
        if held:
            plant(held)
        for item, b in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.docs), item, np.int32)), pa.array(b.docs, mask=b.null), pa.array(b.scores)], schema=schema)
        give_back()

    return found.mapInArrow(run, "item int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, *, block_terms: int = 200_000, tree_docs: int = 8192, tree_entries: int = 2_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item.

    A block's terms, items and document frequencies (at most about `block_terms` each; an item of more
    terms is a block of its own) are collected and broadcast; documents never are."""
    spark = docs.sparkSession
    pairs = staged(items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct(), "item-terms")
    blocks = max(1, math.ceil(pairs.count() / block_terms))
    block = F.pmod(F.xxhash64(F.struct("item_id"), F.lit(7)), F.lit(blocks))
    results = []
    for b in range(blocks):
        rows = (pairs.filter(block == b) if blocks > 1 else pairs).toArrow()
        words, number = np.unique(np.array(rows.column("term").to_pylist(), object), return_inverse=True) if rows.num_rows else (np.empty(0, object), np.empty(0, np.int64))
        item = rows.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        item = item.combine_chunks() if isinstance(item, pa.ChunkedArray) else item
        names, of = item.dictionary, item.indices.to_numpy()
        with small_batches(spark):
            found = staged(vectors(docs, words.tolist()).filter("n > 0"), "vectors")
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs or not len(words):
            continue
        df = np.zeros(len(words), np.int64)
        for row in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
            df[row.t] = row.df  # one row a term of the block
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        order = np.argsort(-df, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        asked = [np.sort(rank[number[of == i]]) for i in range(len(names))]
        with small_batches(spark):
            lists = staged(_searched(found.filter(F.size("terms") > 0), rank, weight[order], asked, n_docs, n_terms, k, tree_docs, tree_entries).withColumn("task", F.spark_partition_id()), "lists")
        for by in ([F.pmod("task", F.lit(slots(spark)))], []):
            first = Window.partitionBy("item", *by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            lists = lists.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        known = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(names)), pa.int32()), "item_id": names}))
        results.append(lists.join(F.broadcast(known), "item").select("item_id", "rank", "doc_id", "score"))  # the items of one block
    if not results:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def op12_document_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), kept AS (SELECT doc_id, r, ts, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
size AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM kept),
tf AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS t FROM kept) GROUP BY r, t),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), w AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM q) GROUP BY t), size
), s AS (
  SELECT q.item_id, k.r, k.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + ((50 * k.n * size.nn) // size.ll))))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN kept k USING (r), size
  GROUP BY q.item_id, k.r, k.doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
