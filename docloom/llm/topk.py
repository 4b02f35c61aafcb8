"""Exact top-k search by tiled matrix products.

Queries and shards form a grid sized so that what is sent twice is least: every
query tile meets every shard in one cell. A cell holds its tile of queries (at most
`tile` rows), streams its shard in Arrow batches, multiplies block by block, keeps
only the k best per query of each product, and merges them into a running list. The
lists of the shards are then merged in a tree, 32 at a time.

Vectors that are null or hold a null or non-finite component, and rows with a null
vec_id, take no part. Vectors meet only vectors of their length. A query is never
its own candidate: rows with its vec_id are left out. Repeated rows are candidates
of their own; of several query rows with one vec_id the smallest vector asks. Ties
go to the smaller vec_id. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import slots

ROWS, BLOCK = 1024, 4096
NOTHING = np.iinfo(np.int64).min


class Cell:
    """The queries of one cell and their best candidates so far."""

    def __init__(self, k: int):
        self.k, self.parts, self.ready = k, {}, {}

    def ask(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.parts.setdefault(vectors.shape[1], []).append((ids, vectors))

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        dim = vectors.shape[1]
        if dim in self.parts:
            parts = self.parts.pop(dim)
            q = np.concatenate([p[0] for p in parts])
            self.ready[dim] = (q, np.concatenate([p[1] for p in parts]), np.full((len(q), self.k), NOTHING), np.full((len(q), self.k), np.iinfo(np.int64).max))
        if dim not in self.ready:
            return
        q_ids, q, scores, found = self.ready[dim]
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        largest = np.abs(q).max(initial=0) * np.abs(vectors).max(initial=0) * dim
        if largest * BLOCK >= 2**53:  # beyond what doubles hold exactly with the tie rank
            return self._slow(q_ids, q, scores, found, ids, vectors)
        for b in range(0, len(ids), BLOCK):
            d_ids, d = ids[b : b + BLOCK], vectors[b : b + BLOCK]
            rank = np.arange(len(d) - 1, -1, -1, dtype=np.float64)
            for r in range(0, len(q), ROWS):
                rows = slice(r, r + ROWS)
                key = q[rows] @ d.T * BLOCK + rank
                key[q_ids[rows, None] == d_ids[None, :]] = -np.inf
                n = min(self.k, key.shape[1])
                at = np.argpartition(key, -n, axis=1)[:, -n:]
                got = np.take_along_axis(key, at, 1)
                there = np.isfinite(got)
                whole = np.floor(np.where(there, got, 0.0) / BLOCK).astype(np.int64)
                self._merge(scores, found, rows, np.where(there, whole, NOTHING), d_ids[at])

    def _merge(self, scores, found, rows, new_scores, new_ids) -> None:
        s = np.concatenate((scores[rows], new_scores), 1)
        i = np.concatenate((found[rows], new_ids), 1)
        best = np.lexsort((i, ~s), axis=1)[:, : self.k]  # ~s falls as s grows, without overflow
        scores[rows], found[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)

    def _slow(self, q_ids, q, scores, found, ids, vectors) -> None:
        """Whole numbers of any size; what a 64-bit score cannot hold is cut to its ends."""
        whole = np.array([[int(x) for x in v] for v in vectors.tolist()], object).reshape(vectors.shape).T
        for r in range(len(q)):
            own = np.array([int(x) for x in q[r].tolist()], object)
            s = np.array([max(NOTHING + 1, min(-(NOTHING + 1), int(x))) for x in own @ whole], np.int64)
            s[ids == q_ids[r]] = NOTHING
            self._merge(scores, found, slice(r, r + 1), s[None, :], ids[None, :])

    def lists(self):
        for q_ids, _, scores, found in self.ready.values():
            row, col = np.nonzero(scores != NOTHING)
            yield q_ids[row], found[row, col], scores[row, col]


def top_k(vectors: DataFrame, query_rows, k: int = 5, *, scale: float = 256.0, tile: int = 16_384, cells: int | None = None, shard_rows: int = 1_000_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest integer inner
    product for every row where `query_rows` holds. Components become
    floor(scale * component). A shard holds about `shard_rows` candidates at most, however
    many query tiles there are."""
    spark = vectors.sparkSession
    value = F.col("embedding")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value).filter(F.col("vec_id").isNotNull() & value.isNotNull() & (F.size(value) > 0) & ~F.coalesce(bad, F.lit(True)))
    clean = clean.select("vec_id", F.transform(value, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    asked = clean.filter(query_rows)
    n_rows, n_queries = clean.agg(F.count("*"), F.count_if(query_rows)).first()
    cells = cells or slots(spark)
    tiles = max(1, math.ceil(n_queries / tile), round(math.sqrt(cells * 0.02)))
    shards = max(1, math.ceil(cells / tiles), math.ceil(n_rows / shard_rows))
    one = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    to_tiles = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    to_shards = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    left = one.select(F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int").alias("tile"), to_shards.alias("shard"), F.lit(0).alias("part"), "vec_id", "v")
    right = clean.select(to_tiles.alias("tile"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("part"), "vec_id", "v")
    grid = left.unionByName(right).repartition(tiles * shards, "tile", "shard").sortWithinPartitions("tile", "shard", "part")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int32())])

    def run(batches):
        def give(cell, shard):
            for q, v, s in cell.lists():
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s), pa.array(np.full(len(q), shard, np.int32))], schema=schema)

        now, cell = None, None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], 1)
            ids = batch.column(3).to_numpy()
            lists = batch.column(4)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            length = np.diff(offsets)
            cuts = np.flatnonzero((np.diff(place, axis=0) != 0).any(1)) + 1
            for rows in np.split(np.arange(len(ids)), cuts) if len(ids) else []:
                key = tuple(place[rows[0], :2])
                if key != now:
                    if cell is not None:
                        yield from give(cell, now[1])
                    now, cell = key, Cell(k)
                for dim in np.unique(length[rows]):
                    own = rows[length[rows] == dim]
                    block = flat[offsets[own][:, None] + np.arange(dim)]
                    (cell.meet if place[rows[0], 2] else cell.ask)(ids[own], block)
        if cell is not None:
            yield from give(cell, now[1])

    lists = grid.mapInArrow(run, "query_id long, vec_id long, score long, shard int")
    while True:
        last = shards == 1
        by = Window.partitionBy("query_id", *([] if last else ["shard"])).orderBy(F.desc("score"), "vec_id")
        if not last:
            shards = math.ceil(shards / 32)
            lists = lists.withColumn("shard", (F.col("shard") / 32).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        if last:
            return lists.select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every vector whose vec_id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM clean q JOIN clean d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
