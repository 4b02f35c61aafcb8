"""Best-two-fit packing of tokenised documents into fixed-length sequences.

The plan needs only how many pieces there are of each length (at most `capacity`
numbers, whatever the corpus), so it is made for all pieces at once:

- take the longest length left, fill greedily with the longest that still fits,
- then take the smallest piece out again and look for two pieces that fit the
  expanded gap more tightly than it did,
- repeat the bin as often as the counts allow (at least one length runs out, so the
  plan has at most a few thousand distinct bins).

Each piece then finds its bin from its rank among the pieces of its length.

Null texts count as empty: their one piece is the end id alone. Null doc_ids are
kept. Repeated rows are packed as often as they occur. Other columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import give_back, small_batches, staged
from docloom.llm.tokenizing import kept_encoder

PIECE_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Encode texts, append end_id and cut only documents of more than `capacity`
    ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    schema = pa.schema(PIECE_FIELDS + [("ids", pa.list_(pa.int32()))] * with_ids)

    def cut(batches):
        encoder, end = None, np.array([end_id], "<u4")
        for batch in batches:
            encoder = encoder or kept_encoder(tokenizer, remember=400_000, run_bytes=4 << 20)
            keys = batch.column(0).to_pylist()
            for first, ids, ends in encoder.encode(batch.column(1)):
                rows, start = [], 0
                for k, stop in enumerate(ends.tolist(), first):
                    doc = np.concatenate((ids[start:stop].astype("<u4"), end))
                    for p, at in enumerate(range(0, len(doc), capacity)):
                        part = doc[at : at + capacity]
                        row = (keys[k], p, at, len(part), zlib.crc32(part.tobytes()))
                        rows.append((*row, part.astype(np.int32)) if with_ids else row)
                    start = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        del encoder
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins), covering every counted piece."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while left.any():
        items, room, spare = [], capacity, left.copy()
        while room and len(fit := np.flatnonzero(spare[1 : room + 1])):
            length = int(fit[-1]) + 1
            n = min(int(spare[length]), room // length)
            items += [length] * n
            room -= length * n
            spare[length] -= n
        if len(items) > 1 and room:
            smallest, gap = items[-1], room + items[-1]
            spare[smallest] += 1
            have = np.flatnonzero(spare[1 : gap + 1]) + 1
            have = have[have < gap]
            if len(have):
                # the largest partner of each candidate; itself only if there are two
                at = np.searchsorted(have, gap - have, side="right") - 1
                alone = (at >= 0) & (have[at] == have) & (spare[have] < 2)
                at = np.where(alone, at - 1, at)
                total = np.where(at >= 0, have + have[at], 0)
                best = int(total.argmax())
                if total[best] > smallest:
                    items[-1:] = sorted((int(have[best]), int(have[at[best]])), reverse=True)
        need = np.bincount(items, minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        left[used] -= need[used] * times
        plan.append((items, times))
    return plan


class Placing:
    """From (length, rank among the pieces of that length) to (bin, offset)."""

    def __init__(self, plan: list[tuple[list[int], int]], capacity: int):
        rows: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        first, used = 0, [0] * (capacity + 1)
        for items, times in plan:
            offset = 0
            for length in items:
                rows[length].append((used[length], first, offset))
                used[length] += times
                offset += length
            first += times
        self.begin = [np.array([r[0] for r in x], np.int64) for x in rows]
        self.bin = [np.array([r[1] for r in x], np.int64) for x in rows]
        self.offset = [np.array([r[2] for r in x], np.int64) for x in rows]
        self.bins = first

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            n = int(length[part[0]])
            k = np.searchsorted(self.begin[n], rank[part], side="right") - 1
            bins[part] = self.bin[n][k] + rank[part] - self.begin[n][k]
            offsets[part] = self.offset[n][k]
        return bins, offsets


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (read three times, so give a
    table that is written out). Ranks are counted in hash buckets of (length, piece),
    so that a length which a third of all pieces share meets in no single task."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    placing = spark.sparkContext.broadcast(Placing(best_two_fit(counts, capacity), capacity))
    buckets = max(1, sum(counts.values()) // 20_000)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucketed.withColumn("rank", F.row_number().over(inner) - 1).join(sizes.hint("shuffle_merge"), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    kept = [c for c in pieces.columns]
    schema = pieces.schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def place(batches):
        for batch in batches:
            rank = batch.column(len(kept)).to_numpy(zero_copy_only=False)
            bins, offsets = placing.value(batch.column(kept.index("length")).to_numpy(zero_copy_only=False), rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(bins), pa.array(offsets)], names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset."""
    with small_batches(docs.sparkSession):
        pieces = staged(token_pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    return pack(pieces, capacity)


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 word-BPE tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
