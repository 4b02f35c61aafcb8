"""Two-pass external shuffle into shards of equal counts, in DataFrame operations.

Pass one counts records per bucket; a seeded hash scatters records uniformly over so
many buckets that one fits in a task's memory. Pass two moves each record once, to
its bucket, and gives the bucket a Fisher-Yates permutation (the `shuffle` function
over its places). Buckets end to end are one random order of all records; shard s
is the s-th run of it, so counts differ by one at most (the `rows` law).

Null texts have no bytes and crc32 0; null doc_ids are records like others. Repeated
rows are placed one by one; buckets are dealt by id and text, so rows of one id (or of
none) spread out, and only rows equal in both share a bucket. Columns of any name are kept
inside the struct `record`. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import shared_dir, slots, staged


def placed(records: DataFrame, *, seed: int = 1, bucket_bytes: int = 8 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """(record, bucket, rank, begin, order): each record's bucket and rank there (from 1),
    where the bucket begins and its permutation of places (from 0)."""
    spark = records.sparkSession
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1
    total = records.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(total / bucket_bytes))
    tasks = max(slots(spark), math.ceil(total / task_bytes))
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), crc, F.octet_length(F.col("text").cast("string"))), F.lit(buckets)).cast("int")
    row = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record"), bucket.alias("bucket"), F.col("doc_id").alias("_key"), crc.alias("_crc"))
    # Pass one: sizes, where each bucket starts (one row per bucket), and its permutation.
    counts = row.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    order = starts.repartition(min(buckets, tasks), "bucket").sortWithinPartitions("bucket").select("bucket", "begin", F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(seed)).alias("order"))
    order = staged(order, "order")  # a permutation must not be drawn twice
    # Pass two: each record to its bucket, and to its place there.
    inside = Window.partitionBy("bucket").orderBy("_key", "_crc")
    ranked = row.repartition(tasks, "bucket").withColumn("rank", F.row_number().over(inside))
    return ranked.join(order.hint("shuffle_merge"), "bucket").select("record", "bucket", "rank", "begin", "order")


def shuffled(records: DataFrame, shards: int, *, seed: int = 1, bucket_bytes: int = 8 << 20) -> DataFrame:
    """(record, shard, slot): all records in shuffled shards, each bucket's rows
    together and in order."""
    rows = placed(records, seed=seed, bucket_bytes=bucket_bytes)
    base, extra = divmod(records.count(), shards)
    at, cut = F.col("begin") + F.element_at("order", F.col("rank")), extra * (base + 1)
    shard = F.when(at < cut, F.floor(at / F.lit(base + 1))).otherwise(F.lit(extra) + F.floor((at - cut) / F.lit(max(base, 1)))).cast("int")
    slot = F.when(at < cut, at % F.lit(base + 1)).otherwise((at - cut) % F.lit(max(base, 1))).cast("long")
    return rows.select("record", shard.alias("shard"), slot.alias("slot"))


def write_shards(records: DataFrame, shards: int, path: str, *, seed: int = 1, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Write shuffled shards as Parquet folders shard=0, 1, ... and read them back;
    within a file rows are in slot order."""
    out = shuffled(records, shards, seed=seed, bucket_bytes=bucket_bytes)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return records.sparkSession.read.schema(out.schema).parquet(path)


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shuffled shards, read back from the written files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return write_shards(docs, 16, shared_dir(spark, "shards")).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
