"""Queries that run a stream several times over files that arrive in between."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.plans import fixtures as fx
from docloom.plans.registry import query
from docloom.sources.shared import shared_folder
from docloom.streaming import jobs


def _arriving(spark, rows, batch, n, start):
    """Write the rows of each batch in turn, and after each run the stream that `start` makes of the
    folder (so it goes on from its checkpoint) to its end."""
    folder = shared_folder(spark, "arriving")
    for k in range(n):
        rows.filter(batch == k).write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


#: A tenth of the events comes last, whatever their time; the others by halves of time.
BATCH_SQL = "CASE WHEN event_id % 10 = 0 THEN 2 WHEN ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) THEN 0 ELSE 1 END"


def _batch(e):
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return F.when(F.col("event_id") % 10 == 0, 2).when(F.col("ts") < F.lit(ends.a + (ends.b - ends.a) / 2), 0).otherwise(1)


@query(f"""WITH e AS (SELECT ts, value, {BATCH_SQL} AS b, date_trunc('hour', ts) AS start FROM events), m AS (SELECT max(ts) FILTER (b < 2) - INTERVAL 10 MINUTE AS before, max(ts) - INTERVAL 10 MINUTE AS at_end FROM e)
SELECT start, count(*) FILTER (NOT late) AS rows, round(avg(value) FILTER (NOT late), 6) AS mean_value, count(*) FILTER (late) AS rejected FROM (SELECT *, b = 2 AND start + INTERVAL 1 HOUR <= before AS late FROM e, m) WHERE start + INTERVAL 1 HOUR <= at_end GROUP BY start""")
def stream_closed_windows(spark, d):
    """Three micro-batches: windows that are closed never change; rows that come after are rejects."""
    e = fx.table(spark, d, "events").select("event_id", "ts", "value")
    path, checkpoint = shared_folder(spark, "windows"), shared_folder(spark, "stream")
    _arriving(spark, e, _batch(e), 3, lambda s: jobs.closing_windows(s, "ts", "value", path, checkpoint))
    late = jobs.late_rows(spark, path).groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")["start"].alias("start")).agg(F.count("*").alias("rejected"))
    closed = jobs.closed_windows(spark, path).join(late.hint("shuffle_merge"), "start", "full")
    return closed.select(F.col("start").cast("timestamp_ntz").alias("start"), F.coalesce("rows", F.lit(0)).alias("rows"), F.round("mean_value", 6).alias("mean_value"), F.coalesce("rejected", F.lit(0)).alias("rejected"))


@query("SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) AS value, CAST(3 AS BIGINT) AS batches FROM events GROUP BY user_id")
def stream_latest(spark, d):
    """Three micro-batches of repeated keys, the oldest rows last: the state lets only newer rows out, and
    two batches were merged into a base."""
    e = fx.table(spark, d, "events").select("user_id", "event_id", "value")
    path, checkpoint = shared_folder(spark, "latest"), shared_folder(spark, "stream")
    batch = F.when(F.col("event_id") % 3 == 0, 2).when(F.col("event_id") % 3 == 1, 1).otherwise(0)
    _arriving(spark, e, batch, 3, lambda s: jobs.upserting(s, "user_id", "event_id", path, checkpoint, merge_every=2))
    done = sorted(jobs.merged_batches(spark, path))
    return jobs.upserted(spark, path, "user_id", "event_id").select("user_id", "event_id", "value", F.lit(done[-1] + 1).cast("bigint").alias("batches"))


@query("SELECT CAST(3 AS BIGINT) AS batches, count(*) AS rows, count(*) FILTER (event_type = 'error') AS skipped FROM events")
def stream_live_counters(spark, d):
    """What a listener wrote in each of three micro-batches, added up."""
    e = fx.table(spark, d, "events").select("event_id", "event_type")
    counters, out, checkpoint = shared_folder(spark, "counters"), shared_folder(spark, "kept"), shared_folder(spark, "stream")
    listener = jobs.BatchCounters(spark, "skips", counters)
    spark.streams.addListener(listener)
    try:
        _arriving(spark, e, (F.col("event_id") % 3).cast("int"), 3, lambda s: jobs.counting_skips(s, F.col("event_type") == "error").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        rows = jobs.batch_counters(spark, counters, ["skipped", "rows"])
    finally:
        spark.streams.removeListener(listener)
    return rows.agg(F.count_distinct("batch").alias("batches"), F.sum("rows").alias("rows"), F.sum("skipped").alias("skipped"))
