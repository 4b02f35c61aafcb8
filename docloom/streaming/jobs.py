"""Structured Streaming forms: file intake, running summaries, resumed logs."""

from __future__ import annotations

import json
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])

#: Fixed value: tasks that look at the files of a micro-batch; Spark's own number is one a file.
LISTING, LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 16
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def incoming_files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder, a bounded number per micro-batch."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    folder, pattern = (f"{sf_dir}/{name}.parquet", None) if _is_folder(spark, f"{sf_dir}/{name}.parquet") else (sf_dir, f"{name}.parquet")
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def finished(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Run the stream over what is there (availableNow) into Parquet files beside the
    checkpoint and read them: append results by the file sink, complete ones as one
    version for each micro-batch, of which the last counts. The files of a micro-batch are looked at by
    LISTING_TASKS tasks: a task for each file would send the driver kilobytes a file."""
    spark, path = stream.sparkSession, f"{checkpoint}-rows"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/v={number}"))
    before = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, LISTING_TASKS)  # sources look at the session that made them
    try:
        writer.start().awaitTermination()
    finally:
        spark.conf.unset(LISTING) if before is None else spark.conf.set(LISTING, before)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return spark.createDataFrame([], stream.schema)
    if mode != "append":
        path += f"/v={max(int(x.getPath().getName()[2:]) for x in files.listStatus(root))}"
    return spark.read.schema(stream.schema).parquet(path)


def running_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Counts and means that are kept up to date while rows arrive."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value"))


def time_windows(rows: DataFrame, ts: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows of event time behind a watermark. In complete mode all windows are kept; in append
    mode each comes out once, when it is closed, and rows for closed windows are dropped (closing_windows
    keeps them)."""
    rows = rows.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", width)).agg(F.count("*").alias("rows"), F.avg(value).alias("mean_value")).select(F.col("window.start").alias("start"), "rows", "mean_value")


def _folders(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    """The complete folders <kind>-<number> below path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(root)] if files.exists(root) else []
    there = {int(n.split("-")[1]): f"{path}/{n}" for n in names if n.startswith(f"{kind}-")}
    return {k: p for k, p in there.items() if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))}


def _dropped(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# ---------------------------------------------------------------- windows that close, late rows kept


def closing_windows(rows: DataFrame, ts: str, value: str, path: str, checkpoint: str, width: str = "1 hour", late: timedelta = timedelta(minutes=10)) -> StreamingQuery:
    """Tumbling windows that close once the largest time seen in earlier micro-batches is `late` beyond their
    end. A row for a closed window goes to the table of rejects, so no count of a closed window
    ever changes. Each micro-batch writes what it holds (sums per window, rejects, and the largest time so far) into
    folders of its number, which a repeated batch replaces; it reads the mark of the batch before only.
    Read by closed_windows and late_rows. Rows without a time are rejects too. Returns the started query."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = _folders(spark, f"{path}/marks", "batch")
        before = max((k for k in marks if k < number), default=None)
        mark = spark.read.parquet(marks[before]).first().mark if before is not None else None
        batch = batch.withColumn("_ts", F.col(ts).cast("timestamp")).persist()
        window = F.window("_ts", width)
        closed = F.lit(False) if mark is None else window["end"] <= F.lit(mark - late)
        # (an expression on a window leaves rows without a time out, so they are taken before)
        late_ones = batch.filter("_ts IS NULL").unionByName(batch.filter(closed).select(*batch.columns))
        late_ones.drop("_ts").write.mode("overwrite").parquet(f"{path}/late/batch-{number}")
        batch.filter("_ts IS NOT NULL").filter(~closed).groupBy(window.alias("w")).agg(F.count("*").alias("rows"), F.sum(F.col(value).cast("double")).alias("total"), F.count(value).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "total", "n").write.mode("overwrite").parquet(f"{path}/parts/batch-{number}")
        batch.agg(F.greatest(F.max("_ts"), F.lit(mark).cast("timestamp")).alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/batch-{number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_windows(spark: SparkSession, path: str, late: timedelta = timedelta(minutes=10)) -> DataFrame:
    """(start, rows, mean_value) of the windows that closing_windows has closed."""
    marks = _folders(spark, f"{path}/marks", "batch")
    mark = spark.read.parquet(marks[max(marks)]).first().mark
    parts = spark.read.parquet(*_folders(spark, f"{path}/parts", "batch").values()).filter(F.col("end") <= F.lit(mark - late))
    return parts.groupBy("start").agg(F.sum("rows").alias("rows"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean_value"))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that closing_windows rejected."""
    return spark.read.parquet(*_folders(spark, f"{path}/late", "batch").values())


def step_windows(rows: DataFrame, step: str, value: str, every: int) -> DataFrame:
    return rows.groupBy(F.floor((F.col(step) - 1) / every).alias("window_id")).agg(F.count("*").alias("steps"), F.avg(value).alias("mean_loss"))


# ---------------------------------------------------------------- first and last writes


def first_seen(rows: DataFrame, key: str) -> DataFrame:
    """The first arrival of each key; later ones are dropped, also after a restart."""
    return rows.dropDuplicates([key])


def latest(rows: DataFrame, key: str, sequence: str, idle: timedelta = timedelta(days=1)) -> DataFrame:
    """Changes of the last row per key (update mode): the state of a key is the highest whole-number sequence it was
    given, and only a row above it comes out, once per micro-batch. A key that is idle for `idle` loses its state;
    a row that comes after that comes out again, which readers that take the highest sequence don't notice.
    Rows without a sequence never come out. The rows of a key are read in chunks, never held at once."""
    given = rows.select(F.col(key).alias("_k"), F.col(sequence).cast("long").alias("_s"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("_r")).filter("_s IS NOT NULL")

    def step(names: tuple, chunks, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        seen, best = (state.get[0] if state.exists else None), None
        for chunk in chunks:
            top = chunk.loc[chunk["_s"].idxmax()]
            if best is None or int(top["_s"]) > best[0]:
                best = (int(top["_s"]), top["_r"])
        state.setTimeoutDuration(int(idle.total_seconds() * 1000))
        if best is not None and (seen is None or best[0] > seen):
            state.update((best[0],))
            yield pd.DataFrame({"_r": [best[1]]})

    changed = given.groupBy("_k").applyInPandasWithState(step, "_r string", "s long", "update", GroupStateTimeout.ProcessingTimeTimeout)
    return changed.select(F.from_json("_r", rows.schema).alias("r")).select("r.*")


def upserting(rows: DataFrame, key: str, sequence: str, path: str, checkpoint: str, merge_every: int = 10) -> StreamingQuery:
    """Last write wins: each micro-batch adds the rows that `latest` lets out as one folder below
    `path` (a repeated batch replaces its folder). Every `merge_every` batches the folders become one base and go, so
    a reader merges few of them however long the stream runs. Read the table by `upserted`. Returns the started
    query."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        if (number + 1) % merge_every == 0:
            upserted(spark, path, key, sequence).write.mode("overwrite").parquet(f"{path}/base-{number}")
            old = [p for k, p in _folders(spark, path, "batch").items() if k <= number] + [p for k, p in _folders(spark, path, "base").items() if k < number]
            _dropped(spark, old)

    conf = rows.sparkSession.conf
    before = conf.get(NO_DATA, "true")
    conf.set(NO_DATA, "false")  # read at the start: else a state with a time limit asks for empty batches for ever
    try:
        return latest(rows, key, sequence).writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(NO_DATA, before)


def last_per_key(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), sequence).alias("_r")).select(key, "_r.*")


def upserted(spark: SparkSession, path: str, key: str, sequence: str) -> DataFrame:
    """The table that `upserting` wrote: the row of the highest sequence of each key, from the
    last base and the batches after it."""
    bases = _folders(spark, path, "base")
    last = max(bases, default=-1)
    parts = [bases[last]] if bases else []
    parts += [p for k, p in _folders(spark, path, "batch").items() if k > last]
    return last_per_key(spark.read.parquet(*parts), key, sequence)


def merged_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the micro-batches whose rows are below path, in a base (by its last batch) or on their own."""
    return [*_folders(spark, path, "base"), *_folders(spark, path, "batch")]


# ---------------------------------------------------------------- counters


def counting_skips(rows: DataFrame, skipped, name: str = "skips") -> DataFrame:
    """Rows that are not skipped; the listener of observation `name` (see BatchCounters) sees the count."""
    return rows.observe(name, F.count_if(skipped).alias("skipped"), F.count("*").alias("rows")).filter(~skipped)


class BatchCounters(StreamingQueryListener):
    """Writes what the observation `name` counted in each micro-batch as one JSON line into a folder of the batch's
    number (a repeated batch replaces it), while the stream runs: register it by spark.streams.addListener."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            line = json.dumps({"query": str(event.progress.id), "batch": event.progress.batchId, **row.asDict()})
            self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{event.progress.id}-{event.progress.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def batch_counters(spark: SparkSession, path: str, counters: list[str], wait: timedelta = timedelta(minutes=1)) -> DataFrame:
    """(query, batch, counters..) that BatchCounters wrote, after all that happened so far was told to it."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(int(wait.total_seconds() * 1000))
    return spark.read.schema("query string, batch long, " + ", ".join(f"{c} long" for c in counters)).option("recursiveFileLookup", "true").json(path)
