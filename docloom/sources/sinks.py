"""Sinks: prediction logs, reports, sharded splits, cards, Markdown, exports."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.sources.shared import written


def write_predictions(rows: DataFrame, path: str, by: str = "variant") -> None:
    """JSON lines, one folder per variant; nulls are written."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(by).json(path)


def write_arrays(rows: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Files that hold one JSON array of objects each, of at most per_file rows."""
    one = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    place = F.monotonically_increasing_id()
    lots = rows.select(one.alias("r"), place.alias("i")).withColumn("lot", F.floor(F.col("i") / per_file))
    texts = lots.groupBy("lot").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value"))
    texts.select("value", "lot").write.partitionBy("lot").text(path)


def report(summary: DataFrame, documents: DataFrame, most: int = 100_000) -> DataFrame:
    """One JSON text {summary, documents[]} of at most `most` documents: more are an
    error, and a matter for write_report."""
    if (n := documents.count()) > most:
        raise ValueError(f"{n} documents in one report; use write_report")
    one, doc = F.struct(*summary.columns), F.struct(*documents.columns)
    none = lambda d, c: F.lit(None).cast(d.select(c).schema[0].dataType)
    rows = summary.select(one.alias("s"), none(documents, doc).alias("d")).unionByName(documents.select(none(summary, one).alias("s"), doc.alias("d")))
    both = rows.agg(F.max("s").alias("summary"), F.array_sort(F.collect_list("d")).alias("documents"))
    return both.select(F.to_json(F.struct("summary", "documents"), {"ignoreNullFields": "false"}).alias("value"))


def write_report(summary: DataFrame, documents: DataFrame, path: str) -> None:
    """A report of any size: documents as JSON lines, the summary beside them."""
    summary.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/summary")
    documents.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/documents")


def write_splits(rows: DataFrame, path: str, split: str = "split", row_bytes: Column | None = None, shard_bytes: int = 2048 << 20) -> None:
    """Parquet per split in files of about shard_bytes; a null split is train.

    With `row_bytes` the bytes before a row, in one order of all rows of its split, decide its file: all files of a
    split but its last hold shard_bytes up to one row. Rows are written once with their running sums; the
    sums of partitions (a row each) give where a partition starts. Without it there is no cap."""
    rows = rows.withColumn(split, F.coalesce(split, F.lit("train")))
    if row_bytes is None:
        rows.write.mode("overwrite").partitionBy(split).parquet(path)
        return
    marked = rows.withColumn("_b", F.coalesce(row_bytes, F.lit(0)).cast("long")).withColumn("_at", F.monotonically_increasing_id())
    placed = written(marked, "sized")
    part = F.shiftright("_at", 33)
    within = F.sum("_b").over(Window.partitionBy(part, split).orderBy("_at"))  # a partition's rows are as many as one task wrote
    each = placed.groupBy(part.alias("_p"), split).agg(F.sum("_b").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(split).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = each.select(F.col("_p"), F.col(split).alias("_split"), before.alias("_start"))
    summed = placed.withColumn("_p", part).withColumn("_upto", within)
    joined = summed.join(F.broadcast(starts), (summed["_p"] == starts["_p"]) & (summed[split] == starts["_split"])).drop(starts["_p"])
    lot = F.floor((F.col("_start") + F.col("_upto") - F.col("_b")) / shard_bytes)
    sizes = {r[0]: r[1] for r in placed.groupBy(split).agg(F.sum("_b")).collect()}  # one row a split
    first, files = {}, 0
    for name in sorted(sizes):
        first[name], files = files, files + max(1, -(-sizes[name] // shard_bytes))
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), F.col(split)) if first else F.lit(0)
    numbered = joined.withColumn("_file", (offset + lot).cast("int")).select(*rows.columns, "_file")
    numbered.repartitionById(max(1, files), "_file").drop("_file").write.mode("overwrite").partitionBy(split).parquet(path)


def split_counts(rows: DataFrame, split: str = "split") -> DataFrame:
    return rows.groupBy(F.coalesce(split, F.lit("train")).alias("split")).agg(F.count("*").alias("rows"))


def card(counts: DataFrame, title: str) -> DataFrame:
    """The counts as a Markdown card with a YAML head; one row per split goes in."""
    lines = F.array_sort(F.collect_list(F.struct("split", "rows")))
    total = F.sum("rows").cast("string")
    yaml = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- split: "), x["split"], F.lit("\n  num_examples: "), x["rows"].cast("string"))), "\n")
    table = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("| "), x["split"], F.lit(" | "), x["rows"].cast("string"), F.lit(" |"))), "\n")
    return counts.agg(F.concat(F.lit("---\nsplits:\n"), yaml, F.lit(f"\n---\n# {title}\n\n| split | rows |\n| --- | --- |\n"), table, F.lit("\n\nTotal rows: "), total).alias("card"))


def write_markdown(docs: DataFrame, path: str) -> DataFrame:
    """One file per document, named by out_name (see corpus.output_names), below a folder
    that pyarrow's file systems reach. A task writes into a hidden folder of its own below it and moves
    whole files out of it (tasks that create files in one folder wait for each other); a repeated one replaces a file by an equal one.
    Returns (file, bytes), written and reread."""

    def write(batches):
        store, root = fs.FileSystem.from_uri(path)
        own = f"{root}/.{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, text in zip(names, batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                with store.open_output_stream(f"{own}/next") as f:
                    f.write(data)
                store.move(f"{own}/next", f"{root}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{n}" for n in names], "bytes": pa.array(sizes, pa.int64())})
        store.delete_dir(own)

    rows = docs.filter(F.col("out_name").isNotNull()).select(F.replace("out_name", F.lit("/"), F.lit("_")).alias("n"), F.col("content").cast("string").alias("c"))
    return written(rows.mapInArrow(write, "file string, bytes long"), "markdown").select("file", "bytes")


def document_export(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """Per document one JSON text: its columns, its pages with their elements in order,
    and whether anything was edited."""
    page = elements.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("pos", "bbox", "label", "content", "included"))).alias("elements"), F.max("edited").alias("edited"))
    pages = page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "elements"))).alias("pages"), F.max("edited").alias("edited"))
    return documents.join(pages.hint("shuffle_merge"), "doc_id", "left").select("doc_id", F.to_json(F.struct(*documents.columns, "pages", F.coalesce("edited", F.lit(False)).alias("edited"))).alias("value"))


def renamed_suffix(spark: SparkSession, path: str, suffix: str) -> None:
    """Give the part files of a written folder another suffix, which Spark's writers choose themselves."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in store.listStatus(root):
        name = f.getPath().getName()
        if name.startswith("part-"):
            store.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(root, name.split(".")[0] + suffix))
