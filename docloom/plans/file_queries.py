"""Queries that write files derived from the driver tables and scan them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import corpus
from docloom.plans import fixtures as fx
from docloom.plans.registry import query
from docloom.sources import readers, sinks
from docloom.sources.shared import shared_folder
from docloom.streaming import jobs


def _image_files(spark, d):
    """A folder with one file per supplier: two of three start like a GIF, by suffix."""
    path = shared_folder(spark, "images")
    k = F.col("s_suppkey")
    suffix = F.element_at(F.array(*map(F.lit, (".gif", ".PNG", ".txt"))), (k % 3 + 1).cast("int"))
    text = F.when(k % 2 == 0, F.concat(F.lit("GIF89a"), "s_name")).otherwise(F.col("s_name"))
    sinks.write_markdown(fx.table(spark, d, "supplier").select(F.concat(k.cast("string"), suffix).alias("out_name"), text.alias("content")), f"{path}/photos")
    return path


IMAGES_SQL = "f AS (SELECT s_suppkey AS k, s_suppkey || ['.gif', '.PNG', '.txt'][CAST(s_suppkey % 3 + 1 AS INTEGER)] AS name, CAST(octet_length(encode(s_name)) + CASE WHEN s_suppkey % 2 = 0 THEN 6 ELSE 0 END AS BIGINT) AS length FROM supplier)"


@query("WITH " + IMAGES_SQL + " SELECT name, length, 'photos' AS label FROM f WHERE k % 3 <> 2")
def image_files(spark, d):
    """Files by suffix in any case, with their folder's name; none is opened."""
    return readers.image_folder(spark, _image_files(spark, d)).select("name", "length", "label")


@query("WITH " + IMAGES_SQL + " SELECT name, CASE WHEN k % 2 = 0 THEN 'decodable' ELSE 'unknown signature' END AS verdict FROM f WHERE k % 3 <> 2")
def image_signatures(spark, d):
    """Files that start like an image, and the others with a reason."""
    good, bad = readers.decodable(readers.files(spark, _image_files(spark, d), content=True))
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return good.select(name, F.lit("decodable").alias("verdict")).unionByName(bad.select(name, F.col("reason").alias("verdict")))


@query("WITH " + IMAGES_SQL + " SELECT name, length FROM f")
def stream_files(spark, d):
    """New files as a stream, a bounded number per micro-batch."""
    path = _image_files(spark, d)
    rows = jobs.incoming_files(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return jobs.finished(rows, "append", shared_folder(spark, "stream"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, s_name AS name, s_suppkey % 7 <> 0 AS valid FROM supplier")
def json_label_files(spark, d):
    """One JSON text per file, some of them broken."""
    path = shared_folder(spark, "labels")
    s = fx.table(spark, d, "supplier")
    text = F.concat(F.to_json(F.struct(F.col("s_name").alias("name"))), F.when(F.col("s_suppkey") % 7 == 0, ",").otherwise(""))
    broken = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("{"), text)).otherwise(text)
    sinks.write_markdown(s.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".json")).alias("out_name"), broken.alias("content")), path)
    back = readers.json_files(spark, path, strict=False)
    return back.select("doc_id", F.regexp_extract("json", r'"name":"([^"]*)"', 1).alias("name"), "valid")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 = 0 THEN 'test' END AS split, CAST(c_nationkey AS INTEGER) AS num_images FROM customer")
def manifest_file(spark, d):
    """A file with one JSON array of objects."""
    path = shared_folder(spark, "manifest")
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "test").alias("split"), F.col("c_nationkey").cast("int").alias("num_images"))
    # as many arrays as partitions: each part file is one array
    sinks.write_arrays(c, path)
    return readers.manifest(spark, path)


@query("SELECT user_id AS \"index\", max(event_id) AS event_id FROM events GROUP BY 1")
def resumed_log(spark, d):
    """JSON lines with broken lines between: the last line of an index wins."""
    path = shared_folder(spark, "log")
    e = fx.table(spark, d, "events").repartitionByRange("event_id").sortWithinPartitions("event_id")
    line = F.to_json(F.struct(F.col("user_id").alias("index"), "event_id"))
    e.select(F.when(F.col("event_id") % 50 == 7, F.concat(line, F.lit("\nnot a record\n{}"))).otherwise(line).alias("value")).write.text(path)
    return readers.prediction_log(spark, path, "index long, event_id long").select("index", "event_id")


@query("SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, kind FROM part, (VALUES ('csv'), ('tsv'), ('jsonl')) AS k (kind)")
def table_files(spark, d):
    """Parts as CSV, TSV and JSON lines, read by suffix."""
    path = shared_folder(spark, "tables")
    p = fx.table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("name"))
    out = None
    for kind in ("csv", "tsv", "jsonl"):
        where = f"{path}/parts.{kind}"
        p.write.json(where) if kind == "jsonl" else p.write.csv(where, header=True, sep="\t" if kind == "tsv" else ",")
        rows = readers.table_file(spark, where).select(F.col("id").cast("bigint").alias("id"), "name", F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT CASE WHEN count(*) OVER (PARTITION BY lower(stem)) > 1 THEN name || '.md' ELSE stem || '.md' END AS file, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM (SELECT stem || CASE WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.png' END AS name, stem, text FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'File' ELSE 'file' END || CAST(doc_id // 3 AS VARCHAR) || CASE WHEN doc_id % 3 = 2 THEN 'c' ELSE '' END AS stem, text FROM documents))")
def markdown_files(spark, d):
    """One Markdown file per document, named by its stem where that is unique."""
    path = shared_folder(spark, "markdown")
    stem = F.concat(F.when(F.col("doc_id") % 4 == 0, "File").otherwise("file"), F.expr("CAST(doc_id DIV 3 AS STRING)"), F.when(F.col("doc_id") % 3 == 2, "c").otherwise(""))
    docs = corpus.output_names(fx.table(spark, d, "documents").select(F.concat(stem, F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".png")).alias("name"), F.col("text").alias("content")))
    files = sinks.write_markdown(docs, path)
    return readers.sizes_of(files.select(F.element_at(F.split("file", "/"), -1)), path)


@query("SELECT round(avg(n_chars), 6) AS mean, count(*) AS documents FROM documents")
def report_files(spark, d):
    """A summary and its documents as JSON lines, read back."""
    path = shared_folder(spark, "report")
    docs = fx.table(spark, d, "documents").select("doc_id", "n_chars")
    sinks.write_report(docs.agg(F.round(F.avg("n_chars"), 6).alias("mean")), docs, path)
    n = spark.read.json(f"{path}/documents").count()
    return spark.read.json(f"{path}/summary").select("mean", F.lit(n).cast("bigint").alias("documents"))


@query("SELECT user_id, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_upserts(spark, d):
    """Last write wins over a stream, kept as one folder per micro-batch."""
    path = shared_folder(spark, "upserts")
    rows = jobs.table_stream(spark, d, "events").select("user_id", "event_id", "value")
    jobs.upserting(rows, "user_id", "event_id", path, shared_folder(spark, "stream")).awaitTermination()
    return jobs.upserted(spark, path, "user_id", "event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'error'")
def stream_kept_rows(spark, d):
    """A stream without the rows that are skipped (and counted for its listener)."""
    rows = jobs.table_stream(spark, d, "events").select("event_id", "event_type")
    return jobs.finished(jobs.counting_skips(rows, F.col("event_type") == "error").select("event_id"), "append", shared_folder(spark, "stream"))


@query("""SELECT kind, id, name FROM (SELECT 'csv' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_partkey AS k FROM part UNION ALL SELECT 'tsv', CAST(p_partkey AS VARCHAR), p_name, p_partkey FROM part
UNION ALL SELECT 'jsonl', CAST(p_partkey AS VARCHAR), p_name, p_partkey FROM part UNION ALL SELECT 'parquet', CAST(p_partkey AS VARCHAR), NULL, p_partkey FROM part UNION ALL SELECT 'txt', NULL, 'line ' || p_name, p_partkey FROM part)
UNION ALL SELECT 'reject', NULL, 'no reader for .md' FROM part WHERE p_partkey <= 3""")
def found_tables(spark, d):
    """A folder of five kinds and some files of none: one listing, columns met by name."""
    path = shared_folder(spark, "found")
    p = fx.table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("name"))
    p.write.csv(f"{path}/a", header=True)
    p.write.option("header", True).option("sep", "\t").option("compression", "none").csv(f"{path}/b")
    p.write.json(f"{path}/c")
    p.select("id").write.parquet(f"{path}/d")
    p.select(F.concat(F.lit("line "), "name").alias("value")).write.text(f"{path}/e")
    sinks.renamed_suffix(spark, f"{path}/b", ".TSV")
    sinks.renamed_suffix(spark, f"{path}/c", ".jsonl")
    sinks.write_markdown(p.filter("id <= 3").select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("out_name"), F.col("name").alias("content")), f"{path}/f")
    rows, rejects = readers.discovered(spark, path)
    return rows.select("kind", F.col("id").cast("string").alias("id"), F.coalesce("name", "value").alias("name")).unionByName(rejects.select(F.lit("reject").alias("kind"), F.lit(None).cast("string").alias("id"), F.col("reason").alias("name")))


@query("""SELECT 'row' AS kind, CAST(user_id AS VARCHAR) AS what, max(event_id) AS n FROM events WHERE event_id % 50 NOT IN (7, 8) GROUP BY user_id
UNION ALL SELECT CASE event_id % 50 WHEN 7 THEN 'not JSON' ELSE 'no index' END, 'lines', count(*) FROM events WHERE event_id % 50 IN (7, 8) GROUP BY 1""")
def log_rejects(spark, d):
    """JSON lines with repeated fields (the last counts), broken ones and some without an index: what is left out is
    counted by reason."""
    path = shared_folder(spark, "log")
    e = fx.table(spark, d, "events").repartitionByRange("event_id").sortWithinPartitions("event_id")
    line = F.concat(F.lit('{"index": 0, "unused": [1, 2], "event_id": -1, "index": '), F.col("user_id").cast("string"), F.lit(', "event_id": '), F.col("event_id").cast("string"), F.lit("}"))
    k = F.col("event_id") % 50
    e.select(F.when(k == 7, F.concat(line, F.lit("}"))).when(k == 8, F.lit('{"event_id": 1}')).otherwise(line).alias("value")).write.text(path)
    rows, rejects = readers.prediction_lines(spark, path, "index long, event_id long")
    return rows.select(F.lit("row").alias("kind"), F.col("index").cast("string").alias("what"), F.col("event_id").alias("n")).unionByName(rejects.groupBy(F.col("reason").alias("kind")).agg(F.lit("lines").alias("what"), F.count("*").alias("n")))


@query("""SELECT 'row' AS kind, doc_id, lang FROM documents WHERE source IS NOT NULL AND n_chars >= 500 UNION ALL
SELECT CASE WHEN source IS NULL THEN 'has a source' ELSE 'is long enough' END, doc_id, NULL FROM documents WHERE source IS NULL OR n_chars < 500""")
def needed_columns(spark, d):
    """Two columns of the rows that pass; the texts are never read."""
    docs = fx.table(spark, d, "documents")
    rows, rejects = readers.needed(docs, ["doc_id", "lang"], "doc_id", {"has a source": F.col("source").isNotNull(), "is long enough": F.col("n_chars") >= 500})
    return rows.select(F.lit("row").alias("kind"), "doc_id", "lang").unionByName(rejects.select(F.col("reason").alias("kind"), "doc_id", F.lit(None).cast("string").alias("lang")))


@query("SELECT split, true AS near_cap FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY split")
def sized_shards(spark, d):
    """Files of a capped size: all of a split but one hold the cap within a tenth."""
    path, cap = shared_folder(spark, "shards"), 200_000
    docs = fx.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "test").alias("split"), F.substring("text", 1, 2000).alias("text"))
    sinks.write_splits(docs, path, row_bytes=F.octet_length("text"), shard_bytes=cap)
    back = spark.read.parquet(path).groupBy("split", F.col("_metadata.file_path").alias("f")).agg(F.sum(F.octet_length("text")).alias("b"))
    return back.groupBy("split").agg((F.count_if(F.abs(F.col("b") - cap) > cap // 10) <= 1).alias("near_cap"))


@query("""SELECT CASE s_suppkey WHEN 1 THEN 'd/one.txt' WHEN 2 THEN 'd/2.txt' WHEN 3 THEN 'moved/3.txt' END AS path, CASE s_suppkey WHEN 1 THEN 'added' WHEN 2 THEN 'removed' WHEN 3 THEN 'renamed' END AS change, CASE WHEN s_suppkey = 3 THEN 'd/3.txt' END AS was FROM supplier WHERE s_suppkey BETWEEN 1 AND 3
UNION ALL SELECT 'd/' || s_suppkey || '.txt', 'changed', NULL FROM supplier WHERE s_suppkey > 3 AND s_suppkey % 5 = 0""")
def revisions(spark, d):
    """Two revisions of a folder named by their content: a file is added, one removed, one renamed, some are
    changed. The older one is found again by its name, and equal folders have one name."""
    old, new, twin, store = (shared_folder(spark, n) for n in ("old", "new", "twin", "store"))
    k = F.col("s_suppkey")
    s = fx.table(spark, d, "supplier").select(k, F.concat(k.cast("string"), F.lit(".txt")).alias("out_name"), F.concat_ws(" ", "s_name", k).alias("content"))
    for path in (old, twin):
        sinks.write_markdown(s.select("out_name", "content"), f"{path}/d")
    sinks.write_markdown(s.filter(~k.isin(2, 3)).select("out_name", F.when((k > 3) & (k % 5 == 0), F.lit("changed")).otherwise(F.col("content")).alias("content")), f"{new}/d")
    sinks.write_markdown(s.filter(k == 1).select(F.lit("one.txt").alias("out_name"), F.lit("added").alias("content")), f"{new}/d")
    sinks.write_markdown(s.filter(k == 3).select("out_name", "content"), f"{new}/moved")
    a, b, c = (readers.commit(spark, path, store) for path in (old, new, twin))
    if a != c or a == b:
        raise ValueError("names do not follow content")
    return readers.manifest_diff(readers.revision(spark, store, a), readers.revision(spark, store, b))


@query("SELECT s_suppkey || '.txt' AS path, CAST(octet_length(encode(s_name)) AS BIGINT) AS bytes FROM supplier")
def pinned_revision(spark, d):
    """A scan pinned by the name of a revision: files that come later are left out."""
    path, store = shared_folder(spark, "pinned"), shared_folder(spark, "store")
    s = fx.table(spark, d, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("out_name"), F.col("s_name").alias("content"))
    sinks.write_markdown(s, path)
    name = readers.commit(spark, path, store)
    sinks.write_markdown(s.select(F.concat(F.lit("later-"), "out_name").alias("out_name"), "content"), path)
    return readers.pinned(spark, path, readers.revision(spark, store, name)).select("path", F.octet_length("content").cast("bigint").alias("bytes"))
