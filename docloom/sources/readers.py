"""Scans of files: images, documents, JSON labels, manifests, predictions."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.leaves import strict_values
from docloom.sources.shared import written

#: The suffixes of each kind of input.
SUFFIXES = {"images": (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp", ".gif"), "pages": (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp"), "documents": (".pdf", ".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp", ".gif")}
#: How files of each image type start (hexadecimal).
SIGNATURES = {"jpeg": "FFD8FF", "png": "89504E470D0A1A0A", "gif": "47494638", "bmp": "424D", "tiff-le": "49492A00", "tiff-be": "4D4D002A", "riff": "52494646", "pdf": "25504446"}
REASON = T.StructType([T.StructField("id", T.StringType()), T.StructField("split", T.StringType()), T.StructField("num_images", T.IntegerType())])


def files(spark: SparkSession, path: str, kind: str = "images", recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, name, length[, content]) of files with a suffix of that kind in any
    case; listings are in order of path, with `content` rows come as they are read (file
    bytes are not sorted). Without `content` no file is opened."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    df = df.filter(suffix.isin(*SUFFIXES[kind])).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return df.select("path", "name", "length", "content") if content else df.select("path", "name", "length").orderBy("path")


def sizes_of(names: DataFrame, path: str) -> DataFrame:
    """(file, bytes) of the named files (their names are the first column) as they stand in a folder that pyarrow's
    file systems reach. Tasks look at them, so no listing of the folder passes through the driver; one that is missing
    fails the job with its name."""

    def look(batches):
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            found = batch.column(0).to_pylist()
            infos = store.get_file_info([f"{root}/{n}" for n in found])
            for name, info in zip(found, infos, strict=True):
                if info.type != fs.FileType.File:
                    raise FileNotFoundError(f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"file": batch.column(0), "bytes": pa.array([i.size for i in infos], pa.int64())})

    return names.select(F.col(names.columns[0]).cast("string")).distinct().mapInArrow(look, "file string, bytes long")


def decodable(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that start like an image or PDF, and the rejected rest."""
    head = F.hex(F.substring("content", 1, 8))
    known = F.coalesce(F.exists(F.array(*map(F.lit, SIGNATURES.values())), lambda s: F.startswith(head, s)), F.lit(False))
    return images.filter(known), images.filter(~known).select("path", "length", F.lit("unknown signature").alias("reason"))


def json_files(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, doc_id, json, valid): one JSON document per file, a byte order mark
    allowed and keys that repeat. With strict, a file that is no JSON fails the job with its name."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("json"))
    df = strict_values(df.withColumn("doc_id", F.regexp_extract("path", r"([^/]*?)(?:\.json)?$", 1)), F.col("json"), "_v").withColumn("valid", F.col("_v").isNotNull()).drop("_v")
    if strict:
        df = df.withColumn("json", F.when(F.col("valid"), F.col("json")).otherwise(F.raise_error(F.concat(F.lit("invalid JSON in "), "path"))))
    return df


def manifest(spark: SparkSession, path: str, schema: T.StructType | str = REASON) -> DataFrame:
    """A file with one JSON array of objects."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(schema).json(path, multiLine=True).select(*schema.names)


def splits(spark: SparkSession, root: str, split: str, known: tuple[str, ...] = ("train", "validation", "test"), revision: str | None = None) -> DataFrame:
    """Files data/<split>-* of a data set with named splits, of a pinned revision (a
    folder of that name below root) if one is given; another split is an error."""
    root = f"{root}/{revision}" if revision else root
    if split not in known:
        raise ValueError(f"unknown split {split!r}; known: {', '.join(sorted(known))}")
    return spark.read.parquet(f"{root}/data/{split}-*")


def prediction_lines(spark: SparkSession, path: str, schema: str, key: str = "index") -> tuple[DataFrame, DataFrame]:
    """JSON lines of predictions, of which only the fields in `schema` are kept: the last line of
    each key (by file and place in it; of repeated fields the last counts), and the rejected lines
    (file, line, reason): those that are not one JSON value, and those without the key."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n"))
    checked = strict_values(lines, F.col("value"), "_v").withColumn("r", F.from_json("value", schema))
    why = F.when(F.col("_v").isNull(), "not JSON").when(F.col(f"r.{key}").isNull(), f"no {key}")
    checked = checked.withColumn("reason", why).drop("_v")
    rows = checked.filter("reason IS NULL").groupBy(f"r.{key}").agg(F.max_by("r", F.struct("_f", "_b", "_n")).alias("r")).select("r.*")
    return rows, checked.filter("reason IS NOT NULL").select(F.col("_f").alias("file"), F.col("value").alias("line"), "reason")


def prediction_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of prediction_lines; broken lines and lines without an index are skipped."""
    return prediction_lines(spark, path, schema)[0]


def needed(rows: DataFrame, columns: list[str], key: str, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Only the named columns, which is all that a columnar scan then reads, of the rows that pass
    all checks (a check is a column that is true on rows that pass), and the others as (key, reason) with the first
    check that fails."""
    why = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    marked = rows.withColumn("_why", why)
    return marked.filter("_why IS NULL").select(*columns), marked.filter("_why IS NOT NULL").select(key, F.col("_why").alias("reason"))


#: Suffixes of tables.
TABLES = ("csv", "tsv", "json", "jsonl", "ndjson", "txt", "parquet")


def _table_reader(spark: SparkSession, kind: str, glob: str | None = None):
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob) if glob else spark.read
    return {
        "csv": lambda p: reader.csv(p, header=True), "tsv": lambda p: reader.csv(p, header=True, sep="\t"), "json": lambda p: reader.json(p, multiLine=True),
        "jsonl": reader.json, "ndjson": reader.json, "txt": reader.text, "parquet": reader.parquet,
    }[kind]


def table_file(spark: SparkSession, path: str) -> DataFrame:
    """CSV, TSV, JSON, JSON lines, text or Parquet, by suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in TABLES:
        raise ValueError(f"no reader for .{suffix}")
    return _table_reader(spark, suffix)(path)


def discovered(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All tables below a folder as one, and the files that no reader takes (file, reason).

    One listing, of which the driver sees only the kinds that occur; each kind is read with its reader. Columns
    meet by name: a column of one type in all kinds keeps it, else it is text; where a kind lacks it, it
    is null. `file` and `kind` are added; lines of text are in `value`."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("kind"))
    known = F.col("kind").isin(*TABLES)
    kinds = sorted(r.kind for r in listed.filter(known).select("kind").distinct().collect())
    parts = []
    for kind in kinds:
        any_case = "*." + "".join(f"[{c}{c.upper()}]" for c in kind)
        rows = _table_reader(spark, kind, any_case)(path)
        parts.append(rows.select("*", F.col("_metadata.file_path").alias("file"), F.lit(kind).alias("kind")))
    types: dict[str, set[str]] = {}
    for p in parts:
        for f in p.schema:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    out = None
    for p in parts:
        same = p.select(*[F.col(f"`{c}`").cast("string").alias(c) if len(types[c]) > 1 else F.col(f"`{c}`") for c in p.columns])
        out = same if out is None else out.unionByName(same, allowMissingColumns=True)
    none = spark.createDataFrame([], "file string, kind string")
    return none if out is None else out, listed.filter(~known).select(F.col("path").alias("file"), F.concat(F.lit("no reader for ."), "kind").alias("reason"))


# ---------------------------------------------------------------- revisions by content


def _below(path: str) -> Column:
    """A file's path below that folder."""
    root = path.split("://", 1)[-1].split(":", 1)[-1].rstrip("/") + "/"
    return F.substring("path", F.instr("path", F.lit(root)) + len(root), F.length("path"))


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a folder, paths below it, written: the
    files are read once."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return written(found.select(_below(path).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")), "manifest")


def revision_name(manifest: DataFrame) -> str:
    """The root of a hash tree over the files in order of their path: equal folders have
    equal names wherever they are. Files are hashed together by four digits of their path's own
    hash, those by two, and the 256 that are left by the driver."""
    at = F.sha2("path", 256)
    level = manifest.select(F.substring(at, 1, 4).alias("k"), F.concat_ws(" ", at, "bytes", "sha256").alias("x"))
    for digits in (2, 0):
        level = level.groupBy("k").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256).alias("h"))
        level = level.select(F.substring("k", 1, digits).alias("k"), F.concat_ws(" ", "k", "h").alias("x"))
    return hashlib.sha256("\n".join(sorted(r.x for r in level.collect())).encode()).hexdigest()


def commit(spark: SparkSession, path: str, store: str) -> str:
    """Keep the manifest of a folder in the store under the revision's name, which is returned."""
    manifest = manifest_of(spark, path)
    name = revision_name(manifest)
    manifest.write.mode("overwrite").parquet(f"{store}/{name}")
    return name


def revision(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The manifest of that name; one that was altered is an error."""
    manifest = spark.read.parquet(f"{store}/{name}")
    if (found := revision_name(manifest)) != name:
        raise ValueError(f"revision {name} holds {found}")
    return manifest


def pinned(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(path, content) of the files of a revision as they stand below a folder; later files are left
    out, and one that is missing or changed fails the job with its name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files_now = found.select(_below(path).alias("path"), "content", F.sha2("content", 256).alias("_now"))
    both = manifest.select("path", "sha256").join(files_now.hint("shuffle_merge"), "path", "left")
    off = F.raise_error(F.concat(F.lit("not as in its revision: "), "path")).cast("binary")
    return both.select("path", F.when(F.col("_now").eqNullSafe(F.col("sha256")), F.col("content")).otherwise(off).alias("content"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, was) from two manifests alone: added, removed, changed, and renamed
    where a content left exactly one path and came to exactly one other (`was` is the old path)."""
    of = lambda c, e: F.max(F.when(F.col("e") == e, F.col(c)))
    tag = lambda d, e: d.select("path", "sha256", F.lit(e).alias("e"))
    both = tag(old, 1).unionByName(tag(new, 2)).groupBy("path").agg(F.bit_or("e").alias("e"), of("sha256", 1).alias("a"), of("sha256", 2).alias("b"))
    moved = written(both.filter(F.col("e").isin(1, 2) | (F.col("a") != F.col("b"))), "changes")
    ends = moved.filter("e <> 3").groupBy(F.coalesce("a", "b").alias("h")).agg(F.count_if(F.col("e") == 1).alias("n1"), F.count_if(F.col("e") == 2).alias("n2"), F.max(F.when(F.col("e") == 1, F.col("path"))).alias("was"), F.max(F.when(F.col("e") == 2, F.col("path"))).alias("now"))
    renamed = ends.filter("n1 = 1 AND n2 = 1").select("was", "now")
    names = renamed.select(F.explode(F.array("was", "now")).alias("path"))
    rest = moved.join(names.hint("shuffle_merge"), "path", "left_anti").select("path", F.when(F.col("e") == 2, "added").when(F.col("e") == 1, "removed").otherwise("changed").alias("change"), F.lit(None).cast("string").alias("was"))
    return rest.unionByName(renamed.select(F.col("now").alias("path"), F.lit("renamed").alias("change"), "was"))


def image_folder(spark: SparkSession, path: str) -> DataFrame:
    """Images with their folder's name as label."""
    return files(spark, path).withColumn("label", F.element_at(F.split("path", "/"), -2))
