"""Tables written to the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_made: list[list[str]] = []


@contextmanager
def cleared(spark: SparkSession):
    """Deletes at its end the folders that were named inside. Results are read from them, so what is
    wanted of a result must be written or collected inside."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that spark.checkpoint.dir names. Where it is
    unset, a local session (one machine) takes a temporary folder; a cluster raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/docloom-{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


SHREDDING = "spark.sql.variant.writeShredding.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there. Variants are written as they are:
    shredded, a whole number would come back as a fraction where other rows have fractions."""
    path, conf = shared_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(SHREDDING, None)
    conf.set(SHREDDING, "false")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(SHREDDING) if before is None else conf.set(SHREDDING, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
