"""Joins that choose by counted sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.shared import written

KINDS = ("inner", "left", "left_semi", "left_anti")


def text_bytes(rows: DataFrame) -> int:
    """Bytes of all rows as JSON text: what a side weighs, counted and not estimated."""
    return rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))).first()[0] or 0


def side_join(rows: DataFrame, side: DataFrame, on: list[str], how: str = "left", *, most_bytes: int = 32 << 20, hot_rows: int = 1_000_000) -> DataFrame:
    """rows joined with a side that is mostly small; how is inner, left, left_semi or left_anti.

    The side is written and its bytes are counted. Up to `most_bytes` it is broadcast. Beyond,
    both sides meet in a shuffle; keys with more than `hot_rows` rows (of which there are at most rows / hot_rows)
    are split off: their rows are dealt by their values over as many parts as they fill, and the side's rows of those
    keys are sent to each part. Rows with a null key match nothing and never enter the shuffle. The side's
    repeated keys give a row each, as in any join. Columns other than `on` must differ in name."""
    if how not in KINDS:
        raise ValueError(f"how is one of {', '.join(KINDS)}")
    if clash := set(rows.columns) & set(side.columns) - set(on):
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    side = written(side, "side")
    if text_bytes(side) <= most_bytes:
        return rows.join(F.broadcast(side), on, how)
    keyed: Column = F.lit(True)
    for c in on:
        keyed = keyed & F.col(c).isNotNull()
    counts = written(rows.filter(keyed).groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).withColumn("_parts", F.ceil(F.col("_n") / hot_rows).cast("int")).drop("_n"), "hot-keys")
    given = [F.col(c) for c in rows.columns]
    added = [c for c in side.columns if c not in on] if how in ("inner", "left") else []
    plain = rows.filter(keyed)
    parts = []
    if not counts.isEmpty():
        hot = F.broadcast(counts)  # at most rows / hot_rows keys
        mine = plain.join(hot, on).withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.col("_parts")).cast("int"))
        theirs = side.join(hot, on).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        parts.append(mine.join(theirs.drop("_parts").hint("shuffle_merge"), [*on, "_part"], how).select(*given, *added))
        plain = plain.join(hot, on, "left_anti")
    parts.append(plain.join(side.hint("shuffle_merge"), on, how).select(*given, *added))
    if how in ("left", "left_anti"):
        none = [F.lit(None).cast(side.schema[c].dataType).alias(c) for c in added]
        parts.append(rows.filter(~keyed).select(*given, *none))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parts_of(rows: DataFrame, size: Column, most: int) -> int:
    """How many parts of about `most` of summed size rows make."""
    return max(1, math.ceil((rows.agg(F.sum(size.cast("double"))).first()[0] or 0) / most))


def sized(rows: DataFrame, size: Column, most: int, *keys: str) -> DataFrame:
    """rows dealt by `keys` into parts of about `most` of summed size: the number of parts follows the rows, and
    neither the session's partitions nor the files they are read from."""
    return rows.repartition(parts_of(rows, size, most), *keys)  # without keys: in turn


def cost_spread(rows: DataFrame, cost: Column, most: float) -> DataFrame:
    """rows dealt so that no task is given more than about `most` of summed cost: expensive rows are spread by
    their running cost, not by their number."""
    total = rows.agg(F.sum(cost)).first()[0] or 0
    return rows.repartition(max(1, math.ceil(total / most)), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
