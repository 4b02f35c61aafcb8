"""JSON documents as leaf tables, and their alignment."""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import once
from docloom.operators.joins import sized
from docloom.sources.shared import written

#: Text bytes that one task parses, or takes apart and groups.
TASK_BYTES = 8 << 20
DUPLICATES = "spark.sql.variant.allowDuplicateKeys"


@contextmanager
def last_key_counts(spark: SparkSession):
    """Of repeated keys the last counts, in what is analysed and run inside. The setting is read again by
    each copy of a plan (a union with itself makes one), so parsed values are written before it ends."""
    before = spark.conf.get(DUPLICATES, "false")
    spark.conf.set(DUPLICATES, "true")
    try:
        yield
    finally:
        spark.conf.set(DUPLICATES, before)


def with_parsed(docs: DataFrame, json: str | Column, name: str) -> DataFrame:
    return docs.withColumn(name, F.try_parse_json(F.col(json) if isinstance(json, str) else json))


def with_strictly_parsed(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """A parser stops after the first value, so the text is parsed as the first item of a list
    that ends with the text's own hash: only where nothing else was read is that the second item."""
    mark = F.sha2(text, 256)
    out = with_parsed(docs, F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), name)
    whole = F.try_variant_get(name, "$[1]", "string") == mark
    return out.withColumn(name, F.when(whole, F.try_variant_get(name, "$[0]", "variant")))


def variants(docs: DataFrame, json: str | Column, name: str = "v") -> DataFrame:
    """Add the parsed value of a JSON text, null where it is none, written. Of repeated keys the
    last counts; what follows a first complete value is not looked at."""
    docs = sized(docs, F.octet_length(json), TASK_BYTES)
    with last_key_counts(docs.sparkSession):
        return written(with_parsed(docs, json, name), "variants")


def strict_values(docs: DataFrame, text: Column, name: str = "v") -> DataFrame:
    """Add the value of a text that is one JSON value and nothing else, null for any other, written.
    Of repeated keys the last counts."""
    docs = sized(docs, F.octet_length(text), TASK_BYTES)
    with last_key_counts(docs.sparkSession):
        return written(with_strictly_parsed(docs, text, name), "variants")


def read_fields(docs: DataFrame, text: Column, fields: dict[str, Callable[[Column], Column]], keep: list[str], strict: bool = False) -> DataFrame:
    """`keep` columns of docs, and of the value of each text what `fields` take from it, written: neither texts nor
    values are dealt or written, rows are read in the tasks that hold them. Of repeated keys the last counts."""
    with last_key_counts(docs.sparkSession):
        parsed = with_strictly_parsed(docs, text, "_v") if strict else with_parsed(docs, text, "_v")
        return written(parsed.select(*keep, *[f(F.col("_v")).alias(name) for name, f in fields.items()]), "fields")


def kind_of(v: Column) -> Column:
    """INT (also beyond 64 bits: 1.0 is a decimal of few digits), REAL, STRING, BOOLEAN,
    VOID, OBJECT or ARRAY."""
    return _kind(F.schema_of_variant(v))


def _kind(t: Column) -> Column:
    return (
        F.when(t == "STRING", t).when(t.startswith("OBJECT<"), "OBJECT").when(t.startswith("ARRAY<"), "ARRAY")
        .when((t == "BIGINT") | t.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "INT").when(t.isin("DOUBLE", "FLOAT") | t.startswith("DECIMAL"), "REAL").otherwise(t)
    )


def leaf_names(v: Column, levels: int = 4) -> Column:
    """A text for each leaf of a value, equal for leaves of equal place, type and value (see leaves) alone: an array in
    the value's own row. It ends with - for empty containers, + for others; what lies below `levels` levels gives a null."""

    def leaf(v: Column) -> Column:
        named = lambda t: F.concat(F.lit("="), t, F.lit(":"), F.coalesce(v.cast("string"), F.lit("")))
        box = lambda t: F.when(v.cast("string").isin("{}", "[]"), F.concat(named(t), F.lit("-")))
        return once(F.schema_of_variant(v), lambda s: once(_kind(s), lambda t: F.when(t.isin("OBJECT", "ARRAY"), box(t)).otherwise(F.concat(named(t), F.lit("+")))))

    def names(v: Column, levels: int) -> Column:
        if not levels:
            return F.array(leaf(v))
        keyed = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(F.concat(F.lit("."), F.length(e["key"]).cast("string"), F.lit(":"), e["key"]).alias("step"), e["value"].alias("v")))
        listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, k: F.struct(F.concat(F.lit("["), k.cast("string"), F.lit("]")).alias("step"), x.alias("v")))
        below = lambda e: F.transform(names(e["v"], levels - 1), lambda n: F.concat(e["step"], n))
        return once(F.coalesce(keyed, listed), lambda inner: F.when(F.size(inner) > 0, F.flatten(F.transform(inner, below))).otherwise(F.array(leaf(v))))

    return F.when(v.isNotNull(), names(v, levels))


def with_depth(docs: DataFrame, json: str, levels: int, name: str = "_depth") -> DataFrame:
    """Add how deep a JSON text nests, levels + 1 for deeper: its brackets outside strings, less the innermost
    pairs until none is left."""
    step = lambda k: f"{name}{k}"
    docs = docs.withColumn(step(0), F.regexp_replace(F.regexp_replace(json, r'(?s)\\.|[^\[\]{}"\\]+', ""), '"[^"]*"', ""))
    for k in range(levels):
        docs = docs.withColumn(step(k + 1), F.regexp_replace(step(k), r"\[\]|\{\}", ""))
    depth = F.lit(levels + 1)
    for k in reversed(range(levels + 1)):
        depth = F.when(F.col(step(k)) == "", k).otherwise(depth)
    return docs.withColumn(name, depth).drop(*map(step, range(levels + 1)))


def parsed_texts(docs: DataFrame, json: str, levels: int = 4) -> DataFrame:
    """docs with the parsed value `v` of each text that has one instead of the text, its bytes `_bytes` and its
    `_depth`, written. Texts are dealt over tasks by their counted bytes."""
    docs = with_depth(sized(docs, F.octet_length(json), TASK_BYTES), json, levels)
    with last_key_counts(docs.sparkSession):
        return written(with_parsed(docs.withColumn("_bytes", F.octet_length(json)), json, "v").filter(F.col("v").isNotNull()).drop(json), "variants")


def dealt_leaves(parsed: DataFrame, keys: list[str], by: list[str], root: str = "", levels: int = 4) -> DataFrame:
    """(keys, at, path, type, value) of the leaves of parsed_texts, dealt by `by` over tasks of about TASK_BYTES
    of text. Values of at most `levels` levels are taken apart where they are dealt to; deeper ones go through written rounds."""
    total, depth = parsed.agg(F.sum("_bytes"), F.max("_depth")).first()
    parts = max(1, math.ceil((total or 0) / TASK_BYTES))
    rows = parsed if (depth or 0) <= levels else parsed.filter(F.col("_depth") <= levels)
    done = shallow_leaves(rows.select(*keys, "v").repartition(parts, *by), keys, root, max(1, min(depth or 0, levels)))
    if (depth or 0) > levels:
        done = done.unionByName(deep_leaves(parsed.filter(F.col("_depth") > levels).select(*keys, "v").repartition(parts, *by), keys, root, levels))
    return done


def leaves(docs: DataFrame, json: str | Column, key: str = "doc_id", *, root: str = "", keep_empty: bool = True, levels: int = 4) -> DataFrame:
    """(key, at, path, type, value): one row per leaf of the JSON text `json`.

    Scalars and nulls are leaves; empty containers are too with `keep_empty`. `at` names
    the leaf's steps without doubt, whatever its keys hold; `path` reads a.b[0] after
    `root`, to be shown. Texts are parsed and written once, and dealt over tasks by their counted bytes. Those of at
    most `levels` levels are taken apart in one chain of variant_explode_outer, which hands leaves through, and their leaves
    are never written or shuffled here. Deeper ones, to no limit but the parser's, go through written rounds of
    `levels` levels until no container is left. Text that is no JSON has no
    leaf; what follows a first complete value is not looked at (see text.json_candidate for
    answers). Null keys and repeated rows are kept as they come."""
    text = F.col(json) if isinstance(json, str) else json
    parsed = parsed_texts(docs.select(F.col(key).alias("_k"), text.alias("_j")), "_j", levels)
    done = dealt_leaves(parsed, ["_k"], [], root, levels).withColumnRenamed("_k", key)
    return done if keep_empty else done.filter(~F.col("type").isin("{}", "[]"))


def _exploded(rows: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """(keys, at, path, type, value, v) after `levels` levels: v is the value that is still to be taken apart, else null."""
    for _ in range(levels):
        inner = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
        item = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))
        step = F.when(F.col("key").isNull(), F.concat("path", item)).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        exact = F.when(F.col("key").isNull(), F.concat("at", item)).otherwise(F.concat("at", F.lit("."), F.length("key").cast("string"), F.lit(":"), "key"))
        there = F.col("value").isNotNull()
        rows = inner.select(*keys, F.when(there, exact).otherwise(F.col("at")).alias("at"), F.when(there, step).otherwise(F.col("path")).alias("path"), F.coalesce("value", "v").alias("v"))
    rows = rows.select(*keys, "at", "path", kind_of(F.col("v")).alias("t"), F.col("v").cast("string").alias("value"), "v")
    box = F.col("t").isin("OBJECT", "ARRAY")
    more = box & ~F.col("value").isin("{}", "[]")
    return rows.select(*keys, "at", "path", F.when(box, F.when(~more, F.col("value"))).otherwise(F.col("t")).alias("type"), F.when(~more, F.col("value")).alias("value"), F.when(more, F.col("v")).alias("v"))


def _start(rows: DataFrame, keys: list[str], root: str) -> DataFrame:
    return rows.select(*keys, F.lit("").alias("at"), F.lit(root).alias("path"), "v")


def shallow_leaves(rows: DataFrame, keys: list[str], root: str = "", levels: int = 4) -> DataFrame:
    """(keys, at, path, type, value) of values (keys, v) of at most `levels` levels. Rows stay in their partitions."""
    return _exploded(_start(rows, keys, root), keys, levels).drop("v")


def deep_leaves(rows: DataFrame, keys: list[str], root: str = "", levels: int = 4) -> DataFrame:
    """(keys, at, path, type, value) of values of any depth, in written rounds of `levels` levels."""
    rows, done = _start(rows, keys, root), None
    while True:
        rows = written(_exploded(rows, keys, levels), "leaves")
        found = rows.filter("v IS NULL").drop("v")
        done = found if done is None else done.unionByName(found)
        rows = rows.filter("v IS NOT NULL").select(*keys, "at", "path", "v")
        if rows.isEmpty():
            return done


def tagged(expected: DataFrame, predicted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Two leaf tables as one; e is 1 on expected leaves, 0 on predicted ones."""
    tag = lambda d, e: d.select(key, "at", "path", "type", "value", F.lit(e).alias("e"))
    return tag(expected, 1).unionByName(tag(predicted, 0))


def aligned(both: DataFrame, key: str = "doc_id") -> DataFrame:
    """Full outer join of the two sides of `both` (see tagged) on (key, at) by one shuffle:
    they are grouped. in_e and in_p tell a null value from a missing one. A leaf of which e is 2 is on both sides."""
    on = lambda e: F.col("e").isin(e, 2)
    side = lambda c, e: F.max(F.when(on(e), F.col(c)))
    return both.groupBy(key, "at").agg(
        F.max("path").alias("path"), (F.count_if(on(1)) > 0).alias("in_e"), (F.count_if(on(0)) > 0).alias("in_p"),
        side("type", 1).alias("e_type"), side("type", 0).alias("p_type"), side("value", 1).alias("e_value"), side("value", 0).alias("p_value"),
    )
