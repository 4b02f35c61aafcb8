"""Key-information extraction: leaf scores, document metrics, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.rows import indel_similarity
from docloom.functions.text import collapse_space
from docloom.operators.corpus import numbered
from docloom.operators.joins import parts_of, side_join
from docloom.operators.leaves import aligned, dealt_leaves, leaves, parsed_texts  # noqa: F401
from docloom.sources.shared import written

#: Bytes of expected texts that one task joins with their predictions.
PAIR_BYTES = 32 << 20


def same_number(pairs: DataFrame) -> Column:
    """Equal values; whole numbers are compared digit by digit, never as doubles."""
    e, p = F.col("e_value"), F.col("p_value")
    whole = lambda c, t: F.when(F.col(t) == "INT", c.try_cast("decimal(38,0)")).otherwise(c.try_cast("double").try_cast("decimal(38,0)"))
    both = (F.col("e_type") == "INT") & (F.col("p_type") == "INT")
    near = e.try_cast("double") == p.try_cast("double")
    one = (F.col("e_type") == "INT") | (F.col("p_type") == "INT")
    return F.when(both, e == p).when(one, near & F.coalesce(whole(e, "e_type") == whole(p, "p_type"), F.lit(True))).otherwise(near)


def leaf_exact(pairs: DataFrame) -> Column:
    """Same type (whole and fractional numbers are two) and same value; strings compare
    after white space is collapsed."""
    e, p = F.col("e_value"), F.col("p_value")
    text = collapse_space(e) == collapse_space(p)
    same = F.when(F.col("e_type") == "STRING", text).when(F.col("e_type").isin("INT", "REAL"), same_number(pairs)).otherwise(e.eqNullSafe(p))
    return F.coalesce(F.col("in_e") & F.col("in_p") & (F.col("e_type") == F.col("p_type")) & same, F.lit(False))


def leaf_score(pairs: DataFrame) -> Column:
    """Similarity of strings; numbers by value across whole and fractional; anything
    else 1 if equal; 0 where one side is missing."""
    e, p = F.col("e_value"), F.col("p_value")
    strings = (F.col("e_type") == "STRING") & (F.col("p_type") == "STRING")
    numbers = F.col("e_type").isin("INT", "REAL") & F.col("p_type").isin("INT", "REAL")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    other = lambda c: F.when(strings & (e != p), c)  # a pandas function is given every row: all but different texts go as nulls
    score = F.when(strings, F.when(e == p, 1.0).otherwise(indel_similarity(collapse_space(other(e)), collapse_space(other(p))))).when(numbers, one(same_number(pairs))).when(F.col("e_type") == F.col("p_type"), one(e.eqNullSafe(p))).otherwise(0.0)
    return F.when(F.col("in_e") & F.col("in_p"), F.coalesce(score, F.lit(0.0))).otherwise(0.0)


def with_predictions(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, expected, predicted, missing), written: a document without a prediction gets {}. Both sides are
    dealt by document over as many tasks as the counted bytes of the truth make, and joined once."""
    parts = parts_of(truth, F.octet_length("json"), PAIR_BYTES)
    side = lambda d, name: d.select("doc_id", F.col("json").alias(name)).repartition(parts, "doc_id")
    out = side(truth, "expected").join(side(predicted, "predicted").hint("shuffle_merge"), "doc_id", "left")
    return written(out.select("doc_id", "expected", F.coalesce("predicted", F.lit("{}")).alias("predicted"), F.col("predicted").isNull().alias("missing")), "pairs")


def scored_leaves(pairs: DataFrame) -> DataFrame:
    """Leaves of both texts, of any depth, aligned and scored. Both sides of a document are
    taken apart in one pass, in the partition where they are grouped: texts travel, leaves do not. Texts that are
    equal are one text, taken apart once for both sides."""
    side = lambda e, c: F.struct(F.col("doc_id"), F.lit(e).alias("e"), F.col(c).alias("json"))
    sides = F.when(F.col("expected") == F.col("predicted"), F.array(side(2, "expected"))).otherwise(F.array(side(1, "expected"), side(0, "predicted")))
    both = parsed_texts(pairs.select(F.explode(sides).alias("s")).select("s.*"), "json")
    out = aligned(dealt_leaves(both, ["doc_id", "e"], ["doc_id"]))
    return out.withColumn("score", leaf_score(out)).withColumn("exact", leaf_exact(out))


def document_metrics(scored: DataFrame) -> DataFrame:
    """Per document: score and exact over the union of leaves, key precision, recall, F1."""
    both = F.count_if(F.col("in_e") & F.col("in_p"))
    m = scored.groupBy("doc_id").agg(
        F.sum("score").alias("score_sum"), F.count_if("exact").alias("exact_n"), F.count("*").alias("union_leaves"), both.alias("matched"),
        F.count_if("in_e").alias("expected_leaves"), F.count_if("in_p").alias("predicted_leaves"),
        F.count_if(~F.col("in_p")).alias("missing_leaves"), F.count_if(~F.col("in_e")).alias("extra_leaves"),
    )
    ratio = lambda a, b, none: F.when(F.col(b) == 0, none).otherwise(F.col(a) / F.col(b))
    m = m.withColumn("score", ratio("score_sum", "union_leaves", 1.0)).withColumn("exact", ratio("exact_n", "union_leaves", 1.0)).withColumn("key_precision", ratio("matched", "predicted_leaves", 0.0)).withColumn("key_recall", ratio("matched", "expected_leaves", 0.0))
    total = F.col("key_precision") + F.col("key_recall")
    return m.withColumn("key_f1", F.when(total == 0, 0.0).otherwise(2 * F.col("key_precision") * F.col("key_recall") / total))


def ordered_report(metrics: DataFrame) -> DataFrame:
    """Document metrics in order of their document, with their place in it."""
    return numbered(metrics, "doc_id", "position").orderBy("doc_id")


def with_templates(documents: DataFrame, templates: DataFrame, key: str = "stem") -> DataFrame:
    """Documents with the template of their stem; a missing one is an error naming it."""
    t = templates.select(key, F.col("template").alias("template"), F.lit(True).alias("_there"))
    j = side_join(documents, t, [key])
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("missing template for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("string")).otherwise(F.col("template"))
    return j.withColumn("template", checked).drop("_there")


def corpus_rollup(metrics: DataFrame) -> DataFrame:
    """Macro: mean of documents; micro: sums over leaves."""
    return metrics.agg(
        F.count("*").alias("documents"), F.avg("score").alias("macro_score"), (F.sum("score_sum") / F.sum("union_leaves")).alias("micro_score"),
        F.avg("exact").alias("macro_exact"), (F.sum("exact_n") / F.sum("union_leaves")).alias("micro_exact"), F.avg("key_f1").alias("macro_key_f1"),
    )


def worst_leaves(scored: DataFrame, n: int, width: int = 90) -> DataFrame:
    """The n lowest leaves below 1 of each document, ties by text; values cut to width."""
    show = lambda there, v: F.when(~F.col(there), F.lit("<MISSING>")).otherwise(F.coalesce(F.substring(F.col(v), 1, width), F.lit("null")))
    low = scored.filter(F.col("score") < 1).select("doc_id", "path", "score", show("in_e", "e_value").alias("expected"), show("in_p", "p_value").alias("predicted"))
    order = Window.partitionBy("doc_id").orderBy("score", "path")
    return low.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
