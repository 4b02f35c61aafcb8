"""Scores of generated table HTML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.rows import table_parts
from docloom.functions.text import aligned_similarity, cut_table, edit_similarity
from docloom.operators.joins import sized

#: Text bytes whose tables one task parses.
TASK_BYTES = 1 << 20
#: Format, exact, structure, content, metadata.
WEIGHTS = {"format_reward": 0.25, "exact_reward": 1.0, "structure_reward": 1.0, "content_reward": 1.0, "metadata_reward": 0.5}


def rewards(samples: DataFrame, extra: dict[str, tuple[Callable[..., Column], float]] | None = None, *, cut_answers: bool = False) -> DataFrame:
    """Five rewards and their weighted sum for (sample_id, completion, table_html,
    num_rows, num_cols, num_cells, merged). An answer must be a table and nothing else; with `cut_answers`
    (evaluation) what it says around its table, and its thoughts, do not count. A reference is the
    table in a text that may be a whole page. Samples are dealt over tasks by the counted bytes of their texts. `extra` registers more rewards by name: a
    function of the columns of the samples, by keyword, that returns a column (a pandas
    function's too), and its weight."""
    size = F.coalesce(F.octet_length("completion"), F.lit(0)) + F.coalesce(F.octet_length("table_html"), F.lit(0))
    samples = sized(samples, size, TASK_BYTES)
    answer = cut_table(F.col("completion"), after_last_think=True) if cut_answers else F.col("completion")
    s = samples.withColumn("p", table_parts(answer)).withColumn("r", table_parts(cut_table(F.col("table_html"))))
    p, r = F.col("p"), F.col("r")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    both = p["valid"] & r["valid"]
    meta = sum((one(a == b) for a, b in ((p["num_rows"], F.col("num_rows")), (p["num_cols"], F.col("num_cols")), (p["num_cells"], F.col("num_cells")), (p["merged"], F.col("merged")))), F.lit(0.0)) / 4.0
    s = s.withColumns({
        "format_reward": one(p["valid"]),
        "exact_reward": one(p["valid"] & (p["canonical"] == r["canonical"])),
        "structure_reward": F.when(both, aligned_similarity(p["structure"], r["structure"])).otherwise(0.0),
        "content_reward": F.when(both, aligned_similarity(p["content"], r["content"])).otherwise(0.0),
        "metadata_reward": F.when(p["valid"], meta).otherwise(0.0),
    })
    weights = dict(WEIGHTS)
    for name, (reward, weight) in (extra or {}).items():
        s = s.withColumn(name, reward(**{c: F.col(f"`{c}`") for c in samples.columns}).cast("double"))
        weights[name] = weight
    return s.withColumn("reward", weighted({k: F.col(k) for k in weights}, weights))


def dataset_summary(train: DataFrame, evaluation: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row: rows of both splits, rows whose number of images is not num_images, and
    images, shape and cells of the first training sample by key. That sample must be a
    complete table and have its images, else the job fails."""
    # the first sample is a least struct, not a sorted limit: a projection is moved below a limit, where it would see
    # (and fail on) the first row of every sorted partition
    first = F.min(F.struct(F.col(key).alias("k"), F.size("images").alias("images"), "num_images", "table_html")).alias("f")
    one = train.agg(F.count("*").alias("train_rows"), F.count_if(F.size("images") != F.col("num_images")).alias("inconsistent"), first)
    one = one.withColumn("eval_rows", F.lit(evaluation.count())).withColumn("t", table_parts(cut_table(F.col("f.table_html"))))
    stop = lambda why: F.raise_error(F.lit(why)).cast("int")
    there = F.col("f").isNotNull()
    images = F.when(there & ~F.col("t.valid"), stop("the first reference is no complete table")).when(F.col("f.images") != F.col("f.num_images"), stop("the first sample has not as many images as it says")).otherwise(F.col("f.images"))
    return one.select("train_rows", "inconsistent", "eval_rows", images.alias("sample_images"), F.when(there, F.array("t.num_rows", "t.num_cols")).alias("sample_shape"), F.when(there, F.col("t.num_cells")).alias("sample_cells"))


def weighted(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    return sum((F.lit(weights[k]) * c for k, c in parts.items()), F.lit(0.0))


def advantages(scored: DataFrame, group: str = "prompt_id") -> DataFrame:
    """Reward minus the mean of its group, without scaling."""
    return scored.withColumn("advantage", F.col("reward") - F.avg("reward").over(Window.partitionBy(group)))


def strata(scored: DataFrame, by: str = "merged") -> DataFrame:
    """Count and means overall (level all) and by stratum."""
    sets = scored.withColumn("stratum", F.explode(F.array(F.lit("all"), F.concat(F.lit(f"{by}="), F.col(by).cast("string")))))
    return sets.groupBy("stratum").agg(F.count("*").alias("samples"), F.avg("format_reward").alias("valid_rate"), F.avg("exact_reward").alias("exact_rate"), F.avg("reward").alias("mean_reward"))


def cell_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean agreement of (id, row, col, text, rowspan, colspan) cells joined by place:
    half for equal spans, half for the similarity of texts; a cell of one side is 0."""
    j = left.alias("l").join(right.alias("r").hint("shuffle_merge"), ["id", "row", "col"], "full")
    both = F.col("l.text").isNotNull() & F.col("r.text").isNotNull()
    spans = F.when((F.col("l.rowspan") == F.col("r.rowspan")) & (F.col("l.colspan") == F.col("r.colspan")), 0.5).otherwise(0.0)
    score = F.when(both, spans + 0.5 * edit_similarity(F.col("l.text"), F.col("r.text"))).otherwise(0.0)
    return j.groupBy("id").agg(F.count("*").alias("cells"), F.avg(score).alias("agreement"))
