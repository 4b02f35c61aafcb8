"""Inputs derived from the driver tables: JSON trees, pages, tables, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.joins import parts_of
from docloom.sources.shared import written

#: Lines that one task gathers to orders.
TASK_LINES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_trees(spark: SparkSession, sf_dir: str, texts: int = 1) -> DataFrame:
    """(doc_id, status, priority, rows): one tree per order, its lines in order. Both tables are dealt by order
    over as many tasks as the counted lines make, for so many texts from each tree in the same task."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    parts = parts_of(lines, F.lit(texts), TASK_LINES)
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("qty"))
    lines = lines.withColumnRenamed("l_orderkey", "o_orderkey").repartition(parts, "o_orderkey")
    orders = orders.select("o_orderkey", "o_orderstatus", "o_orderpriority").repartition(parts, "o_orderkey")
    rows = lines.groupBy("o_orderkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(r["l_partkey"].alias("part"), r["qty"].alias("qty"))).alias("rows"))
    empty = F.array().cast("array<struct<part: bigint, qty: int>>")
    return orders.join(rows.hint("shuffle_merge"), "o_orderkey", "left").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.coalesce("rows", empty).alias("rows"))


def shared_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_trees, written: for queries that take several texts from each."""
    return written(order_trees(spark, sf_dir), "trees")


def truth_text() -> Column:
    """The JSON text of a row of order_trees."""
    return F.to_json(F.struct(F.col("doc_id").alias("id"), "status", "priority", "rows"))


def ground_truth(trees: DataFrame) -> DataFrame:
    return trees.select("doc_id", truth_text().alias("json"))


def prediction_text(drop: int, change: int, extra: int) -> Column:
    """truth_text with the priority dropped, the status changed or a field added for every drop-th, change-th and
    extra-th document."""
    k = F.col("doc_id")
    return F.to_json(F.struct(k.alias("id"), F.when(k % change == 0, F.concat("status", F.lit("X"))).otherwise(F.col("status")).alias("status"), F.when(k % drop != 0, F.col("priority")).alias("priority"), "rows", F.when(k % extra == 0, F.lit("extra")).alias("extra")))


def predictions(trees: DataFrame, drop: int = 5, change: int = 7, extra: int = 11, lost: int | None = 13) -> DataFrame:
    """Ground truth with the faults of prediction_text, and every lost-th without a file."""
    if lost:
        trees = trees.filter(F.col("doc_id") % lost != 0)
    return trees.select("doc_id", prediction_text(drop, change, extra).alias("json"))


#: The same leaves built relationally: (doc_id, path, e_value, p_value, kind).
LEAVES_SQL = """
lines AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(trunc(l_quantity) AS INTEGER)) - 1 AS k, l_partkey AS part, CAST(trunc(l_quantity) AS INTEGER) AS qty
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
), e AS (
  SELECT o_orderkey AS doc_id, 'id' AS path, CAST(o_orderkey AS VARCHAR) AS value FROM orders
  UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders
  UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders
  UNION ALL SELECT doc_id, 'rows[' || k || '].part', CAST(part AS VARCHAR) FROM lines
  UNION ALL SELECT doc_id, 'rows[' || k || '].qty', CAST(qty AS VARCHAR) FROM lines
  UNION ALL SELECT o_orderkey, 'rows', '[]' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
)"""
PREDICTED_SQL = """
p{n} AS (
  SELECT doc_id, path, CASE WHEN path = 'status' AND doc_id % {change} = 0 THEN value || 'X' ELSE value END AS value
  FROM e WHERE doc_id % {lost} <> 0 AND NOT (path = 'priority' AND doc_id % {drop} = 0)
  UNION ALL SELECT o_orderkey, 'extra', 'extra' FROM orders WHERE o_orderkey % {extra} = 0 AND o_orderkey % {lost} <> 0
  UNION ALL SELECT o_orderkey, '', '{{}}' FROM orders WHERE o_orderkey % {lost} = 0
)"""
SCORED_SQL = (
    "WITH " + LEAVES_SQL + "," + PREDICTED_SQL.format(n="", drop=5, change=7, extra=11, lost=13) + """, scored AS (
  SELECT doc_id, path, e.value IS NOT NULL AS in_e, p.value IS NOT NULL AS in_p, e.value AS e_value, p.value AS p_value,
    CASE WHEN e.value IS NULL OR p.value IS NULL THEN 0.0 WHEN e.value = p.value THEN 1.0 ELSE 2.0 * length(e.value) / (2 * length(e.value) + 1) END AS score,
    coalesce(e.value = p.value, false) AS exact
  FROM e FULL JOIN p USING (doc_id, path)
), sums AS (
  SELECT doc_id, sum(score) AS score_sum, count(*) FILTER (exact) AS exact_n, count(*) AS union_leaves, count(*) FILTER (in_e AND in_p) AS matched,
    count(*) FILTER (in_e) AS expected_leaves, count(*) FILTER (in_p) AS predicted_leaves, count(*) FILTER (NOT in_p) AS missing_leaves, count(*) FILTER (NOT in_e) AS extra_leaves
  FROM scored GROUP BY doc_id
), metrics AS (
  SELECT *, score_sum / union_leaves AS score, CAST(exact_n AS DOUBLE) / union_leaves AS exact, CAST(matched AS DOUBLE) / predicted_leaves AS key_precision, CAST(matched AS DOUBLE) / expected_leaves AS key_recall,
    CASE WHEN matched = 0 THEN 0.0 ELSE 2.0 * matched / (predicted_leaves + expected_leaves) END AS key_f1
  FROM sums
)"""
)


def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), F.expr("CAST(doc_id DIV 3 AS STRING)"), F.lit("_page"), (F.col("doc_id") % 3).cast("string")).alias("key"))


KEYS_SQL = "keys AS (SELECT doc_id, 'doc' || CAST(doc_id // 3 AS VARCHAR) || '_page' || CAST(doc_id % 3 AS VARCHAR) AS key FROM documents)"


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, label, bbox, content): each line of a text as a layout element."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    label = F.element_at(F.array(*map(F.lit, ("Title", "Text", "Section-header", "Page-header", "Text"))), (F.col("pos") % 5 + 1).cast("int"))
    box = F.array(*[((F.col("doc_id") * a + F.col("pos") * b) % 1000).cast("double") for a, b in ((7, 13), (11, 17), (3, 29), (5, 31))])
    return docs.select("doc_id", "pos", label.alias("label"), box.alias("bbox"), "content")


ELEMENTS_SQL = """elements AS (
  SELECT doc_id, pos - 1 AS pos, ['Title', 'Text', 'Section-header', 'Page-header', 'Text'][CAST((pos - 1) % 5 + 1 AS INTEGER)] AS label,
    (doc_id * 7 + (pos - 1) * 13) % 1000 AS x1, (doc_id * 11 + (pos - 1) * 17) % 1000 AS y1, (doc_id * 3 + (pos - 1) * 29) % 1000 AS x2, (doc_id * 5 + (pos - 1) * 31) % 1000 AS y2, parts[pos] AS content
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
)"""


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, table_html, completion, answer, num_rows, num_cols, num_cells, merged): per
    customer a table of two columns, every third one in a whole page; the completion is equal, has another cell
    text, a wider cell, or no closing tag, by the key modulo 4, and every eleventh says something before it. The
    answer holds the same behind a thought."""
    c = table(spark, sf_dir, "customer")
    cell = lambda x, tag="td": F.concat(F.lit(f"<{tag}>"), x, F.lit("</td>"))
    rows = F.concat(F.lit("<tr>"), cell(F.col("c_custkey").cast("string")), cell(F.col("c_mktsegment")), F.lit("</tr><tr>"), cell(F.lit("nation")), cell(F.col("c_nationkey").cast("string")), F.lit("</tr></table>"))
    good = F.concat(F.lit("<table>"), rows)
    k = F.col("c_custkey") % 4
    bad = F.when(k == 1, F.replace(good, F.lit("nation"), F.lit("region"))).when(k == 2, F.replace(good, F.lit("<td>nation"), F.lit('<td colspan="2">nation'))).when(k == 3, F.replace(good, F.lit("</table>"), F.lit(""))).otherwise(good)
    page = F.concat(F.lit("<html><head><style>table { color: black; }</style></head><body>"), good, F.lit("</body></html>"))
    said = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("Here it is: "), bad)).otherwise(bad)
    return c.select(F.col("c_custkey").alias("sample_id"), F.when(F.col("c_custkey") % 3 == 0, page).otherwise(good).alias("table_html"), said.alias("completion"), F.concat(F.lit("<think>a <table> is asked</think>"), said).alias("answer"), F.lit(2).alias("num_rows"), F.lit(2).alias("num_cols"), F.lit(4).alias("num_cells"), F.lit(False).alias("merged"), (F.col("c_custkey") % 5).alias("prompt_id"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, loss, n, skipped, ts): events as training steps; event_id is the step."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"), (F.col("user_id") % 7 + 1).alias("n"), (F.col("event_type") == "error").alias("skipped"), F.col("event_type").alias("variant"), F.col("user_id"), "ts")
