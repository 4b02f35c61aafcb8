"""Queries of corpus preparation: joins by counted sizes, profiles, the curator, records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as t
from docloom.operators import corpus, joins, kie, layout, table_html
from docloom.plans import fixtures as fx
from docloom.plans.registry import query

JOINED_SQL = "SELECT l_orderkey AS id, l_linenumber AS line, CAST({k} AS VARCHAR) AS key, {name} AS name FROM lineitem LEFT JOIN nation ON {k} = n_nationkey"


def _lines(spark, d, key):
    side = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), key.alias("key")), side


@query(JOINED_SQL.format(k="l_suppkey % 40", name="n_name"))
def small_side(spark, d):
    """A side of few bytes is broadcast."""
    out = joins.side_join(*_lines(spark, d, F.col("l_suppkey") % 40), ["key"])
    return out.withColumn("key", F.col("key").cast("string"))


@query(JOINED_SQL.format(k="CASE WHEN l_orderkey % 3 = 0 THEN 7 WHEN l_orderkey % 7 = 1 THEN NULL ELSE l_suppkey % 40 END", name="n_name"))
def large_side(spark, d):
    """A side that counts as too large to broadcast: a key with a third of all rows is dealt over
    parts, null keys stay out of the shuffle."""
    key = F.when(F.col("l_orderkey") % 3 == 0, 7).when(F.col("l_orderkey") % 7 == 1, None).otherwise(F.col("l_suppkey") % 40).cast("bigint")
    rows, side = _lines(spark, d, key)
    out = joins.side_join(rows, side, ["key"], most_bytes=0, hot_rows=max(100, rows.count() // 16))
    return out.withColumn("key", F.col("key").cast("string"))


@query("SELECT l_orderkey AS id, l_linenumber AS line FROM lineitem WHERE l_suppkey % 40 NOT IN (SELECT n_nationkey FROM nation)")
def without_partner(spark, d):
    rows, side = _lines(spark, d, F.col("l_suppkey") % 40)
    return joins.side_join(rows, side.select("key"), ["key"], "left_anti", most_bytes=0, hot_rows=1000).select("id", "line")


@query("""WITH u AS (SELECT 'event_id' AS name, count(*) AS rows, count(*) FILTER (event_id IS NULL) AS nulls, CAST(min(event_id) AS DOUBLE) AS least, CAST(max(event_id) AS DOUBLE) AS greatest FROM events
UNION ALL SELECT 'user_id', count(*), count(*) FILTER (user_id IS NULL), CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE) FROM events UNION ALL SELECT 'value', count(*), count(*) FILTER (value IS NULL), CAST(min(value) AS DOUBLE), CAST(max(value) AS DOUBLE) FROM events
UNION ALL SELECT 'event_type', count(*), count(*) FILTER (event_type IS NULL), NULL, NULL FROM events)
SELECT name, rows, nulls, least, greatest, true AS distinct_close, true AS quantiles_close FROM u""")
def merged_profiles(spark, d):
    """Profiles of seven parts of the events, put together from their sketches: counts and ends are exact, the distinct
    values within 5 % of the true number, and each quartile within 3 % of its rank."""
    e = fx.table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    parts = corpus.column_sketches(e, [(F.col("event_id") % 7).alias("part")])
    p = corpus.read_sketches(corpus.merged_sketches(parts))
    numbers = ("event_id", "user_id", "value")
    exact = e.agg(*[F.count_distinct(c).alias(c) for c in e.columns]).first()
    cuts = {r.name: r.quantiles for r in p.collect() if r.name in numbers}  # one row a column
    ranks = e.agg(*[F.array(*[F.struct(F.avg((F.col(c) < q).cast("double")).alias("a"), F.avg((F.col(c) <= q).cast("double")).alias("b")) for q in cuts[c]]).alias(c) for c in numbers]).first()
    near = lambda c: all(x.a - 0.03 <= r <= x.b + 0.03 for x, r in zip(ranks[c], (0.25, 0.5, 0.75), strict=True))
    true = lambda f: F.element_at(F.create_map(*[F.lit(x) for c in e.columns for x in (c, f(c))]), F.col("name"))
    ends = [F.when(F.col("name") != "event_type", F.col(c)).try_cast("double").alias(c) for c in ("least", "greatest")]
    return p.select("name", "rows", "nulls", *ends, (F.abs(F.col("distinct") - true(lambda c: exact[c])) <= 0.05 * true(lambda c: exact[c])).alias("distinct_close"), true(lambda c: c not in numbers or near(c)).alias("quantiles_close"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, left(text, 80) AS text FROM (SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT 20)")
def table_preview(spark, d):
    """The first rows with values cut to be shown: a bounded preview is the feature."""
    return corpus.preview(fx.table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id")


BLANKS = f"[{t.SPACE}]"
CURATED_SQL = "WITH " + fx.KEYS_SQL + f""", c AS (SELECT key, text, trim(regexp_replace(text, '{BLANKS}+', ' ', 'g')) AS clean, CASE WHEN length(text) > 50 THEN left(text, length(text) - 50) ELSE '' END AS cut, regexp_replace(key, '_page[0-9]+$', '') AS document_id FROM keys JOIN documents USING (doc_id)),
r AS (SELECT *, CASE WHEN clean = '' THEN 'empty' WHEN len(list_filter(range(1, least(250, length(text)) + 1), lambda n: suffix(text, repeat(right(text, CAST(n AS INTEGER)), CAST(floor(4 * (1 + 3.0 / n)) AS INTEGER) + 1)))) + len(list_filter(range(1, least(250, length(cut)) + 1), lambda n: suffix(cut, repeat(right(cut, CAST(n AS INTEGER)), CAST(floor(4 * (1 + 3.0 / n)) AS INTEGER) + 1)))) > 0 THEN 'degenerate' END AS why FROM c),
k AS (SELECT *, CASE WHEN why IS NULL AND key <> min(key) FILTER (why IS NULL) OVER (PARTITION BY clean) THEN 'copy' ELSE why END AS reason FROM r)"""


@query(CURATED_SQL + " SELECT key, document_id, CAST(regexp_extract(key, '([0-9]+)$', 1) AS INTEGER) AS page, reason IS NULL AS kept, reason FROM k")
def curated_pages(spark, d):
    """Documents as pages: cleaned, without degenerate ones and copies, grouped and split."""
    rows = fx.page_keys(spark, d).join(fx.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return corpus.curated(rows, "key", "text").select("key", "document_id", "page", "kept", "reason")


@query(CURATED_SQL + " SELECT document_id, count(*) AS pages, array_to_string(list(key ORDER BY CAST(regexp_extract(key, '([0-9]+)$', 1) AS INTEGER)) FILTER (reason IS NULL), ',') AS kept_keys FROM k GROUP BY 1")
def curated_groups(spark, d):
    rows = fx.page_keys(spark, d).join(fx.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    out = corpus.groups_of(corpus.curated(rows, "key", "text"))
    return out.select("document_id", "pages", F.when(F.size("kept_keys") > 0, F.array_join("kept_keys", ",")).alias("kept_keys"))


@query("SELECT c_custkey AS id, 'user' AS role, 'Read this table: ' || c_mktsegment AS content FROM customer")
def prompt_records(spark, d):
    """Records that hold the prompt alone."""
    c = fx.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.inline(corpus.prompt_record(F.concat(F.lit("Read this table: "), "c_mktsegment"))))


@query("SELECT c_custkey AS id, c_custkey % 9 <> 0 AS good, c_custkey % 9 = 0 AS replaced, true AS used_is_good FROM customer")
def substitutes_by_tries(spark, d):
    """Every ninth row is bad: ten seeded tries find it a good one."""
    rows = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    out = corpus.with_tries(rows, F.col("id") % 9 != 0, "id", 7)
    return out.select("id", (F.col("id") % 9 != 0).alias("good"), (F.col("used_key") != F.col("id")).alias("replaced"), (F.col("used_key") % 9 != 0).alias("used_is_good"))


@query("SELECT c_custkey AS id, round(1 - levenshtein(c_name, b) / CAST(greatest(length(c_name), length(b)) AS DOUBLE), 6) AS similarity FROM (SELECT c_custkey, c_name, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS b FROM customer)")
def short_similarities(spark, d):
    """Edit similarity of short texts of ASCII."""
    b = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(""))
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(t.edit_similarity(F.col("c_name"), b), 6).alias("similarity"))


@query("""SELECT o_orderkey AS id, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i <= 4 OR i > len(ids) - o_orderkey % 3 THEN -100 ELSE ids[i] END)::VARCHAR AS labels
FROM (SELECT o_orderkey, [5, 6, 5, 6, 10 + o_orderkey % 9, 7, 2] || CASE o_orderkey % 3 WHEN 0 THEN CAST([] AS BIGINT[]) WHEN 1 THEN [0] ELSE [0, 0] END AS ids FROM orders)""")
def labels_after_marker(spark, d):
    """Only what follows the last marker (5, 6) is learnt from, and no padding."""
    k = F.col("o_orderkey")
    pad = F.slice(F.array(F.lit(0), F.lit(0)), F.lit(1), (k % 3).cast("int"))
    rows = fx.table(spark, d, "orders").select(k.alias("id"), F.concat(F.array(*[F.lit(x) for x in (5, 6, 5, 6)], (10 + k % 9).cast("int"), F.lit(7), F.lit(2)), pad).alias("ids"))
    mask = F.transform("ids", lambda x: F.when(x == 0, 0).otherwise(1))
    labels = t.assistant_labels(F.col("ids"), mask, F.array(F.lit(5), F.lit(6)), 2)
    return rows.select("id", labels.cast("string").alias("labels"))


@query("SELECT o_orderkey AS doc_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE 1.0 END AS score FROM orders")
def report_in_order(spark, d):
    """Document metrics with their place in the report."""
    k = F.col("o_orderkey").cast("string")
    rows = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit('{"a": '), k, F.lit("}")).alias("expected"), F.concat(F.lit('{"a": '), k, F.when(F.col("o_orderkey") % 4 == 0, "1}").otherwise("}")).alias("predicted"))
    return kie.ordered_report(kie.document_metrics(kie.scored_leaves(rows))).select("doc_id", "position", "score")


@query("SELECT doc_id, row_number() OVER (ORDER BY sha1('5:2:' || doc_id)) - 1 AS place FROM documents")
def epoch_places(spark, d):
    """Where each document stands in the seeded order of an epoch."""
    return corpus.seeded_places(fx.table(spark, d, "documents").select("doc_id"), "doc_id", 5, 2)


@query("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL")
def required_rows(spark, d):
    """Named columns must be there and rows must be left, else the job ends with a message."""
    rows = corpus.require_columns(fx.table(spark, d, "documents"), ["doc_id", "lang"]).filter("lang IS NOT NULL")
    return corpus.require_rows(rows, "documents with a language").select("doc_id", "lang")


@query("SELECT doc_id, 'a ' || doc_id || chr(10) || chr(10) || 'b' AS markdown FROM documents")
def blank_elements(spark, d):
    """Elements of white space of any kind leave no empty block, and neither do those that are left out."""
    blanks = F.element_at(F.array(*map(F.lit, ("\t", "\r\n", "\u00a0", " \u2003 ", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    items = [(F.concat(F.lit("a "), F.col("doc_id").cast("string")), True), (blanks, True), (F.lit("left out"), False), (F.lit("\ufffdb"), True)]
    one = F.array(*[F.struct(c.alias("content"), F.lit(on).alias("included")) for c, on in items])
    rows = fx.table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_number"), F.posexplode(one).alias("pos", "e")).select("doc_id", "page_number", "pos", F.lit("Text").alias("label"), "e.content", "e.included")
    return layout.page_markdown(rows).select("doc_id", "markdown")


@query("WITH " + fx.ELEMENTS_SQL + """, b AS (SELECT doc_id, pos, least(x1, 700) / 1.0 AS x1, least(x1, 700) + 50.5 AS x2, least(y1, 900) / 1.0 AS y1, least(y1, 900) + 40.25 AS y2, ['n', 's', 'nw', 'se', 'move'][CAST(pos % 5 + 1 AS INTEGER)] AS mode, (doc_id + pos) % 300 - 150 AS dx, (doc_id * 3 + pos) % 2400 - 1200 AS dy FROM elements)
SELECT doc_id, pos, mode, CASE mode WHEN 'move' THEN greatest(0.0, least(y1 + dy, 1159.75)) WHEN 'n' THEN greatest(0.0, least(y1 + dy, y2 - 1.6)) WHEN 'nw' THEN greatest(0.0, least(y1 + dy, y2 - 1.6)) ELSE y1 END AS y1,
  CASE mode WHEN 'move' THEN greatest(0.0, least(y1 + dy, 1159.75)) + 40.25 WHEN 's' THEN greatest(y1 + 1.6, least(y2 + dy, 1200.0)) WHEN 'se' THEN greatest(y1 + 1.6, least(y2 + dy, 1200.0)) ELSE y2 END AS y2,
  CASE mode WHEN 'move' THEN greatest(0.0, least(x1 + dx, 749.5)) WHEN 'nw' THEN greatest(0.0, least(x1 + dx, x2 - 1.6)) ELSE x1 END AS x1 FROM b""")
def dragged_sides(spark, d):
    """Boxes dragged at their upper or lower side, or at a corner."""
    x, y = F.least(F.get("bbox", F.lit(0)), F.lit(700.0)), F.least(F.get("bbox", F.lit(1)), F.lit(900.0))
    e = fx.elements(spark, d).withColumn("box", F.array(x, y, x + 50.5, y + 40.25)).withColumn("mode", F.element_at(F.array(*map(F.lit, ("n", "s", "nw", "se", "move"))), (F.col("pos") % 5 + 1).cast("int")))
    dx, dy = (F.col("doc_id") + F.col("pos")) % 300 - 150, (F.col("doc_id") * 3 + F.col("pos")) % 2400 - 1200
    b = t.dragged_box(F.col("box"), F.col("mode"), dx.cast("double"), dy.cast("double"), F.lit(800.0), F.lit(1200.0))
    return e.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "mode", F.get(b, F.lit(1)).alias("y1"), F.get(b, F.lit(3)).alias("y2"), F.get(b, F.lit(0)).alias("x1"))


@query("WITH " + fx.ELEMENTS_SQL + " SELECT doc_id, pos, greatest(0.0, least(y1 / 1.0, 499.0)) AS y1, greatest(greatest(0.0, least(y1 / 1.0, 499.0)) + 1, least(y2 / 1.0, 500.0)) AS y2 FROM elements")
def edited_heights(spark, d):
    e = fx.elements(spark, d).withColumn("b", t.edited_box(F.col("bbox"), F.lit(800), F.lit(500)))
    return e.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.get("b", F.lit(1)).cast("double").alias("y1"), F.get("b", F.lit(3)).cast("double").alias("y2"))


@F.pandas_udf(T.DoubleType())
def _last_digit(ids: pd.Series) -> pd.Series:
    return ids % 10 / 10


@query("SELECT c_custkey AS sample_id, round((c_custkey % 10) / 10.0, 6) AS last_digit, round(CASE WHEN c_custkey % 11 = 0 OR c_custkey % 4 = 3 THEN 0.0 ELSE 0.25 END, 6) AS format_part FROM customer")
def pandas_rewards(spark, d):
    """A registered reward that is a pandas function."""
    extra = {"last_digit": (lambda sample_id, **_: _last_digit(sample_id), 2.0)}
    s = table_html.rewards(fx.html_tables(spark, d), extra)
    return s.select("sample_id", F.round("last_digit", 6).alias("last_digit"), F.round(0.25 * F.col("format_reward"), 6).alias("format_part"))
