"""Chat formatting by quotation linking, in DataFrame operations.

A line's quote level is the number of `>` marks before its text. A passage is a run of
lines of one level without an empty line between; passages of level 0 are the message's
own, the others quote. Passages are normalised (lines joined, A-Z lower-cased, white
space runs as one blank, trimmed), so one that a mail program wrapped anew stays equal,
and hashed. A quoted passage is tied to the last earlier message of its conversation
that holds it; where no message holds the whole passage, its lines and sentences (cut
after . ! or ?) are looked up instead, and the message that most of them come from is
its origin (ties: the latest). A message replies to the origin of most of the text
quoted at level 1 (ties: the latest), else to the turn before it. Deeper passages belong
to messages further up: they are tied and counted, but do not vote. A line that only
announces a quotation (`... wrote:` and the like, right before a quoted line) is not
part of the body.

Messages are then put in reply order: each message is followed by its replies in order
of turn, each with all that answers it, so branches do not interleave.

No step gathers a conversation. The latest earlier holder of a hash comes from windows
over 1024 turns at most and one row for each such stretch. Order comes from a written
table sorted over all conversations: stretches in which each message answers the one
before it become one node, and the places of the nodes are found by pointer jumping in
written rounds, which grow with the logarithm of the number of branches. Bodies join
last.

Null texts are empty messages; empty lines are never linked. Null conv_id is a
conversation of its own; null turns sort first. Repeated rows of one conversation and
turn are messages of the same turn, told apart by their text; equal ones count once; a
reply to such a turn hangs on the first of them by hash. The characters U+0001 and
U+0002 count as blanks in hashes. Other columns are not read. An empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import LOWER, UPPER, staged

MARKS = r"^(?:[ \t]*>)+[ \t]?"
ANNOUNCES = r"(?i)(wrote|schrieb|a écrit|escribió) ?:[ \t]*$"
FIRST = -(2**63)
BLANK, ANNOUNCED = -2, -1
MESSAGE = ["c", "t", "m"]
PLACES = 33  # bits of monotonically_increasing_id that count rows in a partition


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER + "\x01\x02", LOWER + "  "), r"[ \t\x0B\f\r\n]+", " "))


def units_of(passages: str) -> Column:
    """(p, level, exact, size, h1, h2) of every passage and of its lines and sentences."""

    def of(x: Column, p: Column) -> Column:
        whole = x["whole"]
        sentences = F.split(F.regexp_replace(whole, r"([.!?]) ", "$1\x02"), "\x02")
        lines = F.when(F.instr(x["raw"], "\n") > 0, F.transform(F.split(x["raw"], "\n"), normal)).otherwise(F.array())
        pieces = F.filter(F.array_distinct(F.concat(lines, sentences)), lambda y: (y != "") & (y != whole))
        unit = lambda y, exact: F.struct(p.alias("p"), x["level"].alias("level"), F.lit(exact).alias("exact"), x["size"].alias("size"), F.xxhash64(y).alias("h1"), F.xxhash64(F.lit(1), y).alias("h2"))
        return F.concat(F.array(unit(whole, True)), F.transform(pieces, lambda y: unit(y, False)))

    return F.flatten(F.transform(F.filter(passages, lambda x: x["level"] >= 0), of))


def parsed_messages(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, c and t (both never null), m (hash of the
    text), body, n_quoted (quoted passages), max_level and units."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = messages.select("conv_id", "turn", "role", F.xxhash64(text).alias("m"), text.alias("x")).groupBy("conv_id", "turn", "m").agg(F.min("role").alias("role"), F.min("x").alias("x"))
    lines = F.transform(F.split("x", r"\r\n|\n|\r"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")))
    rows = rows.select("conv_id", "turn", "role", "m", lines.alias("ls"))
    announces = lambda x, i: (x["level"] == 0) & x["line"].rlike(ANNOUNCES) & (F.coalesce(F.get(F.col("ls"), i + 1)["level"], F.lit(0)) > 0)
    kinds = F.transform("ls", lambda x, i: F.when(normal(x["line"]) == "", BLANK).when(announces(x, i), ANNOUNCED).otherwise(x["level"]))
    rows = rows.withColumn("kinds", kinds)
    opens = lambda i: F.coalesce(F.get(F.col("kinds"), i - 1), F.lit(BLANK)) != F.get(F.col("kinds"), i)
    marked = F.transform("ls", lambda x, i: F.when(F.get(F.col("kinds"), i) == BLANK, "").otherwise(F.concat(F.when(opens(i), F.concat(F.lit("\x01"), F.get(F.col("kinds"), i).cast("string"), F.lit("\x02"))).otherwise(""), F.translate(x["line"], "\x01\x02", "  "))))
    parts = F.filter(F.split(F.array_join(marked, "\n"), "\x01"), lambda p: p.contains("\x02"))
    raw = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\x02", 1).cast("int").alias("level"), F.substring_index(p, "\x02", -1).alias("raw")))
    whole = F.transform(raw, lambda x: F.struct(x["level"].alias("level"), x["raw"].alias("raw"), normal(x["raw"]).alias("whole")))
    passages = F.transform(whole, lambda x: F.struct(x["level"].alias("level"), x["raw"].alias("raw"), x["whole"].alias("whole"), F.length(x["whole"]).alias("size")))
    own = F.filter("ls", lambda x, i: (x["level"] == 0) & (F.get(F.col("kinds"), i) != ANNOUNCED))
    body = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    conv = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    rows = rows.select("conv_id", "turn", "role", conv.alias("c"), F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("t"), "m", body.alias("body"), F.array_max(F.transform("ls", lambda x: x["level"])).alias("max_level"), passages.alias("passages"))
    return rows.withColumn("n_quoted", F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long")).withColumn("units", units_of("passages")).drop("passages")


def last_before(rows: DataFrame, keys: list[str], holds: Column) -> DataFrame:
    """Add `before`: the greatest t below a row's own among the rows of its keys where
    `holds` is true. Rows are distinct in keys and t, and written (they are read twice)."""
    rows = rows.withColumn("_b", F.floor(F.col("t") / 1024))
    held = F.max(F.when(holds, F.col("t")))
    near = held.over(Window.partitionBy(*keys, "_b").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    far = rows.groupBy(*keys, "_b").agg(held.alias("_m"))
    far = far.select(*keys, "_b", F.max("_m").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_far"))
    return rows.withColumn("_near", near).join(far.hint("shuffle_merge"), [*keys, "_b"]).withColumn("before", F.coalesce("_near", "_far")).drop("_b", "_near", "_far")


def origins(messages: DataFrame) -> DataFrame:
    """(c, t, m, n_linked, voted) of the messages whose quoted passages were found."""
    units = messages.select(*MESSAGE, F.explode("units").alias("u")).select(*MESSAGE, "u.*")
    held = units.groupBy("c", "h1", "h2", "t").agg(F.max(F.col("level") == 0).alias("own"), F.max(F.col("level") > 0).alias("asks"))
    found = last_before(staged(held, "units"), ["c", "h1", "h2"], F.col("own")).filter(F.col("asks") & F.col("before").isNotNull())
    asked = units.filter(F.col("level") > 0).join(found.select("c", "h1", "h2", "t", F.col("before").alias("origin")).hint("shuffle_merge"), ["c", "h1", "h2", "t"])
    votes = asked.groupBy(*MESSAGE, "p", "level", "size", "origin").agg(F.max("exact").alias("exact"), F.count("*").alias("n"))
    passages = votes.groupBy(*MESSAGE, "p", "level", "size").agg(F.max(F.struct("exact", "n", "origin"))["origin"].alias("origin"))
    shares = passages.groupBy(*MESSAGE, "origin").agg(F.count("*").alias("n"), F.sum(F.when(F.col("level") == 1, F.col("size"))).alias("size"))
    voted = F.max(F.when(F.col("size").isNotNull(), F.struct("size", "origin")))["origin"]
    return shares.groupBy(*MESSAGE).agg(F.sum("n").alias("n_linked"), voted.alias("voted"))


def ranged(rows: DataFrame, keys: list, name: str) -> DataFrame:
    """rows in order of keys over all partitions, written, with `i`: it grows in that
    order, by one within a partition."""
    return staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("i", F.monotonically_increasing_id()), name)


def following(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add `next`: these columns of the row after it in a ranged table."""
    one, part = F.struct(*columns), F.shiftright("i", PLACES)
    rows = rows.withColumn("_p", part)
    firsts = rows.groupBy("_p").agg(F.min_by(one, "i").alias("_f"))
    firsts = firsts.select("_p", F.lead("_f").over(Window.orderBy("_p")).alias("_f"))  # one row per partition
    inside = F.lead(one).over(Window.partitionBy("_p").orderBy("i"))
    return rows.withColumn("_n", inside).join(F.broadcast(firsts), "_p").withColumn("next", F.coalesce("_n", "_f")).drop("_p", "_n", "_f")


def jumped(rows: DataFrame, pointer: str, take: dict, name: str) -> DataFrame:
    """Follow `pointer` (a node) to its end, doubling the reach in each written round:
    rows (node, pointer, ...) take the pointer of the node they point to, and what `take`
    makes of their own columns and the other node's (under x_)."""
    while not rows.filter(F.col(pointer).isNotNull()).isEmpty():
        other = rows.select(*[F.col(c).alias(f"x_{c}") for c in ["node", pointer, *take]])
        # nodes at their end stay out of the join
        met = rows.filter(F.col(pointer).isNotNull()).join(other.hint("shuffle_merge"), F.col(pointer) == F.col("x_node"), "left")
        rest = [c for c in rows.columns if c not in (pointer, *take)]
        met = met.select(*rest, *[f.alias(c) for c, f in take.items()], F.col(f"x_{pointer}").alias(pointer))
        rows = staged(met.unionByName(rows.filter(F.col(pointer).isNull())), name)
    return rows


def reply_order(replies: DataFrame) -> DataFrame:
    """(c, t, m, position) from (c, t, m, reply): the place in the conversation's reply
    order, from 0."""
    m = ranged(replies.select(*MESSAGE, "reply"), MESSAGE, "turns")
    heads = m.groupBy("c", F.col("t").alias("reply")).agg(F.min("i").alias("parent"))
    m = m.join(heads.hint("shuffle_merge"), ["c", "reply"], "left").select(*MESSAGE, "i", "parent")
    # a message that answers the one right before it goes on with its node
    opens = F.col("parent").isNull() | (F.col("parent") != F.col("i") - 1)
    part = Window.partitionBy(F.shiftright("i", PLACES)).orderBy("i")
    m = staged(m.withColumn("node", F.max(F.when(opens, F.col("i"))).over(part)), "nodes")
    nodes = m.groupBy("c", "node").agg(F.count("*").alias("n"), F.max(F.when(F.col("i") == F.col("node"), F.col("parent"))).alias("parent"))
    above = m.select(F.col("i").alias("parent"), F.col("node").alias("up"))
    nodes = staged(nodes, "parents")
    hung = nodes.filter("parent IS NOT NULL").join(above.hint("shuffle_merge"), "parent", "left").select("c", "node", "n", "up", (F.col("parent") - F.col("up")).alias("hang"))
    tops = nodes.filter("parent IS NULL").select("c", "node", "n", *[F.lit(None).cast("long").alias(c) for c in ("up", "hang")])
    nodes = staged(hung.unionByName(tops), "tree")
    # what hangs on a later message of a node comes first; siblings of one message by turn
    ties = [F.col("c"), F.coalesce("up", F.lit(-1)), F.coalesce(-F.col("hang"), F.lit(0)), F.col("node")]
    order = following(ranged(nodes, ties, "siblings"), ["c", "up", "node"])
    sibling = F.when((F.col("next.c") == F.col("c")) & F.col("next.up").eqNullSafe(F.col("up")), F.col("next.node"))
    child = nodes.filter("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.min(F.struct((-F.col("hang")).alias("a"), "node"))["node"].alias("child"))
    order = staged(order.select("c", "node", "n", "up", sibling.alias("after")).join(child.hint("shuffle_merge"), "node", "left"), "tree")
    # where a node's subtree ends: its next sibling, or that of the nearest node above that has one
    climbs = order.withColumn("climb", F.when(F.col("after").isNull(), F.col("up"))).drop("up")
    climbs = jumped(climbs, "climb", {"after": F.coalesce("after", "x_after")}, "climbs")
    line = climbs.select("c", "node", F.col("n").alias("left"), F.coalesce("child", "after").alias("to"))
    line = jumped(line, "to", {"left": F.col("left") + F.coalesce("x_left", F.lit(0))}, "places")
    totals = line.groupBy("c").agg(F.max("left").alias("total"))
    line = line.join(totals.hint("shuffle_merge"), "c").select("node", (F.col("total") - F.col("left")).alias("begin"))
    return m.join(line.hint("shuffle_merge"), "node").select(*MESSAGE, (F.col("begin") + F.col("i") - F.col("node")).alias("position"))


def linked(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, body (own text without quotes),
    n_quoted (quoted passages), n_linked (those whose original was found), max_level,
    reply_to (a turn, null for a conversation's first), position (from 0, in reply
    order)."""
    whole = staged(parsed_messages(messages), "messages")
    turns = last_before(staged(whole.select("c", "t").distinct(), "turns"), ["c"], F.lit(True))
    links = whole.select(*MESSAGE).join(origins(whole).hint("shuffle_merge"), MESSAGE, "left").join(turns.hint("shuffle_merge"), ["c", "t"])
    links = staged(links.select(*MESSAGE, F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("voted", "before").alias("reply")), "links")
    out = whole.join(links.hint("shuffle_merge"), MESSAGE).join(reply_order(links).hint("shuffle_merge"), MESSAGE)
    reply = F.when(F.col("reply") != FIRST, F.col("reply"))
    return out.select("conv_id", "turn", "role", "body", "n_quoted", "n_linked", F.col("max_level").cast("int").alias("max_level"), reply.alias("reply_to"), "position")


def op9_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as messages in reply order without quotes."""
    return linked(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP9_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, text, min(role) AS role FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations) GROUP BY ALL
), l AS (
  SELECT conv_id, turn, text, role, pos, length(regexp_replace(regexp_extract(parts[pos], '^(?:[ \t]*>)+[ \t]?'), '[^>]', '', 'g')) AS level,
    regexp_replace(parts[pos], '^(?:[ \t]*>)+[ \t]?', '') AS line
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT *, string_split_regex(text, '\r\n|\n|\r') AS parts FROM m))
), k AS (
  SELECT *, CASE WHEN trim(regexp_replace(line, '[ \t\x0B\f\x01\x02]+', ' ', 'g')) = '' THEN -2
      WHEN level = 0 AND regexp_matches(line, '(?i)(wrote|schrieb|a écrit|escribió) ?:[ \t]*$') AND coalesce(lead(level) OVER (PARTITION BY conv_id, turn, text ORDER BY pos), 0) > 0 THEN -1
      ELSE level END AS kind
  FROM l
), runs AS (
  SELECT *, count(*) FILTER (kind <> before) OVER (PARTITION BY conv_id, turn, text ORDER BY pos) AS p
  FROM (SELECT *, coalesce(lag(kind) OVER (PARTITION BY conv_id, turn, text ORDER BY pos), -2) AS before FROM k)
), passages AS (
  SELECT conv_id, turn, text, p, level, list(line ORDER BY pos) AS raw FROM runs WHERE kind >= 0 GROUP BY ALL
), wholes AS (
  SELECT *, trim(regexp_replace(translate(array_to_string(raw, chr(10)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(1) || chr(2), 'abcdefghijklmnopqrstuvwxyz  '), '[ \t\x0B\f\r\n]+', ' ', 'g')) AS norm FROM passages
), units AS (
  SELECT conv_id, turn, text, p, level, true AS exact, length(norm) AS size, norm AS u FROM wholes
  UNION ALL
  SELECT conv_id, turn, text, p, level, exact, size, u FROM (SELECT DISTINCT conv_id, turn, text, p, level, false, length(norm), unnest(list_concat(list_transform(raw, lambda x: trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(1) || chr(2), 'abcdefghijklmnopqrstuvwxyz  '), '[ \t\x0B\f\r\n]+', ' ', 'g'))),
    string_split(regexp_replace(norm, '([.!?]) ', '\1' || chr(2), 'g'), chr(2)))) AS u, norm FROM wholes) AS x (conv_id, turn, text, p, level, exact, size, u, norm) WHERE u <> '' AND u <> norm
), own AS (
  SELECT DISTINCT conv_id, turn, u FROM units WHERE level = 0
), found AS (
  SELECT q.conv_id, q.turn, q.text, q.p, q.level, q.exact, q.size, max(o.turn) AS origin
  FROM units q JOIN own o ON o.conv_id = q.conv_id AND o.u = q.u AND o.turn < q.turn WHERE q.level > 0 GROUP BY q.conv_id, q.turn, q.text, q.p, q.level, q.exact, q.size, q.u
), passage_origin AS (
  SELECT conv_id, turn, text, p, level, size, first(origin ORDER BY exact DESC, n DESC, origin DESC) AS origin
  FROM (SELECT conv_id, turn, text, p, level, size, origin, bool_or(exact) AS exact, count(*) AS n FROM found GROUP BY ALL) GROUP BY ALL
), voted AS (
  SELECT conv_id, turn, text, CAST(sum(n) AS BIGINT) AS n_linked, first(origin ORDER BY size DESC, origin DESC) FILTER (size IS NOT NULL) AS voted
  FROM (SELECT conv_id, turn, text, origin, count(*) AS n, sum(size) FILTER (level = 1) AS size FROM passage_origin GROUP BY ALL) GROUP BY ALL
), whole AS (
  SELECT conv_id, turn, text, min(role) AS role, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0 AND kind <> -1), ''), '^\s+|\s+$', '', 'g') AS body, CAST(max(level) AS INTEGER) AS max_level,
    count(DISTINCT p) FILTER (kind > 0) AS n_quoted
  FROM runs GROUP BY conv_id, turn, text
), replies AS (
  SELECT w.*, coalesce(n_linked, 0) AS n_linked, coalesce(voted, max(w.turn) OVER (PARTITION BY w.conv_id ORDER BY w.turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS reply_to
  FROM whole w LEFT JOIN voted v ON w.conv_id = v.conv_id AND w.turn = v.turn AND w.text = v.text
), paths AS (
  SELECT conv_id, turn, [turn] AS path FROM replies WHERE reply_to IS NULL
  UNION ALL
  SELECT r.conv_id, r.turn, list_append(p.path, r.turn) FROM replies r JOIN paths p ON r.conv_id = p.conv_id AND r.reply_to = p.turn
)
SELECT r.conv_id, r.turn, r.role, r.body, r.n_quoted, r.n_linked, r.max_level, r.reply_to, row_number() OVER (PARTITION BY r.conv_id ORDER BY p.path) - 1 AS position
FROM replies r JOIN paths p ON r.conv_id = p.conv_id AND r.turn = p.turn
"""
