"""Benchmark decontamination by winnowing, in DataFrame operations.

A document's fingerprints are the least k-gram hash of every run of w consecutive
k-grams. Two texts that share w + k - 1 words share one of them, so with k = 5 and
w = 6 no common span of ten words is missed. Fingerprints of both sides are joined;
a hit is extended to both sides, word by word, as far as ten-word windows can reach,
and counts if at least ten words agree. An item of fewer than ten words is one window
of its own length: for each such length (nine at most) documents give the hashes of
all their word runs of that length.

Before they leave their row, fingerprints are held against a bitmap of the items'
fingerprints (a fixed number of bits, so a large benchmark only makes it pass more);
what passes goes through the exact join on the words themselves.

Null texts and texts without a word have no hits; an item without a word has no
window. Rows with one doc_id and one text are one document; a null doc_id is kept as
such. Items repeated under one id count once. An empty benchmark leaves every document
clean; an empty corpus gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import LOWER, UPPER, staged

#: Between words: every ASCII character but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tasks that one fingerprint's rows are dealt over where items are too many to broadcast.
SALTS = 32


def word_list(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    cut = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN)
    # only the first and the last part can be empty
    head = F.when(F.element_at(cut, 1) == "", F.slice(cut, 2, F.size(cut))).otherwise(cut)
    return F.when(F.size(head) == 0, head).when(F.element_at(head, -1) == "", F.slice(head, 1, F.size(head) - 1)).otherwise(head)


def run_hashes(hashes: str, n: int) -> Column:
    """Hash of the n words from each place (null for shorter texts). `hashes` names a
    column of word hashes."""
    h = F.col(hashes)
    places = F.sequence(F.lit(0), F.size(h) - n)
    return F.when(F.size(h) >= n, F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)])))


def is_least(grams: str, i: Column, w: int) -> Column:
    """Whether the hash at i is the least of one of the runs of w hashes around it."""
    g = F.col(grams)
    runs = F.sequence(F.greatest(i - (w - 1), F.lit(0)), F.least(i, F.size(g) - w))
    return F.exists(runs, lambda j: F.least(*[F.get(g, j + t) for t in range(w)]) == F.get(g, i))


def around(words: str, grams: str, i: Column, n: int, reach: int, kind: int) -> Column:
    """What a hit at place i needs: its hash, up to `reach` words before it (nearest
    first), and its n words with up to `reach` after them."""
    x = F.col(words)
    left = F.least(i, F.lit(reach))
    return F.struct(F.lit(kind).alias("kind"), F.get(F.col(grams), i).alias("f"), i.alias("at"), F.reverse(F.slice(x, i - left + 1, left)).alias("before"), F.slice(x, i + 1, F.lit(n + reach)).alias("rest"))


def all_seen(grams: str, seen) -> Column:
    g = F.col(grams)
    return F.when(F.size(g) > 0, F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: seen(F.get(g, i))))


def whole_run(words: str, n: int):
    return lambda i: around(words, f"_g{n}", i, n, 0, n)


def prints(table: DataFrame, words: str, *, k: int, w: int, short: list[int], seen=None) -> DataFrame:
    """Add `prints`: the chosen k-grams of each text, and all runs of the lengths in
    `short`; `seen` is a test that hashes must pass first."""
    seen = seen or (lambda x: F.lit(True))
    table = table.withColumn("_h", F.transform(words, lambda x: F.xxhash64(x))).withColumn("_g", run_hashes("_h", k))
    g = F.col("_g")
    places = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: seen(F.get(g, i)) & is_least("_g", i, w))
    table = table.withColumn("_p", F.when(F.size(g) >= w, places))
    parts = [F.coalesce(F.transform("_p", lambda i: around(words, "_g", i, k, w - 1, 0)), F.array())]
    for n in short:  # the helpers bind n: a lambda's second parameter would be the index
        table = table.withColumn(f"_g{n}", run_hashes("_h", n)).withColumn(f"_p{n}", all_seen(f"_g{n}", seen))
        parts.append(F.coalesce(F.transform(f"_p{n}", whole_run(words, n)), F.array()))
    return table.withColumn("prints", F.concat(*parts)).drop("_h", "_g", "_p", *[f"_{x}{n}" for x in "gp" for n in short])


def bitmap_test(keys: DataFrame, n: int, most_bits: int):
    """A test that all hashes in keys.f pass and few others do: a bitmap of at most
    `most_bits` bits, held by the query as one literal."""
    bits = 1 << min(most_bits, max(12, (64 * max(n, 1) - 1).bit_length()))
    cells = bits // 64
    place = F.col("f").bitwiseAND(bits - 1)
    rows = keys.groupBy(F.shiftright(place, 6).cast("int").alias("c")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(f & 63 AS INT))")).alias("b")).collect()  # at most `cells` rows
    held = [0] * cells
    for r in rows:
        held[r.c] = r.b
    array = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")
    return array, lambda x, table: F.getbit(F.get(table, F.shiftright(x.bitwiseAND(bits - 1), 6).cast("int")), x.bitwiseAND(63).cast("int")) == 1


def agree(a: Column, b: Column) -> Column:
    """How many words two lists share at their start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("int")


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, k: int = 5, most_bits: int = 21, broadcast_rows: int = 100_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per document."""
    w = window - k + 1
    bench = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), word_list(F.col("text")).alias("_w")).filter(F.size("_w") > 0).distinct()
    bench = staged(bench, "items")
    short = sorted(r.n for r in bench.select(F.size("_w").alias("n")).filter(F.col("n") < window).distinct().collect())  # fewer than `window` rows
    long_keys = prints(bench.filter(F.size("_w") >= window), "_w", k=k, w=w, short=[])
    for n in short:
        long_keys = long_keys.unionByName(prints(bench.filter(F.size("_w") == n), "_w", k=k, w=w, short=[n]))
    # explode_outer: for a plain explode Spark adds a filter that computes `prints` twice
    keys = long_keys.select("item_id", F.explode_outer("prints").alias("p")).select("item_id", "p.*").filter(F.col("f").isNotNull())
    keys = staged(keys, "prints")
    n_keys = keys.count()
    table, test = bitmap_test(keys, n_keys, most_bits)
    texts = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("_t"), word_list(F.col("text")).alias("_w"))
    found = prints(texts, "_w", k=k, w=w, short=short, seen=lambda x: test(x, table)).select("doc_id", "_t", F.size("_w").alias("n_words"), F.explode_outer("prints").alias("p")).select("doc_id", "_t", "n_words", "p.*")
    side = keys.select("kind", "f", "item_id", F.col("before").alias("_before"), F.col("rest").alias("_rest"))
    if n_keys <= broadcast_rows:
        met = found.join(F.broadcast(side), ["kind", "f"], "left")
    else:  # a passage of very many documents is dealt over SALTS tasks, and the items repeated there
        found = staged(found, "passing")  # documents without a passing fingerprint stay out of the join
        salt = F.pmod(F.xxhash64("doc_id", "_t", "at"), F.lit(SALTS)).cast("int")
        side = side.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = found.filter("f IS NOT NULL").withColumn("_s", salt).join(side.hint("shuffle_merge"), ["kind", "f", "_s"], "left")
        met = met.unionByName(found.filter("f IS NULL"), allowMissingColumns=True)
    left, right = agree(F.col("before"), F.col("_before")), agree(F.col("rest"), F.col("_rest"))
    met = met.withColumn("_l", F.when(F.col("kind") == 0, left).otherwise(0)).withColumn("_r", right)
    ok = F.col("item_id").isNotNull() & F.when(F.col("kind") == 0, (F.col("_r") >= k) & (F.col("_l") + F.col("_r") >= window)).otherwise(F.col("_r") == F.col("kind"))
    span = F.struct((F.col("at") - F.col("_l")).alias("a"), (F.col("at") + F.col("_r") - 1).alias("b"))
    one = met.groupBy("doc_id", "_t", "n_words").agg(F.collect_set(F.when(ok, span)).alias("spans"), F.collect_set(F.when(ok, F.col("item_id"))).alias("ids"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"])))))
    return one.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("ids")).cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of ten words."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_contaminated(docs: DataFrame, items: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Documents without a hit, with all their columns. A row goes by its own text, named by 128 bits of
    hash: rows that share its doc_id, or have none, stay unless their texts are hit too."""
    text = F.col("text").cast("string")
    name = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    hit = contamination(docs.select(name.alias("doc_id"), "text"), items).filter("contaminated")
    bad = staged(hit.select(F.col("doc_id").alias("_docloom_bad")).distinct(), "contaminated")
    side = F.broadcast(bad) if bad.count() <= broadcast_rows else bad.hint("shuffle_merge")
    return docs.join(side, name == F.col("_docloom_bad"), "left_anti")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS key
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT *, least(len(w), 10) AS n FROM i WHERE len(w) > 0))
), runs AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS key
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT r.doc_id, r.p, r.n, w.item_id FROM runs r JOIN windows w ON r.n = w.n AND r.key = w.key
), places AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
