"""Training-corpus preparation: checks, pairing, splits, samples, batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import collapse_space, document_of, repeated_end, stable_fraction, stable_shard
from docloom.operators.joins import side_join
from docloom.operators.leaves import strict_values
from docloom.sources.shared import written


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df, or an error that lists the missing columns in order."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame, what: str = "rows") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} left")
    return df


def valid_only(df: DataFrame, include_invalid: bool = False) -> DataFrame:
    return df if include_invalid else df.filter("validation_passed")


def first_n(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(n)


def validation_errors(rows: DataFrame, key: str, checks: dict[str, Column], most: int = 10) -> DataFrame:
    """The first `most` failures (key, error); a check is a column that is true on
    rows that pass."""
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return rows.select(key, F.explode(errors).alias("error")).orderBy(key, "error").limit(most)


def pair_by_key(images: DataFrame, labels: DataFrame, key: str = "key", strict: bool = True) -> DataFrame:
    """Images with their label; a missing label is an error naming it, or is left out."""
    if strict and (lost := images.join(labels, key, "left_anti").orderBy(key).select(key).head(1)):
        raise ValueError(f"no label for {lost[0][0]}")
    return images.join(labels, key)


def prefer(left: DataFrame, better: DataFrame, fallback: DataFrame, key: str, value: str, flag: str) -> DataFrame:
    """`value` from better where there is one, else from fallback; flag tells which."""
    b, f = better.select(key, F.col(value).alias("_b")), fallback.select(key, F.col(value).alias("_f"))
    return side_join(side_join(left, b, [key]), f, [key]).withColumn(value, F.coalesce("_b", "_f")).withColumn(flag, F.col("_b").isNotNull()).drop("_b", "_f")


def not_done(jobs: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    return jobs if force else side_join(jobs, done.select(key), [key], "left_anti")


def split_by_document(rows: DataFrame, key: str, fraction: float, pattern: str = r"_page\d+$") -> DataFrame:
    """document_id and split: all pages of a document on one side."""
    doc = document_of(F.col(key), pattern)
    return rows.withColumn("document_id", doc).withColumn("split", F.when(stable_fraction(doc) < fraction, "validation").otherwise("train"))


def assign_shards(rows: DataFrame, key: str, shards: int) -> DataFrame:
    return rows.withColumn("shard", stable_shard(F.col(key), shards))


def exact_sample(rows: DataFrame, n: int, key: str, seed: int, strict: bool = False) -> DataFrame:
    """Exactly n rows (fewer only if there are fewer; with strict an error), the same
    for a seed whatever the partitioning: the n smallest seeded hashes."""
    if strict and rows.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows")
    return rows.orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def share_per_group(rows: DataFrame, group: str, key: str, ratio: float, seed: int) -> DataFrame:
    """Of each group of n rows exactly min(n - 1, max(1, round(n * ratio))); groups of
    one row give none."""
    h = F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    rows = rows.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3)).withColumn("_g", F.struct(F.col(group)))
    # counts per group and one of 4096 stretches of the hash tell where its last kept row lies
    each = rows.groupBy("_g", "_b").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy("_g")
    upto = F.sum("_c").over(whole.orderBy("_b"))
    n = F.sum("_c").over(whole)
    kept = F.least(n - 1, F.greatest(F.lit(1), F.bround(n * ratio).cast("bigint")))
    each = each.select("_g", "_b", (kept - upto + F.col("_c")).alias("_room"), "_c").filter("_room > 0")
    rows = rows.join(each.hint("shuffle_merge"), ["_g", "_b"])
    rank = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h", key))
    return rows.withColumn("_k", F.when(F.col("_room") < F.col("_c"), rank).otherwise(0)).filter("_k <= _room").drop("_h", "_b", "_g", "_room", "_c", "_k")


def seeded_order(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    return rows.orderBy(F.sha1(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string")).cast("binary")), key)


def seeded_places(rows: DataFrame, key: str, seed: int, epoch: int, name: str = "place") -> DataFrame:
    """Add each row's place (from 0) in seeded_order, without sorting rows into one task; equal keys in any order."""
    h = F.sha1(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string")).cast("binary"))
    return numbered(rows.withColumn("_h", h), "_h", name).drop("_h")


def numbered(rows: DataFrame, key: str, name: str = "_i") -> DataFrame:
    """0-based place by key (ties in any order), without one window over all rows.

    Rows are ranged over partitions, sorted there and written once to the shared folder
    with their partition and place; counts per partition (one row each) give its start,
    so both sides come from the same files."""
    ranged = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged, "numbered")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    return ranged.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn(name, within + F.col("_s")).drop("_p", "_at", "_s")


def batches(rows: DataFrame, size: int, key: str, limit: int | None = None, drop_last: bool = False) -> DataFrame:
    """batch_id for runs of `size` rows in key order; with drop_last only full ones."""
    rows = first_n(rows, limit, key) if limit is not None else rows
    out = numbered(rows, key).withColumn("batch_id", F.floor(F.col("_i") / size)).drop("_i")
    if drop_last:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy("batch_id"))).filter(F.col("_n") == size).drop("_n")
    return out


def fraction_split(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Exactly ceil(n * fraction) rows in eval: those of the smallest seeded hashes."""
    n = rows.count()
    k = -(-n * fraction // 1)
    hashed = rows.withColumn("_h", F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))
    return numbered(hashed, "_h").withColumn("split", F.when(F.col("_i") < k, "eval").otherwise("train")).drop("_h", "_i")


def fits(rows: DataFrame, source: str, length: Column, most: int, policy: str = "skip") -> DataFrame:
    """Rows whose length fits. `error` raises with the first three sources instead."""
    if policy == "error":
        if over := rows.filter(length > most).orderBy(source).select(source).head(3):
            raise ValueError("too long: " + ", ".join(str(r[0]) for r in over))
        return rows
    return rows.filter(length <= most)


def overlength_counts(rows: DataFrame, length: Column, most: int, by: list[str] | None = None) -> DataFrame:
    """(by.., rows, kept, skipped) of the skip policy; a null length is skipped."""
    fine = F.coalesce(length <= most, F.lit(False))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.count_if(fine).alias("kept"), F.count_if(~fine).alias("skipped"))


def mapped(rows: DataFrame, name: str, f: Callable[..., Column], inputs: list[str], **constants) -> DataFrame:
    """Add the column that f makes of the named input columns and the constants."""
    return rows.withColumn(name, f(*[F.col(f"`{c}`") for c in inputs], **constants))


def batches_with_counts(rows: DataFrame, f: Callable, schema: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counts): f takes a pandas batch and returns the rows that stay (of
    `schema`) and a dict of counters, which are summed by name. Rows are made once and
    written, so counts and rows come from the same run."""

    def run(batches):
        import json

        totals: dict[str, int] = {}
        for batch in batches:
            kept, counts = f(batch)
            for k, n in counts.items():
                totals[k] = totals.get(k, 0) + int(n)
            kept = kept.copy()
            kept["_counts"] = None
            yield kept
        if totals:
            yield pd.DataFrame([[None] * (len(kept.columns) - 1) + [json.dumps(totals)]], columns=kept.columns)

    out = written(rows.mapInPandas(run, f"{schema}, _counts string"), "batches")
    kept = out.filter("_counts IS NULL").drop("_counts")
    counts = out.filter("_counts IS NOT NULL").select(F.explode(F.from_json("_counts", "map<string, bigint>")).alias("name", "n"))
    return kept, counts.groupBy("name").agg(F.sum("n").alias("n"))


def index_shards(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """Shards by running index in key order, modulo their number."""
    return numbered(rows, key).withColumn("shard", (F.col("_i") % shards).cast("int")).drop("_i")


def revision_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change) between two revisions by content hash: added, removed or changed."""
    side = lambda d, e: d.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("h"), F.lit(e).alias("e"))
    of = lambda c, e: F.max(F.when(F.col("e") == e, F.col(c)))
    both = side(old, 1).unionByName(side(new, 2)).groupBy(key).agg(F.bit_or("e").alias("e"), of("h", 1).alias("a"), of("h", 2).alias("b"))
    change = F.when(F.col("e") == 2, "added").when(F.col("e") == 1, "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(key, change.alias("change")).filter(F.col("change").isNotNull())


def slices(rows: DataFrame, by: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Any metrics per task, language or other slice, with its number of rows."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in metrics.items()])


def distinct_texts(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(key, copies): one row per text whose white space is cleaned, named by the least
    key. Texts meet by a hash, counted before the shuffle."""
    return rows.groupBy(F.sha2(collapse_space(F.col(text)), 256).alias("_h")).agg(F.min(key).alias(key), F.count("*").alias("copies")).drop("_h")


def upload_verdict(name: Column, size: Column, types: list[str], most: int) -> Column:
    """Why an upload is refused, null if it is not."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when(~suffix.isin(*types), "unsupported type").when(size == 0, "empty").when(size > most, "too large")


def length_summary(rows: DataFrame, by: str, length: str) -> DataFrame:
    """count, min, upper median (sorted[n // 2]) and max per group, from a histogram of
    lengths, so that no group is sorted row by row."""
    h = rows.groupBy(by, length).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(length)
    h = h.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    median = F.min(F.when(F.col("upto") >= F.floor(F.col("total") / 2) + 1, F.col(length)))
    return h.groupBy(by).agg(F.max("total").alias("rows"), F.min(length).alias("shortest"), median.alias("median"), F.max(length).alias("longest"))


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: type, rows, nulls, distinct, min, max as text; one pass. The
    distinct values are estimated (about 5 %), or with `exact` counted, which makes as
    many rows as there are values."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    parts = [F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.count("*").alias("rows"), F.count_if(F.col(f.name).isNull()).alias("nulls"), distinct(F.col(f.name)).alias("distinct"), F.min(F.col(f.name)).cast("string").alias("least"), F.max(F.col(f.name)).cast("string").alias("greatest")) for f in df.schema.fields]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


#: Types that a sketch of distinct values takes as they are, and those that have quantiles.
COUNTED, MEASURED = ("int", "bigint", "smallint", "tinyint", "string", "binary"), ("int", "bigint", "smallint", "tinyint", "float", "double")


def column_sketches(df: DataFrame, by: list[Column]) -> DataFrame:
    """Per group of `by` (a file, a day) and column a profile that can be merged: type, rows, nulls, least and
    greatest as text, a sketch of the distinct values (HLL, 2^12 registers: about 2 %) and, of numbers,
    one of the quantiles (KLL, k = 200: ranks within about 2 %). One pass; what is kept has the same
    size however many rows a group has. Least and greatest of numbers are merged as numbers."""
    number = lambda f: f.dataType.simpleString() in MEASURED
    counted = lambda f: F.col(f.name) if f.dataType.simpleString() in COUNTED else F.col(f.name).cast("string")
    one = lambda f: F.struct(
        F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.count("*").alias("rows"), F.count_if(F.col(f.name).isNull()).alias("nulls"),
        F.min(F.col(f.name)).cast("string").alias("least"), F.max(F.col(f.name)).cast("string").alias("greatest"), F.hll_sketch_agg(counted(f)).alias("distinct"),
        (F.kll_sketch_agg_double(F.col(f.name).cast("double")) if number(f) else F.lit(None).cast("binary")).alias("quantiles"),
    )
    return df.groupBy(*by).agg(F.array(*map(one, df.schema.fields)).alias("_p")).select("*", F.inline("_p")).drop("_p")


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """The profile of all groups together, as column_sketches rows of no group: sketches of parts give what the
    union gives, within their error."""
    number = F.col("type").isin(*MEASURED)
    ends = lambda c, f: F.coalesce(f(F.when(number, F.col(c).cast("double"))).cast("string"), f(F.when(~number, F.col(c))))
    return sketches.groupBy("name", "type").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), ends("least", F.min).alias("least"), ends("greatest", F.max).alias("greatest"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def read_sketches(sketches: DataFrame, ranks: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The estimates of profiles: distinct values, and values at the ranks (null for what is no number)."""
    at = F.when(F.col("type").isin(*MEASURED) & (F.col("rows") > F.col("nulls")), F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(r)) for r in ranks]))
    return sketches.withColumn("distinct", F.hll_sketch_estimate("distinct")).withColumn("quantiles", at)


def preview(df: DataFrame, key: str, rows: int = 20, width: int = 80) -> DataFrame:
    """The first rows by key with every value as text of at most `width` characters."""
    first = df.orderBy(key).limit(rows)
    return first.select(*[F.substring(F.col(f"`{c}`").cast("string"), 1, width).alias(c) for c in df.columns])


def curated(pages: DataFrame, key: str, text: str, fraction: float = 0.2, pattern: str = r"_page\d+$") -> DataFrame:
    """One row per page: document_id (its group), page, split (all pages of a document on one side), kept and the
    reason where it is not: `empty` after white space is cleaned, `degenerate` (it ends in a repetition), or
    `copy` (another page with the same cleaned text has a smaller key; a page that is refused for another
    reason is nobody's original). All steps read one written table of keys and hashes; texts are read
    once and never shuffled. Null keys are kept as rows of no document; null texts are empty."""
    clean = collapse_space(F.coalesce(F.col(text), F.lit("")))
    doc = document_of(F.col(key), pattern)
    why = F.when(clean == "", "empty").when(repeated_end(F.col(text)), "degenerate")
    page = F.regexp_extract(F.col(key), r"(\d+)$", 1).try_cast("int")
    facts = pages.select(F.col(key).alias("key"), doc.alias("document_id"), page.alias("page"), F.when(stable_fraction(doc) < fraction, "validation").otherwise("train").alias("split"), why.alias("_why"), F.sha2(clean, 256).alias("_hash"))
    facts = written(facts, "keys")
    first = facts.filter("_why IS NULL").groupBy("_hash").agg(F.min("key").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select("_hash", "_first")
    j = side_join(facts, first, ["_hash"])
    reason = F.coalesce("_why", F.when(F.col("key") != F.col("_first"), "copy"))
    return j.select("key", "document_id", "page", "split", reason.isNull().alias("kept"), reason.alias("reason"))


def groups_of(curated_pages: DataFrame) -> DataFrame:
    """Per document of curated pages: its split, its pages and those that are kept, in order of their number."""
    kept = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("page", "key"))))
    return curated_pages.groupBy("document_id", "split").agg(F.count("*").alias("pages"), F.transform(kept, lambda x: x["key"]).alias("kept_keys"))


def prompt_record(prompt: str | Column) -> Column:
    """A record for sampling: one user message with the prompt."""
    return F.array(F.struct(F.lit("user").alias("role"), (F.lit(prompt) if isinstance(prompt, str) else prompt).alias("content")))


def conversation(user: Column, assistant: Column, image: Column | None = None, image_first: bool = True) -> Column:
    """Two messages; the user's holds text and, if given, an image before or after."""
    part = lambda kind, text, img: F.struct(F.lit(kind).alias("type"), text.alias("text"), img.alias("image"))
    none = F.lit(None).cast("string")
    words = part("text", user, none)
    asked = [words] if image is None else [part("image", none, image), words] if image_first else [words, part("image", none, image)]
    return F.array(F.struct(F.lit("user").alias("role"), F.array(*asked).alias("content")), F.struct(F.lit("assistant").alias("role"), F.array(part("text", assistant, none)).alias("content")))


def last_per_key(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """The row of the highest sequence number of each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(sequence)).alias("_r")).select(key, "_r.*")


def output_names(files: DataFrame, name: str = "name") -> DataFrame:
    """stem.md, or name.ext.md where two inputs share a stem in any case."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    n = F.count("*").over(Window.partitionBy(F.lower(stem)))
    return files.withColumn("out_name", F.when(n > 1, F.concat(F.col(name), F.lit(".md"))).otherwise(F.concat(stem, F.lit(".md"))))


def within_page_cap(pages: DataFrame, most: int, doc: str = "doc_id") -> DataFrame:
    """Pages of documents that have at most `most` of them."""
    return pages.withColumn("_n", F.count("*").over(Window.partitionBy(doc))).filter(F.col("_n") <= most).drop("_n")


def template_problems(rows: DataFrame, text: str, name: str = "problem") -> DataFrame:
    """Add why a text is no template (null if it is one): it must be one JSON value, an object, and not
    empty. Keys may repeat."""
    checked = strict_values(rows, F.col(text), "_v")
    v = F.col("_v")
    why = F.when(v.isNull(), "not JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object").when(v.cast("string") == "{}", "empty")
    return checked.withColumn(name, why).drop("_v")


def template_fields(leaf_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Leaf table to the fields a template asks for: an array of plain values is one
    field, empty containers are fields."""
    parent = F.regexp_extract("path", r"^(.*?)\[\d+\]$", 1)
    inside = F.regexp_extract("path", r"^(.*?)\[\d+\]", 1)
    rows = leaf_rows.select(key, "path", parent.alias("_p"), inside.alias("_i"))
    mixed = F.max(F.when(F.col("_p") == "", 1).otherwise(0)).over(Window.partitionBy(key, "_i"))
    return rows.withColumn("_m", mixed).select(key, F.when((F.col("_p") != "") & (F.col("_m") == 0), F.col("_p")).otherwise(F.col("path")).alias("path")).distinct()


def document_counters(pages: DataFrame, doc: str = "doc_id", text: str = "text", seconds: str = "seconds", tokens: str = "tokens") -> DataFrame:
    """Pages, characters, completion tokens and seconds per document."""
    return pages.groupBy(doc).agg(F.count("*").alias("pages"), F.sum(F.length(text)).alias("characters"), F.sum(tokens).alias("tokens"), F.sum(seconds).alias("seconds"))


def content_chunks(parts: DataFrame, key: str, order: str, images: str, texts: str) -> DataFrame:
    """Per key one content array: of each document in order, its images, then its texts."""
    none = F.lit(None).cast("string")
    one = F.concat(F.transform(images, lambda x: F.struct(F.lit("image").alias("type"), none.alias("text"), x.alias("image"))), F.transform(texts, lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"), none.alias("image"))))
    rows = parts.select(key, F.col(order).alias("_o"), one.alias("_c")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_o", "_c"))).alias("_l"))
    return rows.select(key, F.flatten(F.transform("_l", lambda x: x["_c"])).alias("content"))


def with_substitutes(rows: DataFrame, good: Column, key: str, seed: int) -> DataFrame:
    """Every bad row is replaced by a good one that the seed and its key choose (sha1
    modulo the number of good rows, which stand in key order), named in used_key; without
    good rows nothing is left."""
    marked = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    fine = numbered(marked.filter("_good"), key, "_place")
    n = fine.count()
    others = [c for c in rows.columns if c != key]
    chosen = fine.select("_place", F.struct(*others).alias("_r"), F.col(key).alias("used_key"))
    h = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")
    bad = marked.filter("NOT _good").select(key, F.pmod(h, F.lit(max(n, 1)).cast("decimal(20,0)")).cast("bigint").alias("_place"))
    return fine.select(*rows.columns, F.col(key).alias("used_key")).unionByName(bad.join(chosen.hint("shuffle_merge"), "_place").select(key, "_r.*", "used_key"))


def with_tries(rows: DataFrame, good: Column, key: str, seed: int, tries: int = 10) -> DataFrame:
    """Every bad row is replaced by the first good one of `tries` rows that the seed, its key and the number
    of the try choose among all rows in key order (sha1 modulo their number), named in used_key with the
    tries it took (0 for a good row); where all of them are bad, used_key is null and tries is null: the caller fails
    or drops it."""
    numbered_rows = numbered(rows.withColumn("_good", F.coalesce(good, F.lit(False))), key, "_place")
    n = numbered_rows.count()
    h = lambda k: F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), k.cast("string")).cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")
    bad = numbered_rows.filter("NOT _good").select(key, F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("_try"))
    asked = bad.withColumn("_place", F.pmod(h(F.col("_try")), F.lit(max(n, 1)).cast("decimal(20,0)")).cast("bigint"))
    fine = numbered_rows.filter("_good").select("_place", F.col(key).alias("used_key"))
    met = asked.join(fine.hint("shuffle_merge"), "_place").groupBy(key).agg(F.min(F.struct("_try", "used_key")).alias("_u"))
    out = side_join(numbered_rows.select(key, "_good"), met, [key])
    return out.select(key, F.when(F.col("_good"), F.col(key)).otherwise(F.col("_u.used_key")).alias("used_key"), F.when(F.col("_good"), 0).otherwise(F.col("_u._try")).alias("tries"))
