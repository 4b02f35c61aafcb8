"""Layout elements to Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.rows import grid_to_html, layout_list
from docloom.functions.text import box_pixels, element_markdown, in_markdown, normal_label, once, strip
from docloom.operators.joins import parts_of, sized

#: Answer bytes that one task reads.
TASK_BYTES = 1 << 20
#: Boxes that one task joins or ranks.
TASK_BOXES = 100_000
ITEM = "array<struct<bbox: array<double>, label: string, content: string>>"


def parsed_elements(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, pos, bbox, label, content, included) from model answers
    (doc_id, page_number, raw, image_width, image_height). Answers that are a plain
    JSON list, in a fence or not, never reach Python; the others are read tolerantly. Answers are dealt over
    tasks by their counted bytes."""
    pages = sized(pages, F.octet_length("raw"), TASK_BYTES)
    fence = lambda t: F.when(F.startswith(t, F.lit("```")) & F.endswith(t, F.lit("```")) & (F.length(t) > 5), strip(F.regexp_replace(F.substring(t, F.lit(4), F.length(t) - 6), "(?i)^(json|python)", ""))).otherwise(t)
    pages = pages.withColumn("_bare", once(strip(F.col("raw")), fence))
    native = F.from_json("_bare", ITEM)
    plain = F.col("_bare").rlike(r"^\s*\[\s*\{") & native.isNotNull() & (F.size(native) > 0) & F.forall(native, lambda x: x["bbox"].isNotNull() & (F.size(x["bbox"]) == 4) & F.forall(x["bbox"], lambda v: v.isNotNull()) & x["label"].isNotNull() & x["content"].isNotNull())
    pages = pages.withColumn("_plain", F.coalesce(plain, F.lit(False)))
    keys = ["doc_id", "page_number", "image_width", "image_height"]
    trimmed = F.transform(native, lambda x: F.struct(x["bbox"].alias("bbox"), F.coalesce(F.nullif(F.trim(x["label"]), F.lit("")), F.lit("Text")).alias("label"), F.trim(x["content"]).alias("content")))
    easy = pages.filter("_plain").select(*keys, trimmed.alias("items"))
    hard = pages.filter("NOT _plain").select(*keys, layout_list("raw").alias("items"))
    rows = easy.unionByName(hard).select(*keys, F.posexplode("items").alias("pos", "item")).select(*keys, "pos", "item.*")
    boxed = rows.withColumn("bbox", box_pixels(F.col("bbox"), F.col("image_width"), F.col("image_height")))
    return first_of_box(boxed).withColumn("included", in_markdown(F.col("label"))).drop("image_width", "image_height")


def first_of_box(rows: DataFrame, page: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """Of elements with one box and label on a page, the first."""
    order = Window.partitionBy(*page, "bbox", "label").orderBy("pos")
    return rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def with_tables(rows: DataFrame) -> DataFrame:
    """Add table_html for grid-text tables; other elements reach Python as nulls."""
    is_grid = (normal_label(F.col("label")) == "table") & ~F.startswith(F.lower(strip(F.col("content"))), F.lit("<table"))
    return rows.withColumn("table_html", grid_to_html(F.when(is_grid, F.col("content"))))


def page_markdown(rows: DataFrame, page: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """Included elements that are not empty, in order, a blank line between."""
    table = F.col("table_html") if "table_html" in rows.columns else None
    text = F.replace(element_markdown(F.col("label"), F.col("content"), table), F.lit("�"), F.lit(""))
    kept = F.when(F.col("included") & (strip(F.col("content")) != ""), F.struct("pos", text.alias("text")))
    return rows.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"]), "\n\n").alias("markdown"))


def document_markdown(pages: DataFrame) -> DataFrame:
    """Pages joined under their marks; a document of one page has none."""
    list_ = F.array_sort(F.collect_list(F.struct("page_number", "markdown")))
    marked = F.array_join(F.transform("_p", lambda x: F.concat(F.lit("<!-- Page "), x["page_number"].cast("string"), F.lit(" -->\n\n"), x["markdown"])), "\n\n")
    return pages.groupBy("doc_id").agg(list_.alias("_p")).select("doc_id", F.size("_p").alias("pages"), F.when(F.size("_p") == 1, F.get("_p", F.lit(0))["markdown"]).otherwise(marked).alias("content"))


def overlay(rows: DataFrame, edits: DataFrame, keys: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """Elements with the latest edit of each (content, included) laid over, and edited."""
    latest = edits.groupBy(*keys).agg(F.max_by("content", "seq").alias("_content"), F.max_by("included", "seq").alias("_included"), F.lit(True).alias("_hit"))
    j = rows.join(latest.hint("shuffle_merge"), list(keys), "left")
    return j.withColumn("content", F.coalesce("_content", "content")).withColumn("included", F.coalesce("_included", "included")).withColumn("edited", F.coalesce("_hit", F.lit(False))).drop("_content", "_included", "_hit")


def reading_edges(rows: DataFrame, region: str = "pos", page: str = "doc_id", order: str = "pos") -> DataFrame:
    """(page, from_region, to_region) between consecutive regions."""
    after = F.lead(region).over(Window.partitionBy(page).orderBy(order))
    return rows.select(page, F.col(region).alias("from_region"), after.alias("to_region")).filter(F.col("to_region").isNotNull())


def ocr_pages(lines: DataFrame) -> DataFrame:
    """Text lines (doc_id, pos, text, confidence) to a page: joined in order, least
    confidence (0 if none); lines without text or confidence are dropped."""
    good = F.when(F.col("text").isNotNull() & F.col("confidence").isNotNull(), F.struct("pos", "text"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(good)), lambda x: x["text"]), "\n").alias("text"), F.coalesce(F.min(F.when(F.col("text").isNotNull(), F.col("confidence"))), F.lit(0.0)).alias("confidence"))


def overlapping(a: DataFrame, b: DataFrame, key: str, least: float, parts: int | None = None) -> DataFrame:
    """(key, aid, bid, iou) of the pairs of boxes (key, id, x1..y2) whose intersection
    over union reaches `least`. Pairs are formed within a page and a grid of cells that
    the boxes touch, in the first cell that both touch alone, over as many tasks as the counted boxes make (or `parts`)."""
    size = 250
    parts = parts or parts_of(a, F.lit(1), TASK_BOXES)
    cells = lambda d: d.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x1") / size), F.floor(F.col("x2") / size)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y1") / size), F.floor(F.col("y2") / size))))
    name = lambda d, p: d.select(key, "cx", "cy", F.col("id").alias(f"{p}id"), *[F.col(c).alias(p + c) for c in ("x1", "y1", "x2", "y2")]).repartition(parts, key, "cx", "cy")
    lowest = lambda p, d: F.floor(F.least(f"{p}{d}1", f"{p}{d}2") / size)
    first = lambda d: F.col(f"c{d}") == F.greatest(lowest("a", d), lowest("b", d))
    j = name(cells(a), "a").join(name(cells(b), "b").hint("shuffle_merge"), [key, "cx", "cy"]).filter(first("x") & first("y")).distinct().drop("cx", "cy")
    side = lambda d: F.greatest(F.lit(0.0), F.least(f"a{d}2", f"b{d}2") - F.greatest(f"a{d}1", f"b{d}1"))
    area = lambda p: (F.col(p + "x2") - F.col(p + "x1")) * (F.col(p + "y2") - F.col(p + "y1"))
    inter = side("x") * side("y")
    return j.withColumn("iou", F.try_divide(inter, area("a") + area("b") - inter)).filter(F.col("iou") >= least).select(key, "aid", "bid", "iou")


def box_overlap(a: DataFrame, b: DataFrame, key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """Block F1 per page: boxes matched one to one, each to its best partner if that
    holds both ways."""
    j = overlapping(a, b, key, least)
    rank = lambda own, other: F.row_number().over(Window.partitionBy(key, own).orderBy(F.desc("iou"), other))
    hit = j.withColumn("ra", rank("aid", "bid")).withColumn("rb", rank("bid", "aid")).filter("ra = 1 AND rb = 1").groupBy(key).agg(F.count("*").alias("matched"))
    n = a.groupBy(key).agg(F.count("*").alias("n_a")).join(b.groupBy(key).agg(F.count("*").alias("n_b")).hint("shuffle_merge"), key, "full")
    return n.join(hit.hint("shuffle_merge"), key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b", "matched")]).withColumn("f1", 2 * F.col("matched") / (F.col("n_a") + F.col("n_b")))


def mean_average_precision(predicted: DataFrame, truth: DataFrame, key: str = "doc_id", thresholds: tuple[float, ...] = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)) -> DataFrame:
    """(label, average_precision, n_truth) over all pages: boxes (key, id, label, score,
    x1..y2) ranked by score, each matched to the true box of its label that it overlaps
    most, the best-scored first where several want one; the area under the precision
    and recall curve (precision made falling), averaged over the thresholds. Joins and
    windows are dealt over as many tasks as the counted boxes make; only counts per label, level and score
    leave them."""
    page = F.struct(F.col(key).alias("k"), F.col("label").alias("label"))
    boxes = lambda d: d.select(page.alias("page"), "id", "x1", "y1", "x2", "y2")
    parts = parts_of(predicted, F.lit(1), TASK_BOXES)
    pairs = overlapping(boxes(predicted), boxes(truth), "page", min(thresholds), parts)
    levels = F.explode(F.array(*map(F.lit, thresholds)))
    ranked = predicted.select(page.alias("page"), F.col("id").alias("aid"), "score")
    near = pairs.repartition(parts, "page", "aid").join(ranked.repartition(parts, "page", "aid").hint("shuffle_merge"), ["page", "aid"])
    own = Window.partitionBy("page", "aid", "level").orderBy(F.desc("iou"), "bid")
    taken = Window.partitionBy("page", "bid", "level").orderBy(F.desc("score"), "aid")
    best = near.withColumn("level", levels).filter(F.col("iou") >= F.col("level")).withColumn("_o", F.row_number().over(own)).filter("_o = 1")
    hits = best.repartition(parts, "page", "bid").withColumn("_t", F.row_number().over(taken)).filter("_t = 1")
    # equal scores count together, so one row per label, level and score is ordered; every level ranks all predictions
    asked = predicted.groupBy("label", "score").agg(F.count("*").alias("n")).select("label", levels.alias("level"), "score", "n", F.lit(0).cast("long").alias("h"))
    right = hits.groupBy(F.col("page.label").alias("label"), "level", "score").agg(F.count("*").alias("h")).select("label", "level", "score", F.lit(0).cast("long").alias("n"), "h")
    steps = asked.unionByName(right).groupBy("label", "level", "score").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    total = truth.groupBy("label").agg(F.count("*").alias("n_truth"))
    down = Window.partitionBy("label", "level").orderBy(F.desc("score"))
    steps = steps.withColumn("p", F.sum("h").over(down) / F.sum("n").over(down))
    steps = steps.withColumn("p", F.max("p").over(down.rowsBetween(0, Window.unboundedFollowing)))
    areas = steps.groupBy("label").agg(F.sum(F.col("p") * F.col("h")).alias("area"))
    return total.join(areas.hint("shuffle_merge"), "label", "left").select("label", (F.coalesce("area", F.lit(0.0)) / (F.col("n_truth") * len(thresholds))).alias("average_precision"), "n_truth")


def reading_order_accuracy(predicted: DataFrame, truth: DataFrame, page: str = "doc_id") -> DataFrame:
    """(page, edges, right, accuracy): the share of the true edges (see reading_edges)
    that the prediction has too; 0 for a page that has edges in the prediction only."""
    tag = lambda d, n: d.select(page, "from_region", "to_region", F.lit(n).alias("_e"))
    edges = tag(truth, 1).unionByName(tag(predicted, 2)).groupBy(page, "from_region", "to_region").agg(F.bit_or("_e").alias("_e"))
    n = edges.groupBy(page).agg(F.count_if(F.col("_e") != 2).alias("edges"), F.count_if(F.col("_e") == 3).alias("right"))
    return n.withColumn("accuracy", F.when(F.col("edges") == 0, 0.0).otherwise(F.col("right") / F.col("edges")))
