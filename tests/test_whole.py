"""Queries that read whole tables and whole texts, against brute force."""

import html
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.functions import rows as r
from docloom.plans.queries import QUERIES
from docloom.sources import readers, sinks
from docloom.streaming import jobs


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def texts():
    rng = random.Random(4)
    words = ["alpha", "béta", "γάμμα", "delta", "línea", "x", "日本語", "zwölf"]
    long = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(4)]
    same = "start " * 60
    return [*long, same + "end", same + "other ending", "", "   ", "été fin", "```json\n{}\n```" + "y" * 90, "one\r\ntwo\rthree", "q"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(k, x, "en") for k, x in enumerate(texts())], "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    return d


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(90))) for _ in range(2))
        assert r.edit_distance(a, b) == levenshtein(a, b) and r.lcs_length(a, b) == common(a, b)
    assert r.edit_distance(["aa", "b"], ["aa", "c", "b"]) == 1


def test_whole_pairs(spark, folder):
    x = [" ".join(v.split()) for v in texts()]
    edit = {k: 1.0 if not x[k] and not x[k + 1] else 1 - levenshtein(x[k], x[k + 1]) / max(len(x[k]), len(x[k + 1])) for k in range(len(x) - 1)}
    indel = {k: 1.0 if x[k] == x[k + 1] else 2 * common(x[k], x[k + 1]) / (len(x[k]) + len(x[k + 1])) for k in range(len(x) - 1)}
    for name, want in (("edit_similarity_pairs", edit), ("indel_similarity_pairs", indel)):
        got = {v.left_id: v.similarity for v in QUERIES[name](spark, folder).collect()}
        assert got == pytest.approx(want, abs=1e-6)


def test_whole_words(spark, folder):
    w = [v.split() for v in texts()]
    rate = lambda a, b: levenshtein(a, b) / len(a) if a else float(a != b)
    want = {k: (len(w[k]), rate(w[k], w[k + 1])) for k in range(len(w) - 1)}
    got = {v.left_id: (v.words, v.wer) for v in QUERIES["word_error_rate"](spark, folder).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6)


def test_whole_characters(spark, folder):
    x = texts()
    want = {k: levenshtein(x[k], x[k + 1]) / len(x[k]) if x[k] else float(x[k] != x[k + 1]) for k in range(len(x) - 1)}
    got = {v.left_id: v.cer for v in QUERIES["character_error_rate"](spark, folder).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_whole_fences(spark, folder):
    got = {v.doc_id: v for v in QUERIES["fences_and_thoughts"](spark, folder).collect()}
    for k, v in enumerate(texts()):
        x = v.strip()
        assert (got[k].after_first, got[k].after_last) == (x, "b")
        assert got[k].inner_text == x


def test_whole_rows(spark, folder, tmp_path):
    x = texts()
    d = str(tmp_path)
    more = [*x, "été   fin", "q "]
    spark.createDataFrame(list(enumerate(more)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    pages = ["<p> <b>é</b> <i>x\n y</i></p>", " <p>a</p>\r\n<p>b</p> "]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{d}/pages.parquet")
    copies = {}
    for k, v in enumerate(more):
        copies.setdefault(" ".join(v.split()), []).append(k)
    assert {(v.doc_id, v.copies) for v in QUERIES["cleaned_distinct"](spark, d).collect()} == {(k[0], len(k)) for k in copies.values()}
    shown = {k: re.sub("\r\n|\r|\n", "<br>", html.escape(v)) for k, v in enumerate(more)}
    assert {v.doc_id: v.html for v in QUERIES["escaped_html"](spark, d).collect()} == shown
    assert [v.html for v in QUERIES["normal_html"](spark, d).orderBy("page_id").collect()] == ["<p><b>é</b><i>x y</i></p>", "<p>a</p><p>b</p>"]
    labels, want = ("Title", "Text", "Section-header", "Page-header", "Text"), set()
    for k, v in enumerate(more):
        for pos, line in enumerate(v.split("\n")):
            hit = (k + pos) % 5 == 0
            want.add((k, pos, "edited: " + line if hit else line, labels[pos % 5] != ("Text" if hit else "Page-header"), hit))
    assert {tuple(v) for v in QUERIES["edit_overlay"](spark, d).collect()} == want


def test_all_full_batches(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    assert {(v.doc_id, v.batch_id) for v in QUERIES["full_batches"](spark, str(tmp_path)).collect()} == {(k, k // 64) for k in range(960)}


def test_streams_go_to_files(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    for name in ("stream_first_seen", "stream_step_windows", "stream_time_windows", "stream_running_summary"):
        out = QUERIES[name](spark, d)
        assert out.inputFiles() and out.count() > 0, name
    rows = spark.readStream.schema("k long").parquet(str(tmp_path))
    for mode, stream in (("append", rows), ("complete", rows.groupBy("k").count())):
        assert jobs.finished(stream, mode, f"{tmp_path}-{mode}").count() == 0
    sinks.write_report(spark.range(1).select(F.lit(0.5).alias("score")), spark.range(30, numPartitions=3), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/documents")).count() == 30 and spark.read.json(str(tmp_path / "report/summary")).first().score == 0.5


def test_dataset_summary_looks_at_the_first_sample_alone(spark):
    """Sorted into several partitions, whose first rows have other numbers of images than they say."""
    from docloom.operators import table_html

    html = "<table><tr><td>x</td></tr></table>"
    rows = spark.range(1, 2001, 1, 8).select(F.col("id").alias("sample_id"), F.lit(html).alias("table_html"), F.array(F.lit("a")).alias("images"), F.when(F.col("id") == 1, 1).otherwise(2).alias("num_images"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = table_html.dataset_summary(rows, rows.limit(0)).first().asDict()
        none = table_html.dataset_summary(rows.limit(0), rows).first().asDict()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert one == {"train_rows": 2000, "inconsistent": 1999, "eval_rows": 0, "sample_images": 1, "sample_shape": [1, 1], "sample_cells": 1}
    assert none == {"train_rows": 0, "inconsistent": 0, "eval_rows": 2000, "sample_images": None, "sample_shape": None, "sample_cells": None}


def test_depth_of_texts(spark):
    from docloom.operators import leaves as lv

    cases = {'{"a": 1}': 1, "[]": 1, "7": 0, '{"a": "]}"}': 1, r'["\\", "[\"[[[[[", [1]]': 2, '[["]]", [[[1]]], "[["]]': 5, "[[[[[[1]]]]]]": 5}
    got = lv.with_depth(spark.createDataFrame([(k,) for k in cases], "j string"), "j", 4)
    assert {r.j: r._depth for r in got.collect()} == cases


def test_leaves_meet_where_their_texts_are(spark):
    """Leaves of shallow texts are neither written nor shuffled: one exchange, of the texts, is below their grouping."""
    from docloom.operators import kie

    pairs = spark.range(50).select(F.col("id").alias("doc_id"), F.format_string('{"a": [%d, {"b": "x"}]}', "id").alias("expected"), F.format_string('{"a": [%d, {"b": "xy"}]}', "id").alias("predicted"))
    scored = kie.scored_leaves(pairs)
    assert scored.select("doc_id", "at", "in_e")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r.path, r.exact, round(r.score, 6)) for r in scored.collect()} == {("a[0]", True, 1.0), ("a[1].b", False, 0.666667)}


def test_pandas_functions_are_given_what_they_are_needed_for(spark):
    seen = r.indel_similarity(F.col("a"), F.col("b"))
    plan = spark.createDataFrame([("x", "x"), ("x", ""), ("x", "xy")], "a string, b string").select(seen.alias("s"))
    assert [round(x.s, 6) for x in plan.collect()] == [1.0, 0.0, 0.666667]
    assert "CASE WHEN" in plan._jdf.queryExecution().optimizedPlan().toString().split("indel_udf(")[1][:12]


def test_written_variants_keep_whole_numbers(spark):
    from docloom.operators import leaves as lv

    rows = spark.createDataFrame([(1, '{"n": 4}'), (2, '{"n": 4.5}'), (3, '{"n": [7, {"m": 1.0}]}'), (4, '{"n": [[[[[[7]]]]]]}'), (5, '{"n": [[[[[[7.5]]]]]]}')], "doc_id int, j string").coalesce(1)
    got = {(r.doc_id, r.path): r.type for r in lv.leaves(rows, "j").collect()}
    assert got == {(1, "n"): "INT", (2, "n"): "REAL", (3, "n[0]"): "INT", (3, "n[1].m"): "REAL", (4, "n[0][0][0][0][0][0]"): "INT", (5, "n[0][0][0][0][0][0]"): "REAL"}


def test_python_steps_follow_the_bytes_of_texts(spark):
    """One file of a few megabytes of tables or answers is read by several tasks."""
    from docloom.operators import layout, table_html

    one = spark.range(0, 3000, 1, 1)
    html = F.concat(F.lit("<table><tr><td>"), F.repeat(F.lit("x"), F.lit(500)), F.col("id").cast("string"), F.lit("</td></tr></table>"))
    samples = one.select(F.col("id").alias("sample_id"), html.alias("completion"), html.alias("table_html"), F.lit(1).alias("num_rows"), F.lit(1).alias("num_cols"), F.lit(1).alias("num_cells"), F.lit(False).alias("merged"))
    assert table_html.rewards(samples).select("sample_id", "reward").rdd.getNumPartitions() >= 3
    item = F.concat(F.lit('[{"bbox": [1, 2, 3, 4], "label": "Text", "content": "'), F.repeat(F.lit("x"), F.lit(1500)), F.lit('"}]'))
    pages = one.select(F.col("id").alias("doc_id"), F.lit(1).alias("page_number"), F.concat(F.lit("```JSON\n"), item, F.lit("\n```")).alias("raw"), F.lit(9).alias("image_width"), F.lit(9).alias("image_height"))
    plan = layout.parsed_elements(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan
    assert layout.parsed_elements(pages.limit(5)).count() == 5


def test_kie_steps_follow_counted_sizes(spark, monkeypatch):
    """Trees and pairs meet in as many tasks as they fill, not in the session's four; equal texts are parsed once."""
    from docloom.operators import kie
    from docloom.plans import fixtures as fx

    monkeypatch.setattr(fx, "TASK_LINES", 500)
    monkeypatch.setattr(kie, "PAIR_BYTES", 20_000)
    trees = fx.order_trees(spark, "/root/testdata/sf0.001")
    assert trees.rdd.getNumPartitions() > 8
    pairs = kie.with_predictions(fx.ground_truth(trees), fx.predictions(trees))
    assert len(pairs.inputFiles()) > 8
    parsed, real = [], kie.parsed_texts
    monkeypatch.setattr(kie, "parsed_texts", lambda docs, json: parsed.append(docs.count()) or real(docs, json))
    rows = spark.createDataFrame([(1, '{"a": 1}', '{"a": 1}'), (2, '{"a": "x"}', '{"a": "y"}'), (2, '{"b": 1}', '{"b": 1}'), (3, "no", "no")], "doc_id long, expected string, predicted string")
    got = {(v.doc_id, v.path): (v.in_e, v.in_p, v.e_value, v.p_value, v.score, v.exact) for v in kie.scored_leaves(rows).collect()}
    assert parsed == [5]
    assert got == {(1, "a"): (True, True, "1", "1", 1.0, True), (2, "a"): (True, True, "x", "y", 0.0, False), (2, "b"): (True, True, "1", "1", 1.0, True)}


def test_average_precision_follows_counted_boxes(spark, monkeypatch):
    """Against brute force, with boxes over several cells, equal scores and a null label; joined in more tasks than the session's four."""
    from docloom.operators import layout

    monkeypatch.setattr(layout, "TASK_BOXES", 10)
    rng = random.Random(3)
    box = lambda: (x := rng.uniform(0, 900), y := rng.uniform(0, 900), x + rng.uniform(1, 600), y + rng.uniform(1, 600))
    truth = [(k % 7, k, rng.choice(["a", "b", None]), *box()) for k in range(120)]
    moved = [(d, k, lb, float(k % 9), x + rng.uniform(-60, 60), y, u, v + rng.uniform(-60, 60)) for d, k, lb, x, y, u, v in truth]
    cols = "x1 double, y1 double, x2 double, y2 double"
    t = spark.createDataFrame(truth, f"doc_id long, id long, label string, {cols}")
    p = spark.createDataFrame(moved, f"doc_id long, id long, label string, score double, {cols}")

    def iou(a, b):
        w = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        size = lambda c: (c[2] - c[0]) * (c[3] - c[1])
        return w / (size(a) + size(b) - w)

    pairs = {(a[0], a[1], b[1]): iou(a[4:], b[3:]) for a in moved for b in truth if a[0] == b[0] and a[2] == b[2] and iou(a[4:], b[3:]) >= 0.5}
    near = layout.overlapping(p.withColumn("page", F.struct("doc_id", "label")), t.withColumn("page", F.struct("doc_id", "label")), "page", 0.5)
    assert near.rdd.getNumPartitions() > 8
    rows = near.collect()
    assert len(rows) == len(pairs) and {(v.page.doc_id, v.aid, v.bid): v.iou for v in rows} == pytest.approx(pairs)
    levels = [0.5 + 0.05 * k for k in range(10)]
    want = {}
    for label in ("a", "b"):
        total, area = sum(v[2] == label for v in truth), 0.0
        guesses = [v for v in moved if v[2] == label]
        for level in map(lambda v: round(v, 2), levels):
            taken = {}
            for g in guesses:
                mine = sorted((-v, b) for (d, a, b), v in pairs.items() if (d, a) == (g[0], g[1]) and v >= level)
                if mine:
                    taken.setdefault((g[0], mine[0][1]), []).append((-g[3], g[1]))
            hit = {min(v)[1] for v in taken.values()}
            steps = [(sum(g[3] >= s for g in guesses), sum(g[3] >= s and g[1] in hit for g in guesses), sum(g[3] == s and g[1] in hit for g in guesses)) for s in sorted({g[3] for g in guesses}, reverse=True)]
            area += sum(max(h / n for n, h, _ in steps[k:]) * steps[k][2] for k in range(len(steps)))
        want[label] = area / (total * 10)
    got = {v.label: v.average_precision for v in layout.mean_average_precision(p, t).collect()}
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_files_are_looked_at_in_few_tasks(spark, tmp_path, monkeypatch):
    """No task for each file of a micro-batch, no listing of all written files, nothing left beside them."""
    docs = spark.range(200).repartition(3).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("out_name"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("content"))
    path = f"file://{tmp_path}/out"
    files = sinks.write_markdown(docs, path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{k}.txt" for k in range(200))
    names = files.select(F.element_at(F.split("file", "/"), -1))
    assert {tuple(v) for v in readers.sizes_of(names, path).collect()} == {(f"{k}.txt", k) for k in range(200)}
    with pytest.raises(Exception, match="nowhere.txt"):
        readers.sizes_of(spark.createDataFrame([("nowhere.txt",)], "file string"), path).collect()
    before, sc = spark.conf.get(jobs.LISTING, None), spark.sparkContext

    def most_tasks(checkpoint):
        sc.setJobGroup("mark", "")
        spark.range(1).write.format("noop").mode("overwrite").save()
        sc.setLocalProperty("spark.jobGroup.id", None)
        first = max(sc.statusTracker().getJobIdsForGroup("mark"))
        rows = jobs.finished(jobs.incoming_files(spark, path).select("length"), "append", str(tmp_path / checkpoint))
        infos = [sc.statusTracker().getJobInfo(k) for k in range(first, first + 40)]
        assert rows.count() == 199  # Spark's scans pass over an empty file
        return max(v.numTasks for i in infos if i for k in i.stageIds if (v := sc.statusTracker().getStageInfo(k)))

    assert most_tasks("few") <= jobs.LISTING_TASKS
    assert spark.conf.get(jobs.LISTING, None) == before
    monkeypatch.setattr(jobs, "LISTING_TASKS", 10_000)
    assert most_tasks("many") == 200  # as Spark does it


def test_leaf_names_tell_leaves_apart(spark):
    """Names in the row agree with the table of leaves: as many, and equal where place, type and value are."""
    from docloom.operators import leaves as lv

    texts = ['{"a": 1, "b": [1.0, 2.5, {"c": null}]}', '{"a": 1.0, "b": [1, 2.50, {"c": "null"}]}', '{"a.b": "1", "a": {"b": 1, "": []}}', '{"a": {"b": "1"}, "a[0]": {}}', "[[], {}, [[[1]]]]", "[[], [], [[[1]]]]",
             '{"a": "x=INT:1+"}', '{"a": true, "é": "é", "n": 12345678901234567890123}', '{"a": 1, "a": [2]}', "null", '"text"', "7", "7.0", "{}", "[]", '{"a": [{"b": [1, 2]}, {"b": [1, 3]}]}', "{broken", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, j string")
    table = {}
    for r in lv.leaves(rows, "j").collect():
        table.setdefault(r.doc_id, set()).add((r.at, r.type, r.value))
    with lv.last_key_counts(spark):
        names = {r.doc_id: r.n for r in lv.written(lv.with_parsed(rows, "j", "v").select("doc_id", lv.leaf_names(F.col("v")).alias("n")), "names").collect()}
    assert {k for k, n in names.items() if n is None} == {16, 17}
    for a in table:
        assert len(names[a]) == len(set(names[a])) == len(table[a])
        assert sum(x.endswith("-") for x in names[a]) == sum(t in ("{}", "[]") for _, t, _ in table[a])
        for b in table:
            assert len(set(names[a]) & set(names[b])) == len(table[a] & table[b]), (a, b)
    deep = spark.createDataFrame([('{"a": [[[[1]]]], "b": 2}',), ("[[[[]]]]",)], "j string").select(lv.leaf_names(F.try_parse_json("j")).alias("n"))
    assert [[x is None for x in r.n] for r in deep.collect()] == [[True, False], [False]]


def test_answers_are_scored_where_they_lie(spark, monkeypatch):
    """No text, value or leaf of an answer is shuffled or written, but for values of more than four levels."""
    from docloom.operators import json_bench
    from docloom.operators import leaves as lv

    plans, real = [], json_bench.written
    keep = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name)
    monkeypatch.setattr(json_bench, "written", keep)
    monkeypatch.setattr(lv, "written", keep)
    noise = F.concat_ws("", *[F.sha2(F.concat_ws("-", "id", F.lit(k)), 256) for k in range(30)])
    text = F.concat(F.lit('{"n": '), F.col("id").cast("string"), F.lit(', "e": [], "t": "'), noise, F.lit('"}'))
    deep = F.concat(F.lit('{"d": [[[[['), F.col("id").cast("string"), F.lit("]]]]]}"))
    wanted = F.when(F.col("id") < 3, deep).otherwise(text)
    rows = spark.range(0, 500, 1, 3).select(F.lit("v").alias("variant"), F.col("id").cast("string").alias("source"), F.when(F.col("id") % 5 == 4, F.concat(wanted, F.lit(" x"))).otherwise(F.replace(wanted, F.lit('"n": 1'), F.lit('"n": 2'))).alias("prediction"), wanted.alias("reference"))
    scores = json_bench.prediction_scores(rows, similarity=False)
    assert "Exchange" not in plans[0]
    size = lambda df: sum(Path(f.removeprefix("file:")).stat().st_size for f in df.inputFiles())
    assert size(scores) < 200_000 < 500 * 30 * 64
    got = {int(r.source): (r.json_valid, r.exact_match, r.tp, r.n_predicted, r.n_reference) for r in scores.collect()}
    for k in range(500):
        valid, same = k % 5 != 4, k < 3 or not str(k).startswith("1")
        n = 1 if k < 3 else 2
        assert got[k] == (valid, valid and same, (n if same else n - 1) if valid else 0, n if valid else 0, n), k
    plans.clear()
    assert size(json_bench.tolerant_fields(rows, {"n": lambda v: F.try_variant_get(v, "$.n", "int")}, ["source"])) < 100_000 and size(json_bench.strict_fields(rows, {"valid": lambda v: v.isNotNull()}, ["source"])) < 100_000
    assert len(plans) == 2 and not any("Exchange" in p for p in plans)


def test_variants_are_compared_by_one_shuffle(spark):
    from docloom.operators import json_bench

    rows = spark.createDataFrame([("a", "1", 3), ("b", "1", 4), ("a", "2", 5), ("b", "3", None), ("c", "3", 9)], "variant string, source string, tp long")
    out = json_bench.variant_comparison(rows, ["a", "b"], "tp")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, out.collect())) == [("1", 3, 4), ("2", 5, None), ("3", None, None)]


@pytest.mark.parametrize("name,column", [("json_tolerant_values", "id"), ("json_strict_validity", "valid")])
def test_read_answers_are_not_written(spark, name, column):
    """What is written of the answers is the result, without their texts and values."""
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert spark.read.parquet(*out.inputFiles()).columns == ["variant", "source", column]
