"""Odd rows and plans of joins by size, profiles, revisions, shards, streams and the curator."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.functions import rows as r
from docloom.functions import text as t
from docloom.operators import corpus, joins, json_bench, kie, layout
from docloom.operators.leaves import leaves
from docloom.sources import readers, shared, sinks
from docloom.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- joins


@pytest.mark.parametrize("how", joins.KINDS)
def test_side_join_equals_a_plain_join(spark, how):
    keys = [1] * 400 + [2, 3, None, None, 4, 9] * 5
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k long, n long").repartition(3)
    side = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (4, None), (None, "z"), (7, "q")], "k long, v string")
    want = sorted_rows(rows.join(side, "k", how))
    small = joins.side_join(rows, side, ["k"], how)
    large = joins.side_join(rows, side, ["k"], how, most_bytes=0, hot_rows=50)
    assert sorted_rows(small) == want and sorted_rows(large.select(*small.columns)) == want
    assert "BroadcastHashJoin" in plan(small) and "SortMergeJoin" not in plan(small)
    assert "SortMergeJoin" in plan(large)


def test_side_join_odd_cases(spark):
    rows = spark.createDataFrame([(1, 2, "x")], "a long, b long, c string")
    side = spark.createDataFrame([(1, 2, 3.5)], "a long, b long, v double")
    assert sorted_rows(joins.side_join(rows, side, ["a", "b"], most_bytes=0)) == [(1, 2, "x", 3.5)]
    assert sorted_rows(joins.side_join(rows, side.limit(0), ["a", "b"], most_bytes=0)) == [(1, 2, "x", None)]
    assert joins.side_join(rows.limit(0), side, ["a", "b"], "inner", most_bytes=0).count() == 0
    with pytest.raises(ValueError, match="both sides have c"):
        joins.side_join(rows, rows, ["a", "b"])
    with pytest.raises(ValueError, match="how is one of"):
        joins.side_join(rows, side, ["a", "b"], "full")


def test_small_joins_choose_by_size(spark):
    jobs_ = spark.createDataFrame([(k,) for k in range(20)], "key long")
    assert "BroadcastHashJoin" in plan(corpus.not_done(jobs_, jobs_.filter("key < 5"), "key"))
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "stem string, n long")
    with pytest.raises(Exception, match="missing template for b"):
        kie.with_templates(docs, spark.createDataFrame([("a", "{}")], "stem string, template string")).collect()


# ---------------------------------------------------------------- JSON


def test_leaves_of_any_depth(spark):
    deep = "[" * 40 + "1" + "]" * 40
    df = spark.createDataFrame([(1, deep), (2, '{"a":{"b":{"c":{"d":{"e":{"f":{}}}}}},"a2":null}'), (3, None), (None, '{"x":1,"x":{"y":[2]}}'), (4, "{")], "doc_id long, j string")
    got = {(x.doc_id, x.path, x.type, x.value) for x in leaves(df, "j").collect()}
    assert got == {(1, "[0]" * 40, "INT", "1"), (2, "a.b.c.d.e.f", "{}", "{}"), (2, "a2", "VOID", None), (None, "x.y[0]", "INT", "2")}
    assert leaves(df.limit(0), "j").count() == 0


def test_repeated_keys_everywhere(spark, tmp_path):
    rows = spark.createDataFrame([('{"a":1,"a":[1,2]}',), ('{"a":1}}',), ("[1]",), ("{}",), (None,)], "text string")
    assert {x.text: x.problem for x in corpus.template_problems(rows, "text").collect()} == {'{"a":1,"a":[1,2]}': None, '{"a":1}}': "not JSON", "[1]": "not an object", "{}": "empty", None: "not JSON"}
    value = json_bench.tolerant_values(spark.createDataFrame([('so: {"a":1,"a":2} x',)], "prediction string"))
    assert value.unionByName(value).select(F.col("value").cast("string")).first()[0] == '{"a":2}'  # a copied plan too
    (tmp_path / "a.json").write_text('{"a":1,"a":2}')
    assert readers.json_files(spark, str(tmp_path)).first().valid
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") == "false"


def test_numbers_in_exact_matches(spark):
    rows = spark.createDataFrame([("v", "1", '{"a":1.0}', '{"a":1}'), ("v", "2", '{"a":1}', '{"a":1}'), ("v", "3", "[]", "[]"), ("v", "4", "[]", "{}")], "variant string, source string, prediction string, reference string")
    of = lambda **k: {x.source: x.exact_match for x in json_bench.prediction_scores(rows, **k).collect()}
    assert of() == {"1": True, "2": True, "3": True, "4": False}
    assert of(strict=True) == {"1": False, "2": True, "3": True, "4": False}


# ---------------------------------------------------------------- text and tables


def test_positive_int(spark):
    texts = ["5", "+5", " 7\n", "99999999999", "0", "-3", "1.0", "x", "", "9" * 30, None]
    n, ok = t.positive_int(F.col("x"))
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(n.alias("n"), ok.alias("ok")).collect()
    assert [(x.n, x.ok) for x in got] == [(5, True), (5, True), (7, True), (99999999999, True)] + [(1, False)] * 7


def test_grid_text_of_many_rows_is_linear():
    text = "<nl>".join("<fcel>a<lcel><ucel>" for _ in range(20_000))
    html = r.grid_html(text)
    assert html.count("<tr>") == 20_000 and 'rowspan="19999"' not in html and html.count("</td>") == 20_000 + 1
    assert r.grid_html("<ucel>x<b>y<fcel> z <nl><xcel><ucel>") == "<table><tr><td></td><td>z</td></tr><tr><td></td></tr></table>"


def test_blank_elements_leave_no_block(spark):
    rows = spark.createDataFrame([(1, 1, 0, "Text", "a", True), (1, 1, 1, "Text", "\t \r", True), (1, 1, 2, "Text", "b", True)], "doc_id long, page_number int, pos int, label string, content string, included boolean")
    assert layout.page_markdown(rows).first().markdown == "a\n\nb"


# ---------------------------------------------------------------- profiles, curator, substitutes


def test_sketches_of_parts_are_those_of_the_union(spark):
    df = spark.range(30_000).select(F.col("id"), (F.col("id") % 700).cast("string").alias("s"), F.when(F.col("id") % 10 != 0, F.col("id") * 1.5).alias("x"), F.lit(None).cast("double").alias("none"), F.to_date(F.lit("2024-01-01")).alias("day"))
    parts = corpus.column_sketches(df, [(F.col("id") % 3).alias("part")])
    assert parts.count() == 15
    got = {x.name: x for x in corpus.read_sketches(corpus.merged_sketches(parts)).collect()}
    assert (got["id"].rows, got["id"].nulls, got["x"].nulls, got["none"].nulls) == (30_000, 0, 3_000, 30_000)
    assert abs(got["s"].distinct - 700) <= 35 and abs(got["id"].distinct - 30_000) <= 1_500 and got["none"].distinct == 0
    assert abs(got["x"].quantiles[1] - 22_500) <= 0.03 * 45_000 and got["s"].quantiles is None and got["none"].quantiles is None
    assert float(got["id"].greatest) == 29_999 and got["s"].least == "0" and got["day"].greatest == "2024-01-01"


def test_curated_odd_rows(spark):
    pages = [("d1_page0", " same  text "), ("d1_page1", "same text"), ("d2_page0", None), ("d2_page1", "\t"), ("d3_page2", "end" + " again" * 60), (None, "same text"), ("plain", "own")]
    out = {x.key: x for x in corpus.curated(spark.createDataFrame(pages, "key string, text string"), "key", "text").collect()}
    assert {k: x.reason for k, x in out.items()} == {"d1_page0": None, "d1_page1": "copy", "d2_page0": "empty", "d2_page1": "empty", "d3_page2": "degenerate", None: None, "plain": None}
    assert out["d1_page0"].split == out["d1_page1"].split and out["d3_page2"].page == 2 and out["plain"].page is None
    groups = corpus.groups_of(corpus.curated(spark.createDataFrame(pages, "key string, text string"), "key", "text"))
    assert {x.document_id: (x.pages, x.kept_keys) for x in groups.collect()}["d1"] == (2, ["d1_page0"])


def test_tries_end(spark):
    rows = spark.createDataFrame([(k,) for k in range(200)], "id long")
    none = corpus.with_tries(rows, F.lit(False), "id", 1).collect()
    assert len(none) == 200 and all(x.used_key is None and x.tries is None for x in none)
    few = corpus.with_tries(rows, F.col("id") == 3, "id", 1, tries=2).collect()
    assert {x.tries for x in few} <= {0, 1, 2, None} and [x.used_key for x in few if x.tries == 0] == [3]
    same = lambda n: sorted_rows(corpus.with_tries(rows.repartition(n), F.col("id") % 3 == 0, "id", 1))
    assert same(2) == same(5)


# ---------------------------------------------------------------- files


def test_shards_hold_the_cap(spark, tmp_path):
    rows = spark.range(3_000).select(F.col("id"), F.when(F.col("id") % 10 == 0, "b").alias("split"), F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("text"))
    path = str(tmp_path / "s")
    sinks.write_splits(rows.repartition(7), path, row_bytes=F.length("text"), shard_bytes=4_000)
    back = spark.read.parquet(path)
    assert back.count() == 3_000 and {x.split for x in back.select("split").distinct().collect()} == {"b", "train"}
    sizes = back.groupBy("split", F.col("_metadata.file_path").alias("f")).agg(F.sum(F.length("text")).alias("b")).collect()
    for name in ("b", "train"):
        own = sorted(x.b for x in sizes if x.split == name)
        assert sum(abs(b - 4_000) > 40 for b in own) <= 1 and max(own) <= 4_040
        assert len(own) == -(-sum(own) // 4_000)
    sinks.write_splits(rows.limit(0), str(tmp_path / "e"), row_bytes=F.length("text"))


def test_discovered_folders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "sub" / "b.TSV").write_text("id\tmore\n2\ty\n")
    (tmp_path / "c.json").write_text('[{"id": 3, "name": "z"}]')
    (tmp_path / "d.jsonl").write_text('{"id": 4}\n{"id": 5}\n')
    (tmp_path / "e.txt").write_text("line\n")
    (tmp_path / "f.docx").write_text("?")
    rows, rejects = readers.discovered(spark, str(tmp_path))
    assert sorted((x.kind, x.id, x.name, x.more, x.value) for x in rows.collect() if x.id) == [("csv", "1", "x", None, None), ("json", "3", "z", None, None), ("jsonl", "4", None, None, None), ("jsonl", "5", None, None, None), ("tsv", "2", None, "y", None)]
    assert [x.value for x in rows.filter("kind = 'txt'").collect()] == ["line"]
    assert [(x.file.rsplit("/", 1)[-1], x.reason) for x in rejects.collect()] == [("f.docx", "no reader for .docx")]


def test_needed_columns_prune_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, rejects = readers.needed(docs, ["doc_id"], "doc_id", {"long": F.col("n_chars") > 100, "english": F.col("lang") == "en"})
    assert "text" not in plan(rows).split("ReadSchema")[1].split(">")[0]
    assert rows.count() + rejects.count() == docs.count() and {x.reason for x in rejects.select("reason").distinct().collect()} <= {"long", "english"}


def test_revisions(spark, tmp_path):
    a, b, store = tmp_path / "a", tmp_path / "b", str(tmp_path / "store")
    for d in (a, b):
        (d / "x").mkdir(parents=True)
        for k in range(5):
            (d / "x" / f"{k}.txt").write_text(f"content {k}")
    first = readers.commit(spark, str(a), store)
    assert readers.commit(spark, str(b), store) == first
    (b / "x" / "0.txt").write_text("other")
    (b / "x" / "1.txt").rename(b / "moved.txt")
    (b / "x" / "2.txt").unlink()
    (b / "new.txt").write_text("new")
    (b / "x" / "copy.txt").write_text("content 4")
    second = readers.commit(spark, str(b), store)
    old, new = readers.revision(spark, store, first), readers.revision(spark, store, second)
    assert sorted_rows(readers.manifest_diff(old, new)) == sorted([("x/0.txt", "changed", None), ("moved.txt", "renamed", "x/1.txt"), ("x/2.txt", "removed", None), ("new.txt", "added", None), ("x/copy.txt", "added", None)], key=str)
    assert readers.manifest_diff(old, old).count() == 0
    assert {x.path: bytes(x.content) for x in readers.pinned(spark, str(a), old).collect()}["x/3.txt"] == b"content 3"
    with pytest.raises(Exception, match="not as in its revision"):
        readers.pinned(spark, str(b), old).collect()
    spark.read.parquet(f"{store}/{first}").limit(4).write.parquet(f"{store}/{'0' * 64}")
    with pytest.raises(ValueError, match="holds"):
        readers.revision(spark, store, "0" * 64)


def test_rejected_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"index":1,"v":1}\nnot\n{"index":1,"v":2,"v":3}\n{"v":9}\n{"index":2}{}\n{"index":2,"v":null}\n')
    rows, rejects = readers.prediction_lines(spark, str(tmp_path), "index long, v long")
    assert sorted_rows(rows) == [(1, 3), (2, None)]
    assert sorted((x.line, x.reason) for x in rejects.collect()) == [("not", "not JSON"), ('{"index":2}{}', "not JSON"), ('{"v":9}', "no index")]


# ---------------------------------------------------------------- streams


def arriving(spark, folder, batches, schema, start):
    for k, rows in enumerate(batches):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(x) for x in rows))
        start(spark.readStream.schema(schema).json(str(folder))).awaitTermination()


def test_state_lets_only_newer_rows_out(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    batches = [[{"k": "a", "s": 1, "v": 1}, {"k": "a", "s": 3, "v": 2}, {"k": "b", "s": 1}], [{"k": "a", "s": 2, "v": 9}, {"k": "b", "s": 2, "v": 4}, {"k": None, "s": 1, "v": 5}, {"k": "c", "v": 6}], [{"k": "a", "s": 4, "v": None}]]
    arriving(spark, folder, batches, "k string, s long, v long", lambda s: jobs.upserting(s, "k", "s", out, checkpoint, merge_every=2))
    assert sorted_rows(jobs.upserted(spark, out, "k", "s")) == sorted([("a", 4, None), ("b", 2, 4), (None, 1, 5)], key=str)
    assert jobs.merged_batches(spark, out) == [1, 2]  # two batches became a base, and went
    assert [x.v for x in spark.read.parquet(f"{out}/batch-2").collect()] == [None]


def test_closed_windows_do_not_change(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    at = lambda h, m: datetime(2024, 1, 1, h, m).isoformat()
    batches = [[{"ts": at(1, 5), "v": 1}, {"ts": at(2, 15), "v": 2}], [{"ts": at(1, 30), "v": 4}, {"ts": at(2, 5), "v": 6}, {"ts": None, "v": 7}], [{"ts": at(4, 0), "v": 8}], [{"ts": at(2, 50), "v": 10}, {"ts": at(3, 55), "v": 11}]]
    arriving(spark, folder, batches, "ts timestamp_ntz, v double", lambda s: jobs.closing_windows(s, "ts", "v", out, checkpoint))
    got = {x.start.hour: (x.rows, x.mean_value) for x in jobs.closed_windows(spark, out).select(F.col("start").cast("timestamp_ntz").alias("start"), "rows", "mean_value").collect()}
    assert got == {1: (1, 1.0), 2: (2, 4.0)}  # the window of 3 is open: its end is not 10 minutes back
    assert sorted(x.v for x in jobs.late_rows(spark, out).collect()) == [4, 7, 10]
    assert jobs.closed_windows(spark, out, timedelta(0)).count() == 3


def test_counters_of_each_batch(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "counters")
    folder.mkdir()
    listener = jobs.BatchCounters(spark, "skips", path)
    spark.streams.addListener(listener)
    try:
        start = lambda s: jobs.counting_skips(s, F.col("v") < 0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        arriving(spark, folder, [[{"v": 1}, {"v": -1}], [{"v": -2}, {"v": -3}, {"v": 4}]], "v long", start)
        got = jobs.batch_counters(spark, path, ["skipped", "rows"])
    finally:
        spark.streams.removeListener(listener)
    assert sorted((x.batch, x.skipped, x.rows) for x in got.collect()) == [(0, 1, 2), (1, 2, 3)]


# ---------------------------------------------------------------- the shared folder


def test_cleared(spark):
    def there(path):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

    outside = shared.written(spark.range(3), "outside")
    with shared.cleared(spark):
        inside = shared.written(spark.range(5), "inside")
        assert inside.count() == 5
        path = inside.inputFiles()[0].rsplit("/", 1)[0]
        assert there(path)
    assert not there(path) and outside.count() == 3
