"""Cases of the operators, and invariants. Expected values are fixed by the rules they test."""

import math

import pytest
from pyspark.sql import functions as F

from docloom.functions import rows as r
from docloom.functions import text as t
from docloom.operators import corpus, json_bench, kie, layout, runs, table_html
from docloom.operators.leaves import leaves
from docloom.sources import readers, sinks
from docloom.streaming import jobs


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first().x


def kie_score(spark, expected, predicted):
    pairs = spark.createDataFrame([("d", expected, predicted)], "doc_id string, expected string, predicted string")
    return kie.document_metrics(kie.scored_leaves(pairs)).first()


def test_indel(spark):
    assert r.lcs_length("kitten", "sitting") == 4
    assert one(spark, r.indel_similarity(t.collapse_space(F.col("a")), t.collapse_space(F.col("b"))), a="a  b\n c", b="a b c") == 1
    assert one(spark, r.indel_similarity(F.col("a"), F.col("b")), a="", b="value") == 0


def test_kie_worked_cases(spark):
    m = kie_score(spark, '{"name":"Alice","age":30}', '{"name":"Alice","extra":true}')
    assert (m.union_leaves, m.missing_leaves, m.extra_leaves) == (3, 1, 1)
    assert m.score == pytest.approx(1 / 3) and m.exact == pytest.approx(1 / 3)


def test_kie_types(spark):
    m = kie_score(spark, '{"a":1,"b":null,"c":true,"d":{}}', '{"a":1.0,"b":null,"c":1,"d":{}}')
    assert m.score == pytest.approx(0.75) and m.exact == pytest.approx(0.5)  # 1 and 1.0 score but are not exact


def test_kie_missing_prediction_is_one_leaf(spark):
    truth = spark.createDataFrame([("x", '{"a":1,"b":2}')], "doc_id string, json string")
    pairs = kie.with_predictions(truth, truth.limit(0))
    m = kie.document_metrics(kie.scored_leaves(pairs)).first()
    assert (m.extra_leaves, m.expected_leaves, m.union_leaves, m.key_f1) == (1, 2, 3, 0)


def test_leaf_paths(spark):
    df = spark.createDataFrame([("d", '{"rows":[{"value":1},{"value":2}],"e":[]}')], "doc_id string, j string")
    assert {(x.path, x.value) for x in leaves(df, "j").collect()} == {("rows[0].value", "1"), ("rows[1].value", "2"), ("e", "[]")}
    assert {x.path for x in leaves(df, "j", root="$", keep_empty=False).collect()} == {"$.rows[0].value", "$.rows[1].value"}
    assert {x.path for x in leaves(df, "j", levels=1).collect()} == {"rows[0].value", "rows[1].value", "e"}  # in several rounds


def test_strict_json(spark):
    strict = lambda x: json_bench.strictly_parsed(spark.createDataFrame([(x,)], "prediction string")).first().parsed
    assert strict('<think>x [1]</think>```json\n{"b": 1.5, "a": "é"}\n```') == '{"a":"é","b":1.5}'
    assert strict('{"a":1,"b":2,"a":3}') == '{"a":3,"b":2}' and strict("null") == "null"
    assert strict('so: {"a": "```"}\n```\n') == '{"a":"```"}' and strict(" 12 ") == "12" and strict("```\n[1]") == "[1]"
    for bad in ('{"a":1} x', "[1] [2]", "none", '{"a":1}{"b":2}', "", "{", "1,2", "[1],[2]", '{"a":1}]', "NaN"):
        assert strict(bad) is None


def test_tolerant_json(spark):
    value = lambda x: json_bench.tolerant_values(spark.createDataFrame([(x,)], "prediction string")).select(F.col("value").cast("string")).first()[0]
    assert value('{"id":1} and {more}') == '{"id":1}' and value("a list [1, 2] and {") == "[1,2]" and value('12 {"a":1}') == '{"a":1}'
    assert value('"a [b] {c"') == "a [b] {c" and value("```json\n[3]\n```") == "[3]" and value("<think>{}</think> 5") == "5"
    assert value("nothing") is None and value("{broken") is None


def test_json_scores(spark):
    rows = spark.createDataFrame([("v", "1", '{"a":1,"b":2}', '{"a":1,"b":3}'), ("v", "2", "oops", '{"c":1}')], "variant string, source string, prediction string, reference string")
    s = json_bench.variant_summary(json_bench.prediction_scores(rows)).first()
    assert (s.valid_rate, s.exact_rate, s.field_precision, s.field_recall) == (0.5, 0, 0.5, pytest.approx(1 / 3))
    assert s.field_f1 == pytest.approx(0.4)


def parse(html):
    return r.table_parts.func(__import__("pandas").Series([html])).iloc[0]


def test_tables():
    p = parse('<table><tr><td colspan="2">a</td></tr><tr><td>b</td><td>c</td></tr></table>')
    assert p.valid and (p.num_rows, p.num_cols, p.num_cells, p.merged) == (2, 2, 3, True)
    p = parse('<table><tr><td rowspan="3">a</td><td>b</td></tr></table>')
    assert (p.num_rows, p.num_cols) == (3, 2)
    p = parse('<table><caption>c</caption><tr><td rowspan="1000000000">a</td><td>b</td></tr><tr><td colspan="1000000000">c</td></tr></table>')
    assert (p.num_rows, p.num_cols) == (10**9, 10**9 + 1) and "<caption>" not in list(p.structure) and "<caption>" in list(p.canonical)
    for bad in ("x<table><tr><td>a</td></tr></table>", "<table><tr><td>a</tr></table>", "<table></table>", "<table><tr><td>a</td></tr></table><p>", None, "<table><tr><td>a</td></tr>"):
        assert not parse(bad).valid
    assert list(parse('<table><tr><td b="1" a="2">x</td></tr></table>').canonical) == list(parse('<table><tr><td a="2" b="1">x</td></tr></table>').canonical)


def test_grid_tables():
    assert r.grid_html("<fcel>Name<fcel>Value<nl><fcel>A<fcel>1") == "<table><tr><td>Name</td><td>Value</td></tr><tr><td>A</td><td>1</td></tr></table>"
    assert r.grid_html(" ") == "<table></table>"
    assert r.grid_html("<lcel>x<nl><ucel>") == '<table><tr><td rowspan="2"></td></tr><tr></tr></table>'


def test_layout_items():
    assert r.layout_items("[{'bbox': [1, 2, 3, 4], 'label': 'Title', 'content': 'x'}]") == [([1, 2, 3, 4], "Title", "x")]
    assert r.layout_items("see {'box': [1,2,3,4], 'type': 'T'} and {'bbox': [1,2]}") == [([1, 2, 3, 4], "T", "")]
    assert r.layout_items("[{'bbox': [1,2,3,4]}, {'bbox': [5,6,7,8]}")[1][0] == [5, 6, 7, 8]
    assert r.layout_items("") == [] and r.layout_items(None) == []


def test_pages(spark):
    sel = lambda s, n: one(spark, t.pages_of(F.col("s"), F.col("n")), s=s, n=n)
    assert sel("1,3-5,3", 5) == [1, 3, 4, 5] and sel(" ", 2) == [1, 2]
    for bad in ("5-3", "0", "1,9", "a", ","):
        assert sel(bad, 5) is None


def test_boxes(spark):
    assert one(spark, t.box_pixels(F.array(*[F.lit(500.0)] * 4), F.lit(100), F.lit(100))) == [50, 50, 51, 51]
    assert one(spark, t.box_pixels(F.array(F.lit(900.0), F.lit(-5.0), F.lit(100.0), F.lit(2000.0)), F.lit(100), F.lit(100))) == [10, 0, 90, 100]


def test_text(spark):
    assert one(spark, t.repeated_end(F.repeat(F.lit("10\n"), 200))) is True
    assert one(spark, t.repeated_end(F.repeat(F.lit("a"), 16))) is False and one(spark, t.repeated_end(F.repeat(F.lit("a"), 17))) is True
    assert one(spark, t.formula(F.lit(r"$$\begin{aligned} a \tag{4} \end{aligned}$$"))) == "$$\n\\begin{aligned}\na\n\\end{aligned}\n$$\n4"
    assert one(spark, t.cut_table(F.lit("a <TABLE>x</table> b</Table> c"))) == "<TABLE>x</table> b</Table>" and one(spark, t.cut_table(F.lit("none"))) == ""
    assert one(spark, t.aligned_similarity(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == 0.5
    assert one(spark, t.element_markdown(F.lit(" Section_header"), F.lit("a\nb"))) == "## a\n## b"


def test_splits_and_shards(spark):
    pages = spark.createDataFrame([(f"n/doc{d}_page{p}",) for d in range(20) for p in (1, 2)], "key string")
    s = corpus.split_by_document(pages, "key", 0.25)
    assert s.count() == 40 and s.select("document_id", "split").distinct().count() == 20
    again = {(x.key, x.split) for x in corpus.split_by_document(pages.repartition(17), "key", 0.25).collect()}
    assert again == {(x.key, x.split) for x in s.select("key", "split").collect()}
    assert corpus.assign_shards(s, "key", 2).groupBy("shard").count().agg(F.sum("count")).first()[0] == 40


def test_batches_and_samples(spark):
    v = spark.range(10).withColumnRenamed("id", "k")
    n = [x["count"] for x in corpus.batches(v, 2, "k", limit=5).groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert n == [2, 2, 1]
    assert corpus.batches(v, 4, "k", drop_last=True).count() == 8
    g = spark.range(32).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"))
    assert {x["count"] for x in corpus.share_per_group(g, "g", "k", 0.75, 1).groupBy("g").count().collect()} == {12}
    with pytest.raises(ValueError, match="fewer"):
        corpus.exact_sample(v, 11, "k", 1, strict=True)


def test_policies(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 2000)], "source string, n int")
    assert corpus.fits(rows, "source", F.col("n"), 100).count() == 1
    with pytest.raises(ValueError, match="too long: b"):
        corpus.fits(rows, "source", F.col("n"), 100, policy="error")
    with pytest.raises(ValueError, match="no label for a"):
        corpus.pair_by_key(rows.withColumnRenamed("source", "key"), rows.limit(0).withColumnRenamed("source", "key"))
    with pytest.raises(ValueError, match="missing columns: x, y"):
        corpus.require_columns(rows, ["y", "n", "x"])


def test_policy_loss(spark):
    def loss(lp, old, adv, **kw):
        df = spark.createDataFrame([(1, lp, old, old, 1, adv)], "completion_id int, lp double, old_lp double, ref_lp double, mask int, advantage double")
        return runs.policy_loss(df, 1, **kw).first().loss

    assert loss(-1.0, -1.0, 0.0) == 0
    assert loss(math.log(2), 0.0, 1.0) == pytest.approx(-1.2)
    assert loss(math.log(0.75), 0.0, 1.0) == pytest.approx(-0.75)


def test_table_rewards(spark):
    good = "<table><tr><td>a</td></tr></table>"
    rows = spark.createDataFrame([(1, good, good, 1, 1, 1, False, 0), (2, "nothing", good, 1, 1, 1, False, 0)], "sample_id int, completion string, table_html string, num_rows int, num_cols int, num_cells int, merged boolean, prompt_id int")
    got = {x.sample_id: x for x in table_html.advantages(table_html.rewards(rows)).collect()}
    assert got[1].reward == pytest.approx(3.75) and got[2].reward == 0 and got[1].advantage == pytest.approx(1.875)


def test_document_assembly(spark):
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "doc_id string, page_number int, markdown string")
    got = {x.doc_id: x.content for x in layout.document_markdown(pages).collect()}
    assert got == {"a": "<!-- Page 1 -->\n\nx\n\n<!-- Page 2 -->\n\ny", "b": "z"}


def test_files(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.PNG").write_bytes(bytes.fromhex("89504E470D0A1A0A00"))
    (tmp_path / "img" / "b.jpg").write_bytes(b"not an image")
    (tmp_path / "img" / "c.txt").write_text("x")
    found = readers.image_folder(spark, str(tmp_path / "img"))
    assert [(x.name, x.label) for x in found.collect()] == [("a.PNG", "img"), ("b.jpg", "img")]
    good, bad = readers.decodable(readers.files(spark, str(tmp_path / "img"), content=True))
    assert good.count() == 1 and bad.count() == 1
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "d1.json").write_text('﻿{"a": 1}')
    assert readers.json_files(spark, str(tmp_path / "j")).first().doc_id == "d1"
    (tmp_path / "j" / "d2.json").write_text("{")
    with pytest.raises(Exception, match="d2.json"):
        readers.json_files(spark, str(tmp_path / "j")).collect()
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "p.jsonl").write_text('{"index": 1, "v": "a"}\nbroken\n{"index": 1, "v": "b"}\n{"v": "c"}\n')
    assert [(x["index"], x.v) for x in readers.prediction_log(spark, str(tmp_path / "log"), "index int, v string").collect()] == [(1, "b")]


def test_table_files(spark, tmp_path):
    for name, text in (("a.csv", "k,v\n1,x\n"), ("a.tsv", "k\tv\n1\tx\n"), ("a.json", '[{"k": 1, "v": "x"}]'), ("a.jsonl", '{"k": 1, "v": "x"}\n')):
        (tmp_path / name).write_text(text)
        row = readers.table_file(spark, str(tmp_path / name)).first()
        assert (str(row.k), row.v) == ("1", "x")
    with pytest.raises(ValueError, match="no reader"):
        readers.table_file(spark, "a.xyz")
    (tmp_path / "m.json").write_text('[{"id": "a", "split": null, "num_images": 2}, {"id": "b"}]')
    assert [(x.id, x.split, x.num_images) for x in readers.manifest(spark, str(tmp_path / "m.json")).collect()] == [("a", None, 2), ("b", None, None)]
    with pytest.raises(ValueError, match="unknown split"):
        readers.splits(spark, str(tmp_path), "dev")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, None), (3, "test")], "k int, split string")
    sinks.write_splits(rows, str(tmp_path / "s"), row_bytes=F.lit(10), shard_bytes=100)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {(x.split, x.rows) for x in sinks.split_counts(back).collect()} == {("train", 2), ("test", 1)}
    assert "Total rows: 3" in sinks.card(sinks.split_counts(rows), "T").first().card
    text = sinks.report(spark.range(1).select(F.lit(0.5).alias("score")), rows.select("k")).first().value
    assert text == '{"summary":{"score":0.5},"documents":[{"k":1},{"k":2},{"k":3}]}'


def test_upsert_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, seq int, v string").coalesce(1).write.parquet(str(source))
    for _ in range(2):
        stream = spark.readStream.schema("k int, seq int, v string").parquet(str(source))
        jobs.upserting(stream, "k", "seq", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([(1, 2, "c")], "k int, seq int, v string").coalesce(1).write.mode("append").parquet(str(source))
    assert {(x.k, x.v) for x in jobs.upserted(spark, str(tmp_path / "out"), "k", "seq").collect()} == {(1, "c"), (2, "b")}


def test_numbers_on_many_partitions(spark):
    """Every row keeps one number, whatever the width of the rows and the partitions."""
    n = 1_500_000
    rows = spark.range(n, numPartitions=9).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("x"), 480).alias("wide"))
    got = corpus.numbered(rows, "k").agg(F.count("*"), F.count_distinct("_i"), F.min("_i"), F.max("_i"), F.count_if(F.col("_i") != F.col("k"))).first()
    assert tuple(got) == (n, n, 0, n - 1, 0)
    few = rows.select("k").limit(0)
    assert corpus.numbered(few, "k").count() == 0 and corpus.batches(few, 4, "k", drop_last=True).count() == 0


def test_hot_group_share(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).alias("g"))
    got = {x.g: x["count"] for x in corpus.share_per_group(rows, "g", "k", 0.25, 3).groupBy("g").count().collect()}
    assert got == {7: 4950}  # groups of one row give none


def test_exact_leaves(spark):
    m = kie_score(spark, '{"a.b":1,"a":{"b":2}}', '{"a":{"b":2}}')
    assert (m.union_leaves, m.score) == (2, 0.5)
    assert kie_score(spark, '{"a":1,"a":2}', '{"a":2}').score == 1
    assert kie_score(spark, '{"n":9007199254740993}', '{"n":9007199254740992}').score == 0
    assert kie_score(spark, '{"n":123456789012345678901234567890}', '{"n":123456789012345678901234567891}').score == 0
    m = kie_score(spark, '{"a":1}', "{broken")
    assert (m.key_precision, m.key_recall, m.key_f1, m.score) == (0, 0, 0, 0)
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") == "false"


def test_repeated_answers_and_null_names(spark):
    rows = spark.createDataFrame([(None, "1", "{\"a\":1}", "{\"a\":1}"), (None, "1", "{\"a\":2}", "{\"a\":1}"), ("", "1", None, None)], "variant string, source string, prediction string, reference string")
    got = sorted((x.variant is None, x.tp, x.n_predicted, x.n_reference, x.exact_match) for x in json_bench.prediction_scores(rows).collect())
    assert got == [(False, 0, 0, 0, False), (True, 0, 1, 1, False), (True, 1, 1, 1, True)]


def test_completion_value(spark):
    text = lambda x: one(spark, t.completion_value(F.parse_json(F.col("j"))), j=x)
    assert text('"a"') == "a" and text('{"content":"b"}') == "b" and text("5") == "" and text("{}") == "" and text("null") == ""
    assert text('[{"type":"text","content":"a"},{"type":"image","content":"x"},{"content":[{"content":"b"},"c"]},"d",[]]') == "abcd"
    with pytest.raises(Exception, match="nested too deeply"):
        text('{"content":{"content":{"content":{"content":{"content":"x"}}}}}')


def test_label_errors(spark):
    labels = lambda ids, mask: one(spark, t.assistant_labels(F.col("i"), F.col("m"), F.array(F.lit(8), F.lit(9)), 2), i=ids, m=mask)
    assert labels([8, 9, 1, 8, 9, 5, 2, 0], [1, 1, 1, 1, 1, 1, 1, 0]) == [-100] * 5 + [5, 2, -100]
    for bad, why in ([1, 2], "no target marker"), ([1, 8, 9], "no target tokens"), ([8, 9, 5], "no end token"):
        with pytest.raises(Exception, match=why):
            labels(bad, [1] * len(bad))


def test_required_parts(spark):
    with pytest.raises(Exception, match="no complete"):
        one(spark, t.cut_table(F.lit("none"), required=True))
    docs = spark.createDataFrame([("a",), ("b",)], "stem string")
    made = spark.createDataFrame([("a", "x")], "stem string, template string")
    with pytest.raises(Exception, match="missing template for b"):
        kie.with_templates(docs, made).collect()
    with pytest.raises(ValueError, match="use write_report"):
        sinks.report(spark.range(1), spark.range(5), most=4)
    rows = spark.createDataFrame([(1, [1], 2, "<table><tr><td>a</td></tr></table>")], "sample_id int, images array<int>, num_images int, table_html string")
    with pytest.raises(Exception, match="as many images"):
        table_html.dataset_summary(rows, rows).collect()
    with pytest.raises(ValueError, match="no rows left"):
        corpus.require_rows(docs.limit(0))
    assert [x.k for x in corpus.first_n(spark.range(9).withColumnRenamed("id", "k"), 3, "k").collect()] == [0, 1, 2]


def test_pinned_revision(spark, tmp_path):
    for revision, k in (("r1", 1), ("r2", 2)):
        spark.range(k).write.parquet(str(tmp_path / revision / "data" / "train-0"))
    assert readers.splits(spark, str(tmp_path), "train", revision="r2").count() == 2


def test_seeded_order(spark):
    v = spark.range(50).withColumnRenamed("id", "k")
    order = lambda e, n: [x.k for x in corpus.seeded_order(v.repartition(n), "k", 3, e).collect()]
    assert order(0, 1) == order(0, 7) != order(1, 1) and sorted(order(1, 1)) == list(range(50))


def test_repeated_ends_against_plain_version(spark):
    import random

    def ends(x):
        return any(x.endswith(x[-n:] * (math.floor(4 * (1 + 3 / n)) + 1)) for n in range(1, min(250, len(x)) + 1))

    rng = random.Random(2)
    rows = []
    for k in range(400):
        unit = "".join(rng.choice("ab\né") for _ in range(rng.randrange(1, 260)))
        rows.append((k, "x" * rng.randrange(3) + unit * rng.randrange(0, 20) + ("y" * rng.randrange(55) if rng.random() < 0.3 else "")))
    want = {k for k, x in rows if ends(x) or (len(x) > 50 and ends(x[:-50]))}
    got = {x.k for x in spark.createDataFrame(rows, "k int, x string").filter(t.repeated_end(F.col("x"))).collect()}
    assert got == want and 50 < len(want) < 350


def test_files_of_a_stream_and_skips(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"xyz")
    rows = jobs.finished(jobs.incoming_files(spark, str(tmp_path / "in")).select("length"), "append", str(tmp_path / "cp"))
    assert [x.length for x in rows.collect()] == [3]
    assert jobs.counting_skips(spark.range(10), F.col("id") < 3).count() == 7


def test_broken_layouts_stay_cheap():
    assert r.layout_items("{" * 20_000 + "[" * 20_000) == []
    assert sorted(x[0] for x in r.layout_items("so {'x': {'bbox': [1,2,3,4]}, 'bbox': [5,6,7,8]")) == [[1, 2, 3, 4], [5, 6, 7, 8]]
