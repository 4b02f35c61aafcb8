"""What the models learn from: every token, and whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import language, lm


def test_all_training_tokens_are_learnt_from(spark):
    rng = random.Random(3)
    rows = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 63, 64, 65, 128, 1000)]
    docs = spark.createDataFrame([(x,) for x in [*rows, None]], "text string").coalesce(1)
    words = lm.vocabulary(lm.count_words(docs).groupBy("h").agg(F.sum("c").alias("c")))
    windows = [np.frombuffer(x.w, lm.symbol_type(words)) for x in lm.training_windows(docs, words, 64).collect()]
    end = int(words.symbols_of(np.array([lm.END]))[0])
    want = [np.append(end, words.symbols_of(t)) for t in lm.tokens(pa.array([*rows, None], pa.string()))]
    assert sum(len(w) - 1 for w in windows) == words.total == sum(len(x.split()) if x else 0 for x in rows) + 8
    at = 0
    for t in want:
        for a in range(0, len(t) - 1, 64):
            assert windows[at].tolist() == t[a : a + 65].tolist()
            at += 1
    assert at == len(windows)


def test_words_after_the_first_window_are_learnt(spark):
    """The tail of the texts repeats in a fixed order that counts alone do not tell."""
    rng = random.Random(6)
    tail = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(k, " ".join([*rng.choices("abcdefgh", k=64), *[tail] * 10])) for k in range(150)], "doc_id long, text string").repartition(4)
    got = lm.lm_scores(docs, F.col("doc_id") % 7 == 2).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > 0.5 * got.b


def test_language_learns_outside_the_middle(spark):
    """Only the ends of the training texts tell the languages apart."""
    ends = {"xx": "lorem ipsum dolor sit amet ", "yy": "quick brown foxes jump over "}
    rows = [(k, v * 40 + "0 " * 15000 + v * 40, v, n) for k, (n, v) in enumerate([*ends.items()] * 12)]
    docs = spark.createDataFrame([(k, long, n) for k, long, _, n in rows], "doc_id long, text string, lang string")
    short = spark.createDataFrame([(k, v * 3, n) for k, _, v, n in rows[:2]], "doc_id long, text string, lang string")
    model = language.fit_language(docs, F.lit(True))
    assert {x.lang: x.lang_pred for x in language.identify(short, model, ["lang"]).collect()} == {"xx": "xx", "yy": "yy"}


def test_the_language_model_does_not_depend_on_partitions(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(["a", "b", "c", "dd", f"r{k}"], k=rng.choice([0, 5, 200, 900])))) for k in range(60)]
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
            out = lm.lm_scores(docs, F.col("doc_id") % 7 == 2, task_windows=40)  # several tasks a round
            seen.append({x.doc_id: x.score for x in out.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == pytest.approx(seen[1], rel=1e-7)  # texts are scored in lanes, whose sums are in single precision


def test_the_language_model_takes_texts_apart_twice(spark):
    """Once to count words, once for training and scores together."""
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    rows = [(k, f"a b c{k % 5} d") for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs = docs.select("doc_id", F.udf(read, "string")("text").alias("text"))
    assert lm.lm_scores(docs, F.col("doc_id") % 7 == 2).count() == 70
    assert 70 < seen.value <= 140


def test_words_are_found_and_chosen_alike_on_all_paths():
    rng = np.random.default_rng(4)
    for n in (1, 5, 3000):
        h = np.unique(np.append(rng.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True), np.array([0, 2**64 - 1], np.uint64)[: n % 3]))
        words = lm.Vocabulary(h, np.ones(len(h)), np.arange(len(h)), np.zeros(len(h)), 1, 2, np.zeros(2, int), np.zeros(1), 1, 1, 0.0, 0, 0.5)
        ask = np.concatenate((h, h + np.uint64(1), h - np.uint64(1), rng.integers(0, 2**64, 500, dtype=np.uint64)))
        at, there = words.look(ask)
        assert there.tolist() == np.isin(ask, h).tolist() and (h[at[there]] == ask[there]).all() and not at[~there].any()
    h, w, bias = rng.standard_normal((40, 6)), rng.standard_normal((6, 9)), rng.standard_normal(9)
    at = np.arange(40), rng.integers(0, 9, 40)
    logits = h @ w + bias
    want = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    for near in (True, False):
        assert np.allclose(lm.log_softmax(h, w, bias, at, near), want[at])
        e, f, total = lm.softmax(h, w, bias, near)
        assert np.allclose(np.log(e * f / total[:, None]), want)
    assert np.isfinite(lm.log_softmax(h * 1000, w, bias, at, lm.reach(h * 1000, w, bias, 0) < 60.0)).all()


def test_a_text_scores_alike_whatever_follows_it_in_its_lane():
    rng = np.random.default_rng(5)
    words = lm.Vocabulary(np.arange(9, dtype=np.uint64), np.ones(9), np.arange(9), np.zeros(9), 7, 9, np.array([0] * 7 + [1, 2]), np.log(np.full(3, 1 / 3)), 9, 9, 1.0, 1, 0.5)
    gru = lm.Gru(words, 6)
    for k, v in gru.w.items():
        gru.w[k] = rng.standard_normal(v.shape).astype(np.float32)
    texts = [np.append(rng.integers(1, 9, n), 0) for n in rng.choice([0, 1, 3, 12, 40], 50)]
    one = [gru.score([t], 0)[0] for t in texts]
    for lanes, window in ((1, 64), (3, 7), (60, 64)):
        assert np.allclose(gru.score(texts, 0, lanes, window), one, rtol=1e-5)


def test_rows_over_all_languages_are_bounded(spark):
    rows = [(k, f"{'abcdefgh'[k % 4] * 6} {k}", f"l{k % 4}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(docs, F.lit(True), most_rows=80)
    found = language.identify(docs, model, ["lang"])
    assert found.filter("lang = lang_pred").count() == 400
