"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and
skip-grams.

Features are the presence of a word, a word pair, or a pair with one or two words
between, and the share of words with a certain stem (their first 5, 6 or 7 bytes;
inflected abuse is seldom twice the same word), hashed into 2^bits places. Each coordinate has its own learning rate, and
L1 keeps most weights at zero, so the model is a short list that every task gets.

Null and empty texts have no feature and get the score of the intercept. Null
doc_ids never join a label but are scored. Repeated rows are scored alike; a
document with several labels is toxic if one says so. Other columns are not read.
An empty label table gives score 0.5 - just below, so nothing is predicted toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import MARKS, appended, chunks, fold, mix, sampled, word_hashes, word_spans

_PAIR = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]


@dataclass
class Toxicity:
    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float


def features(data: np.ndarray, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place) of each word, pair, skip-gram and stem of the rows of a run, and
    the number of words of each row. Stems take the upper half of the places."""
    starts, ends, first = word_spans(data, rows, MARKS)
    words = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(first))
    shift, upper = np.uint64(65 - bits), np.int64(1 << (bits - 1))
    out_row, out = [row], [(words >> shift).astype(np.int64)]
    for gap, factor in enumerate(_PAIR, 1):
        if len(words) > gap:
            same = row[:-gap] == row[gap:]
            out.append((mix(words[:-gap] * factor + words[gap:]) >> shift)[same].astype(np.int64))
            out_row.append(row[:-gap][same])
    for length in (5, 6, 7):
        stems = word_hashes(data, starts, np.minimum(ends, starts + length))
        out.append((mix(stems + np.uint64(length)) >> shift).astype(np.int64) + upper)
        out_row.append(row)
    return np.concatenate(out_row), np.concatenate(out), np.diff(first)


def strength(place: np.ndarray, count: np.ndarray, n_words: np.ndarray, bits: int) -> np.ndarray:
    """1 for what is there; for stems their share of the words, times 64, up to 1."""
    return np.where(place >> (bits - 1) == 0, 1.0, np.minimum(1.0, 64.0 * count / (n_words + 16.0)))


def distinct(row: np.ndarray, place: np.ndarray, n_words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (row, place) once, with its strength."""
    pairs, count = np.unique(row << bits | place, return_counts=True)
    row, place = pairs >> bits, pairs & (2**bits - 1)
    return row, place, strength(place, count, n_words[row], bits)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> Toxicity:
    """Online FTRL-proximal; the last place is the intercept, which has no L1."""
    z, n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)
    lam = np.full(2**bits + 1, l1)
    lam[-1] = 0.0

    def weights(k):
        zk = z[k]
        return np.where(np.abs(zk) <= lam[k], 0.0, -(zk - np.sign(zk) * lam[k]) / ((beta + np.sqrt(n[k])) / alpha + l2))

    for epoch in range(epochs):
        for e in np.random.default_rng(epoch).permutation(len(examples)):
            k, x = examples[e]
            w = weights(k)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - labels[e]) * x
            sigma = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha
            z[k] += g - sigma * w
            n[k] += g * g
    w = weights(np.arange(2**bits + 1))
    kept = np.flatnonzero(w[:-1])
    return Toxicity(bits, kept.astype(np.int32), w[kept].astype(np.float32), float(w[-1]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, bits: int = 20, max_rows: int = 12_000, max_bytes: int = 48_000_000, alpha: float = 0.5, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, epochs: int = 3, folds: int = 5) -> Toxicity:
    """Fit on labelled rows outside the held-out fold: all of them, or a sample by hashes
    of about `max_rows` rows and `max_bytes` bytes of text, which bound what one task holds: seven features of 8 bytes a
    word are about ten times the text, half a gigabyte; rows equal in doc_id and text teach once. The weights that L1 leaves
    come to the driver, 2^bits at most."""
    given = labels.filter((fold(F.col("doc_id"), folds) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    n = given.count()
    given = given.filter(sampled(F.col("doc_id"), min(1.0, max_rows / max(n, 1))))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(given), "doc_id").dropDuplicates(["doc_id", "text"])  # about max_rows ids of 12 bytes
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first() if n else (0, 0)
    if rows > 2 * max_rows or size > max_bytes:  # ids of many rows, or long texts
        texts = texts.filter(sampled(F.xxhash64("doc_id", "text"), min(max_rows / rows, max_bytes / max(size, 1))))
    schema = pa.schema([("key", pa.int64()), ("label", pa.int32()), ("places", pa.list_(pa.int32())), ("strengths", pa.list_(pa.float32()))])

    def extract(batches):
        for batch in batches:
            for first, _, data, rows in chunks(batch.column(0)):
                row, place, x = distinct(*features(data, rows, bits), bits)
                at = np.searchsorted(row, np.arange(len(rows)))
                spans = list(zip(at[:-1], at[1:], strict=True))
                places = [np.append(place[a:b], 2**bits).astype(np.int32) for a, b in spans]
                strengths = [np.append(x[a:b], 1.0).astype(np.float32) for a, b in spans]
                n = len(spans)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, n), batch.column(2).slice(first, n), pa.array(places, pa.list_(pa.int32())), pa.array(strengths, pa.list_(pa.float32()))], schema=schema)

    def train(batches):
        keys, examples, y = [], [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
            examples += [(k.values.to_numpy().astype(np.int32), x.values.to_numpy().astype(np.float32)) for k, x in zip(batch.column(2), batch.column(3), strict=True)]
        order = sorted(range(len(keys)), key=lambda k: (keys[k], len(examples[k][0])))
        model = ftrl([examples[k] for k in order], [y[k] for k in order], bits, alpha, beta, l1, l2, epochs)
        yield pa.RecordBatch.from_pydict({"place": model.index.astype(np.int64).tolist() + [-1], "weight": model.weight.astype(float).tolist() + [model.bias]})

    found = texts.select("text", "doc_id", "_toxic").mapInArrow(extract, "key long, label int, places array<int>, strengths array<float>").repartition(1)
    rows = found.mapInArrow(train, "place long, weight double").collect() if n else []
    held = {r.place: r.weight for r in rows}
    bias = held.pop(-1, -1e-9)
    index = np.array(sorted(held), np.int32)
    return Toxicity(bits, index, np.array([held[int(k)] for k in index], np.float32), bias)


def score_toxicity(docs: DataFrame, model: Toxicity, keep: list[str], name: str = "score") -> DataFrame:
    """`keep` columns and the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    made: list[np.ndarray] = []

    def score(texts):
        m = sent.value
        if not made:
            table = np.zeros(2**m.bits, np.float32)
            table[m.index] = m.weight
            made.append(table)
        out = np.full(len(texts), m.bias)
        for first, end, data, rows in chunks(texts):
            row, place, n_words = features(data, rows, m.bits)
            hit = np.flatnonzero(made[0][place])
            row, place, x = distinct(row[hit], place[hit], n_words, m.bits)
            out[first:end] += np.bincount(row, made[0][place] * x, end - first)
        return [1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))]

    return appended(docs, [(name, "double", pa.float64())], score, keep)


def op3_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt outside the fold crc32(doc_id) mod 5 = 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    scored = score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents that score below the threshold, with all their columns."""
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs, model, docs.columns, "_docloom_score").filter(F.col("_docloom_score") < threshold).drop("_docloom_score")
