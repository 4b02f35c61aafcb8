"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits. One binary logistic classifier per bit
reads hashed byte trigrams of the lower-cased letters; a text's language is the one
whose codeword has the least weighted logistic loss against the bits' outputs. A
text whose two best codewords are nearly as close is flagged as ambiguous.

Null texts and texts without a letter are `und` with score 0 and are not ambiguous.
Repeated rows are decoded alike; null languages teach nothing; other columns are not
read; with no language to learn every text is `und`, with one every text with a
letter is that language. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import TO_LOWER, appended, chunks, fold, sampled

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPREAD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass
class LanguageModel:
    names: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # 2^places x bits
    bias: np.ndarray  # bits
    trust: np.ndarray  # bits: weight of a bit's loss
    places: int
    margin: float


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """All splits of few languages; for more, random words chosen far apart."""
    if n <= 5:
        columns = [[1 if (c >> k) & 1 else -1 for k in range(n)] for c in range(1, 2 ** (n - 1))] if n > 1 else [[1]]
        return np.array(columns, np.float32).T
    rng, bits = np.random.default_rng(seed), int(10 * np.ceil(np.log2(n)))
    best, most = None, -1
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = code @ code.T
        least = (code.shape[1] - apart[~np.eye(n, dtype=bool)].max()) / 2
        if least > most:
            best, most = code, least
    return best


def trigrams(data: np.ndarray, rows: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams over letters and single gaps, and per row its first one (one
    more entry closes the last)."""
    letter = LETTERS[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of what is between letters, one byte stays
    keep[rows[:-1][rows[:-1] < len(data)]] = True
    at = np.flatnonzero(keep)
    x = np.where(letter[at], TO_LOWER[data[at]], np.uint8(32)).astype(np.uint32)
    first = np.searchsorted(at, rows)
    if len(x) < 3:
        return np.empty(0, np.int64), np.zeros(len(rows), np.int64)
    h = x[:-2] * _SPREAD[0] + x[1:-1] * _SPREAD[1] + x[2:] * _SPREAD[2]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h >> np.uint32(32 - places)).astype(np.int64)
    inside = np.ones(len(h), bool)
    for back in (1, 2):  # a trigram stays within its row
        edge = first[1:-1] - back
        inside[edge[(edge >= 0) & (edge < len(h))]] = False
    before = np.concatenate(([0], np.cumsum(inside)))
    return h[inside], before[np.minimum(first, len(h))]


def fit_bits(examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, code: np.ndarray, places: int, epochs: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """AdaGrad logistic regression of all bits at once; the last place is the bias.
    A bit's trust is its accuracy above chance over the last pass."""
    w = np.zeros((2**places + 1, code.shape[1]), np.float64)
    n = np.full_like(w, 1e-6)
    right = np.zeros(code.shape[1])
    for epoch in range(epochs):
        right[:] = 0
        for e in np.random.default_rng(epoch).permutation(len(examples)):
            k, x = examples[e]
            target = code[y[e]]
            f = x @ w[k]
            right += f * target > 0
            g = -target / (1.0 + np.exp(np.clip(target * f, -35, 35)))
            step = np.outer(x, g)
            n[k] += step * step
            w[k] -= rate * step / np.sqrt(n[k])
    trust = np.maximum(0.05, 2 * right / max(1, len(examples)) - 1)
    return w[:-1].astype(np.float32), w[-1], trust / trust.sum()


def example(k: np.ndarray, n: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.sqrt(n)
    x = x / max(1e-9, np.linalg.norm(x))
    return np.append(k, 2**places), np.append(x, 1.0)


class Examples:
    """Counts as they came, made into an example each time one is asked for."""

    def __init__(self, held: list[tuple[bytes, bytes]], places: int):
        self.held, self.places = held, places

    def __len__(self) -> int:
        return len(self.held)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k >= len(self.held):
            raise IndexError(k)
        at, n = self.held[k]
        return example(np.frombuffer(at, np.uint16 if self.places <= 16 else np.uint32).astype(np.int64), np.frombuffer(n, np.uint32).astype(np.int64), self.places)


def fit_language(docs: DataFrame, training, *, per_language: int = 1500, most_rows: int = 12_000, places: int = 14, epochs: int = 3, rate: float = 0.3, margin: float = 0.02) -> LanguageModel:
    """Learn from the rows where `training` holds and lang is not null: all of them,
    or a sample of about `per_language` rows of each language, and of `most_rows` over all languages, by a
    hash of doc_id and text; of the chosen, rows equal in both teach once.
    Tasks count the trigrams of whole texts; the one fitting task holds the counts, 6 bytes each and
    at most 2^places a text."""
    given = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in given.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    names = sorted(counts)
    code = codewords(len(names)) if names else np.zeros((0, 1), np.float32)
    if len(names) < 2:
        return LanguageModel(names, code, np.zeros((2**places, 1), np.float32), np.ones(1), np.ones(1), places, margin)
    per_language = min(per_language, most_rows / len(names))
    share = F.element_at(F.create_map(*[x for n in names for x in (F.lit(n), F.lit(min(1.0, per_language / counts[n])))]), F.col("lang"))
    numbers = F.element_at(F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))]), F.col("lang"))
    chosen = given.filter(sampled(F.xxhash64("doc_id", "text"), share)).select(F.col("text").cast("string").alias("text"), numbers.alias("y"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"))
    chosen = chosen.dropDuplicates()

    def count(batches):
        for batch in batches:
            at, n = [], []
            for _, _, data, rows in chunks(batch.column(0)):
                h, ends = trigrams(data, rows, places)
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    k, times = np.unique(h[a:b], return_counts=True)
                    at.append(k.astype(np.uint16 if places <= 16 else np.uint32).tobytes()), n.append(times.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(n, pa.binary()), batch.column(1), batch.column(2)], names=["at", "n", "y", "key"])

    def train(batches):
        examples, y, keys = [], [], []
        for batch in batches:
            y += batch.column(2).to_pylist()
            keys += batch.column(3).to_pylist()
            examples += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        order = sorted(range(len(y)), key=lambda k: (keys[k], y[k], len(examples[k][0])))
        w, bias, trust = fit_bits(Examples([examples[k] for k in order], places), np.array([y[k] for k in order], int), code, places, epochs, rate)
        yield pa.RecordBatch.from_pydict({"what": ["w", "b", "t"], "bytes": [w.tobytes(), bias.tobytes(), trust.tobytes()]})

    made = {r.what: r.bytes for r in chosen.mapInArrow(count, "at binary, n binary, y int, key long").repartition(1).mapInArrow(train, "what string, bytes binary").collect()}
    bits = code.shape[1]
    return LanguageModel(names, code, np.frombuffer(made["w"], np.float32).reshape(-1, bits), np.frombuffer(made["b"]), np.frombuffer(made["t"]), places, margin)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], prefix: str = "") -> DataFrame:
    """`keep` columns and lang_pred, score (0 to 1) and ambiguous, over whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        m = sent.value
        code, bits = m.code.astype(np.float64), m.code.shape[1]
        names, scores, doubts = [], [], []
        for first, end, data, rows in chunks(texts, 1 << 20):
            plain = np.concatenate(([0], np.cumsum(LETTERS[data] & (data < 128))))
            beyond = np.concatenate(([0], np.cumsum(data >= 128)))
            has = plain[rows[1:]] > plain[rows[:-1]]
            for k in np.flatnonzero(~has & (beyond[rows[1:]] > beyond[rows[:-1]])):
                has[k] = any(c.isalpha() for c in data[rows[k] : rows[k + 1]].tobytes().decode())
            h, at = trigrams(data, rows, m.places)
            out = np.tile(m.bias.astype(np.float64), (end - first, 1))
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if b > a:
                    n = np.bincount(h[a:b])
                    place = np.flatnonzero(n)
                    x = np.sqrt(n[place])
                    out[k] += (x @ m.weights[place]) / np.linalg.norm(x)
            if not m.names:
                has[:] = False
            if len(m.names) > 1:
                loss = np.stack([np.logaddexp(0, -out * code[c]) @ m.trust for c in range(len(m.names))], 1)
                order = np.sort(loss, 1)
                best = loss.argmin(1)
                p = 1.0 / np.exp(-bits * (loss - order[:, :1])).sum(1)
                doubt = order[:, 1] - order[:, 0] < m.margin
            else:
                best, p, doubt = np.zeros(end - first, int), np.ones(end - first), np.zeros(end - first, bool)
            names += [m.names[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist(), strict=True)]
            scores.append(np.where(has, p, 0.0))
            doubts.append(doubt & has)
        return [names, np.concatenate(scores) if scores else [], np.concatenate(doubts) if doubts else []]

    return appended(docs, [(prefix + "lang_pred", "string", pa.string()), (prefix + "score", "double", pa.float64()), (prefix + "ambiguous", "boolean", pa.bool_())], score, keep)


def op8_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt where crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    return identify(docs, fit_language(docs, ~held_out), ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """Documents whose language is known and clear, with all their columns: those
    without a letter and those between two languages go."""
    model = fit_language(docs, fold(F.col("doc_id"), 4) != 2)
    found = identify(docs, model, docs.columns, "_docloom_")
    return found.filter((F.col("_docloom_lang_pred") != "und") & ~F.col("_docloom_ambiguous")).drop("_docloom_lang_pred", "_docloom_score", "_docloom_ambiguous")
