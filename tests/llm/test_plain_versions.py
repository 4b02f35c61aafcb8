"""Packing and language-model scores against plain loops, one document and one step at a time."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import lm, packing


def plain_bins(lengths, capacity):
    """Best-two-fit, one bin after the other over single documents."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        items, room = [], capacity
        for x in list(left):  # longest first
            if x <= room:
                items.append(x)
                left.remove(x)
                room -= x
        if len(items) > 1 and room:
            smallest = items.pop()
            gap = room + smallest
            left.append(smallest)
            best = max(((a + b, a, b) for k, a in enumerate(left) for j, b in enumerate(left) if j > k and smallest < a + b <= gap), default=None)
            chosen = sorted(best[1:]) if best else [smallest]
            if best:  # of equal sums the one the plan takes: its first part is the shortest
                chosen = min((sorted((a, b)) for k, a in enumerate(left) for j, b in enumerate(left) if j > k and a + b == best[0]))
            for x in chosen:
                left.remove(x)
            items += sorted(chosen, reverse=True)
        left.sort(reverse=True)
        bins.append(tuple(items))
    return Counter(bins)


@pytest.mark.parametrize("seed", range(12))
def test_the_plan_is_that_of_single_documents(seed):
    rng = random.Random(seed)
    capacity = rng.choice([32, 64, 100])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, 12)]) for _ in range(rng.choice([1, 20, 120]))]
    planned = Counter()
    for items, times in packing.best_two_fit(dict(Counter(lengths)), capacity):
        planned[tuple(items)] += times
    assert planned == plain_bins(lengths, capacity)


def test_scores_by_a_plain_loop(spark):
    rng = random.Random(4)
    common, some = [f"w{k}" for k in range(70)], [f"t{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(common, k=40) + rng.choices(some, k=8) + [f"rare{k % 9}", f"once{k}"])) for k in range(60)] + [(100, "w1 never seen t2"), (101, ""), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held_out = F.col("doc_id") >= 100
    counts = lm.count_words(docs.filter(~held_out)).groupBy("h").agg(F.sum("c").alias("c")).cache()
    words = lm.vocabulary(counts, head=66, least=5)  # words beyond the head in classes of their counts, and rare ones
    assert words.symbols > words.head + 1 and words.rare_types > 9
    model = lm.train_gru(lm.training_windows(docs.filter(~held_out), words, 16), words, size=6)
    got = {r.doc_id: r.score for r in lm.score_texts(docs, held_out, counts, words, model).collect()}
    c_of = {r.h: r.c for r in counts.collect()}
    end = int(words.symbols_of(np.array([lm.END]))[0])
    w = {k: v.astype(np.float64) for k, v in model.w.items()}

    def step(x, h):
        n = model.size
        a, u = w["x"][x] + w["b"], h @ w["u"]
        z, r = (1 / (1 + np.exp(-(a[k * n : (k + 1) * n] + u[k * n : (k + 1) * n]))) for k in range(2))
        new = np.tanh(a[2 * n :] + r * u[2 * n :])
        return z * h + (1 - z) * new

    def soft(v, k):
        return v[k] - v.max() - math.log(np.exp(v - v.max()).sum())

    for doc_id, text in rows:
        h, x, total = np.zeros(model.size), end, 0.0
        (hashes,) = lm.tokens(pa.array([text], pa.string()))
        for word in hashes:
            h = step(x, h)
            x = int(words.symbols_of(np.array([word]))[0])
            klass = int(words.klass[x])
            total += soft(h @ w["c"] + w["cb"], klass) / math.log(10)
            if x < words.head:
                first = klass * lm.CLASS
                own = slice(first, min(words.head, first + lm.CLASS))
                total += soft(w["o"][own] @ h + w["ob"][own], x - first) / math.log(10)
            elif x < words.symbols - 1:
                at, _ = words.look(np.array([word]))
                total += float(words.share[at[0]])
            else:
                c = c_of.get(int(word.astype(np.int64)), 0)
                total += math.log10((c - words.discount) / words.rare_total if c else words.discount * words.rare_types / words.rare_total)
        assert got[doc_id] == pytest.approx(total, rel=1e-4), doc_id
