"""A gated recurrent language model with a class-factored output softmax.

Vocabulary. Word counts cover all training texts. The `head` most frequent words have
embeddings and learned probabilities within classes of 64; the other common words
fall in classes by the logarithm of their count and share it in proportion; all words
below that are one class, shared by absolute discounting with a place for words never
seen. P(word | past) = P(class | past) * P(word | class) sums to one over the known
words and one unknown.

Training. Every training text is cut into consecutive windows of tokens, each with the
token before it, so that every training token is predicted once in training. Tasks run
truncated backpropagation over `steps` tokens, the state carried from one to the next
within a window, and their weights are averaged after each round.

Scoring. Texts run in parallel lanes, one after the other in each lane; the state is
carried through a whole text and reset at its end, so a score is the log-likelihood
of the complete text.

Null texts are empty: their one token is the end. Repeated rows are scored alike. A
null doc_id counts as the empty text in the fold. Empty training data give every
token the same probability; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import chunks, fold, give_back, keep_memory, small_batches, staged, word_hashes, word_spans

END = np.uint64(0xE4D0F7E2B1C9A853)
CLASS = 64


@dataclass
class Vocabulary:
    known: np.ndarray  # hashes of the common words, ascending
    count: np.ndarray  # their counts
    symbol: np.ndarray  # their symbols
    share: np.ndarray  # log10 P(word | class) where it is fixed, else 0
    head: int  # symbols below are head words
    symbols: int  # the last symbol is that of rare words
    klass: np.ndarray  # symbol -> class
    prior: np.ndarray  # log P(class) over all training tokens
    total: int
    distinct: int
    rare_total: float
    rare_types: int
    discount: float

    def look(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the common words (0 where absent) and whether it is there."""
        if not len(self.known):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        shift, first = self.runs
        at = first[words >> shift]
        below = np.flatnonzero(self.known[at] < words)
        while len(below):  # as often as the longest run is long: hashes are spread evenly
            below = below[at[below] < len(self.known) - 1]
            at[below] += 1
            below = below[self.known[at[below]] < words[below]]
        there = self.known[at] == words
        at[~there] = 0
        return at, there

    @cached_property
    def runs(self) -> tuple[np.uint64, np.ndarray]:
        """By how much a hash is shifted to its leading bits, and for each value of these the place of the
        first common word that is not below (the last place, if there is none)."""
        bits = min(20, len(self.known).bit_length() + 2)
        shift = np.uint64(64 - bits)
        first = np.searchsorted(self.known, np.arange(1 << bits, dtype=np.uint64) << shift)
        return shift, np.minimum(first, len(self.known) - 1)

    def symbols_of(self, words: np.ndarray) -> np.ndarray:
        at, there = self.look(words)
        return np.where(there, self.symbol[at] if len(self.known) else 0, self.symbols - 1)


def softmax(h: np.ndarray, w: np.ndarray, bias: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """e and f, with e * f in proportion to each row's probabilities under the softmax of h @ w + bias, and
    the rows' sums of e * f. `near`: no logit is far from zero, so that the bias becomes a factor and no
    row's largest is taken off."""
    e = h @ w
    if near:
        f = np.exp(bias)
    else:
        e += bias
        e -= e.max(1, keepdims=True)
        f = np.ones(e.shape[1], e.dtype)
    np.exp(e, out=e)
    return e, f, e @ f


def log_softmax(h: np.ndarray, w: np.ndarray, bias: np.ndarray, chosen: tuple, near: bool) -> np.ndarray:
    """The log-probability of each row's chosen column (`chosen`: rows and columns)."""
    if near:
        e, f, total = softmax(h, w, bias, near)
        return np.log(e[chosen] * f[chosen[1]] / total)
    e = h @ w
    e += bias
    e -= e.max(1, keepdims=True)
    one = e[chosen]
    return one - np.log(np.exp(e, out=e).sum(1))


def reach(h: np.ndarray, w: np.ndarray, bias: np.ndarray, axis: int) -> float:
    """No entry of h @ w + bias (w's inner axis is `axis`) is further from zero, nor any part of it."""
    if not (h.size and w.size):
        return 0.0
    return float(max(h.max(), -h.min()) * np.abs(w).sum(axis).max() + np.abs(bias).max())


def group_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over runs of rows (the last axis but one) that begin at `first`; two numbers are added at a time."""
    pair = np.result_type(rows.dtype, np.complex64)
    if rows.shape[-1] % 2 or pair.itemsize != 2 * rows.itemsize:
        return np.add.reduceat(rows, first, axis=-2)
    return np.add.reduceat(rows.view(pair), first, axis=-2).view(rows.dtype)


class Gru:
    """Weights in a dict of float32 arrays. The input table holds each symbol's part
    of the three gates."""

    def __init__(self, vocabulary: Vocabulary, size: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        v, self.size = vocabulary, size
        self.head, self.klass = v.head, v.klass
        n_class = int(v.klass.max()) + 1
        self.w = {
            "x": (rng.standard_normal((v.symbols, 3 * size)) * 0.2).astype(np.float32),
            "u": (rng.standard_normal((size, 3 * size)) / np.sqrt(size)).astype(np.float32),
            "b": np.zeros(3 * size, np.float32),
            "c": np.zeros((size, n_class), np.float32),
            "cb": v.prior.astype(np.float32),
            "o": np.zeros((v.head, size), np.float32),
            "ob": np.log(np.maximum(1.0, v.count[np.argsort(v.symbol, kind="stable")][: v.head])).astype(np.float32) if v.head else np.zeros(0, np.float32),
        }

    def step(self, x: np.ndarray, h: np.ndarray):
        n = self.size
        a = self.w["x"][x] + self.w["b"]
        hu = h @ self.w["u"]
        g = 1.0 / (1.0 + np.exp(-(a[:, : 2 * n] + hu[:, : 2 * n])))
        z, r = g[:, :n], g[:, n:]
        new = np.tanh(a[:, 2 * n :] + r * hu[:, 2 * n :])
        return new + z * (h - new), z, r, new, hu[:, 2 * n :]

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """What each symbol, and what each state, gives to the three gates: a block per gate, as whole
        blocks are faster to work on than column ranges."""
        n = self.size
        given = (self.w["x"] + self.w["b"]).reshape(-1, 3, n).transpose(1, 0, 2)
        return np.ascontiguousarray(given), np.ascontiguousarray(self.w["u"].reshape(n, 3, n).transpose(1, 0, 2))

    def log_probs(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Natural-log P(class) * P(head word | class) per row; with `grads`, adds the gradients
        of the negated sum instead and returns, in second place, that of h."""
        w = self.w
        klass = self.klass[target].astype(np.min_scalar_type(len(w["cb"])))  # short numbers are sorted by counting
        order = np.argsort(klass, kind="stable")
        hs, klass, place = h.take(order, axis=0), klass[order], target[order] % CLASS
        bounds = np.searchsorted(klass, np.arange(-(-self.head // CLASS) + 1)).tolist()
        out, some = np.empty(len(h) if grads is None else hs.shape, hs.dtype), 2048  # a run of rows stays near the processor
        near = reach(h, w["c"], w["cb"], 0) < 60.0
        for a in range(0, len(h), some):
            part = hs[a : a + some]
            at = np.arange(len(part)), klass[a : a + some]
            if grads is None:
                out[a : a + some] = log_softmax(part, w["c"], w["cb"], at, near)
                continue
            e, f, total = softmax(part, w["c"], w["cb"], near)
            over = 1.0 / total
            e[at] -= total / f[at[1]]
            grads["c"] += (part * over[:, None]).T @ e * f
            grads["cb"] += over @ e * f
            np.multiply(e @ (w["c"] * f).T, over[:, None], out=out[a : a + some])
        near = reach(h, w["o"], w["ob"], 1) < 60.0
        for c, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            words = slice(c * CLASS, min(self.head, (c + 1) * CLASS))
            for a in range(low, high, some):
                b = min(high, a + some)
                part, at, o = hs[a:b], (np.arange(b - a), place[a:b]), w["o"][words]
                if grads is None:
                    out[a:b] += log_softmax(part, o.T, w["ob"][words], at, near)
                    continue
                e, f, total = softmax(part, o.T, w["ob"][words], near)
                over = 1.0 / total
                e[at] -= total / f[at[1]]
                grads["o"][words] += e.T @ (part * over[:, None]) * f[:, None]
                grads["ob"][words] += over @ e * f
                more = e @ (o * f[:, None])
                more *= over[:, None]
                out[a:b] += more
        home = np.empty_like(order)
        home[order] = np.arange(len(h))
        return (out[home].astype(np.float64), None) if grads is None else (None, out.take(home, axis=0))

    def learn(self, batch: np.ndarray, h: np.ndarray, squares: dict, rate: float) -> np.ndarray:
        """One truncated backpropagation over batch (rows x steps + 1 symbols, -1 where
        a row has ended) from state h; returns the state after it."""
        n, (rows, width) = self.size, batch.shape
        steps = width - 1
        x = np.maximum(batch[:, :-1].T, 0)
        given, u = self.gates()
        given[:2] *= -1.0
        low = u * np.array([-1.0, -1.0, 1.0], u.dtype)[:, None, None]
        h0, kind = h, given.dtype
        z, r, c, hu2, states = (np.empty((steps, rows, n), kind) for _ in range(5))
        for t in range(steps):
            g, hu = given.take(x[t], axis=1), np.matmul(h, low)
            zr = g[:2]
            zr += hu[:2]
            np.exp(zr, out=zr)
            zr += 1.0
            np.reciprocal(zr[0], out=z[t])
            np.reciprocal(zr[1], out=r[t])
            hu2[t] = hu[2]
            new = np.multiply(r[t], hu[2], out=hu[2])
            new += g[2]
            np.tanh(new, out=c[t])
            h = np.subtract(h, c[t], out=states[t])
            h *= z[t]
            h += c[t]
        target = batch[:, 1:].T
        live = target >= 0
        if not live.any():
            return h
        grads = {k: np.zeros_like(v) for k, v in self.w.items() if k not in ("x", "u", "b")}
        if live.all():
            d_out = self.log_probs(states.reshape(-1, n), target.ravel(), grads)[1].reshape(steps, rows, n)
        else:
            d_out = np.zeros_like(states)
            d_out[live] = self.log_probs(states[live], target[live], grads)[1]
        # what a state's gradient is multiplied by on its way to the gates, for all steps at once: to the
        # state's part of the candidate, to the two other gates, to the symbol's part of the candidate
        before = np.concatenate((h0[None].astype(kind), states[:-1]))
        into = np.empty((4, steps, rows, n), kind)
        part = np.subtract(1.0, z)
        np.multiply(c, c, out=into[3])
        np.subtract(1.0, into[3], out=into[3])
        into[3] *= part
        np.subtract(before, c, out=into[1])
        into[1] *= z
        into[1] *= part
        np.multiply(into[3], r, out=into[0])
        np.multiply(into[0], hu2, out=into[2])
        into[2] *= np.subtract(1.0, r, out=part)
        dh, ut = np.zeros((rows, n), kind), np.ascontiguousarray(u[[2, 0, 1]].transpose(0, 2, 1))
        for t in range(steps - 1, -1, -1):
            dh += d_out[t]
            into[:, t] *= dh
            dh *= z[t]
            for more in np.matmul(into[:3, t], ut):
                dh += more
        flat = into.reshape(4, -1, n)
        grads["u"] = np.matmul(before.reshape(-1, n).T, flat[:3])[[1, 2, 0]].transpose(1, 0, 2).reshape(n, 3 * n)
        x = x.ravel().astype(np.min_scalar_type(len(self.w["x"])))
        order = np.argsort(x, kind="stable")
        seen = x[order]
        first = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
        some = seen[first]
        grads["x"] = group_sums(flat[1:].take(order, axis=1), first).transpose(1, 0, 2).reshape(-1, 3 * n)  # of the symbols that occur
        grads["b"] = grads["x"].sum(0)
        scale = 1.0 / np.count_nonzero(live)
        norm = scale * np.sqrt(sum(float(g.ravel() @ g.ravel()) for g in grads.values()))
        scale *= min(1.0, 1.0 / max(norm, 1e-9))
        for k, g in grads.items():
            at = some if k == "x" else slice(None)
            g *= scale
            seen = squares[k][at] if k == "x" else squares[k]
            seen += g * g
            if k == "x":
                squares[k][at] = seen
            g *= rate
            root = np.sqrt(seen)
            root += 1e-8
            g /= root
            self.w[k][at] -= g
        return h

    def train(self, windows: list[np.ndarray], squares: dict, steps: int, rate: float, batch: int = 128) -> None:
        for a in range(0, len(windows), batch):
            part = windows[a : a + batch]
            longest = max(map(len, part))
            table = np.full((len(part), longest), -1, np.int64)
            for k, x in enumerate(part):
                table[k, : len(x)] = x
            h = np.zeros((len(part), self.size), np.float32)
            for t in range(0, longest - 1, steps):
                h = self.learn(table[:, t : t + steps + 1], h, squares, rate)

    def score(self, texts: list[np.ndarray], end: int, lanes: int = 384, window: int = 64) -> np.ndarray:
        """log10 P(class) * P(head word | class), summed over the symbols of each text
        (each closed by the end symbol). Lanes stand end to end in one array, the longest
        first, and a step computes those that still run: memory follows the symbols, not
        lanes times the longest text."""
        out = np.zeros(len(texts))
        if not texts:
            return out
        sizes = np.array([len(t) for t in texts], np.int64)
        lanes = min(lanes, len(texts))
        load, line = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
        for k in np.argsort(-sizes, kind="stable").tolist():
            lane = int(load.argmin())
            line[lane].append(k)
            load[lane] += sizes[k]
        rank = np.argsort(-load, kind="stable")
        load, order = load[rank], np.concatenate([line[k] for k in rank])
        target, owner = np.concatenate([texts[k] for k in order]), np.repeat(order, sizes[order])
        starts = np.zeros(len(target), bool)
        starts[np.cumsum(sizes[order]) - sizes[order]] = True
        begin, before = np.cumsum(load) - load, np.append(end, target[:-1])  # the symbol before a text is the end of another
        h, (given, u), a, most = np.zeros((lanes, self.size), np.float32), self.gates(), 0, lanes * window
        np.negative(given[:2], out=given[:2])
        np.negative(u[:2], out=u[:2])
        while a < load[0]:
            n = int(np.searchsorted(-load, -a))  # lanes longer than a
            steps = min(int(load[0]) - a, most // n)
            when = a + np.arange(steps)
            running = np.searchsorted(-load, -when)  # lanes longer than each step
            at = (begin[:n] + when[:, None])[np.arange(n) < running[:, None]]
            x, states = before[at], np.empty((len(at), self.size), np.float32)
            fresh = np.flatnonzero(starts[at])  # a text begins with no state
            stop = np.cumsum(running)
            cut = np.searchsorted(fresh, stop).tolist()
            i = k = 0
            for j, m in zip(stop.tolist(), cut, strict=True):
                h = h[: j - i]
                if m > k:
                    h = h.copy()  # the states before are still to be read
                    h[fresh[k:m] - i] = 0.0
                g, hu = given.take(x[i:j], axis=1), np.matmul(h, u)
                zr, new = g[:2], hu[2]
                zr += hu[:2]
                np.exp(zr, out=zr)
                zr += 1.0
                np.reciprocal(zr, out=zr)
                new *= zr[1]
                new += g[2]
                np.tanh(new, out=new)
                h = np.subtract(h, new, out=states[i:j])
                h *= zr[0]
                h += new
                i, k = j, m
            h = h.copy()
            out += np.bincount(owner[at], self.log_probs(states, target[at])[0], len(texts))
            a += steps
        return out / np.log(10.0)


def tokens(column: pa.Array):
    """Word hashes of each text, its end last."""
    for _, _, data, rows in chunks(column, 1 << 17):  # what is made of a run stays near the processor
        starts, ends, first = word_spans(data, rows)
        words = word_hashes(data, starts, ends)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.append(words[a:b], END)


def count_words(training: DataFrame) -> DataFrame:
    """Rows (h, c): counts of the words of a task's texts."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])

    def run(batches):
        held, size = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], schema=schema)

        for batch in batches:
            for t in tokens(batch.column(0)):
                held.append(t)
                size += len(t)
                if size > 1 << 22:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return training.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, c long")


def symbol_type(words: Vocabulary) -> np.dtype:
    return np.min_scalar_type(words.symbols - 1)


def encoded(docs: DataFrame, words: Vocabulary, held_out=None) -> DataFrame:
    """Per row, so that each text is taken apart once for training and scores: a number of its own (uid), doc_id, held_out,
    key (a hash of its doc_id), symbols (its end last), n_tokens, the number of its common words that training has,
    their part of the base score, what is fixed of the model's, and the hashes of its rare words."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("key", pa.int64()), ("symbols", pa.binary()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("fixed", pa.float64()), ("rare", pa.list_(pa.int64()))])

    def run(batches):
        from pyspark import TaskContext

        v, uid, rows, size = sent.value, TaskContext.get().partitionId() << 33, [], 0
        kind, logs = symbol_type(v), np.log10(v.count + 1.0)

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, held, key, t in zip(*(batch.column(k).to_pylist() for k in range(3)), tokens(batch.column(3)), strict=True):
                at, there = v.look(t)
                found = at[there]
                symbols = np.where(there, v.symbol[at], v.symbols - 1).astype(kind)
                rows.append((uid, doc_id, held, key, symbols.tobytes(), len(t), int((v.count[found] > 0).sum()), float(logs[found].sum()), float(v.share[found].sum()), t[~there].view(np.int64)))
                uid, size = uid + 1, size + len(t)
                if size >= 1 << 20:
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()
        give_back()

    named = "doc_id" in docs.columns
    key = F.col("doc_id").cast("string") if named else F.col("text")
    doc_id = (F.col("doc_id") if named else F.lit(None)).cast("long").alias("doc_id")
    held_out = (F.lit(False) if held_out is None else held_out).alias("held_out")
    rows = docs.select(doc_id, held_out, F.xxhash64(key).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "uid long, doc_id long, held_out boolean, key long, symbols binary, n_tokens long, n_known long, base double, fixed double, rare array<long>")


def training_windows(training: DataFrame, words: Vocabulary, window: int) -> DataFrame:
    """The windows of texts (see `windows_of`)."""
    return windows_of(encoded(training, words), words, window)


def windows_of(rows: DataFrame, words: Vocabulary, window: int) -> DataFrame:
    """Rows (w, deal): each encoded text as consecutive windows of `window` symbols to predict, after
    the symbol before them (the end symbol at the start of a text), and a number from its doc_id and place by
    which windows are dealt to tasks, the same wherever a row is read."""
    schema = pa.schema([("w", pa.binary()), ("deal", pa.int64())])
    kind = symbol_type(words)
    end = words.symbols_of(np.array([END])).astype(kind).tobytes()
    step = kind.itemsize

    def run(batches):
        windows, deal = [], []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(deal, pa.int64())], schema=schema)
        for batch in batches:
            for symbols, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = end + symbols
                for at in range(0, len(symbols) // step, window):
                    windows.append(s[at * step : (at + window + 1) * step])
                    deal.append(((key ^ at * 0x9E3779B97F4A7C15) & (1 << 64) - 1) % 1_000_003)
                    if len(windows) == 1 << 14:
                        yield made()
                        windows, deal = [], []
        if windows:
            yield made()

    return rows.select("symbols", "key").mapInArrow(run, "w binary, deal long")


def vocabulary(counts: DataFrame, *, head: int = 2048, most: int = 1 << 18, least: int = 5) -> Vocabulary:
    """From counts (h, c) over the whole corpus. The common words (at most `most`, of
    at least `least` occurrences) come to the driver; the rest stays in the table."""
    level = F.floor(F.log2(F.col("c")) * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("types"), F.sum("c").alias("total")).orderBy(F.desc("level")).collect()  # at most 512 rows
    total, distinct, low, so_far = sum(r.total for r in levels), sum(r.types for r in levels), 1 << 20, 0
    for r in levels:
        so_far += r.types
        if so_far > most or 2 ** (r.level / 8) < least:
            break
        low = r.level
    end = int(END.astype(np.int64))
    table = counts.filter((level >= low) | (F.col("h") == end)).select("h", "c").toArrow()
    h = table.column("h").to_numpy().view(np.uint64) if table.num_rows else np.empty(0, np.uint64)
    c = table.column("c").to_numpy() if table.num_rows else np.empty(0, np.int64)
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    if END in h[head:]:  # the end is always a head word
        k = int(np.flatnonzero(h == END)[0])
        move = np.r_[k, 0:k, k + 1 : len(h)]
        h, c = h[move], c[move]
    if END not in h:
        h, c = np.append(END, h), np.append(0, c)
    n_head = min(head, len(h))
    tail = np.floor(np.log2(np.maximum(c[n_head:], 1))).astype(int)
    names = np.unique(tail)
    symbol = np.concatenate((np.arange(n_head), n_head + np.searchsorted(names, tail)))
    symbols = n_head + len(names) + 1
    n_classes = -(-n_head // CLASS)
    klass = np.concatenate((np.arange(n_head) // CLASS, n_classes + np.arange(len(names) + 1)))
    mass = np.bincount(symbol, c, symbols)
    share = np.zeros(len(h))
    if len(names):
        share[n_head:] = np.log10(np.maximum(c[n_head:], 1)) - np.log10(mass[symbol[n_head:]])
    rare_total, rare_types = total - int(c.sum()), distinct - int((c > 0).sum())
    mass[-1] = rare_total
    few = {r.c: r.n for r in counts.filter("c <= 2").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2 = few.get(1, 0), few.get(2, 0)
    per_class = np.bincount(klass, mass) + 1.0
    by_hash = np.argsort(h)
    return Vocabulary(h[by_hash], c[by_hash], symbol[by_hash], share[by_hash], n_head, symbols, klass, np.log(per_class / per_class.sum()), total, distinct, float(rare_total), rare_types, min(0.9, n1 / (n1 + 2 * n2)) if n1 else 0.5)


def train_gru(windows: DataFrame, words: Vocabulary, *, size: int = 24, steps: int = 32, rounds: int = 3, rate: float = 0.1, replicas: int | None = None, task_windows: int = 1 << 14) -> Gru:
    """Rounds of parallel training on all windows (each window in one round), the
    tasks' weights averaged by their numbers of windows, 32 at a time. The number of tasks comes from
    the counted windows alone, so the model does not depend on the session's partitions."""
    spark = windows.sparkSession
    model = Gru(words, size)
    replicas = replicas or max(1, -(-windows.count() // (rounds * task_windows)))
    names = list(model.w)
    shape = {k: v.shape for k, v in model.w.items()}

    def pack(w: dict) -> bytes:
        return np.concatenate([w[k].ravel() for k in names]).astype(np.float32).tobytes()

    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((model, words))
        part = windows.filter(F.pmod(F.xxhash64("w"), F.lit(rounds)) == turn)

        def run(batches, sent=sent):
            import copy

            from pyspark import TaskContext

            keep_memory()
            start, vocabulary_ = sent.value
            own = copy.deepcopy(start)
            kind, squares = symbol_type(vocabulary_), {k: np.full_like(v, 1e-6) for k, v in own.w.items()}
            held, n = [], 0

            def learn():
                held.sort(key=lambda x: (len(x), x))
                own_order = np.random.default_rng(5).permutation(-(-len(held) // 128))
                own.train([np.frombuffer(held[k], kind) for b in own_order for k in range(b * 128, min(len(held), (b + 1) * 128))], squares, steps, rate)

            for batch in batches:
                held += batch.column(0).to_pylist()
                n += batch.num_rows
                if len(held) >= 1 << 17:  # bounded memory, whatever a task gets
                    learn()
                    held.clear()
            if held:
                learn()
            give_back()
            if n:
                yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId() // 32], "n": [n], "w": [pack(own.w)]})

        def average(key, table):
            pairs = sorted(zip(table.column("n").to_pylist(), table.column("w").to_pylist(), strict=True))  # sums in one order
            n = sum(k for k, _ in pairs)
            total = sum(float(k) * np.frombuffer(w, np.float32).astype(np.float64) for k, w in pairs)
            return pa.table({"part": [key[0].as_py() // 32], "n": [n], "w": [(total / n).astype(np.float32).tobytes()]})

        # not by content: copies spread out
        trained = part.repartitionById(replicas, (F.col("deal") % replicas).cast("int")).select("w")
        trained = trained.mapInArrow(run, "part long, n long, w binary")
        left = -(-replicas // 32)
        while True:
            trained = trained.groupBy("part").applyInArrow(average, "part long, n long, w binary")
            if left == 1:
                break
            left = -(-left // 32)
        rows = trained.collect()  # one model
        if rows:
            n = sum(r.n for r in rows)
            flat, at = sum(r.n / n * np.frombuffer(r.w, np.float32).astype(np.float64) for r in rows).astype(np.float32), 0
            for k in names:
                length = int(np.prod(shape[k]))
                model.w[k] = flat[at : at + length].reshape(shape[k])
                at += length
    return model


def score_texts(docs: DataFrame, held_out, counts: DataFrame, words: Vocabulary, model: Gru) -> DataFrame:
    """The scores of texts (see `scores_of`)."""
    return scores_of(staged(encoded(docs, words, held_out), "texts"), counts, words, model)


def scores_of(texts_: DataFrame, counts: DataFrame, words: Vocabulary, model: Gru) -> DataFrame:
    """Per encoded row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    Common words were looked up in a broadcast table of bounded size; the rare ones
    meet their counts in a join."""
    sent = texts_.sparkSession.sparkContext.broadcast((words, model))
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])

    def run(batches):
        keep_memory()
        v, gru = sent.value
        kind, end = symbol_type(v), int(v.symbols_of(np.array([END]))[0])
        texts, rows, size = [], [], 0

        def scored():
            *same, fixed = zip(*rows, strict=True)
            scores = gru.score(texts, end) + np.array(fixed)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*same, scores], schema, strict=True)], schema=schema)

        for batch in batches:
            for symbols, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts.append(np.frombuffer(symbols, kind))
                rows.append(row)
                size += len(texts[-1])
                if size >= 1 << 22:  # texts of many batches share the lanes, up to so many symbols
                    yield scored()
                    texts, rows, size = [], [], 0
        if texts:
            yield scored()
        give_back()

    same = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base"]
    rows = staged(texts_.select("symbols", *same, "fixed").mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double"), "scores")
    c = F.coalesce("c", F.lit(0))
    z = max(words.rare_total, 1e-9)
    unseen = words.discount * words.rare_types / z if words.rare_types else 1.0
    within = F.log10(F.when(c > 0, (c - words.discount) / z).otherwise(F.lit(unseen)))
    rare = texts_.select("uid", F.explode_outer("rare").alias("h")).filter(F.col("h").isNotNull()).groupBy("uid", "h").agg(F.count("*").alias("k"))
    joined = rare.join(counts.hint("shuffle_merge"), "h", "left").groupBy("uid").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("k_known"), F.sum(F.col("k") * F.log10(c + 1.0)).alias("k_base"), F.sum(F.col("k") * within).alias("k_model"))
    zero = F.lit(0.0)
    per_token = float(np.log10(words.total + words.distinct + 1.0))
    return rows.join(joined.hint("shuffle_merge"), "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("k_base", zero) - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("model") + F.coalesce("k_model", zero)).alias("score"),
    )


def lm_scores(docs: DataFrame, held_out, *, window: int = 64, **training) -> DataFrame:
    """Learn from the rows where `held_out` is false and score all rows."""
    with small_batches(docs.sparkSession):
        return _lm_scores(docs, held_out, window, training)


def _lm_scores(docs: DataFrame, held_out, window: int, training: dict) -> DataFrame:
    learnt = docs.filter(~held_out)
    counts = staged(count_words(learnt).groupBy("h").agg(F.sum("c").alias("c")), "counts")
    words = vocabulary(counts)
    texts = staged(encoded(docs, words, held_out), "texts")
    model = train_gru(staged(windows_of(texts.filter("not held_out"), words, window), "windows"), words, **training)
    return scores_of(texts, counts, words, model)


def op1_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learnt where crc32(doc_id) mod 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_scores(docs, fold(F.col("doc_id"), 7) == 2)
