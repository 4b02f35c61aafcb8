"""Spelling variants: words one edit apart, by k-d trees over letter-count vectors.

A word's vector counts its letters. One inserted or deleted letter moves it by 1 and one
replaced letter by 2 in L1 distance. So words of a length are searched within 2 of their
vectors, and words one letter longer within 1, in a k-d tree of each length; what is
found is verified by the order of the letters.

The trees have two parts. The upper splits of a length with many words come from a bounded
sample (`sample` words over all lengths; they decide balance only), so each word has a cell, and a word asks
in every cell whose box lies within its radius: words meet in a shuffle by
cell. A cell with far more words than planned (words of equal letters cannot be split) is dealt
over tiles, and who asks there asks in all of them. Within a task a cell's words form the lower k-d tree, and
those who ask go down it together, in blocks: boxes out of reach are pruned, last nodes compare counts,
then letters.

Null and empty texts have no words; long words have long vectors of letters and nothing
else changes. Rows are counted as they come: repeated rows count again, and the id is taken as text,
a null id as the empty text. Ties between forms go to the smallest in code-point order. Empty
tables give no rows. Other columns are not read, whatever their names."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import TO_LOWER, chunks, give_back, slots, small_batches, staged

#: Letters are a-z and U+00C0 to U+00FF (in UTF-8, C3 and a second byte).
LETTERS, WIDE = 26 + 64, 0xC3
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


CRC = _crc_table()


def runs(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, and the row of each."""
    letter = _ASCII[data] | (data == WIDE)
    letter[1:] |= data[:-1] == WIDE
    begin, end = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    edges = rows[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = letter[edges]
    end[edges - 1] = letter[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(rows, starts, side="right") - 1


def crc_on(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of what `before` is the crc32 of, followed by the bytes from start to end."""
    order = np.argsort(starts - ends, kind="stable")  # longest first
    at, left = starts[order], (ends - starts)[order]
    crc = ~before[order].astype(np.uint32)
    step, n = 0, len(order)
    while n:
        n = int(np.searchsorted(-left, -step, side="left"))  # those longer than step
        if not n:
            break
        crc[:n] = CRC[(crc[:n] ^ data[at[:n] + step]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
        step += 1
    out = np.empty(len(order), np.uint32)
    out[order] = ~crc
    return out


def counted(docs: DataFrame, *, damage: int | None = 199, shortest: int = 6, flush: int = 400_000) -> DataFrame:
    """(word, n): lower-cased runs of letters of at least `shortest` code points. With `damage`, a run
    for which it divides crc32(id:run) loses its letter crc32 % length."""

    def run(batches):
        counts: dict[str, int] = {}

        def give():
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            ids = batch.column(0).fill_null("").to_pylist()
            for first, _, data, rows in chunks(batch.column(1), 4 << 20):
                data = np.ascontiguousarray(TO_LOWER[data])
                starts, ends, row = runs(data, rows)
                wide = np.concatenate(([0], np.cumsum(data == WIDE)))
                length = ends - starts - (wide[ends] - wide[starts])
                keep = length >= shortest
                starts, ends, row, length = starts[keep], ends[keep], row[keep], length[keep]
                if not len(starts):
                    continue
                if damage:
                    head = np.array([zlib.crc32(f"{i}:".encode()) for i in ids[first : first + len(rows) - 1]], np.uint32)
                    crc = crc_on(data, starts, ends, head[row])
                    hurt = crc % damage == 0
                    for k in np.flatnonzero(hurt).tolist():
                        word, at = data[starts[k] : ends[k]].tobytes().decode(), int(crc[k]) % int(length[k])
                        word = word[:at] + word[at + 1 :]
                        if len(word) >= shortest:
                            counts[word] = counts.get(word, 0) + 1
                    starts, ends = starts[~hurt], ends[~hurt]
                edges = np.empty(2 * len(starts) + 1, np.int64)
                edges[:-1:2], edges[1::2], edges[-1] = starts, ends, len(data)
                words = pa.LargeStringArray.from_buffers(2 * len(starts), pa.py_buffer(edges), pa.py_buffer(data)).take(pa.array(np.arange(0, 2 * len(starts), 2)))
                for x in words.value_counts().to_pylist():
                    counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
                if len(counts) > flush:
                    yield from give()
        yield from give()
        give_back()

    given = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- vectors and trees


def spelled(words: list[str]) -> np.ndarray:
    """Letters of words of one length as numbers below LETTERS (n x length)."""
    raw = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    return np.where(raw < 128, raw - 97, raw - 0xC0 + 26).astype(np.uint8)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """(n x LETTERS)"""
    n = len(letters)
    flat = (np.arange(n)[:, None] * LETTERS + letters).ravel()
    return np.bincount(flat, minlength=n * LETTERS).reshape(n, LETTERS).astype(np.int32)


def split_of(counts: np.ndarray) -> tuple[int, int] | None:
    """(letter, t): the split into counts below t and the rest that is nearest to halves."""
    n, best = len(counts), None
    spread = counts.max(0) > counts.min(0)
    for letter in np.flatnonzero(spread).tolist():
        own = np.bincount(counts[:, letter])
        below = np.cumsum(own)[:-1]
        t = int(np.argmin(np.abs(below - n / 2)))
        off = abs(int(below[t]) - n / 2)
        if 0 < below[t] < n and (best is None or off < best[0]):
            best = (off, letter, t + 1)
    return best and best[1:]


class Splits:
    """The upper tree of one length: split nodes (letter, t, left, right); cells are ~number."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[list[int]] = []
        self.cells = 0
        self.root = self._grow(sample, cells)

    def _grow(self, counts: np.ndarray, cells: int) -> int:
        split = split_of(counts) if cells > 1 and len(counts) > 1 else None
        if split is None:
            self.cells += 1
            return ~(self.cells - 1)
        letter, t = split
        low = counts[:, letter] < t
        me = len(self.nodes)
        self.nodes.append([letter, t, 0, 0])
        share = max(1, min(cells - 1, round(cells * float(low.mean()))))
        self.nodes[me][2] = self._grow(counts[low], share)
        self.nodes[me][3] = self._grow(counts[~low], cells - share)
        return me

    def reach(self, counts: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows of counts within radius of its box). Radius 0 is a word's own cell. The distance to a box
        is the sum over letters of how far the count is outside the box's range."""
        todo = [(self.root, np.arange(len(counts)), np.zeros(len(counts), np.int32), {})]
        while todo:
            node, rows, far, box = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows
                continue
            letter, t, left, right = self.nodes[node]
            lo, hi = box.get(letter, (0, 1 << 30))
            c = counts[rows, letter]
            now = far - np.maximum(0, np.maximum(lo - c, c - hi))
            for child, a, b in ((left, lo, t - 1), (right, t, hi)):
                d = now + np.maximum(0, np.maximum(a - c, c - b))
                near = d <= radius
                todo.append((child, rows[near], d[near], box | {letter: (a, b)}))


class Cell:
    """The words of one cell, the lower k-d tree over them, and its range search."""

    def __init__(self, words: list[str], leaf: int = 48):
        self.letters = spelled(words)
        self.counts = letter_counts(self.letters)
        self.leaf = leaf
        self.root = self._grow(np.arange(len(words)))

    def _grow(self, rows: np.ndarray):
        own = self.counts[rows]
        lo, hi = own.min(0), own.max(0)
        split = split_of(own) if len(rows) > self.leaf else None
        if split is None:
            return lo, hi, rows, None
        low = own[:, split[0]] < split[1]
        return lo, hi, None, (self._grow(rows[low]), self._grow(rows[~low]))

    def near(self, counts: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asking row, own row) of all pairs of words one edit apart. The asking words have the length of the
        own ones, or one letter less."""
        less = self.letters.shape[1] - letters.shape[1]
        radius = 2 - less
        asked, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        todo = [(self.root, np.arange(len(counts)))]
        while todo:
            (lo, hi, rows, below), ask = todo.pop()
            c = counts[ask]
            ask = ask[(np.maximum(lo - c, 0) + np.maximum(c - hi, 0)).sum(1) <= radius]
            if not len(ask):
                continue
            if below is not None:
                todo += [(x, ask) for x in below]
                continue
            step = max(1, (4 << 20) // (len(rows) * max(LETTERS, letters.shape[1])))
            own = self.counts[rows].astype(np.float32)
            for k in range(0, len(ask), step):
                q = ask[k : k + step]
                # sums of smaller counts are cheaper than L1: |a - b| = a + b - 2 min(a, b)
                far = np.abs(counts[q][:, None, :].astype(np.float32) - own[None, :, :]).sum(2)
                i, j = np.nonzero(far == radius)
                i, j = q[i], rows[j]
                ok = one_edit(letters[i], self.letters[j])
                asked.append(i[ok])
                found.append(j[ok])
        return np.concatenate(asked), np.concatenate(found)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows differ by one replaced letter, or b has one letter more."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    head = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= n


# ---------------------------------------------------------------- the distributed search


def near_pairs(words: DataFrame, *, cell_words: int = 4096, sample: int = 200_000) -> DataFrame:
    """(word, near, near_n) in both directions for the distinct words of (word, n) that are one edit
    apart. Rows per length are collected only for lengths of more than `cell_words` words."""
    spark = words.sparkSession
    words = words.select("word", "n", F.length("word").alias("size"))
    large = {r["size"]: r["count"] for r in words.groupBy("size").count().filter(F.col("count") > cell_words).collect()}
    splits: dict[int, Splits] = {}
    if large:
        share = min(1.0, sample / sum(large.values()))
        held = words.filter(F.col("size").isin(*large) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("size", "word").toArrow()
        sizes, texts = held.column("size").to_numpy(), np.array(held.column("word").to_pylist(), object)
        for size, count in large.items():
            own = texts[sizes == size].tolist()
            splits[size] = Splits(letter_counts(spelled(own)), -(-count // cell_words)) if own else Splits(np.empty((0, LETTERS), np.int32), 1)

    def by_length(batch: pa.RecordBatch):
        texts, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            yield size, [texts[k] for k in rows], n[rows]

    def cells(counts, size, radius):
        if size in splits:
            return splits[size].reach(counts, radius)
        return iter([(0, np.arange(len(counts)))])

    placed_schema = pa.schema([("size", pa.int32()), ("cell", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def place(batches):
        for batch in batches:
            for size, texts, n in by_length(batch):
                own = np.zeros(len(texts), np.int32)
                for cell, rows in cells(letter_counts(spelled(texts)), size, 0):
                    own[rows] = cell
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), size, np.int32)), pa.array(own), pa.array(texts, pa.string()), pa.array(n)], schema=placed_schema)

    placed = staged(words.select("word", "n").mapInArrow(place, "size int, cell int, word string, n long"), "placed")
    # cells of far more words than planned, at most one for each 4 * cell_words words
    overfull = {(r["size"], r["cell"]): -(-r["count"] // (2 * cell_words)) for r in placed.groupBy("size", "cell").count().filter(F.col("count") > 4 * cell_words).collect()}
    sent_schema = pa.schema([("size", pa.int32()), ("cell", pa.int32()), ("tile", pa.int32()), ("role", pa.int8()), ("own", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def send(batches):
        for batch in batches:
            at = batch.column("cell").to_numpy().astype(np.int64)
            sizes = batch.column("size").to_numpy()
            texts, n = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy()
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                w, own, k = texts[rows], at[rows], n[rows]
                counts = letter_counts(spelled(w.tolist()))
                tiles = np.array([overfull.get((size, int(c)), 1) for c in own])
                mine = np.array([zlib.crc32(x.encode()) for x in w.tolist()], np.int64) % tiles

                def rows_of(to, cell, tile, role, pick):
                    m = len(pick)
                    full = lambda x, kind: pa.array(np.full(m, x, kind)) if np.isscalar(x) else pa.array(x[pick].astype(kind))
                    return pa.RecordBatch.from_arrays([full(to, np.int32), full(cell, np.int32), full(tile, np.int32), full(role, np.int8), pa.array(own[pick]), pa.array(w[pick].tolist(), pa.string()), pa.array(k[pick])], schema=sent_schema)  # noqa: B023

                yield rows_of(size, own, mine, 0, np.arange(len(w)))
                for to, radius in ((size, 2), (size + 1, 1)):
                    for cell, pick in cells(counts, to, radius):
                        if to == size:
                            pick = pick[own[pick] <= cell]  # of two cells, the later one answers
                        for tile in range(overfull.get((to, cell), 1)) if len(pick) else ():
                            yield rows_of(to, cell, tile, 1, pick)

    sent = placed.mapInArrow(send, "size int, cell int, tile int, role byte, own long, word string, n long")
    sent = sent.repartition(slots(spark), "size", "cell", "tile").sortWithinPartitions("size", "cell", "tile", "role")
    pair_schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def meet(batches):
        now, words, n, tree = None, [], [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], 1)
            texts, many, own = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy(), batch.column("own").to_numpy()
            cut = np.flatnonzero((np.diff(place, axis=0) != 0).any(1)) + 1
            for rows in np.split(np.arange(len(texts)), cut) if len(texts) else []:
                key, role = tuple(place[rows[0], :3].tolist()), place[rows[0], 3]
                if key != now:
                    now, words, n, tree = key, [], [], None
                if role == 0:
                    words += texts[rows].tolist()
                    n.append(many[rows])
                    continue
                if not words:
                    continue
                if tree is None:
                    tree, counts_of = Cell(words), np.concatenate(n)
                asking = texts[rows]
                lengths = np.fromiter(map(len, asking), np.int64, len(asking))
                for length in np.unique(lengths).tolist():
                    pick = rows[lengths == length]
                    letters = spelled(texts[pick].tolist())
                    i, j = tree.near(letter_counts(letters), letters)
                    a, b = texts[pick][i].tolist(), [words[x] for x in j.tolist()]
                    there = pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(counts_of[j])], schema=pair_schema)
                    yield there
                    # within one cell both words ask; else the answer goes both ways
                    back = np.flatnonzero((length != key[0]) | (own[pick][i] != key[1]))
                    yield pa.RecordBatch.from_arrays([pa.array([b[x] for x in back], pa.string()), pa.array([a[x] for x in back], pa.string()), pa.array(many[pick][i][back])], schema=pair_schema)
        give_back()

    return sent.mapInArrow(meet, "word string, near string, near_n long")


def variants(docs: DataFrame, *, least: int = 5, times: int = 5, shortest: int = 6, damage: int | None = None, **limits: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of at least `least` occurrences: a word's form is its
    near word of largest n, if that is `times` its own at least; its root is the end of the forms that follow."""
    spark = docs.sparkSession
    with small_batches(spark):
        words = staged(counted(docs, damage=damage, shortest=shortest).filter(F.col("n") >= least), "words")
    pairs = near_pairs(words, **limits)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best"))
    known = words.join(best.hint("shuffle_merge"), "word", "left").withColumn("_ok", F.coalesce(-F.col("best.n") >= times * F.col("n"), F.lit(False)))
    formed = staged(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_ok"), F.col("best.w")).alias("form"), F.when(F.col("_ok"), -F.col("best.n")).alias("form_n")), "forms")
    # forms grow `times`-fold, so chains are short and end; each round doubles what is followed
    ends = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ends = staged(ends, "roots")
        step = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = ends.join(step.hint("shuffle_merge"), "root", "left")
        if joined.filter("_next IS NOT NULL").isEmpty():
            break
        ends = joined.select("word", F.coalesce("_next", "root").alias("root"))
    out = formed.join(ends.hint("shuffle_merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of the documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), damage=199)
