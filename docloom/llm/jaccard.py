"""Exact n-gram Jaccard join by prefix trees, and the components of its links.

1. Every text becomes its set of 64-bit shingle hashes. Equal sets form one class,
   joined through one representative. A linked text shares at least s of its
   elements with one other text, so texts of which fewer elements occur anywhere
   else leave at once: shingles, shortened to some bits, are sent as sorted runs to
   regions of their range, and the regions send back how many of each text's
   elements another text holds too. This runs over all texts, then once more over
   the representatives of those that stay.
2. The sets that stay are ordered globally: a fixed table of 2^20 counters over all texts says how
   often the hashes of a cell occur; rare cells come first, then the hash. The order
   decides only the work: results are the same for any order.
3. Two sets with similarity s share one of the first n - ceil(s n) + 1 elements.
   Classes that share such an element fall in one block (connected components, so no
   group lists its pairs).
4. A block is joined in one task over a trie of its ordered sets: a probe walks the
   trie with its overlap so far, leaves a subtree when the elements that remain
   cannot reach the needed overlap, and skips subtrees that are already in its component.
   Elements that one set of the block holds alone only count by its size.
   A block of too many elements is cut into tiles, and every pair of tiles is a task.

Texts that are null, empty or without a word have an empty set and no links. A text
of fewer than n words is one shingle. Rows that share a doc_id are one document;
repeated rows give repeated results; a null doc_id keeps its set's component but
names none. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import chunks, give_back, gram_hashes, mix, slots, small_batches, staged, word_hashes, word_spans
from docloom.llm.graph import components

CELL_BITS, PART_BITS = 20, 14
#: Shingles that one task holds at a time: tables are cut into as many parts as that takes.
REGION = 2_000_000


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    for _, _, data, rows in chunks(texts):
        starts, ends, first = word_spans(data, rows)
        words = word_hashes(data, starts, ends)
        grams = gram_hashes(words, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                s = np.sort(grams[a : b - n + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield gram_hashes(words[a:b], b - a)
            else:
                yield np.empty(0, np.uint64)


def needed(n_a: int, n_b: int, percent: int) -> int:
    """Least intersection with 100 * intersection >= percent * union."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def cell_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How often the shingles of each cell occur, over all texts: one table of fixed
    size per task, summed by parts, first of up to 256 tasks, then over those."""
    import zlib

    from pyspark import TaskContext

    parts = 1 << (CELL_BITS - PART_BITS)

    def count(batches):
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(0), n):
                np.add.at(total, (s >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        if total.any():
            lot = TaskContext.get().partitionId() // 256
            yield pa.RecordBatch.from_pydict({"part": list(range(parts)), "lot": [lot] * parts, "counts": [zlib.compress(x.tobytes(), 1) for x in total.reshape(parts, -1)]})

    def add(key, table):
        total = np.zeros(1 << PART_BITS, np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.int64)
        return pa.table({"part": [key[0].as_py()], "lot": [0], "counts": [zlib.compress(total.tobytes(), 1)]})

    ddl = "part long, lot long, counts binary"
    lots = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, ddl).groupBy("part", "lot").applyInArrow(add, ddl)
    out = np.zeros((parts, 1 << PART_BITS), np.int64)
    for r in lots.groupBy("part").applyInArrow(add, ddl).collect():  # as many rows as parts
        out[r.part] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return out.reshape(-1)


class Trie:
    """Ordered sets with shared beginnings; a leaf keeps the unshared rest as an
    array. Below a node, `low` and `high` bound the sizes of the sets, `long` how many of
    their elements are in the trie; `one` is a set of the only component there, -1 where they were of
    several when inserted."""

    __slots__ = ("low", "high", "long", "one", "next", "leaf", "rest", "ends")

    def __init__(self):
        self.low, self.high, self.long, self.one, self.next, self.leaf, self.rest, self.ends = 1 << 60, 0, 0, None, None, None, None, None

    def insert(self, items: np.ndarray, size: int, name: int, union: Union) -> None:
        node, at, count, mine = self, 0, len(items), union.find(name)
        while True:
            node.low, node.high, node.long = min(node.low, size), max(node.high, size), max(node.long, count)
            if node.one is None:
                node.one = name
            elif node.one >= 0 and union.find(node.one) != mine:
                node.one = -1
            if node.next is None and node.leaf is None and node.ends is None:
                node.leaf, node.rest = (name, size), items[at:]
                return
            if node.leaf is not None:  # split: move the lone set one step down
                (other, other_size), rest = node.leaf, node.rest
                node.leaf = node.rest = None
                if len(rest):
                    child = Trie()
                    child.leaf, child.rest, child.low, child.high, child.long, child.one = (other, other_size), rest[1:], other_size, other_size, at + len(rest), other
                    node.next = {int(rest[0]): child}
                else:
                    node.ends, node.next = [(other, other_size)], {}
            if at == count:
                node.ends = [*(node.ends or []), (name, size)]
                return
            key = int(items[at])
            if node.next is None:
                node.next = {}
            child = node.next.get(key)
            if child is None:
                child = node.next[key] = Trie()
            node, at = child, at + 1


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def probe(root: Trie, items: np.ndarray, size: int, percent: int, name: int, union: Union, held: np.ndarray) -> None:
    """Join `name` with every set of the trie that it links to. `items` are those of its `size` elements
    that another set may hold, and `held` is true at them alone."""
    least, most = -(-percent * size // 100), 100 * size // percent
    count, both, find = len(items), 100 + percent, union.find
    listed = items.tolist()
    rank = {t: k for k, t in enumerate(listed)}
    mine = find(name)
    stack = [(root, 0, 0, 0)]  # node, elements passed, of them shared, first own element not yet passed
    while stack:
        node, depth, shared, own = stack.pop()
        if node.high < least or node.low > most:
            continue
        # shared so far and what both sides still hold must reach the need of the smallest set below
        low = node.low if node.low > least else least
        if (shared + min(count - own, node.long - depth)) * both < percent * (size + low):
            continue
        if node.one >= 0 and find(node.one) == mine:
            continue
        if node.leaf is not None:
            other, n = node.leaf
            if least <= n <= most:
                need = needed(size, n, percent) - shared
                if len(node.rest) >= need and np.count_nonzero(held[node.rest]) >= need:
                    union.join(name, other)
                    mine = find(name)
            continue
        for other, n in node.ends or ():
            if shared >= needed(size, n, percent):
                union.join(name, other)
                mine = find(name)
        for key, child in (node.next or {}).items():
            k = rank.get(key)
            # own elements before this one are not below it: numbers rise
            stack.append((child, depth + 1, shared, bisect_left(listed, key, own)) if k is None else (child, depth + 1, shared + 1, k + 1))


def shared_parts(sets: list[np.ndarray], percent: int, rounds: int = 8) -> list[np.ndarray | None]:
    """Of each set the elements that another set holds, in their order; None for a set that too few are left of
    to link with any. Sets that leave can only take elements from others, so this is done until none leaves, or `rounds`
    times."""
    sizes, left = np.array([len(s) for s in sets], np.int64), [s if len(s) else None for s in sets]
    for _ in range(rounds):
        stay = [k for k, s in enumerate(left) if s is not None]
        if not stay:
            break
        flat = np.concatenate([left[k] for k in stay])
        again = np.bincount(flat)[flat] > 1
        edge = np.cumsum([0, *(len(left[k]) for k in stay)])
        gone = 0
        for k, a, b in zip(stay, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            part = flat[a:b][again[a:b]]
            if 100 * len(part) < percent * sizes[k]:
                part, gone = None, gone + 1
            left[k] = part
        if not gone:
            break
    return left


def join_sets(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[int]:
    """Root of each set (left, then right) after all links among them. Sets are rising numbers of one global
    order, as `ordered` gives them.

    Elements that only one set holds count by its size alone, and sets that they keep from any link never enter
    the trie. Those with the fewest of them come first: they link with most others, and from then on whole
    subtrees of what is already one component are left out."""
    sets = left + (right or [])
    union, root = Union(len(sets)), Trie()
    parts = shared_parts(sets, percent) if len(sets) >= 32 else sets
    held = np.zeros(max((int(s[-1]) + 1 for s in sets if len(s)), default=0), bool)
    lost = [1.0 if p is None else 1 - len(p) / len(s) for p, s in zip(parts, sets, strict=True)]
    for k in sorted(range(len(sets)), key=lambda k: (lost[k], len(sets[k]))):
        if parts[k] is not None:
            held[parts[k]] = True
            probe(root, parts[k], len(sets[k]), percent, k, union, held)
            held[parts[k]] = False
            root.insert(parts[k], len(sets[k]), k, union)
    return [union.find(k) for k in range(len(sets))]


def ordered(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets as numbers in one order, elements of the fewest sets first."""
    flat = np.concatenate(sets)
    value, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(value), np.int64)
    rank[np.lexsort((value, count))] = np.arange(len(value))
    numbers = rank[inverse]
    at = np.cumsum([0, *map(len, sets)])
    return [np.sort(numbers[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def shared_elements(docs: DataFrame, n: int, regions: int, bits: int, chunk: int = 1 << 20, fan_out: int = 4096) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, high, low (two sums that
    name the set; null for an empty one) and shared, how many of its shingles occur in
    another row too (shortened to `bits` bits, which may only raise the number).

    A task sends each value of a chunk of texts once: with its row, or, where rows of
    the chunk share it, with none, so a value of all texts costs one entry a chunk.
    Beyond `fan_out` regions a second level splits each region among its own, so a chunk
    makes at most `fan_out` runs whatever the corpus."""
    import zstandard

    fields = [("region", "long"), ("part", "long"), ("data", "binary"), ("owner", "long"), ("doc_id", "long"), ("n_shingles", "long"), ("high", "long"), ("low", "long"), ("local", "long")]
    ddl = ", ".join(f"{name} {kind}" for name, kind in fields)
    wide = pa.schema([(name, pa.binary() if kind == "binary" else pa.int64()) for name, kind in fields])
    cut, nobody = np.uint64(64 - bits), np.uint64(2**64 - 1)
    first = min(regions, fan_out)
    ratio = -(-regions // first)

    def packed(x: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())

    def unpacked(b: bytes, kind) -> np.ndarray:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
        return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()

    def runs(value: np.ndarray, owner: np.ndarray, part: int, coarse: bool):
        """Sorted values and their owners as one row for each region that has any."""
        region = (value.astype(np.float64) * (first * ratio / 2.0**bits)).astype(np.int64)
        region = region // ratio if coarse else region
        edge = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1], [True]))) if len(region) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            steps = packed(np.diff(value[a:b], prepend=np.uint64(0)))
            data = len(steps).to_bytes(4, "little") + steps + packed(owner[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([int(region[a])]), pa.array([part]), pa.array([data], pa.binary()), *[pa.nulls(1, pa.int64())] * 6], schema=wide)

    def opened(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        k = 4 + int.from_bytes(data[:4], "little")
        return np.cumsum(unpacked(data[4:k], np.uint64), dtype=np.uint64), unpacked(data[k:], np.uint64)

    def send(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        ids, sets, size = [], [], 0

        def chunk_rows():
            counts, m = np.array([len(s) for s in sets], np.int64), len(sets)
            high = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None for s in sets]
            low = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None for s in sets]
            value, row = np.concatenate(sets) >> cut, np.repeat(np.arange(m), counts)
            order = np.argsort(value, kind="stable")
            value, row = value[order], row[order]
            begin = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))[: len(value)]
            times = np.diff(np.append(begin, len(value)))
            local = np.bincount(row[np.repeat(times > 1, times)], minlength=m)
            owners = (np.arange(m) + (number << 20)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((np.arange(m) + number * 31) % first), pa.array(np.full(m, number % ratio)), pa.nulls(m, pa.binary()), pa.array(owners), pa.array(ids, pa.int64()), pa.array(counts), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(local)], schema=wide)
            sent = np.where(times == 1, owners[row[begin]].view(np.uint64), nobody)
            yield from runs(value[begin], sent, number % ratio, True)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for k, s in enumerate(shingle_sets(batch.column(1), n)):
                ids.append(keys[k]), sets.append(s)
                size += len(s)
                if size >= chunk or len(ids) == 1 << 20:
                    yield from chunk_rows()
                    number += 1
                    ids, sets, size = [], [], 0
        if ids:
            yield from chunk_rows()
        ids, sets = [], []
        give_back()

    def merged(table) -> tuple[np.ndarray, np.ndarray]:
        given = [opened(x) for x in table.column("data").to_pylist() if x is not None]
        value = np.concatenate([v for v, _ in given]) if given else np.empty(0, np.uint64)
        owner = np.concatenate([o for _, o in given]) if given else np.empty(0, np.uint64)
        order = np.argsort(value, kind="stable")
        return value[order], owner[order]

    def split(table):
        """The runs of one region from some chunks, dealt to the regions within it."""
        known = table.filter(pa.compute.is_null(table.column("data")))
        return pa.Table.from_batches([*known.to_batches(), *runs(*merged(table), 0, False)], schema=wide)

    def compare(table):
        known = table.filter(pa.compute.is_null(table.column("data")))
        value, owner = merged(table)
        out = []
        if len(value):
            same = value[1:] == value[:-1]
            again = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            rows, times = np.unique(owner[again & (owner != nobody)], return_counts=True)
            edge = np.flatnonzero(np.concatenate(([True], rows[1:] >> np.uint64(20) != rows[:-1] >> np.uint64(20), [True]))) if len(rows) else np.zeros(1, np.int64)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                places = packed((rows[a:b] & np.uint64((1 << 20) - 1)).astype(np.uint32))
                out.append((int(rows[a] >> np.uint64(20)), len(places).to_bytes(4, "little") + places + packed(times[a:b].astype(np.uint32))))
        nulls = [pa.nulls(len(out), pa.int64())] * 5
        found = pa.table([pa.array([-1] * len(out), pa.int64()), pa.array([-1] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[0] for x in out], pa.int64()), *nulls], schema=wide)
        give_back()
        return pa.concat_tables([known, found])

    def add(key, table):
        total = np.zeros(1 << 20, np.int64)
        for b in table.column("data").to_pylist():
            k = 4 + int.from_bytes(b[:4], "little")
            total[unpacked(b[4:k], np.uint32)] += unpacked(b[k:], np.uint32)
        row = np.flatnonzero(total)
        return pa.table({"owner": row + (key[0].as_py() << 20), "found": total[row]})

    rows = docs.select("doc_id", "text").mapInArrow(send, ddl)
    if ratio > 1:
        rows = staged(rows.groupBy("region", "part").applyInArrow(split, ddl), "runs")
    made = staged(rows.groupBy("region").applyInArrow(compare, ddl), "shared")
    counts = made.filter("data is not null").groupBy("owner").applyInArrow(add, "owner long, found long")
    known = made.filter("data is null").select("owner", "doc_id", "n_shingles", "high", "low", "local")
    return staged(known.join(counts.hint("shuffle_merge"), "owner", "left").select("doc_id", "n_shingles", "high", "low", (F.col("local") + F.coalesce("found", F.lit(0))).alias("shared")), "sets")


def of_ids(docs: DataFrame, ids: DataFrame, broadcast_rows: int) -> DataFrame:
    """The rows of docs whose doc_id is in ids (a written table), with its columns;
    ids are broadcast only if they are few."""
    few = ids.count() <= broadcast_rows
    return docs.join(F.broadcast(ids) if few else ids.hint("shuffle_merge"), "doc_id")


def similar_components(docs: DataFrame, *, n: int = 5, percent: int = 80, tile_elements: int = 2_000_000, broadcast_rows: int = 1_000_000, fan_out: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs."""
    with small_batches(docs.sparkSession):  # all that reads texts runs in here
        return _similar_components(docs, n, percent, tile_elements, broadcast_rows, fan_out)


def _similar_components(docs: DataFrame, n: int, percent: int, tile_elements: int, broadcast_rows: int, fan_out: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_rows, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    bits = min(60, max(32, n_rows.bit_length() + 17))  # about 2^11 shingles a text, and 2^-7 by chance
    parts = lambda shingles: max(slots(spark), -(-int(shingles or 0) // REGION))
    enough = F.col("shared") * 100 >= F.col("n_shingles") * percent
    named = shared_elements(docs, n, parts(n_bytes // 6), bits, fan_out=fan_out)
    staying = named.filter(enough & F.col("high").isNotNull() & F.col("doc_id").isNotNull())
    classes = staged(staying.groupBy("high", "low").agg(F.min("doc_id").alias("cls"), F.first("n_shingles").alias("n")), "classes")
    first = of_ids(docs, staged(classes.select(F.col("cls").alias("doc_id")).distinct(), "ids"), broadcast_rows)
    again = shared_elements(first, n, parts(classes.agg(F.sum("n")).first()[0]), bits, fan_out=fan_out).filter(enough & F.col("high").isNotNull())
    docs = of_ids(docs, staged(again.select("doc_id").distinct(), "ids"), broadcast_rows)
    tasks = parts(again.agg(F.sum("n_shingles")).first()[0])
    sent = spark.sparkContext.broadcast(cell_counts(docs, n))  # 2^20 numbers
    shift = np.uint64(64 - CELL_BITS)

    def forest(tokens: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each token once with its smallest owner; and an edge from every other
        owner of a token to that one, each edge once."""
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        new = np.concatenate(([True], tokens[1:] != tokens[:-1]))[: len(tokens)]
        at = np.flatnonzero(new)
        first = owners[at[np.cumsum(new) - 1]]
        other = first != owners
        edges = np.unique(np.stack([owners[other], first[other]], 1), axis=0)
        return tokens[at], owners[at], edges[:, 0], edges[:, 1]

    names = ["token", "a", "b"]

    def spread(batches):
        """Tokens with one owner per batch, so that a token of very many owners
        leaves a task as few rows."""
        for batch in batches:
            keys = batch.column(0).to_numpy()
            heads, owners, size = [], [], 0
            for k, s in enumerate(shingle_sets(batch.column(1), n)):
                order = np.lexsort((s, sent.value[(s >> shift).astype(np.int64)]))
                heads.append(s[order[: prefix_length(len(s), percent)]].view(np.int64))
                owners.append(np.full(len(heads[-1]), keys[k]))
                size += len(heads[-1])
                if size > 1 << 20 or k == len(keys) - 1:
                    token, owner, a, b = forest(np.concatenate(heads), np.concatenate(owners))
                    yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(owner), pa.nulls(len(token), pa.int64())], names=names)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a ^ b), pa.array(a), pa.array(b)], names=names)
                    heads, owners, size = [], [], 0

    def meet(batches):
        """Tokens come sorted; the last token's owner is carried from batch to batch."""
        last = None
        for batch in batches:
            b = batch.column(2)
            is_edge = b.is_valid().to_numpy(zero_copy_only=False)
            token, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if is_edge.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[is_edge]), pa.array(b.fill_null(0).to_numpy()[is_edge])], names=["a", "b"])
            token, a = token[~is_edge], a[~is_edge]
            if not len(token):
                continue
            if last is not None:
                token, a = np.concatenate(([last[0]], token)), np.concatenate(([last[1]], a))
            t, owner, x, y = forest(token, a)
            last = (t[-1], owner[-1])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    met = docs.select("doc_id", "text").mapInArrow(spread, "token long, a long, b long").repartition(tasks, "token").sortWithinPartitions("token").mapInArrow(meet, "a long, b long")
    near = components(met)
    # blocks of two classes or more, cut into tiles where they hold too many elements
    near = near.join(classes.select(F.col("cls").alias("node"), "n").groupBy("node").agg(F.max("n").alias("n")).hint("shuffle_merge"), "node")
    near = staged(near, "near")
    large = staged(near.groupBy("component").agg(F.sum("n").alias("elements")).filter(F.col("elements") > tile_elements), "large")
    side = F.broadcast(large) if large.count() <= broadcast_rows else large.hint("shuffle_merge")
    near = near.join(side, "component", "left").withColumn("tiles", F.coalesce(F.ceil(F.col("elements") / tile_elements), F.lit(1)).cast("int"))
    blocks = staged(near.select(F.col("node").alias("doc_id"), F.col("component").alias("block"), "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile")), "blocks")
    n_members, most = blocks.agg(F.count("*"), F.coalesce(F.max("tiles"), F.lit(1))).first()
    small = F.broadcast(blocks) if n_members <= broadcast_rows else blocks.hint("shuffle_merge")
    # two tiles meet in a task that joins all of both, so a tile has no task of its own where there are others
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: (t != F.col("tile")) | (F.col("tiles") == 1))
    pairs = F.transform(others, lambda t: F.struct(F.least(t, "tile").alias("i"), F.greatest(t, "tile").alias("j")))
    members = docs.join(small, "doc_id")
    cells = members.select("block", F.explode(pairs).alias("pair"), "doc_id", "text").select("block", "pair.i", "pair.j", "doc_id", "text")
    cells = cells.repartition(tasks * 2, "block", "i", "j").sortWithinPartitions("block", "i", "j")

    def solve(ids, sets):
        roots = join_sets(ordered(sets), None, percent)
        a = [ids[k] for k, r in enumerate(roots) if r != k]
        b = [ids[r] for k, r in enumerate(roots) if r != k]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None

    def link(batches):
        now, ids, sets = None, [], []
        for batch in batches:
            block, i, j, doc = (batch.column(c).to_pylist() for c in range(4))
            for k, s in enumerate(shingle_sets(batch.column(4), n)):
                if (block[k], i[k], j[k]) != now:
                    if ids and (out := solve(ids, sets)) is not None:
                        yield out
                    now, ids, sets = (block[k], i[k], j[k]), [], []
                if len(s):
                    ids.append(doc[k]), sets.append(s)
        if ids and (out := solve(ids, sets)) is not None:
            yield out

    found = components(cells.mapInArrow(link, "a long, b long")).select(F.col("node").alias("cls"), "component")
    of_class = classes.select("high", "low", "cls").join(found.hint("shuffle_merge"), "cls", "left").select("high", "low", F.coalesce("component", "cls").alias("component_id"))
    return named.join(of_class.hint("shuffle_merge"), ["high", "low"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, five words, similarity 0.8."""
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one_of_each(docs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Documents with all their columns, exactly one row of each component: that of the
    smallest doc_id (nulls last; of rows that share it any one). Texts without a word
    all stay. Where doc_ids repeat or are null, rows are written with a number of their
    own first, and classes are made of those numbers."""
    n_rows, n_ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n_rows == n_ids:
        gone = similar_components(docs.select("doc_id", "text")).filter("doc_id <> component_id").select("doc_id")
        gone = staged(gone, "copies")
        return docs.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone.hint("shuffle_merge"), "doc_id", "left_anti")
    names = docs.columns
    rows = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.monotonically_increasing_id().alias("key")), "rows")
    found = similar_components(rows.select(F.col("key").alias("doc_id"), F.col("r.text").alias("text"))).select(F.col("doc_id").alias("key"), "component_id")
    found = staged(found.join(rows.select("key", F.col("r.doc_id").alias("id")).hint("shuffle_merge"), "key"), "copies")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))["key"].alias("key"))
    return rows.join(staged(first.select("key"), "kept").hint("shuffle_merge"), "key", "left_semi").select(*[F.col(f"r.`{c}`").alias(c) for c in names])
