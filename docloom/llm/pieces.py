"""SentencePiece ids of whole texts by a score-ordered agenda, and back.

A merge-type vocabulary is applied as it is defined: a text is a chain of characters,
the agenda holds all adjacent pairs that form a piece, the pair of the highest score
(of equal scores the leftmost) is merged, and the two new pairs go on the agenda until
it is empty. Characters without a piece become their byte pieces, or the unknown id
where the vocabulary has none.

Merges never cross a place whose two characters stand side by side in no piece, so a text
is cut at such places (between ASCII characters) and each distinct part runs through
the agenda once per worker, as long as it is remembered. A text without such a place is one
agenda, n log n in its length. Each Arrow batch is encoded by the sentencepiece library too, whole text by whole
text, and what does not come back as it was is decoded by it; a difference is an error that names the row's place.

Null texts are empty; an empty text has only the begin and end ids and decodes to an
empty text. U+2581 stands for a space, as in the library, so it decodes to one; any other
text decodes to itself. Rows keep all their columns, repeated rows each give their own
result, and an empty table gives no rows. Added columns are named by the caller; a clash with
a column of the input is an error. Vocabularies that fold characters, drop white space, or hold user-defined
or unused pieces are refused."""

from __future__ import annotations

import heapq
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import appended
from docloom.llm.tokenizing import Encoder

#: The mark of a space, and kinds of pieces in a model file.
MARK, NORMAL, UNKNOWN, CONTROL, BYTE = "▁", 1, 2, 3, 6
MERGES = 2  # the model type
SYMBOLS = 1 << 31  # more than pieces and characters together
SHORT, BLOCK, NEVER = 48, 16_384, 1 << 30


class PieceCodec(Encoder):
    """One per Python worker; its memory of parts is bounded like that of `Encoder`."""

    def __init__(self, path: str, remember: int = 400_000, run_bytes: int = 4 << 20):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.library = SentencePieceProcessor(model_file=path)
        model = ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        form = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != MERGES or form.precompiled_charsmap or form.remove_extra_whitespaces or not form.escape_whitespaces or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a merge-type vocabulary without folding, user-defined and unused pieces is needed")
        self.remember, self.run_bytes = remember, run_bytes
        self.known, self.at, self.flat = {}, np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.prefix = form.add_dummy_prefix
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        texts = [p.piece.replace(MARK, " ") for p in model.pieces]
        self.id_of = {t: k for k, (t, p) in enumerate(zip(texts, model.pieces, strict=True)) if p.type == NORMAL}
        place = {s: k for k, s in enumerate(sorted({p.score for p in model.pieces}, reverse=True))}
        self.rank = {t: place[model.pieces[k].score] for t, k in self.id_of.items()}
        self.size = len(model.pieces)
        # a symbol is a piece by its id, or a character without a piece by what follows the ids
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + np.int32(self.size)
        for t, k in self.id_of.items():
            if len(t) == 1:
                self.symbol_of[ord(t)] = k
        symbol = lambda t: self.id_of.get(t, self.size + ord(t) if len(t) == 1 else -1)
        pairs = [(symbol(t[:c]) * SYMBOLS + symbol(t[c:]), self.rank[t], k) for t, k in self.id_of.items() for c in range(1, len(t)) if symbol(t[:c]) >= 0 <= symbol(t[c:])]
        self._file_pairs(np.array(sorted(pairs) or [(-1, NEVER, 0)], np.int64))
        self.byte_id = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        self.joined = np.zeros((128, 128), bool)
        for t in self.id_of:
            for a, b in pairwise(t):
                if a < "\x80" and b < "\x80":
                    self.joined[ord(a), ord(b)] = True
        surface = {UNKNOWN: model.trainer_spec.unk_surface, CONTROL: ""}
        shown = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else surface.get(p.type, t).encode() for t, p in zip(texts, model.pieces, strict=True)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.concatenate(([0], np.cumsum([len(x) for x in shown]))).astype(np.int64)
        self.is_byte = np.array([p.type == BYTE for p in model.pieces])
        self.is_normal = np.array([p.type == NORMAL for p in model.pieces])

    def cuts(self, data: np.ndarray, starts_of_rows: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data), bool)
        if len(data) > 1:
            a, b = data[:-1], data[1:]
            cut[1:] = (a < 128) & (b < 128) & ~self.joined[a & 127, b & 127]
        rows = starts_of_rows[:-1]
        cut[rows[rows < len(data)]] = True
        return np.flatnonzero(cut)

    def ids_of(self, pieces: list[str]) -> list[list[int]]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list[list[int]] = [[]] * len(pieces)
        order = np.argsort(sizes, kind="stable")
        short = order[: int(np.searchsorted(sizes[order], SHORT, side="right"))]
        for k in range(0, len(short), BLOCK):
            rows = short[k : k + BLOCK]
            for row, ids in zip(rows.tolist(), self.short_agendas([pieces[x] for x in rows.tolist()], sizes[rows]), strict=True):
                out[row] = ids
        for row in order[len(short) :].tolist():
            out[row] = [x for s in self.long_agenda(pieces[row]) if s for x in self.ids_of_symbol(s)]
        return out

    def ids_of_symbol(self, symbol: str) -> list[int]:
        if symbol in self.id_of:
            return [self.id_of[symbol]]
        return [self.byte_id[x] for x in symbol.encode()] if self.byte_id else [self.unknown]

    def _file_pairs(self, pairs: np.ndarray) -> None:
        """Pairs (key, rank, product) in buckets by a multiplied key, all buckets as wide as the fullest."""
        self.shift = np.uint64(64 - max(4, len(pairs).bit_length()))
        bucket = self._bucket(pairs[:, 0])
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(1 << (64 - int(self.shift))))
        slot = np.arange(len(pairs)) - first[bucket[order]]
        shape = (len(first), int(slot.max()) + 1)
        self.pair, self.pair_rank, self.pair_product = np.full(shape, -1, np.int64), np.full(shape, NEVER, np.int32), np.zeros(shape, np.int32)
        for table, column in ((self.pair, 0), (self.pair_rank, 1), (self.pair_product, 2)):
            table[bucket[order], slot] = pairs[order, column]

    def _bucket(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def looked_up(self, table: np.ndarray, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        """What the table holds for each pair of symbols, `none` for a pair that forms no piece."""
        key = a.astype(np.int64) * SYMBOLS + b
        at = self._bucket(key)
        out = np.full(key.shape, none, np.int32)
        for slot in range(self.pair.shape[1]):
            hit = self.pair[at, slot] == key
            out[hit] = table[at[hit], slot]
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair of symbols forms, NEVER where it forms none."""
        return self.looked_up(self.pair_rank, a, b, NEVER)

    def short_agendas(self, parts: list[str], sizes: np.ndarray) -> list[list[int]]:
        """The agendas of many parts at once, a row each: in each round every row that still has
        an open pair merges its best one, the first of equal ranks."""
        width, n = int(sizes[-1]), len(parts)
        symbols = np.full((n, width + 1), -1, np.int32)
        symbols[:, :width][np.arange(width) < sizes[:, None]] = self.symbol_of[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        left = sizes.copy()
        final = np.full((n, width), -1, np.int32)
        active, open_pairs = np.arange(n), self.ranks(symbols[:, :-1], symbols[:, 1:])
        while len(active):
            k = open_pairs.argmin(1)
            going = open_pairs[np.arange(len(active)), k] < NEVER
            final[active[~going]] = symbols[~going, :width]
            active, symbols, open_pairs, k = active[going], symbols[going], open_pairs[going], k[going]
            if not len(active):
                break
            at = np.arange(len(active))
            product = self.looked_up(self.pair_product, symbols[at, k], symbols[at, k + 1], -1)
            after = np.arange(width)[None, :] > k[:, None]
            symbols[:, :-1] = np.where(after, symbols[:, 1:], symbols[:, :-1])
            open_pairs[:, :-1] = np.where(after[:, :-1], open_pairs[:, 1:], open_pairs[:, :-1])
            symbols[at, k] = product
            left[active] -= 1
            open_pairs[at, k] = self.ranks(product, symbols[at, k + 1])
            back = np.flatnonzero(k)
            open_pairs[back, k[back] - 1] = self.ranks(symbols[back, k[back] - 1], product[back])
        lists = [row[:m] for row, m in zip(final.tolist(), left.tolist(), strict=True)]
        for row in np.flatnonzero((final >= self.size).any(1)).tolist():
            lists[row] = [i for x in lists[row] for i in ([x] if x < self.size else self.ids_of_symbol(chr(x - self.size)))]
        return lists

    def long_agenda(self, text: str) -> list[str]:
        """A pair on the heap is stale once either symbol was merged: its two lengths then
        no longer add up."""
        rank, n = self.rank, len(text)
        symbols: list[str] = list(text)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        open_pairs = []
        for k in range(n - 1):
            r = rank.get(text[k : k + 2])
            if r is not None:
                open_pairs.append((r, k, k + 1, 2))
        heapq.heapify(open_pairs)
        while open_pairs:
            _, a, b, size = heapq.heappop(open_pairs)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
                continue
            symbols[a] += symbols[b]
            symbols[b] = ""
            after = right[b]
            right[a] = after
            if after < n:
                left[after] = a
                both = symbols[a] + symbols[after]
                if (r := rank.get(both)) is not None:
                    heapq.heappush(open_pairs, (r, a, after, len(both)))
            if (before := left[a]) >= 0:
                both = symbols[before] + symbols[a]
                if (r := rank.get(both)) is not None:
                    heapq.heappush(open_pairs, (r, before, a, len(both)))
        return symbols

    def encode_rows(self, column: pa.Array, begin: bool, end: bool):
        """Yield the ids of each row (uint32)."""
        text = pc.replace_substring(column.fill_null("").cast(pa.large_string()), MARK, " ")
        if self.prefix:
            text = pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
        head, tail = [np.array([x] if on else [], np.uint32) for x, on in ((self.begin, begin), (self.end, end))]
        for _, ids, until in self.encode(text):
            first = 0
            for last in until.tolist():
                yield np.concatenate((head, ids[first:last], tail))
                first = last

    def decode_row(self, ids: np.ndarray) -> bytes:
        """The text of the ids in UTF-8; a byte piece that is part of no character is U+FFFD."""
        n = self.shown_at[ids.astype(np.int64) + 1] - self.shown_at[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = self.shown[np.repeat(self.shown_at[ids] - (ends - n), n) + np.arange(total)]
        # a space at the front of a normal piece stands for the prefix
        drop = int(self.prefix and total > 0 and out[0] == 32 and bool(self.is_normal[ids[int(np.argmax(n > 0))]]))
        raw = out.tobytes()
        one = self.is_byte[ids]
        if one.any():
            run = np.where(one, np.cumsum(~one), -1)  # byte pieces in a row have one number
            if (n[1:-1] == 0).any() or not valid(raw):
                raw = mended(raw, np.repeat(run, n))
        return raw[drop:]

    def check(self, texts: pa.Array, rows: list[np.ndarray], back: list[bytes], begin: bool, end: bool) -> None:
        """The library's ids, or an error; and its texts, where a text does not come back as it was (but for U+2581,
        which comes back as a space). A batch is handed over in runs of about a megabyte."""
        given, first = texts.fill_null("").to_pylist(), 0
        while first < len(given):
            last, size = first, 0
            while last < len(given) and size < 1 << 20:
                size += len(given[last])
                last += 1
            right = self.library.encode(given[first:last], add_bos=begin, add_eos=end, num_threads=1)
            for k, r in enumerate(right, first):
                same = given[k].replace(MARK, " ").encode() == back[k]
                if r != rows[k].tolist() or not (same or self.library.decode(r).encode() == back[k]):
                    raise ValueError(f"row {k} of a batch differs from the sentencepiece library: {given[k][:80]!r}")
            first = last


def valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def mended(raw: bytes, run: np.ndarray) -> bytes:
    """Each run of byte pieces is decoded on its own (`run` is its number per byte, -1 elsewhere);
    a byte that begins no character in it is U+FFFD."""
    out, k = bytearray(), 0
    while k < len(raw):
        size = 1
        if run[k] >= 0:
            lead = raw[k]
            size = 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 1
            if not (run[k : k + size] == run[k]).all() or not valid(raw[k : k + size]):
                size = 0
        out += raw[k : k + size] if size else "\N{REPLACEMENT CHARACTER}".encode()
        k += max(size, 1)
    return bytes(out)


def encode_pieces(docs: DataFrame, path: str, *, ids: str = "ids", decoded: str = "decoded", begin: bool = True, end: bool = True, check: bool = True) -> DataFrame:
    """docs with two more columns: `ids`, the ids of the text as little-endian unsigned
    32-bit integers, and `decoded`, what they decode to. `check` holds each batch against
    the library. Null texts are empty; see the module for all odd rows."""
    if clash := {ids, decoded} & set(docs.columns):
        raise ValueError(f"columns exist: {', '.join(sorted(clash))}")
    codec: list[PieceCodec] = []

    def run(texts: pa.Array):
        if not codec:
            codec.append(PieceCodec(path))
        rows = list(codec[0].encode_rows(texts, begin, end))
        back = [codec[0].decode_row(r) for r in rows]
        if check:
            codec[0].check(texts, rows, back, begin, end)
        return [pa.array([r.astype("<u4").tobytes() for r in rows], pa.binary()), pa.array([b.decode() for b in back], pa.string())]

    return appended(docs, [(ids, "binary", pa.binary()), (decoded, "string", pa.string())], run, docs.columns)


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of what they decode to."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    n = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
