"""Token-id files: independent zstandard frames with a trailing seek table.

File layout, in order:
- data frames: each holds the ids of whole documents (one document of more than
  `frame_ids` ids has a frame of its own) as little-endian unsigned integers of 2
  or 4 bytes, and is decoded without any other frame;
- a skippable frame 0x184D2A50 with the document index: per document its id, its
  frame, its place in the frame and its number of ids (zstandard over four
  little-endian 64-bit columns), after one row (version, bytes per id, documents);
- a skippable frame 0x184D2A5E, the seek table of the public seekable format:
  compressed size, decompressed size and the low 32 bits of XXH64 per frame, then
  the number of frames, a descriptor with the checksum bit, and 0x8F92EAB1.

Null texts count as empty and get the end id alone; a null doc_id sorts first and is
kept as the smallest 64-bit integer in the file; rows of one doc_id follow in order of
a hash of their text and may lie in several files; repeated rows are repeated; other
columns are not read; an empty table gives no file and no rows. An id that does not fit
the width is an error, never cut.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import shared_dir, slots, small_batches, staged
from docloom.llm.tokenizing import Encoder, vocabulary_size

SEEK_MAGIC, SKIP_SEEK, SKIP_INDEX = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
NULL_ID = -(2**63)


class TokenWriter:
    """Writes one file; `add` takes documents in their final order."""

    def __init__(self, sink, width: int, frame_ids: int, level: int):
        import zstandard

        self.sink, self.width, self.frame_ids = sink, width, frame_ids
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if self.n_held and self.n_held + len(ids) > self.frame_ids:
            self.flush()
        self.index.append((doc_id, len(self.table), self.n_held, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)

    def flush(self) -> None:
        import xxhash

        if not self.held:
            return
        ids = np.concatenate(self.held)
        if int(ids.max()) >> 8 * self.width:
            raise ValueError(f"id {ids.max()} does not fit {self.width} bytes")
        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self.zip.compress(raw)
        self.sink.write(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        self.flush()
        rows = np.array(self.index, "<i8").reshape(-1, 4)
        index = struct.pack("<III", 1, self.width, len(rows)) + self.zip.compress(np.ascontiguousarray(rows.T).tobytes())
        self.sink.write(struct.pack("<II", SKIP_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIP_SEEK, len(table)) + table)


class TokenReader:
    """Reads documents of one file; only the frames that hold them are decoded."""

    def __init__(self, source):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not descriptor & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.frames = [struct.unpack_from("<III", table, 12 * k) for k in range(n)]
        self.starts = np.concatenate(([0], np.cumsum([f[0] for f in self.frames]))).astype(np.int64)
        at = int(self.starts[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        index = self._at(at + 8, length)
        _, self.width, docs = struct.unpack_from("<III", index)
        self.doc_id, self.frame, self.place, self.n_ids = np.frombuffer(self.unzip.decompress(index[12:]), "<i8").reshape(4, docs)

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(int(start))
        return self.source.read(int(length))

    def load(self, frame: int) -> np.ndarray:
        import xxhash

        size, full, check = self.frames[frame]
        raw = self.unzip.decompress(self._at(self.starts[frame], size), max_output_size=full)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {frame} is damaged")
        return np.frombuffer(raw, f"<u{self.width}")

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) in file order, of all documents or of the wanted ones."""
        last, ids = -1, None
        for doc_id, frame, place, n in zip(self.doc_id.tolist(), self.frame.tolist(), self.place.tolist(), self.n_ids.tolist(), strict=True):
            if wanted is None or doc_id in wanted:
                if frame != last:
                    last, ids = frame, self.load(frame)
                yield doc_id, ids[place : place + n]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, *, files: int | None = None, frame_ids: int = 1 << 16, level: int = 1, id_bytes: int | None = None, file_bytes: int = 64 << 20) -> DataFrame:
    """Encode `text` of every row and write the ids, `end_id` last, in ascending
    doc_id order to files below `path` (any address that pyarrow's file systems
    take). Without `files` and `id_bytes` there are as many files as `file_bytes` of text
    each make, and ids take two bytes if the vocabulary and the end id allow it, else
    four. Returns the manifest (file_no, file, n_docs, n_ids), written and reread.

    A task writes under a name of its own and renames at the end, so a repeated or
    speculative task replaces its file by an equal one."""
    spark = docs.sparkSession
    if not files:
        total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
        files = max(slots(spark), -(-total // file_bytes))
    id_bytes = id_bytes or (2 if max(vocabulary_size(tokenizer) - 1, end_id) < 1 << 16 else 4)
    fs.FileSystem.from_uri(path)[0].create_dir(fs.FileSystem.from_uri(path)[1], recursive=True)

    def write(batches):
        from pyspark import TaskContext

        part, encoder, out = TaskContext.get().partitionId(), None, None
        store, root = fs.FileSystem.from_uri(path)
        name = f"part-{part:06d}.tokens"
        temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
        end = np.array([end_id], np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder, sink = Encoder(tokenizer), store.open_output_stream(temporary)
                out = TokenWriter(sink, id_bytes, frame_ids, level)
            keys = batch.column(0).fill_null(NULL_ID).to_pylist()
            for first, ids, ends in encoder.encode(batch.column(1)):
                start = 0
                for k, stop in enumerate(ends.tolist(), first):
                    out.add(keys[k], np.concatenate((ids[start:stop], end)))
                    start = stop
        if out is not None:
            out.close()
            sink.close()
            store.move(temporary, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file_no": [part], "file": [f"{path}/{name}"], "n_docs": [len(out.index)], "n_ids": [out.n_ids]}, schema=pa.schema([("file_no", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    with small_batches(spark):
        return staged(ordered.mapInArrow(write, "file_no long, file string, n_docs long, n_ids long"), "manifest")


def read_token_files(manifest: DataFrame, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in the whole output),
    n_tokens, ids_crc32 (over its ids as little-endian unsigned 32-bit integers) and,
    if asked for, ids. Files are read where they lie, one task per few files."""
    wanted = None if doc_ids is None else set(doc_ids)
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("file", "before")
    n = manifest.count()
    files = files.repartition(max(1, min(n, max(slots(manifest.sparkSession), -(-n // 8)))))  # eight files a task at most
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
    schema = pa.schema([(n, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n in names])

    def read(batches):
        def block(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as source:
                    reader = TokenReader(source)
                    at = start + np.cumsum(reader.n_ids) - reader.n_ids
                    place = iter(at if wanted is None else at[np.isin(reader.doc_id, list(wanted))])
                    rows, held = [], 0
                    for doc_id, ids in reader.documents(wanted):
                        row = (None if doc_id == NULL_ID else doc_id, int(next(place)), len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                        held += 100 + len(ids) * with_ids
                        if held > 1 << 20:
                            yield block(rows)
                            rows, held = [], 0
                    if rows:
                        yield block(rows)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level BPE ids with end id 2, written and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, shared_dir(spark, "tokens"))
    return read_token_files(manifest, with_ids=False)
