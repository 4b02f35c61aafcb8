"""Operator 13 against the sentencepiece library and against a plain merge loop."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from docloom.llm import common
from docloom.llm.pieces import PieceCodec, encode_pieces, op13_sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", " ", "  ", "▁", "\n", "\t", "é", "ñ", "漢", "😀", "\x00", "é", "<s>", "</s>", "<0x41>", ".", ",", "1", "23", "http://www.", "=====", " ", "​", "한", "\r\n"]
ODD = ["", " ", "  ", "▁", " a", "a ", "\n", "aaaa" * 3000, "漢" * 3000, "word " * 5000]


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(PATH)


def texts(n: int) -> list[str]:
    rng = random.Random(3)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ODD


def merged(codec: PieceCodec, text: str) -> list[str]:
    """Merge the best pair (leftmost of equal scores) of the whole text until none is left."""
    symbols = list(" " + text.replace("▁", " ")) if text else []
    while True:
        best = min(((codec.rank[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in codec.rank), default=None)
        if best is None:
            return symbols
        k = best[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


def test_agenda_equals_plain_merging(codec):
    some = texts(150)[:150]
    for text, ids in zip(some, codec.encode_rows(pa.array(some), False, False), strict=True):
        want = [x for s in merged(codec, text) for x in ([codec.id_of[s]] if s in codec.id_of else [codec.byte_id[b] for b in s.encode()])]
        assert ids.tolist() == want


def test_ids_and_texts_equal_the_library(codec):
    some = texts(1500)
    for begin, end in ((True, True), (False, True), (False, False)):
        rows = list(codec.encode_rows(pa.array(some), begin, end))
        assert [r.tolist() for r in rows] == codec.library.encode(some, add_bos=begin, add_eos=end)
        assert [codec.decode_row(r).decode() for r in rows] == [t.replace("▁", " ") for t in some]


def test_any_ids_decode_as_the_library_does(codec):
    rng = random.Random(5)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32_000), rng.randrange(4)]) for _ in range(rng.randint(0, 12))]
        assert codec.decode_row(np.array(ids, np.uint32)).decode() == codec.library.decode(ids)


def test_a_full_memory_changes_nothing(codec):
    some = texts(300)
    small = PieceCodec(PATH, remember=10, run_bytes=200)
    assert [r.tolist() for r in small.encode_rows(pa.array(some), True, True)] == [r.tolist() for r in codec.encode_rows(pa.array(some), True, True)]


def test_check_finds_a_difference(codec):
    rows = list(codec.encode_rows(pa.array(["one text"]), True, True))
    with pytest.raises(ValueError, match="differs"):
        codec.check(pa.array(["one text"]), [rows[0][:-1]], [b"one text"], True, True)


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_docloom", T.StringType()), T.StructField("text 2.x", T.LongType())])
    rows = [(1, None, "x", 1), (1, None, "x", 1), (None, "", None, None), (2, "Same words", "y", 2), (2, "Same words", "y", 2)]
    docs = spark.createDataFrame(rows, schema)
    with pytest.raises(ValueError, match="exist"):
        encode_pieces(docs, PATH, ids="text")
    out = encode_pieces(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded, len(r.ids) // 4) for r in out)[:3] == [(0, "", 2), (1, "", 2), (1, "", 2)]
    assert len({bytes(r.ids) for r in out if r.doc_id == 2}) == 1
    assert encode_pieces(docs.limit(0), PATH).count() == 0


def test_query_gives_the_librarys_digests(spark, codec):
    d = "/root/testdata/sf0.001"
    texts_of = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    out = op13_sentence_pieces(spark, d).collect()
    assert len(out) == len(texts_of)
    for r in out:
        ids = codec.library.encode(texts_of[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()


def test_staged_tables_are_cleared(spark):
    with common.cleared(spark):
        path = common.staged(spark.range(4), "short").inputFiles()[0]
        assert spark.read.parquet(path).count() >= 1
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
