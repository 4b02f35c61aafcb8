"""A Python worker keeps one encoder for its later tasks."""

import pyarrow as pa
import public_tokenizers

from docloom.llm.tokenizing import Encoder, kept_encoder


def test_encoder_is_kept_and_encodes_alike():
    path = public_tokenizers.path("word_bpe_49k.json")
    first = kept_encoder(path, 50, 1 << 20)
    ids = lambda e, texts: [(ids.tolist(), ends.tolist()) for _, ids, ends in e.encode(pa.array(texts))]
    ids(first, ["some words before", "été und über"])
    again = kept_encoder(path, 50, 1 << 20)
    texts = ["some other words", "", "été 12 x!"]
    assert again is first and ids(again, texts) == ids(Encoder(path, 50, 1 << 20), texts)
    assert kept_encoder(path, 60, 1 << 20) is not first
