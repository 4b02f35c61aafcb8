"""Token ids of whole Arrow columns by the tokenizers library.

A byte-pair tokenizer handles each pre-token on its own. Texts are cut where every
such tokenizer cuts (before white space that follows a visible ASCII character, and
between an ASCII letter and an ASCII character that is none), each distinct piece
is encoded once, and the ids are gathered. The result equals
encoding each whole text; tests hold both against each other."""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa

from docloom.llm.common import SPACE, chunks

#: Words on which the direct way into the model must agree with the whole tokenizer.
PROBES = ["the", " the", "Word", " Señor", "élève", " Straße", " überaus", "\nNext", " thinnessly", "ΑΣ", " кот"]


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
ASCII_OTHER = ~LETTER
ASCII_OTHER[128:] = False


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: visible Latin-1 bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    rest = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + k) for k, b in enumerate(rest)}


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class Encoder:
    """One per Python worker; remembers up to `remember` pieces, which bounds its
    memory. Pieces beyond that are encoded anew each time they are met."""

    def __init__(self, path: str, remember: int = 600_000, run_bytes: int = 12 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remember, self.run_bytes = remember, run_bytes
        self.known: dict[str, int] = {}
        self.at = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.folds = self.tokenizer.normalizer is not None  # lower case, composed, white space dropped
        self.table = _byte_letters()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.direct = all(self._direct(p) == self._whole([p])[0] for p in PROBES)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _direct(self, piece: str) -> list[int] | None:
        """Ids of one word of letters, perhaps after a space or line end: it is one
        pre-token, so the model gets it without the scan."""
        before = piece[0] if piece[0] in " \n" else ""
        word = piece[len(before) :]
        if not word.isalpha():
            return None
        ids: list[int] = []
        model = self.tokenizer.model
        if self.folds:
            if not word.isascii() and not unicodedata.is_normalized("NFC", word):
                return None
            word = word.lower() if word.isascii() else "".join(map(str.lower, word))
        elif before == "\n":
            ids = [t.id for t in model.tokenize(self.table[10])]
        elif before:
            word = before + word
        word = word.replace(" ", self.table[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return ids + [t.id for t in model.tokenize(word)]

    def ids_of(self, pieces: list[str]) -> list[list[int]]:
        if not self.direct:
            return self._whole(pieces)
        out = [self._direct(p) for p in pieces]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self._whole([pieces[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def cuts(self, data: np.ndarray, starts_of_rows: np.ndarray) -> np.ndarray:
        """Where pieces start; every row that is not empty starts one."""
        cut = np.zeros(len(data), bool)
        if len(data) > 1:
            visible = (data > 32) & (data < 127)
            cut[1:] = SPACE[data[1:]] & visible[:-1] | (LETTER[data[:-1]] & ASCII_OTHER[data[1:]])
        rows = starts_of_rows[:-1]
        if self.special:
            for m in re.finditer(b"|".join(map(re.escape, self.special)), data):
                cut[m.start() + 1 : m.end()] = False  # they stay whole
        cut[rows[rows < len(data)]] = True
        return np.flatnonzero(cut)

    def _gather(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and where each starts (one more closes)."""
        known = self.known
        place = np.fromiter((known.get(t, -1) for t in texts), np.int64, len(texts))
        missing = np.flatnonzero(place < 0)
        lists = self.ids_of([texts[k] for k in missing])
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        fresh = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
        held = len(self.at) - 1
        place[missing] = held + np.arange(len(missing))
        at = np.concatenate((self.at, self.at[-1] + np.cumsum(size)))
        flat = np.concatenate((self.flat, fresh))
        room = max(0, self.remember - held)
        if room and len(missing):
            known.update(zip((texts[k] for k in missing[:room]), range(held, held + room), strict=False))
            self.at = at[: held + min(room, len(missing)) + 1]
            self.flat = flat[: self.at[-1]]
        n = at[place + 1] - at[place]
        ends = np.cumsum(n)
        where = np.repeat(at[place] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return flat[where], np.concatenate(([0], ends))

    def encode(self, column: pa.Array):
        """Yield (first row, ids of a run of rows as uint32, end of each row's ids)."""
        for first, _, data, rows in chunks(column, self.run_bytes):
            starts = self.cuts(data, rows)
            bounds = np.append(starts, len(data)).astype(np.int64)
            pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
            flat, at = self._gather(pieces.dictionary.to_pylist())
            index = pieces.indices.to_numpy()
            n = at[index + 1] - at[index]
            ends = np.cumsum(n)
            ids = flat[np.repeat(at[index] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
            until = np.concatenate(([0], ends))
            yield first, ids, until[np.searchsorted(starts, rows[1:])]


_kept: dict[tuple, Encoder] = {}


def kept_encoder(path: str, remember: int, run_bytes: int) -> Encoder:
    """The encoder that an earlier task of this Python worker left, with the pieces it remembers, else a new one. A
    worker keeps one; ids do not depend on what is remembered."""
    key = (path, os.stat(path).st_mtime_ns, remember, run_bytes)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(path, remember, run_bytes)
    return _kept[key]
