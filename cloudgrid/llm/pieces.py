"""Encoding whole texts through a cache of white-space delimited pieces.

Tokenizers that first cut a text by a pattern encode each cut by itself. Where a
single space or line feed stands between two other characters, the byte-level
pattern always cuts before it, so the pieces between such places can be encoded
once and looked up afterwards. Texts with any other white space go to the
tokenizer whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import chunks, held, rows_of

#: Pieces that one Python worker keeps: as objects, of about 200 bytes, and in arrays, of about 35.
HOT, RECENT, PACKED = 60_000, 40_000, 1_200_000
#: Unknown pieces that are encoded as one text; longer texts take the library more time a piece.
JOINED = 50
#: What stands between unknown pieces that are encoded as one text: a cut of its own, of one id.
SEPARATORS = {"byte_level": "\n", "word": " \x01 "}
_other_space = re.compile(r"[^\S \n]").search


class PieceTable:
    """Packed ids by piece. The first HOT pieces stay in a dict; later ones go through a small dict into sorted arrays.

    The arrays are searched by 128-bit hashes. When they are full, pieces that weren't met
    again since the last time go, or all of them if most were.
    """

    def __init__(self):
        self.hot: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self._empty()

    def _empty(self) -> None:
        self.high, self.low = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size, self.blob = np.zeros(0, np.int64), np.zeros(0, np.uint32), b""
        self.met = np.zeros(0, bool)

    def _forget(self) -> None:
        """Let go of what wasn't met again."""
        if 2 * self.met.sum() > len(self.met):
            self._empty()
            return
        order = np.argsort(self.start)  # the blob's order
        size, kept = self.size[order], self.met[order]
        self.blob = np.frombuffer(self.blob, np.uint8)[np.repeat(kept, size)].tobytes()
        start = np.zeros(len(order), np.int64)
        start[order[kept]] = np.cumsum(size[kept], dtype=np.int64) - size[kept]
        self.high, self.low, self.start, self.size = (x[self.met] for x in (self.high, self.low, start, self.size))
        self.met = np.zeros(len(self.high), bool)

    @staticmethod
    def _hashes(pieces) -> np.ndarray:
        return np.frombuffer(b"".join([xxhash.xxh3_128_digest(p) for p in pieces]), np.uint64).reshape(-1, 2)

    def get(self, pieces: list[str]) -> list[bytes | None]:
        found = list(map(self.hot.get, pieces))
        if None in found:
            at = [k for k, v in enumerate(found) if v is None]
            for k, v in zip(at, map(self.recent.get, [pieces[k] for k in at]), strict=True):
                found[k] = v
            at = [k for k in at if found[k] is None]
            if at and len(self.high):
                h = self._hashes([pieces[k] for k in at])
                order = np.argsort(h[:, 0])  # neighbouring searches then touch the same memory
                at, h = np.array(at)[order].tolist(), h[order]
                place = np.minimum(np.searchsorted(self.high, h[:, 0]), len(self.high) - 1)
                hit = np.flatnonzero((self.high[place] == h[:, 0]) & (self.low[place] == h[:, 1]))
                self.met[place[hit]] = True
                start = self.start[place[hit]]
                for k, a, b in zip(hit.tolist(), start.tolist(), (start + self.size[place[hit]]).tolist(), strict=True):
                    found[at[k]] = self.blob[a:b]
        return found

    def add(self, new: dict[str, bytes]) -> None:
        if len(self.hot) < HOT:
            self.hot |= new
            return
        self.recent |= new
        if len(self.recent) < RECENT:
            return
        if len(self.high) > PACKED:
            self._forget()
        h, ids = self._hashes(self.recent), list(self.recent.values())
        size = np.fromiter(map(len, ids), np.uint32, len(ids))
        start = len(self.blob) + np.cumsum(size, dtype=np.int64) - size
        high = np.concatenate([self.high, h[:, 0]])
        order = np.argsort(high, kind="stable")
        self.high, self.low = high[order], np.concatenate([self.low, h[:, 1]])[order]
        self.start, self.size = np.concatenate([self.start, start])[order], np.concatenate([self.size, size])[order]
        self.met = np.concatenate([self.met, np.zeros(len(size), bool)])[order]
        self.blob += b"".join(ids)
        self.recent = {}


class PieceEncoder:
    """encode_many maps strings to id lists; mode says which cuts are safe.

    byte_level: pieces keep the space or line feed before them.
    word: white space carries no ids, so pieces are what lies between.
    whole: no cuts.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], mode: str, wide: bool = False, joined: bool = False, special: Iterable[str] = ()):
        """special: strings that the tokenizer takes out of a text before it cuts it; a text that holds one isn't cut here."""
        self.encode_many, self.mode, self.code = encode_many, mode, "I" if wide else "H"
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE).search if special else lambda text: None
        self.table = PieceTable()
        mark = encode_many([SEPARATORS[mode]])[0] if joined and mode in SEPARATORS else []
        self.mark = mark[0] if len(mark) == 1 else None
        self.feed = self.pack(encode_many(["\n"])[0]) if mode == "byte_level" else b""

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def prepared(self, text: str) -> str | None:
        """The text with a space before each piece but the first, or None where no cut is safe."""
        if self.special(text):
            return None
        if self.mode == "word":
            return text.replace("\n", " ")
        if self.mode == "whole" or not text or text[0] in " \n" or text[-1] in " \n" or _other_space(text):
            return None
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return None
        return "\r" + text.replace("\n", " \n")  # a mark: the first piece has no space before it

    def _learn(self, pieces: list[str]) -> list[bytes]:
        if self.mode == "word":
            return self._packed(pieces)
        plain = [p[1:] if p[0] in "\r\n" else " " + p for p in pieces]
        return [self.feed + ids if p[0] == "\n" else ids for p, ids in zip(pieces, self._packed(plain), strict=True)]

    def _packed(self, texts: list[str]) -> list[bytes]:
        """Many short texts as one, whose ids are parted at the separator's."""
        if self.mark is None:
            return list(map(self.pack, self.encode_many(texts)))
        sep, out = SEPARATORS[self.mode], []
        for at in range(0, len(texts), JOINED):
            some = texts[at : at + JOINED]
            ids = np.array(self.encode_many([sep.join(some)])[0], self.code)
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) == len(some) - 1:
                raw, w = ids.tobytes(), ids.itemsize
                bounds = [0, *((ends + 1) * w).tolist(), len(raw) + w]
                out += [raw[a : b - w] for a, b in zip(bounds, bounds[1:])]
            else:  # a text has the separator's id itself
                out += map(self.pack, self.encode_many(some))
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Packed little-endian ids of each text.

        Arrow cuts the texts and numbers their distinct pieces; each is looked up once.
        """
        ready = [self.prepared(t) for t in texts]
        cut = pc.split_pattern(pa.array([t for t in ready if t is not None], pa.large_string()), " ")
        pieces = cut.flatten().dictionary_encode()
        names = pieces.dictionary.to_pylist()
        found = self.table.get(names)
        if None in found:
            missing = [p for p, ids in zip(names, found, strict=True) if ids is None]
            new = dict(zip(missing, self._learn(missing), strict=True))
            found = [new[p] if ids is None else ids for p, ids in zip(names, found, strict=True)]
            self.table.add(new)
        joined = pa.array(found, pa.large_binary()).take(pieces.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :][cut.offsets.to_numpy()].tolist() if len(joined) else [0] * (len(cut) + 1)
        raw = memoryview(joined.buffers()[2] or b"")
        bounds = iter(zip(ends, ends[1:]))
        whole = iter(self.encode_many([t for t, r in zip(texts, ready, strict=True) if r is None]) if None in ready else ())
        for r in ready:
            if r is None:
                yield self.pack(next(whole))
            else:
                a, b = next(bounds)
                yield bytes(raw[a:b])


def tokenizers_encoder(model: str, mode: str, special_as_text: bool = False) -> PieceEncoder:
    """An encoder of the tokenizers library, kept by each Python worker.

    Strings of special tokens in a text become these tokens, as the library has it, or ordinary text with special_as_text.
    """

    def make() -> PieceEncoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(model)
        t.encode_special_tokens = special_as_text
        special = [x.content for x in t.get_added_tokens_decoder().values()]
        return PieceEncoder(lambda xs: [e.ids for e in t.encode_batch_fast(xs, add_special_tokens=False)], mode, t.get_vocab_size() > 1 << 16, joined=True, special=special)

    return held(("tokenizers", mode, special_as_text, hashlib.sha1(model.encode()).digest()), make)


def read_model(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(batches: Iterable, encoder: PieceEncoder) -> Iterator[tuple]:
    """Rows of Arrow batches that end in text, with packed ids in its place; a null text is empty."""
    for some in chunks(rows_of(batches), lambda r: len(r[-1] or ""), 3 << 20):
        for row, ids in zip(some, encoder.encode([r[-1] or "" for r in some]), strict=True):
            yield *row[:-1], ids
