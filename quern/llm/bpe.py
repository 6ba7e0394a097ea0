"""Byte-pair encoding by per-prefix dynamic programming.

For every prefix of a piece there is exactly one token that can stand last in
its encoding: the vocabulary tokens ending there come from an automaton over
the vocabulary (suffix matches), and of those the one that is compatible with
the last token of the prefix before it is stored. Following the back-pointers
from the end gives the exact ids without running the merges.

Two tokens are compatible if encoding their joined bytes gives the two again.
That is tested on the merge tree alone: undo the youngest merges along the
border, from both sides, and look whether some pair across the border would
have merged earlier.
"""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import spread

#: Where the vocabulary lies; every entry point takes another place.
VOCABULARY = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: The pieces a text is cut into before encoding (fixed values of the public tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same on text that is all ASCII, for the faster engine of the standard library.
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"
#: Pieces a worker remembers before it starts anew; bounds its memory, changes no result.
REMEMBER = 1_000_000


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.merged: dict[int, int] = {}  # left << 32 | right -> token
        self.left = [0] * (max(ranks.values()) + 1)
        self.right = list(self.left)
        self.known: dict[int, bool] = {}
        self.whole: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton()
        for b, t in sorted(ranks.items(), key=lambda x: x[1]):
            self.left[t] = self.right[t] = t
            if len(b) > 1:
                for k in range(1, len(b)):
                    x, y = ranks.get(b[:k]), ranks.get(b[k:])
                    if x is not None and y is not None and x < t and y < t and self.compatible(x, y):
                        self.left[t], self.right[t] = x, y
                        self.merged[x << 32 | y] = t
                        break
                else:
                    continue  # no merge makes it
            self.whole[b] = t
            automaton.add_word(b.decode("latin-1"), (t, len(b)))
        self.known.clear()  # filled while merges were missing
        automaton.make_automaton()
        self.automaton = automaton

    @classmethod
    def load(cls, path: str = VOCABULARY) -> PrefixBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def compatible(self, a: int, b: int) -> bool:
        left, right, merged = self.left, self.right, self.merged
        before = sys.maxsize  # merges from this rank on come too late to break the border
        while True:
            t = merged.get(a << 32 | b)
            if t is not None and t < before:
                return False
            if a > b:
                before, inner = a, right[a]
                if inner == a:  # a single byte; go on with the other side
                    before, inner = b + 1, left[b]
                    if inner == b:
                        return True
                    b = inner
                else:
                    a = inner
            else:
                before, inner = b + 1, left[b]
                if inner == b:
                    before, inner = a, right[a]
                    if inner == a:
                        return True
                    a = inner
                else:
                    b = inner

    def piece(self, b: bytes) -> list[int]:
        if (t := self.whole.get(b)) is not None:
            return [t]
        n, known = len(b), self.known
        last, size = [-1] * n, [0] * n
        for end, (t, k) in self.automaton.iter(b.decode("latin-1")):
            if size[end]:
                continue
            if k == end + 1:
                last[end], size[end] = t, k
            elif (p := last[end - k]) >= 0:
                key = p << 32 | t
                ok = known.get(key)
                if ok is None:
                    if len(known) > REMEMBER:
                        known.clear()
                    ok = known[key] = self.compatible(p, t)
                if ok:
                    last[end], size[end] = t, k
        ids, at = [], n - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]


class Encoder(dict):
    """piece -> its ids as int32 bytes; ``encode`` joins those of a text."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe = bpe
        self.cut, self.cut_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.bpe.piece(piece.encode())).tobytes()
        if len(piece) < 64:
            if len(self) > REMEMBER:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, (self.cut_ascii if text.isascii() else self.cut)(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(PrefixBpe.load(path))
    return _encoders[path]


def lists(parts: list[bytes]) -> pa.ListArray:
    offsets = array("i", [0])
    at = 0
    for p in parts:
        at += len(p) >> 2
        offsets.append(at)
    return pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]), pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(parts))]))


def encode(df: DataFrame, column: str = "text", path: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",), into: str = "ids") -> DataFrame:
    """``keep`` columns and the token ids of ``column`` as array<int>, without special tokens.

    A null or empty text gives an empty array; a text that looks like a
    special token is plain text. The ids of a text depend on nothing else, so
    repeated rows give repeated rows. ``path`` is read on the executors.
    """
    given = spread(df.select(*[F.col(c) for c in keep], F.col(column).alias("__text")))
    schema = given.drop("__text").schema.add(into, T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path).encode
        for b in batches:
            ids = lists([enc(t) for t in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], [*keep, into])

    return given.mapInArrow(run, schema)
