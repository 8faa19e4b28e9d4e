"""Byte-level BPE encoding of a corpus with a public vocabulary."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: The published pre-tokenisation pattern of this vocabulary, a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Splits at blanks exactly where PATTERN can split at all, with one match a word; each piece is then split by PATTERN alone.
COARSE = r"\s+(?!\S)| ?\S+|\s+"
#: Entries each cache of a Python worker may hold; a full cache is emptied.
CACHE = 200_000
#: Longer pieces are encoded without being kept.
CACHE_CHARS = 64
NEVER = 1 << 62


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 stands for itself, the others follow from code point 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in own}
    for i, b in enumerate(b for b in range(256) if b not in set(own)):
        letters[chr(256 + i)] = b
    return letters


class Encoder:
    """Merges by a segment tree over the byte positions of a piece.

    The tree's leaves hold, for each live position, (rank, position) of the pair
    that begins there, packed into one integer, so its root is the leftmost pair
    of minimum rank. A merge changes three leaves (the pair itself, its left and
    its right neighbour) and repairs their paths, so a piece of n bytes costs
    O(n log n) even if it is one unbroken run.
    """

    def __init__(self, path: str):
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[left] << 20 | vocab[right]] = (rank, vocab[left + right])
        self.fine = regex.compile(PATTERN).findall
        self.coarse = regex.compile(COARSE).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        pairs, size = self.pairs, 1 << (n - 1).bit_length()
        tree = [NEVER] * (2 * size)
        result: list[int] = [0] * n  # id that the pair beginning at a position would become
        for i in range(n - 1):
            hit = pairs.get(ids[i] << 20 | ids[i + 1])
            if hit:
                tree[size + i], result[i] = hit[0] << 32 | i, hit[1]
        for k in range(size - 1, 0, -1):
            x, y = tree[2 * k], tree[2 * k + 1]
            tree[k] = x if x < y else y
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            if tree[k] == value:
                return
            tree[k] = value
            k >>= 1
            while k:
                x, y = tree[2 * k], tree[2 * k + 1]
                low = x if x < y else y
                if tree[k] == low:
                    return
                tree[k] = low
                k >>= 1

        while (top := tree[1]) != NEVER:
            i = top & 0xFFFFFFFF
            gone = after[i]
            ids[i] = result[i]
            follow = after[i] = after[gone]
            ids[gone] = -1
            put(gone, NEVER)
            if follow < n:
                before[follow] = i
                hit = pairs.get(ids[i] << 20 | ids[follow])
                if hit:
                    result[i] = hit[1]
                put(i, hit[0] << 32 | i if hit else NEVER)
            else:
                put(i, NEVER)
            prev = before[i]
            if prev >= 0:
                hit = pairs.get(ids[prev] << 20 | ids[i])
                if hit:
                    result[prev] = hit[1]
                put(prev, hit[0] << 32 | prev if hit else NEVER)
        return tuple(x for x in ids if x >= 0)

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of one coarse piece."""
        out: list[int] = []
        pieces = self.pieces
        for p in self.fine(text):
            ids = pieces.get(p)
            if ids is None:
                ids = self.merge(p.encode("utf-8", "replace"))
                if len(p) <= CACHE_CHARS:
                    if len(pieces) >= CACHE:
                        pieces.clear()
                    pieces[p] = ids
            out.extend(ids)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        words, add = self.words, out.extend
        for w in self.coarse(text):
            ids = words.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= CACHE_CHARS:
                    if len(words) >= CACHE:
                        words.clear()
                    words[w] = ids
            add(ids)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    return Encoder(path)


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens, whose strings are ordinary text.

    A null and an empty text give an empty list; a text of blanks is encoded as
    it is; repeated rows give repeated rows; other columns are ignored, whatever
    their names. An empty table gives an empty result. ``vocabulary`` is the path
    of a byte-level BPE file that every executor can read.

    Plan: one map over Arrow batches straight from the scan, no shuffle.
    """
    path = vocabulary or default_vocabulary()
    source = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path).encode
        for batch in batches:
            offsets, values = np.zeros(batch.num_rows + 1, np.int32), []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    values.extend(enc(t))
                offsets[i + 1] = len(values)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(values, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return source.mapInArrow(run, schema)
