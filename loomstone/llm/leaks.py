"""Evaluation items leaking into documents: n-gram seeds, then local alignment."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Words of a seed, consecutive words that make a leak, and words that may come in or go between two seeds of one copy.
SEED, RUN, DRIFT = 3, 10, 3
#: Items are held on every executor in blocks of about this many words (about 60 bytes each, as arrays and a vocabulary).
BLOCK_WORDS = 1_500_000
#: Alignment scores: equal word, different word, skipped word. Fixed values.
EQUAL, DIFFERENT, SKIPPED = 2, -1, -1
#: Share of the best possible score, of the item or of an aligned stretch with RUN equal words, from which an edited copy counts.
EDITED = 0.6
#: The least score of a stretch with RUN equal words and EDITED of its best possible score: of c columns e are equal, and 2 e - (c - e) >= 2 EDITED c.
LEAST_PART = EQUAL * EDITED * RUN * (EQUAL - DIFFERENT) / (EQUAL * EDITED - DIFFERENT)

_WORD = re.compile(r"[^\W_]+")
_MARKS = {c: None for c in range(0x300, 0x370)}


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits after compatibility decomposition, without combining marks and letter case."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_MARKS)
        if not text.isascii():
            text = "".join(c for c in text if not unicodedata.category(c).startswith("M"))
        text = unicodedata.normalize("NFKD", text.casefold())
    return _WORD.findall(text.lower())


@dataclass
class Index:
    """Seeds of a block of items as arrays: ``keys`` holds the distinct seeds in order, ``first`` where the places of each begin in ``where``."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    passages: list[tuple[int, str, list[int]]] = field(default_factory=list)  # item_id, field, numbers of its words
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    where: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int32))  # passage, position

    @classmethod
    def of(cls, items: list[tuple[int, str | None, str | None]]) -> Index:
        out = cls()
        for item_id, question, answer in items:
            for name, text in (("question", question), ("answer", answer)):
                ws = words(text)
                if len(ws) >= RUN:
                    out.passages.append((item_id, name, [out.vocabulary.setdefault(w, len(out.vocabulary)) for w in ws]))
        if out.passages:
            keys = [out.seeds(np.array(p, np.int64)) for *_, p in out.passages]
            where = np.array([(n, i) for n, k in enumerate(keys) for i in range(len(k))], np.int32)
            joined = np.concatenate(keys)
            order = np.argsort(joined, kind="stable")
            out.keys, first = np.unique(joined[order], return_index=True)
            out.first, out.where = np.append(first, len(order)), where[order]
        return out

    def seeds(self, numbers: np.ndarray) -> np.ndarray:
        """The number of each run of SEED words, one of its own as a block has fewer than two million; -1 where a word is unknown."""
        n, own = len(self.vocabulary), np.zeros(max(len(numbers) - SEED + 1, 0), np.int64)
        known = np.ones(len(own), bool)
        for k in range(SEED):
            part = numbers[k : k + len(own)]
            own = own * n + part
            known &= part >= 0
        return np.where(known, own, -1)

    def read(self, text: str) -> list[int]:
        get = self.vocabulary.get
        return [get(w, -1) for w in words(text)]

    def candidates(self, numbers: list[int]) -> Iterator[tuple[int, list[int]]]:
        """(passage, where its words would begin) for the passages of which two different seeds stand within DRIFT words of their places to each other."""
        if len(numbers) < SEED or not len(self.keys):
            return
        own = self.seeds(np.array(numbers, np.int64))
        at = np.searchsorted(self.keys, own)
        hits = np.flatnonzero((own >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == own))
        if len(hits) < 2:
            return
        low, high = self.first[at[hits]], self.first[at[hits] + 1]
        place = self.where[np.concatenate([np.arange(a, b) for a, b in zip(low, high)])]
        begins = np.repeat(hits, high - low) - place[:, 1]
        order = np.lexsort((place[:, 1], begins, place[:, 0]))
        passage, begins, position = place[order, 0], begins[order], place[order, 1]
        near = (passage[1:] == passage[:-1]) & (begins[1:] - begins[:-1] <= DRIFT) & (position[1:] != position[:-1])
        for n in np.unique(passage[1:][near]):
            both = near & (passage[1:] == n)
            yield int(n), np.unique(np.concatenate([begins[1:][both], begins[:-1][both]])).tolist()


def _swept(a: np.ndarray, b: np.ndarray, equal: int, other: int, bits: int, each: int, hit: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Smith-Waterman over many pairs at once: the best cell of each, or with ``hit`` whether it holds in any cell.

    A cell is one number, the score above ``bits`` and below it what decides ties:
    an equal word adds ``equal`` there and ``each``, any other step ``other``. A row
    is filled from the cells above, then along itself by a running maximum.
    """
    one = 1 << bits
    match, slip = equal * one + each, other * one - (each > 1)
    along = slip * np.arange(b.shape[1] + 1, dtype=np.int64)
    row = np.zeros((len(a), b.shape[1] + 1), np.int64)
    best = np.zeros(len(a), np.int64)
    for i in range(a.shape[1]):
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(a[:, i : i + 1] == b, match, slip), row[:, 1:] + slip)
        new = np.maximum.accumulate(new - along, axis=1) + along
        new[new < one] = 0
        row = new
        best = np.maximum(best, (hit(new) if hit else new).max(axis=1))
    return best


def _dense(cells: np.ndarray) -> np.ndarray:
    """Cells whose path has RUN equal words and EDITED of the best possible score of its columns."""
    rest = cells & ((1 << 26) - 1)
    equal = (rest + 8191) >> 13
    columns = (equal << 13) - rest
    return (cells > 0) & (equal >= RUN) & (EQUAL * equal + DIFFERENT * (columns - equal) >= EDITED * EQUAL * columns)


def aligned(pairs: list[tuple[list[int], list[int]]]) -> list[tuple[int, int, int, bool]]:
    """(best local score, words matched on its path, most consecutive equal words, whether an edited part) of pairs (passage, part of a text).

    An edited part is an alignment with RUN equal words and, by its own length,
    EDITED of the best possible score; it is looked for on the paths of best score,
    which also span small gaps, and on those of best score above EDITED, which leave
    thin surroundings out. Pairs of about one size are swept together.
    """
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    for at in range(0, len(order), 128):
        own = order[at : at + 128]
        a, b = (np.full((len(own), max(len(pairs[i][k]) for i in own)), -2 - k, np.int64) for k in (0, 1))
        for r, i in enumerate(own):
            a[r, : len(pairs[i][0])], b[r, : len(pairs[i][1])] = pairs[i]
        best = _swept(a, b, EQUAL, DIFFERENT, 13, 1)
        run, longest = np.zeros(b.shape, np.int64), np.zeros(len(own), np.int64)
        for i in range(a.shape[1]):
            run = np.where(a[:, i : i + 1] == b, np.pad(run, ((0, 0), (1, 0)))[:, :-1] + 1, 0)
            longest = np.maximum(longest, run.max(axis=1))
        part = np.zeros(len(own), bool)
        open_ = np.flatnonzero((longest < RUN) & (best >> 13 >= LEAST_PART))  # the others need no part or have none
        share = round(10 * EDITED * EQUAL)
        for equal, other in ((10 * EQUAL, 10 * DIFFERENT), (10 * EQUAL - share, 10 * DIFFERENT - share)) if len(open_) else ():
            part[open_] |= _swept(a[open_], b[open_], equal, other, 26, 8191, _dense).astype(bool)
        for r, i in enumerate(own):
            out[i] = int(best[r] >> 13), int(best[r] & 8191), int(longest[r]), bool(part[r])
    return out


def in_order(places: dict[int, int], size: int, part: list[int]) -> int:
    """Most words that a passage of ``size`` words, given by the bits of each word's places, and a part hold in one order.

    Bit-parallel longest common subsequence (Allison and Dix, 1986): no alignment has more equal words.
    """
    full = left = (1 << size) - 1
    for word in part:
        here = places.get(word)
        if here:
            met = left & here
            left = (left + met | left - met) & full
    return size - left.bit_count()


FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("field", T.StringType()),
    T.StructField("score", T.IntegerType()), T.StructField("matched_words", T.IntegerType()), T.StructField("item_words", T.IntegerType()),
    T.StructField("run_words", T.IntegerType()),
])


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Aligned passages (doc_id, item_id, field, score, matched_words, item_words, run_words).

    One row for each document, item and field that share two seeds (any four words
    in a row, or twice three in about the same places) and either a
    run of RUN words, an alignment of at least EDITED of the item's best possible
    score, or one of a part with RUN equal words and at least EDITED of the best
    possible score of that part. ``run_words`` is the longest run of equal consecutive words. Null and
    empty texts and items hold nothing; fields of fewer than RUN words cannot
    leak; repeated documents give repeated rows, repeated items count once; empty
    tables give an empty result; other columns are ignored.

    Plan: the items are read in blocks of bounded size, each held by every
    executor, so their number may grow. For each block one scan of the documents
    finds all item n-grams, frequent ones too, by bisection in sorted arrays of word
    numbers, and aligns the passages around them in the same task. Stretches with too few words of the passage for any row are
    not aligned. Nothing is shuffled or written, and no number of candidates is
    capped.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    out = None
    for block in _blocks(items):
        found = _search(docs, block)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], FOUND)


def _blocks(items: DataFrame) -> Iterator[Index]:
    held, size = [], 0
    for r in items.select("item_id", "question", "answer").where(F.col("item_id").isNotNull()).distinct().orderBy("item_id", "question", "answer").toLocalIterator():
        held.append((r[0], r[1], r[2]))
        size += len(words(r[1])) + len(words(r[2]))
        if size > BLOCK_WORDS:
            yield Index.of(held)
            held, size = [], 0
    if held:
        yield Index.of(held)


def _search(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by BLOCK_WORDS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            pairs, of = [], []  # stretches to align, and (row, passage) of each
            keys = batch.column(0).to_pylist()
            for r, t in enumerate(batch.column(1).to_pylist()):
                ws = own.read(t)
                for n, begins in own.candidates(ws):
                    passage = own.passages[n][2]
                    for part in stretches(ws, begins, passage):
                        pairs.append((passage, part))
                        of.append((r, n))
            rows = []
            for (r, n), some in groupby(zip(of, aligned(pairs)), key=lambda x: x[0]):
                item_id, name, passage = own.passages[n]
                row = judged([x for _, x in some], len(passage))
                if row:
                    rows.append((keys[r], item_id, name, *row))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=FOUND.fieldNames())

    return docs.mapInArrow(search, FOUND)


_TYPES = [pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 4]


def stretches(ws: list[int], begins: list[int], passage: list[int]) -> Iterator[list[int]]:
    """The stretches of text around the seeds of a passage, but for those with too few of its words in order for any row."""
    m = len(passage)
    places: dict[int, int] = {}
    for i, word in enumerate(passage):
        places[word] = places.get(word, 0) | 1 << i
    stretch: list[int] | None = None
    for b in [*sorted(set(begins)), None]:
        if stretch is not None and (b is None or b - m // 2 > stretch[1]):
            part = ws[max(0, stretch[0]) : stretch[1]]
            if in_order(places, m, part) >= min(RUN, EDITED * m):
                yield part
            stretch = None
        if b is not None:
            low, high = b - m // 2, b + m + m // 2
            stretch = [low, high] if stretch is None else [stretch[0], max(stretch[1], high)]


def judged(parts: list[tuple[int, int, int, bool]], m: int) -> tuple[int, int, int, int] | None:
    """(score, matched words, words, longest run) of a passage of ``m`` words over its aligned stretches, if it is a copy."""
    score, matched = max(p[:2] for p in parts)
    run = max(p[2] for p in parts)
    if run >= RUN or score >= EDITED * EQUAL * m or any(p[3] for p in parts):
        return score, matched, m, run
    return None
