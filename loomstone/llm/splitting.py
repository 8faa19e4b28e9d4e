"""Splitting oversized sections at natural boundaries by dynamic programming over boundary positions."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from loomstone.llm.blocks import TOKEN, Block, batched, read, stream

LIMIT, OVERLAP = 400, 40
#: Cost of a cut at the end of a block, of a sentence, and inside a sentence. Fixed values.
BLOCK_END, SENTENCE_END, INSIDE = 0.0, 1.0, 25.0
#: Weight of the squared relative deviation of a piece from the even size.
IMBALANCE = 4.0
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("node_path", T.StringType()), T.StructField("piece_no", T.IntegerType()),
    T.StructField("pieces", T.IntegerType()), T.StructField("block_start", T.IntegerType()), T.StructField("block_end", T.IntegerType()),
    T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("token_start", T.LongType()),
    T.StructField("token_count", T.IntegerType()), T.StructField("section_tokens", T.LongType()),
])
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("node_path", pa.string()), ("piece_no", pa.int32()), ("pieces", pa.int32()), ("block_start", pa.int32()), ("block_end", pa.int32()),
    ("char_start", pa.int32()), ("char_end", pa.int32()), ("token_start", pa.int64()), ("token_count", pa.int32()), ("section_tokens", pa.int64()),
])


def cuts(total: int, natural: dict[int, float], limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Ends of the pieces of ``total`` tokens: 0 < c1 < ... < ck = total, at least cost.

    Piece i covers tokens [c(i-1) - overlap, c(i)), the first one [0, c1), and has
    at most ``limit`` tokens; consecutive pieces share exactly ``overlap`` tokens.
    ``natural`` gives the cost of a cut after so many tokens. Positions inside a
    sentence are offered only within stretches where no natural boundary is in
    reach, so a cut elsewhere always exists. Ties keep the earliest previous cut.
    """
    if total <= limit:
        return [total]
    reach = limit - overlap
    if reach < 1:
        raise ValueError("the overlap must be smaller than the limit")
    spots = sorted(p for p in natural if overlap < p < total)
    offered, before = [], overlap
    for p in [*spots, total]:
        # a stretch longer than a piece may grow needs positions inside it
        if p - before > reach // 2:
            offered.extend(range(before + 1, p))
        if p < total:
            offered.append(p)
        before = p
    offered.append(total)
    parts = -(-(total - overlap) // reach)
    even = (total - overlap) / parts + overlap  # tokens of a piece if all were equal
    best, back = [float("inf")] * len(offered), [-1] * len(offered)
    for j, end in enumerate(offered):
        price = 0.0 if end == total else natural.get(end, INSIDE)
        low = float("inf")
        if end <= limit:
            low, back[j] = IMBALANCE * (end / even - 1) ** 2, -1
        for i in range(bisect_left(offered, end - reach), j):
            size = end - offered[i] + overlap
            cost = best[i] + IMBALANCE * (size / even - 1) ** 2
            if cost < low:
                low, back[j] = cost, i
        best[j] = low + price
    out, j = [], len(offered) - 1
    while j >= 0:
        out.append(offered[j])
        j = back[j]
    return out[::-1]


def split_section(blocks: list[Block], limit: int = LIMIT, overlap: int = OVERLAP) -> Iterator[tuple]:
    """Piece rows of one section, one piece if it is within the limit."""
    counts = [len(TOKEN.findall(b.text)) for b in blocks]
    total = sum(counts)
    doc, path = blocks[0].doc_id, blocks[0].path
    if total <= limit:
        last = blocks[-1]
        yield doc, path, 0, 1, blocks[0].ordinal, last.ordinal, blocks[0].start, last.start + len(last.text), 0, total, total
        return
    starts: list[int] = []  # tokens before each block
    spans: list[tuple[int, int]] = []  # characters of each token
    natural: dict[int, float] = {}
    n = 0
    for b in blocks:
        starts.append(n)
        for m in TOKEN.finditer(b.text):
            n += 1
            spans.append((b.start + m.start(), b.start + m.end()))
            if _SENTENCE.search(m.group()):
                natural[n] = SENTENCE_END
        natural[n] = BLOCK_END
    ends = cuts(total, natural, limit, overlap)
    for i, end in enumerate(ends):
        begin = ends[i - 1] - overlap if i else 0
        first = bisect_right(starts, begin) - 1
        final = bisect_right(starts, end - 1) - 1
        yield doc, path, i, len(ends), blocks[first].ordinal, blocks[final].ordinal, spans[begin][0], spans[end - 1][1], begin, end - begin, total


def pieces(documents: DataFrame, blocks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every section (doc_id, node_path) of at most ``limit`` tokens, see ``SCHEMA``.

    Tokens are counted in the text of the spans, not taken from token_count. A
    section within the limit is one piece; of a longer one, consecutive pieces
    share ``overlap`` tokens. A null node_path is a section of its own; blocks
    without document, text or span have no tokens; a section without tokens is
    one piece of 0 tokens; repeated rows count once; empty tables give an empty
    result; other columns are ignored.

    Plan: one shuffle by document of texts and spans together, then one pass over
    the sorted rows that holds one text and one section.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sections = groupby(read(batches), key=lambda b: (b.doc_id, b.path))
        yield from batched((row for _, own in sections for row in split_section(list(own), limit, overlap)), _ARROW)

    return stream(documents, blocks, by_section=True).mapInArrow(run, SCHEMA)
