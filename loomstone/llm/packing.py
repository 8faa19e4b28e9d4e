"""Filling chunks of fixed capacity with the blocks of a document, neighbours on a Hilbert curve first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loomstone.llm.blocks import TOKEN, batched, read, stream
from loomstone.runtime import Scratch

CAPACITY = 400
#: The curve runs through DIMS dimensions of BITS bits each.
DIMS, BITS = 3, 10
#: Parts behind the first open one on the curve that may fill its chunk.
LOOK = 128

ITEMS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("curve", T.LongType()), T.StructField("block_ordinal", T.IntegerType()),
    T.StructField("part", T.IntegerType()), T.StructField("tokens", T.IntegerType()),
])
_ITEMS = pa.schema([("doc_id", pa.int64()), ("curve", pa.int64()), ("block_ordinal", pa.int32()), ("part", pa.int32()), ("tokens", pa.int32())])
_MEMBER = pa.struct([("block_ordinal", pa.int32()), ("part", pa.int32()), ("tokens", pa.int32())])
_CHUNKS = pa.schema([("doc_id", pa.int64()), ("first_block", pa.int32()), ("first_part", pa.int32()), ("token_count", pa.int32()), ("blocks", pa.list_(_MEMBER))])
CHUNKS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("first_block", T.IntegerType()), T.StructField("first_part", T.IntegerType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("blocks", T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("block_ordinal", "part", "tokens")]))),
])


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of integer cells, shape (n, dims), along the Hilbert curve (Skilling's transpose method, 2004)."""
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[:, i] & q) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(up, x[:, 0] ^ p, x[:, 0] ^ swap)
            if i:
                x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t, q = np.zeros(n, np.int64), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[:, i] >> b) & 1
    return key


def curve_keys(token_lists: list[list[str]]) -> np.ndarray:
    """Hilbert keys of the hashed token vectors, each projected to DIMS dimensions by random signs.

    The sign of a token in a dimension is a bit of its mixed hash, so vectors are
    summed without ever being laid out; the length is divided out and the result
    cut to cells four deviations to either side.
    """
    sizes = np.array([len(t) for t in token_lists])
    sums = np.zeros((len(token_lists), DIMS))
    if sizes.sum():
        h = np.fromiter((crc32(t.encode("utf-8", "replace")) for ts in token_lists for t in ts), np.uint64, int(sizes.sum()))
        h = h * np.uint64(0x9E3779B97F4A7C15)  # spreads neighbouring hashes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for d in range(DIMS):
            sign = ((h >> np.uint64(40 + 7 * d)) & np.uint64(1)).astype(np.float64) * 2 - 1
            sums[:, d] = np.bincount(owner, sign, len(sizes))
    scaled = sums / np.sqrt(np.maximum(sizes, 1))[:, None]
    cells = np.clip((scaled + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells)


def _items(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Blocks to parts of at most ``capacity`` tokens with their place on the curve."""

    def flush(held: list[tuple[int, int, list[str]]]) -> pa.RecordBatch:
        keys = curve_keys([t for _, _, t in held])
        rows = []
        for (doc, ordinal, tokens), key in zip(held, keys):
            n = len(tokens)
            for part, begin in enumerate(range(0, max(n, 1), capacity)):
                rows.append((doc, int(key), ordinal, part, min(capacity, n - begin)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ITEMS)], schema=_ITEMS)

    held, last = [], None
    for b in read(batches):
        if (b.doc_id, b.ordinal) == last:  # one block, whatever its other columns say
            continue
        last = (b.doc_id, b.ordinal)
        held.append((b.doc_id, b.ordinal, TOKEN.findall(b.text)))
        if len(held) >= 2048:
            yield flush(held)
            held = []
    if held:
        yield flush(held)


def fill(items: Iterable[tuple[int, int, int]], capacity: int = CAPACITY, look: int = LOOK) -> Iterator[list[tuple[int, int, int]]]:
    """Chunks of (ordinal, part, tokens), packed along the order in which the items come.

    A chunk opens with the first item left and is filled from the ``look`` items
    behind it: as full as any subset of them allows, and with those of the shortest
    stretch that does, so neighbours of the order stand together. The reachable
    fill levels are the bits of one integer. Items without tokens fill no room and
    go with the chunk before them, at the begin with the first.
    """
    source = iter(items)
    held: list[tuple[int, int, int]] = []
    empty: list[tuple[int, int, int]] = []
    last: list[tuple[int, int, int]] | None = None  # kept back for empty items behind it
    while True:
        while len(held) <= look and (item := next(source, None)) is not None:
            (held if item[2] else empty).append(item)
        if not held:
            break
        if last is not None:
            yield last + empty
            empty = []
        room, levels = capacity - held[0][2], [1]
        mask, full = (1 << room + 1) - 1, 1 << room
        for _, _, tokens in held[1:]:  # levels[k]: fill levels reachable with the first k items
            if levels[-1] & full:
                break
            levels.append((levels[-1] | levels[-1] << tokens) & mask)
        level, taken = levels[-1].bit_length() - 1, {0}
        for k in range(len(levels) - 1, 0, -1):
            if not levels[k - 1] >> level & 1:
                taken.add(k)
                level -= held[k][2]
        last = [held[k] for k in sorted(taken)]
        held = [x for k, x in enumerate(held) if k not in taken]
    if last or empty:
        yield (last or []) + empty


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, look: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for c in (tuple(col.to_pylist() for col in b.columns) for b in batches):
            yield from zip(*c)

    def chunk(doc: int, members: list[tuple[int, int, int]]) -> tuple:
        own = sorted(members)
        listed = [{"block_ordinal": o, "part": p, "tokens": t} for o, p, t in own]
        return doc, own[0][0], own[0][1], sum(t for _, _, t in own), listed

    def chunks() -> Iterator[tuple]:
        for doc, group in groupby(rows(), key=lambda r: r[0]):
            yield from (chunk(doc, members) for members in fill(((o, p, t) for _, _, o, p, t in group), capacity, look))

    yield from batched(chunks(), _CHUNKS, 1024)


def room(chunks: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, chunks, tokens, least_chunks, unused): how many chunks each document has, the fewest that its tokens could fill, and the unused share of their room."""
    each = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))
    return each.select("*", F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)).cast("long").alias("least_chunks"), F.round(1 - F.col("tokens") / (F.col("chunks") * capacity), 6).alias("unused"))


def pack(documents: DataFrame, blocks: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Chunks (doc_id, first_block, first_part, token_count, blocks) of at most ``capacity`` tokens.

    Each block is in exactly one chunk of its document, with its tokens counted
    in the text; only a block above the capacity is split, into parts of
    ``capacity`` tokens and a rest. (doc_id, first_block, first_part) identifies a
    chunk. Blocks without document, text or span have no tokens and fill no room;
    repeated rows count once; empty tables give an empty result; other columns
    are ignored.

    Plan: one shuffle by document turns texts and spans into parts with a Hilbert
    key of their hashed, projected token vector, which are written once (they are
    small, and a range shuffle reads its input twice); a range shuffle sorts the parts by
    (document, Hilbert key), so one document of any size spreads over several
    partitions; each partition packs along the curve (see ``fill``). A document cut
    by a partition edge may have one chunk more than needed.
    """
    look = LOOK
    items, _ = Scratch(documents.sparkSession, "packing").save(stream(documents, blocks, by_section=False).mapInArrow(lambda it: _items(it, capacity), ITEMS))
    order = ["doc_id", "curve", "block_ordinal", "part"]
    return items.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _pack(it, capacity, look), CHUNKS)
