"""Sorted stream of each document's text followed by its blocks, shared by splitting and packing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A token is a longest run of characters other than space, tab, CR and LF.
TOKEN = re.compile(r"[^ \t\r\n]+")


@dataclass(slots=True)
class Block:
    doc_id: int
    ordinal: int
    path: str | None
    start: int
    text: str


def stream(documents: DataFrame, blocks: DataFrame, by_section: bool) -> DataFrame:
    """Texts and blocks in one table, partitioned by document and sorted so that the text comes first.

    One shuffle carries both sides; nothing is grouped in memory. Blocks without
    doc_id or block_ordinal do not count. With ``by_section`` the blocks of one
    node_path follow each other, else they come by ordinal.
    """
    none = F.lit(None)
    texts = documents.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("kind"), none.cast("string").alias("path"), none.cast("int").alias("ordinal"),
        none.cast("int").alias("start"), none.cast("int").alias("end"), F.col("text"),
    )
    spans = blocks.where(F.col("doc_id").isNotNull() & F.col("block_ordinal").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("kind"), F.col("node_path").alias("path"), F.col("block_ordinal").cast("int").alias("ordinal"),
        F.col("char_start").cast("int").alias("start"), F.col("char_end").cast("int").alias("end"), none.cast("string").alias("text"),
    )
    order = ["doc_id", "kind", *(["path"] if by_section else []), "ordinal", "start", "end"]
    return texts.unionByName(spans).repartition("doc_id").sortWithinPartitions(*order)


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks with their text; repeated rows of one (document, section, ordinal) count once.

    A block without a document or text, or with a null or reversed span, has an
    empty text. Spans beyond the text end at its end.
    """
    doc, text, last = None, "", None
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(7)]
        for doc_id, kind, path, ordinal, start, end, t in zip(*cols):
            if doc_id != doc:
                doc, text, last = doc_id, "", None
            if kind == 0:
                text = t or ""
                continue
            key = (path, ordinal)
            if key == last:
                continue
            last = key
            ok = start is not None and end is not None and 0 <= start < end
            yield Block(doc_id, ordinal, path, start or 0, text[start:end] if ok else "")


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows to Arrow batches."""
    held: list[tuple] = []
    make: Callable[[list[tuple]], pa.RecordBatch] = lambda xs: pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*xs), schema)], schema=schema
    )
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield make(held)
            held = []
    if held:
        yield make(held)
