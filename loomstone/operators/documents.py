"""Document sources, block grid, sections, chunks and reuse."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomstone.runtime import Scratch

BUDGET, ANCHOR_MODULUS, ANCHOR_GAP, DEPTH = 400, 24, 200, 16
#: Roles of sections. Fixed values.
ROLES = (
    "body", "abstract", "introduction", "results", "methods", "discussion", "conclusion", "references", "appendix", "table", "figure_caption", "nav", "boilerplate", "legal",
)


# --- sources --------------------------------------------------------------------------------------------------------


def read_files(spark, folder: str, suffixes: tuple[str, ...] = (".md", ".txt", ".html")) -> DataFrame:
    """Files below a folder: (source_ref, revision, content, content_hash, storage_class)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower("path").endswith(s)
    return files.where(wanted).select(
        F.col("path").alias("source_ref"), F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("revision"), "content", F.sha2("content", 256).alias("content_hash")
    )


def storage_class(mime: Column) -> Column:
    """Media are hot, all else is cold."""
    return F.when(mime.rlike("^(video|audio|image)/"), "hot").otherwise("cold")


def appended_versions(observed: DataFrame) -> DataFrame:
    """Versions (lineage, version_no, content_hash, seq): a new one only when the bytes differ from the version before, so A, B, A makes three."""
    w = Window.partitionBy("lineage").orderBy("seq")
    new = observed.withColumn("_before", F.lag("content_hash").over(w)).where(~F.col("_before").eqNullSafe(F.col("content_hash")))
    return new.select("lineage", F.row_number().over(w).cast("long").alias("version_no"), "content_hash", "seq")


def poll(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(source_ref, state): what a cycle does with each reference.

    deleted if it vanished, unchanged if its revision is known, debounced while it
    is still being written (quiet is false), else fetched.
    """
    both = listing.join(known.select("source_ref", F.col("revision").alias("_known")), "source_ref", "full")
    state = F.when(F.col("revision").isNull(), "deleted").when(F.col("revision").eqNullSafe(F.col("_known")), "unchanged").when(~F.coalesce("quiet", F.lit(True)), "debounced").otherwise("fetch")
    return both.select("source_ref", state.alias("state"))


def known_revisions(versions: DataFrame) -> DataFrame:
    """(lineage, revision): the latest of each lineage that is not deleted."""
    last = versions.where("deleted_at is null").groupBy("lineage").agg(F.max_by("revision", F.struct("version_no", "revision")).alias("revision"))
    return last


def latest_upsert(table: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Union of both by key, the row with the latest order winning, updates on ties."""
    both = table.withColumn("_src", F.lit(0)).unionByName(updates.withColumn("_src", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(order), F.desc("_src"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_src")


# --- blocks ---------------------------------------------------------------------------------------------------------

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:\s|$)")
_UNDERLINE = re.compile(r"^ {0,3}(=+|-+)\s*$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(\s+|$)")
_TABLE = re.compile(r"^ {0,3}\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def block_text(raw: str) -> str:
    """The text a block is known by: composed, lines joined, single blanks."""
    return " ".join(unicodedata.normalize("NFC", " ".join(line.strip() for line in raw.splitlines())).split())


def blockize(text: str) -> list[tuple[str, int, int]]:
    """(type, char_start, char_end) of the blocks of a Markdown text, in order.

    Types: heading, paragraph, list_item (a top-level item with all it holds),
    table, code, quote. Spans slice the text without the final line end. Line
    based: a block ends at a blank line or where another kind begins; reference
    definitions and raw HTML count as paragraphs.
    """
    lines = text.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    out: list[tuple[str, int, int]] = []

    def emit(kind: str, first: int, last: int) -> None:
        raw = text[starts[first] : starts[last]].rstrip("\r\n")
        out.append((kind, starts[first], starts[first] + len(raw)))

    blank = [not line.strip() for line in lines]
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if blank[i] or _RULE.match(line) and not (out and out[-1][0] == "paragraph" and _UNDERLINE.match(line) and i and not blank[i - 1]):
            i += 1
            continue
        j = i + 1
        if fence := _FENCE.match(line):
            mark = fence.group(1)
            while j < n and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[j]):
                j += 1
            j = min(j + 1, n)
            emit("code", i, j)
        elif _HEADING.match(line):
            emit("heading", i, j)
        elif line.startswith(("    ", "\t")):
            while j < n and (blank[j] or lines[j].startswith(("    ", "\t"))):
                j += 1
            while blank[j - 1]:
                j -= 1
            emit("code", i, j)
        elif line.lstrip(" ").startswith(">"):
            while j < n and not blank[j] and not _starts_other(lines[j], ">"):
                j += 1
            emit("quote", i, j)
        elif item := _ITEM.match(line):
            indent = len(item.group(0)) if item.group(3) else len(item.group(0)) + 1
            while j < n:
                if blank[j]:
                    k = j
                    while k < n and blank[k]:
                        k += 1
                    if k < n and lines[k].startswith(" " * indent):
                        j = k
                        continue
                    break
                if not lines[j].startswith(" " * indent) and (_ITEM.match(lines[j]) or _starts_other(lines[j], "")):
                    break
                j += 1
            emit("list_item", i, j)
        elif "|" in line and j < n and "-" in lines[j] and _TABLE.match(lines[j]):
            j += 1
            while j < n and not blank[j] and "|" in lines[j]:
                j += 1
            emit("table", i, j)
        else:
            kind = "paragraph"
            while j < n and not blank[j]:
                if _UNDERLINE.match(lines[j]):
                    kind, j = "heading", j + 1
                    break
                if _starts_other(lines[j], "") or (_ITEM.match(lines[j]) and not re.match(r"^ {0,3}\d+[.)]", lines[j])):
                    break
                j += 1
            emit(kind, i, j)
        i = j
    return out


def _starts_other(line: str, own: str) -> bool:
    """Whether a line opens a block of another kind without a blank line before it."""
    quote = line.lstrip(" ").startswith(">")
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line)) or (quote and own != ">")


def block_rows(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ordinal, type, level, char_start, char_end, tokens, block_hash) of every document, in one map over the scan."""
    schema = f"{key} {documents.schema[key].dataType.simpleString()}, ordinal int, type string, level int, char_start int, char_end int, tokens int, block_hash string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, (kind, a, b) in enumerate(blockize(t or "")):
                    raw = t[a:b]
                    mark = _HEADING.match(raw)
                    level = len(mark.group(1)) if mark else (1 if raw.rstrip().endswith("=") else 2) if kind == "heading" else 0
                    rows.append((k, i, kind, level, a, b, len(raw.split()), hashlib.sha256(block_text(raw).encode("utf-8", "replace")).hexdigest()))
            if rows:
                types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[key, "ordinal", "type", "level", "char_start", "char_end", "tokens", "block_hash"])

    return documents.select(key, text).mapInArrow(run, schema)


# --- sections -------------------------------------------------------------------------------------------------------


def _on_grid(grid: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposals with ``at``: the last grid position that begins at or before them, by one running maximum over both sorted by character."""
    marks = grid.select("doc_id", F.col("char_start").alias("c"), "pos", F.lit(None).cast("string").alias("section_id"))
    starts = proposed.select("doc_id", F.col("char_start").alias("c"), F.lit(None).cast("int").alias("pos"), "section_id")
    upto = Window.partitionBy("doc_id").orderBy("c").rangeBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(starts).withColumn("at", F.coalesce(F.max("pos").over(upto), F.lit(0))).where("section_id is not null")
    return proposed.join(met.select("doc_id", "section_id", "at"), ["doc_id", "section_id"])


def snapped_sections(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, node_path, parent_path, title, role, block_start, block_end, char_start, char_end, summary) of proposed trees on the block grid.

    Input are blocks (doc_id, ordinal, char_start, char_end) and proposals (doc_id,
    section_id, title, role, char_start, char_end, summary, children), roots being
    those that no other lists, in the order of their ids. A proposal moves back to
    the block that holds its begin, but not before its parent. Of siblings on one
    block the longest stays (ties: listed first) and takes the children of all.
    Siblings tile: each ends before the next, the last with its parent. What has no
    length or lies outside its parent goes with all below it; so does what lies DEPTH
    or more levels down, and a section listed below itself. Roles lose blanks and
    letter case, unknown ones are body.

    Every document of either table has a root '0' over all its blocks, 0 to -1 if it
    has none. Blocks without a span have no place on the grid; rows without
    document or section id do not count; repeated rows count once; other columns
    are ignored; empty tables give an empty result.

    Plan: begins meet the grid once, in a running maximum. Then each level of all
    documents is one set: a window over siblings gives place, end and number of
    each, and their children are the next level, so there are DEPTH rounds at most.
    """
    scratch = Scratch(blocks.sparkSession, "sections")
    keyed = blocks.where("doc_id is not null and ordinal is not null and char_start is not null and char_end is not null")
    once = keyed.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "ordinal").agg(F.min(F.struct("char_start", "char_end")).alias("span"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal")) - 1
    grid, _ = scratch.save(once.select("doc_id", number.alias("pos"), "ordinal", "span.*"))
    none = F.lit(None).cast("string")
    told = sections.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "section_id", "title", "role", "char_start", "char_end", (F.col("summary") if "summary" in sections.columns else none).alias("summary"), "children")
    each = told.where("section_id is not null").groupBy("doc_id", "section_id").agg(F.max(F.struct("char_start", "char_end", "title", "role", "summary", "children")).alias("s")).select("doc_id", "section_id", "s.*")
    known, _ = scratch.save(_on_grid(grid, each.where("char_end > char_start")))
    listed = each.select("doc_id", F.col("section_id").alias("by"), F.explode("children").alias("section_id")).where("section_id <> by").select("doc_id", "section_id")
    over = grid.groupBy("doc_id").agg(F.max("pos").alias("hi"), F.max("ordinal").alias("last"), F.max_by("char_end", "pos").alias("pb"))
    span = lambda name, pos, char: grid.select("doc_id", F.col("pos").alias(pos), F.col("ordinal").alias(name), char)
    tie = "struct<turn:int,place:int,name:string>"
    front = known.join(listed, ["doc_id", "section_id"], "left_anti").join(over, "doc_id").select(
        "doc_id", "section_id", F.lit("0").alias("parent_path"), F.lit(0).alias("lo"), "hi", F.lit(0).alias("pa"), "pb",
        F.struct(F.lit(0).alias("turn"), F.lit(0).alias("place"), F.col("section_id").alias("name")).cast(tie).alias("seq"), F.array().cast("array<string>").alias("trail"),
    )
    documents = grid.select("doc_id").unionByName(told.select("doc_id")).distinct()
    roots = documents.join(over, "doc_id", "left").select(
        "doc_id", F.lit("0").alias("node_path"), none.alias("parent_path"), F.lit("").alias("title"), F.lit("body").alias("role"), F.lit(0).alias("block_start"),
        F.coalesce("last", F.lit(-1)).alias("block_end"), F.lit(0).alias("char_start"), F.coalesce("pb", F.lit(0)).alias("char_end"), F.lit("").alias("summary"),
    )
    out = roots
    for _ in range(1, DEPTH):
        inside = front.join(known, ["doc_id", "section_id"]).where("char_end > pa and char_start < pb").withColumn("at", F.greatest("at", "lo")).where("at <= hi")
        family = Window.partitionBy("doc_id", "parent_path").orderBy("at")
        placed = inside.select(
            "*", (F.dense_rank().over(family) - 1).alias("number"), F.coalesce(F.min("at").over(family.rangeBetween(1, Window.unboundedFollowing)) - 1, "hi").alias("to"),
            F.row_number().over(Window.partitionBy("doc_id", "parent_path", "at").orderBy(F.col("char_start") - F.col("char_end"), "seq")).alias("turn"),
        ).withColumn("node_path", F.concat_ws(".", "parent_path", "number"))
        level = placed.drop("pa", "pb", "char_start", "char_end").join(span("block_start", "at", "char_start"), ["doc_id", "at"]).join(span("block_end", "to", "char_end"), ["doc_id", "to"])
        level, got = scratch.save(level, n=F.count(F.lit(1)))
        if not got["n"]:
            break
        role = F.lower(F.trim("role"))
        out = out.unionByName(level.where("turn = 1").select(
            "doc_id", "node_path", "parent_path", F.coalesce("title", F.lit("")).alias("title"), F.when(role.isin(*ROLES), role).otherwise("body").alias("role"),
            "block_start", "block_end", "char_start", "char_end", F.coalesce("summary", F.lit("")).alias("summary"),
        ))
        below = level.select(
            "doc_id", F.col("node_path").alias("parent_path"), F.col("at").alias("lo"), F.col("to").alias("hi"), F.col("char_start").alias("pa"), F.col("char_end").alias("pb"), "turn",
            F.array_append("trail", F.col("section_id")).alias("trail"), F.posexplode(F.array_distinct("children")).alias("place", "section_id"),
        ).where(~F.array_contains("trail", F.col("section_id")))
        seq = F.struct("turn", "place", F.lit("").alias("name")).cast(tie)
        front = below.groupBy("doc_id", "section_id", "parent_path", "lo", "hi", "pa", "pb").agg(F.min(seq).alias("seq"), F.min_by("trail", seq).alias("trail"))
    return out


def outline(blocks: DataFrame) -> DataFrame:
    """Blocks with ``section``: the ordinal of the heading they stand under (itself for a heading), -1 before the first."""
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.coalesce(F.max(F.when(F.col("type") == "heading", F.col("ordinal"))).over(w), F.lit(-1)))


def owners(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, ordinal, node_path): the deepest section whose block range holds each block."""
    depth = F.size(F.split("node_path", r"\."))
    hit = blocks.alias("b").join(sections.alias("s"), (F.col("b.doc_id") == F.col("s.doc_id")) & F.col("b.ordinal").between(F.col("s.block_start"), F.col("s.block_end")))
    return hit.groupBy("b.doc_id", "b.ordinal").agg(F.max_by("node_path", F.struct(depth, "node_path")).alias("node_path"))


def in_order(path: Column) -> Column:
    """Sort key of section paths by their numbers."""
    return F.transform(F.split(path, r"\."), lambda x: x.cast("int"))


# --- chunks ---------------------------------------------------------------------------------------------------------


def anchored(block_hash: Column, modulus: int = ANCHOR_MODULUS) -> Column:
    """Whether the first 16 hex digits of a hash, as a number, are divisible by the modulus."""
    return F.conv(F.substring(block_hash, 1, 16), 16, 10).cast("decimal(20,0)") % modulus == 0


def cuts(tokens: np.ndarray, anchor: np.ndarray, budget: int, gap: int) -> list[int]:
    """First positions of the chunks of one run, from prefix sums of its tokens.

    Anchors count where ``gap`` tokens lie between them and the last that counted,
    the first always; they are found by bisection in the sums before the anchors,
    and the chunk after a position by bisection in the sums of the stretch up to
    the next anchor.
    """
    after = np.cumsum(tokens)
    before = after - tokens
    marks = np.flatnonzero(anchor)
    fixed, i = [0], 0
    while i < len(marks):
        fixed.append(int(marks[i]))
        i = max(i + 1, int(np.searchsorted(before[marks], before[marks[i]] + gap)))
    out: list[int] = []
    for at, end in zip(fixed, [*fixed[1:], len(tokens)]):
        while at < end:
            out.append(at)
            at = max(at + 1, int(np.searchsorted(after[:end], before[at] + budget, side="right")))
    return out


def chunks(blocks: DataFrame, budget: int = BUDGET, gap: int = ANCHOR_GAP) -> DataFrame:
    """(doc_id, section, chunk_no, block_start, block_end, char_start, char_end, tokens, chunk_hash) from blocks with section, tokens and block_hash.

    ``section`` names the deepest section that owns a block, so neighbours of one
    owner make a run, and a parent's blocks before and between its children are
    runs of their own. A chunk is a stretch of whole blocks of one run with at most
    ``budget`` tokens; a longer block is a chunk of its own. An anchored block (see
    ``anchored``) opens a chunk if ``gap`` tokens of the run lie behind the anchor
    before it, so packing does not depend on what stands before an anchor. Null
    tokens count as 0, null hashes as empty; blocks without document or ordinal do
    not count, repeated ordinals once; an empty table gives an empty result.

    Plan: one shuffle by document, whose blocks are bounded by its text; the runs
    are cut by bisection in prefix sums, not row by row.
    """
    schema = "doc_id long, section string, chunk_no int, block_start int, block_end int, char_start int, char_end int, tokens int, chunk_hash string"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["ordinal", "tokens", "block_hash"]).drop_duplicates("ordinal", ignore_index=True)
        owner, tokens = rows["section"].fillna(""), rows["tokens"].to_numpy()
        edges = [*np.flatnonzero(np.r_[True, (owner != owner.shift())[1:]]), len(rows)]
        begins = [a + c for a, b in zip(edges, edges[1:]) for c in cuts(tokens[a:b], rows["_anchor"].to_numpy()[a:b], budget, gap)]
        ends = np.array([*begins[1:], len(rows)]) - 1
        digest = [hashlib.sha256("\n".join(rows["block_hash"][a : b + 1]).encode()).hexdigest() for a, b in zip(begins, ends)]
        first, last = rows.iloc[begins], rows.iloc[ends]
        return pd.DataFrame({
            "doc_id": first["doc_id"].to_numpy(), "section": first["section"].to_numpy(), "chunk_no": np.arange(len(begins)), "block_start": first["ordinal"].to_numpy(),
            "block_end": last["ordinal"].to_numpy(), "char_start": first["char_start"].to_numpy(), "char_end": last["char_end"].to_numpy(),
            "tokens": np.add.reduceat(tokens, begins), "chunk_hash": digest,
        })

    ready = blocks.where("doc_id is not null and ordinal is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("section").cast("string").alias("section"), F.col("ordinal").cast("int").alias("ordinal"), "char_start", "char_end",
        F.coalesce("tokens", F.lit(0)).cast("int").alias("tokens"), F.coalesce("block_hash", F.lit("")).alias("block_hash"), F.coalesce(anchored(F.col("block_hash")), F.lit(False)).alias("_anchor"),
    )
    return ready.groupBy("doc_id").applyInPandas(pack, schema)


def reuse_keys(chunk: DataFrame, header: Column, extractor: str, structurer: str) -> DataFrame:
    """Chunks with ``reuse_key``: own hash, neighbours' hashes, header facts and versions; the same key means nothing to extract anew."""
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    near = F.concat_ws("\n", F.lag("chunk_hash").over(w), F.lead("chunk_hash").over(w))
    return chunk.withColumn("reuse_key", F.sha2(F.concat_ws("\x1e", "chunk_hash", near, header, F.lit(extractor), F.lit(structurer)), 256))


def reused(chunk: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, from_doc, from_chunk): the nearest strictly earlier version of the lineage with the same reuse key, lowest chunk first.

    One window per (lineage, key) over version order, no self-join.
    """
    # the last row of an earlier version is the frame's end; of one version the lowest chunk counts
    per = chunk.groupBy("lineage_id", "reuse_key", "version_no").agg(F.min(F.struct("chunk_no", "doc_id")).alias("own"))
    w = Window.partitionBy("lineage_id", "reuse_key").orderBy("version_no")
    before = per.withColumn("src", F.lag("own").over(w)).where("src is not null").select("lineage_id", "reuse_key", "version_no", "src")
    return chunk.join(before, ["lineage_id", "reuse_key", "version_no"]).select("doc_id", "chunk_no", F.col("src.doc_id").alias("from_doc"), F.col("src.chunk_no").alias("from_chunk"))


def grounded(claims: DataFrame) -> DataFrame:
    """Claims (span, text, char_start, char_end, kept) whose span stands in the chunk's part of the text and overlaps a kept range."""
    at = F.expr("locate(span, text, char_start + 1)") - 1
    inside = (at >= 0) & (at + F.length("span") <= F.col("char_end"))
    overlaps = F.exists("kept", lambda k: (k["begin"] < at + F.length("span")) & (k["end"] > at))
    return claims.where(inside & overlaps)


# --- conversion and extraction --------------------------------------------------------------------------------------


def html_to_markdown(html: str) -> str:
    """Headings, paragraphs, list items, quotes and preformatted text of an HTML page as Markdown; scripts, styles and tags go."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.out: list[str] = []
            self.skip = self.pre = 0

        def handle_starttag(self, tag, attrs) -> None:
            if tag in ("script", "style", "noscript", "template", "head"):
                self.skip += 1
            elif tag == "pre":
                self.pre += 1
                self.out.append("\n\n```\n")
            elif re.fullmatch("h[1-6]", tag):
                self.out.append("\n\n" + "#" * int(tag[1]) + " ")
            elif tag == "li":
                self.out.append("\n- ")
            elif tag == "blockquote":
                self.out.append("\n\n> ")
            elif tag in ("p", "div", "section", "article", "ul", "ol", "table", "tr"):
                self.out.append("\n\n")
            elif tag == "br":
                self.out.append("\n")

        def handle_endtag(self, tag) -> None:
            if tag in ("script", "style", "noscript", "template", "head"):
                self.skip = max(0, self.skip - 1)
            elif tag == "pre":
                self.pre = max(0, self.pre - 1)
                self.out.append("\n```\n\n")
            elif re.fullmatch("h[1-6]", tag) or tag in ("p", "blockquote", "ul", "ol"):
                self.out.append("\n\n")

        def handle_data(self, data) -> None:
            if not self.skip:
                self.out.append(data if self.pre else re.sub(r"\s+", " ", data))

    reader = Reader()
    reader.feed(html)
    reader.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(reader.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip() + "\n"


CONVERTERS = {"text/plain": lambda b: b.decode("utf-8", "strict"), "text/markdown": lambda b: b.decode("utf-8", "strict"), "text/html": lambda b: html_to_markdown(b.decode("utf-8", "replace"))}


def convert(files: DataFrame, converters: dict = CONVERTERS) -> DataFrame:
    """(source_ref, markdown, error) of (source_ref, mime, content); a type without converter and undecodable bytes are typed errors, no failures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ref, mime, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    f = converters.get((mime or "").split(";")[0].strip().lower())
                    rows.append((ref, f(content or b""), None) if f else (ref, None, "unrouted"))
                except UnicodeDecodeError:
                    rows.append((ref, None, "undecodable"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["source_ref", "markdown", "error"])

    return files.select("source_ref", "mime", "content").mapInArrow(run, "source_ref string, markdown string, error string")


_SPLIT = re.compile(r"(?<=[.!?。])\s+|\n{2,}")


def sentences(text: str, least_words: int = 4) -> list[tuple[str, int, int, bool]]:
    """(sentence, start, end, kept): the rule in the extractor's seat keeps statements and drops questions, headings, tables, code and short ones."""
    out, at = [], 0
    for m in [*_SPLIT.finditer(text), None]:
        end = m.start() if m else len(text)
        raw = text[at:end]
        body = raw.strip()
        if body:
            start = at + raw.index(body[0])
            keep = len(body.split()) >= least_words and not body.endswith("?") and body[0] not in "#|`>" and "```" not in body
            out.append((body, start, start + len(body), keep))
        at = m.end() if m else end
    return out


def extract_claims(documents: DataFrame) -> DataFrame:
    """(doc_id, seq, claim_text, char_start, char_end, kept): one decision a sentence, so the ledger of drops is complete; spans slice the text exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, *s) for k, t in zip(*(c.to_pylist() for c in batch.columns)) for i, s in enumerate(sentences(t or ""))]
            if rows:
                types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "seq", "claim_text", "char_start", "char_end", "kept"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, seq int, claim_text string, char_start int, char_end int, kept boolean")
