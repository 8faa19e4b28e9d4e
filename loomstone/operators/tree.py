"""The browsable tree: view paths, bounded directories and their indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomstone.functions.text import slug

THRESHOLD, SHARD_DEPTH, TOPICS = 150, 4, 6


def view_paths(documents: DataFrame) -> DataFrame:
    """(doc_id, directory) for each view of a document: by source, by month if it is dated, by topic if it is placed.

    Input (doc_id, source_kind, stamp, placement).
    """
    month = F.when(F.col("stamp").isNotNull(), F.concat(F.lit("by-time/"), F.date_format("stamp", "yyyy/MM")))
    parts = F.filter(F.split(F.regexp_replace("placement", "^/+|/+$", ""), "/"), lambda p: p != "")
    topic = F.when(F.size(parts) > 0, F.concat(F.lit("by-topic/"), F.array_join(F.transform(F.slice(parts, 1, TOPICS), lambda p: slug(p)), "/")))
    source = F.concat(F.lit("by-source/"), slug(F.col("source_kind")))
    return documents.select("doc_id", F.explode(F.filter(F.array(source, month, topic), lambda p: p.isNotNull())).alias("directory"))


def shard(entries: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(directory, name, doc_id) with directories of more than ``threshold`` entries split by ever longer lower-case name prefixes.

    A prefix with a character that is no letter or digit goes to 'other'. Splitting
    stops at SHARD_DEPTH letters, or where the prefix no longer distinguishes. One
    window count a level; no directory is gathered in a task beyond its counts.
    """
    now = entries.withColumns({"path": F.col("directory"), "open": F.lit(True)})
    for depth in range(1, SHARD_DEPTH + 1):
        # counts are aggregated and joined back, so a huge directory is counted with partial sums
        head = F.lower(F.substring("name", 1, depth))
        key = F.when(head.rlike(r"^[\p{L}\p{N}]+$"), head).otherwise("other")
        now = now.withColumn("key", key)
        sizes = now.where("open").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("k0"), F.max("key").alias("k1"))
        split = sizes.select("path", ((F.col("n") > threshold) & (F.col("k0") != F.col("k1"))).alias("split"))
        now = now.join(split, "path", "left").select(
            "directory", "name", "doc_id", F.when(F.col("open") & F.col("split"), F.concat_ws("/", "path", "key")).otherwise(F.col("path")).alias("path"), (F.col("open") & F.coalesce("split", F.lit(False))).alias("open")
        )
    return now.select(F.col("path").alias("directory"), "name", "doc_id")


def levels(entries: DataFrame) -> DataFrame:
    """(directory, child, kind) of every level: each directory with its documents and subdirectories, all ancestors included."""
    parts = F.split("directory", "/")
    ancestors = entries.select("directory").distinct().select(F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"), parts.alias("p"))
    dirs = ancestors.select(
        F.when(F.col("n") > 1, F.array_join(F.slice("p", F.lit(1), F.col("n") - 1), "/")).otherwise("").alias("directory"), F.element_at("p", F.col("n")).alias("child"), F.lit("directory").alias("kind")
    ).distinct()
    return dirs.unionByName(entries.select("directory", F.col("name").alias("child"), F.lit("document").alias("kind")))


def index_pages(entries: DataFrame) -> DataFrame:
    """(directory, n_documents, n_directories, body): the index of each level, children in order, directories first."""
    rows = levels(entries).groupBy("directory", "kind", "child").agg(F.count(F.lit(1)).alias("n"))
    line = F.format_string("- %s%s", "child", F.when(F.col("kind") == "directory", "/").otherwise(""))
    return rows.groupBy("directory").agg(
        F.sum(F.when(F.col("kind") == "document", F.col("n")).otherwise(0)).alias("n_documents"), F.sum((F.col("kind") == "directory").cast("long")).alias("n_directories"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "child", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"),
    )
