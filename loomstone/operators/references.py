"""References to records that are missing, deleted or came later."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomstone.operators.skew import HEAVY_FLOOR, HEAVY_PARTS
from loomstone.runtime import Scratch


def target_state(targets: DataFrame, key: str, arrived: str, deleted: str | None = None) -> DataFrame:
    """One row (key, target_live, target_first) a target key; rows of one key are pre-aggregated before the shuffle."""
    live = F.col(deleted).isNull() if deleted else F.lit(True)
    return targets.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(
        F.max(live.cast("int")).alias("target_live"), F.min(F.when(live, F.col(arrived))).alias("target_first")
    )


def orphans(refs: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """The rows of ``refs`` (field, key, at, ...) whose key is orphaned, with ``orphan_state``.

    ``targets[field]`` is the result of :func:`target_state`. State ``missing``:
    no row of that key; ``deleted``: all its rows are deleted; ``late``: the first
    row that is not deleted arrived after ``at``. References with a null key do
    not count; with a null ``at`` they are never late. An empty target makes every
    reference missing, empty references give an empty result. Other columns of the
    references are kept, whatever their names but target_live and target_first.

    Plan: references are pre-aggregated per (field, key) with map-side partial
    sums, so the targets see each key once however many references it has. The
    judged keys are written once. Heavy ones (at most ``HEAVY_PARTS`` by
    pigeonhole), orphaned or not, leave the references by broadcast and are
    answered there; only the references of other keys are shuffled to the
    orphaned ones, and the union of both is the result.
    """
    refs = refs.where(F.col("key").isNotNull()).withColumn("key", F.col("key").cast("string"))
    per_key = refs.groupBy("field", "key").agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("_first"))
    known = None
    for field, df in targets.items():
        tagged = df.select(F.lit(field).alias("field"), "key", "target_live", "target_first")
        known = tagged if known is None else known.unionByName(tagged)
    judged, seen = Scratch(refs.sparkSession, "references").save(per_key.join(known, ["field", "key"], "left"), rows=F.sum("_n"))
    suspect = F.col("target_live").isNull() | (F.col("target_live") == 0) | (F.col("target_first") > F.col("_first"))
    state = (
        F.when(F.col("target_live").isNull(), F.lit("missing")).when(F.col("target_live") == 0, F.lit("deleted")).when(F.col("target_first") > F.col("at"), F.lit("late"))
    )
    parts = [part.join(keys, ["field", "key"]) for part, keys in split(refs, judged, suspect, seen["rows"] or 0)]
    hit = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return hit.withColumn("orphan_state", state).where(F.col("orphan_state").isNotNull()).drop("target_live", "target_first")


def split(refs: DataFrame, judged: DataFrame, suspect, rows: int) -> list[tuple[DataFrame, DataFrame]]:
    """(references, their suspect keys) of the heavy keys, by broadcast, and of the others."""
    bad = judged.where(suspect).select("field", "key", "target_live", "target_first", "_n")
    limit = max(HEAVY_FLOOR, rows // HEAVY_PARTS)
    if rows <= HEAVY_FLOOR:
        return [(refs, bad.drop("_n"))]
    heavy = F.broadcast(judged.where(F.col("_n") > limit).select("field", "key"))
    on = ["field", "key"]
    return [(refs, F.broadcast(bad.where(F.col("_n") > limit).drop("_n"))), (refs.join(heavy, on, "left_anti"), bad.where(F.col("_n") <= limit).drop("_n"))]


def report(found: DataFrame, period: str) -> DataFrame:
    """Orphan counts per target field, period and state, pre-aggregated per key and period."""
    per_key = found.groupBy("field", period, "orphan_state", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("field", period, "orphan_state").agg(F.sum("n").alias("references"), F.count(F.lit(1)).alias("keys"))
