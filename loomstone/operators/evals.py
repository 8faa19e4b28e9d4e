"""Standing checks and quality figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def precision_recall(pairs: DataFrame) -> DataFrame:
    """(entity_type, tp, fp, fn, tn, precision, recall) of judged pairs (label, verdict: match or no_match); undefined ratios are null."""
    hit = lambda label, verdict: F.sum(((F.col("label") == label) & (F.col("verdict") == verdict)).cast("long"))
    out = pairs.groupBy("entity_type").agg(hit("match", "match").alias("tp"), hit("no_match", "match").alias("fp"), hit("match", "no_match").alias("fn"), hit("no_match", "no_match").alias("tn"))
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return out.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


def flag_rate(flags: DataFrame, covered: DataFrame) -> DataFrame:
    """(generation, rate): flags over flags and covered, 0 when there is neither."""
    a = flags.groupBy("generation").agg(F.count(F.lit(1)).alias("f"))
    b = covered.groupBy("generation").agg(F.count(F.lit(1)).alias("c"))
    both = a.join(b, "generation", "full").select("generation", F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("c", F.lit(0)).alias("c"))
    return both.select("generation", F.when(F.col("f") + F.col("c") > 0, F.col("f") / (F.col("f") + F.col("c"))).otherwise(0.0).alias("rate"))


def invariants(relations: DataFrame, evidence: DataFrame, entities: DataFrame, survivors: DataFrame) -> DataFrame:
    """(check, n) of broken rows of each standing rule; every n of a sound store is 0."""
    from loomstone.operators.graph import unresolved

    reversed_ = relations.where("valid_until < valid_from")
    loose = evidence.join(relations.select("relation_id"), "relation_id", "left_anti")
    twice = evidence.groupBy("relation_id", "claim_id").count().where("count > 1")
    early = relations.where("invalidated_at < ingested_at")
    checks = {"window_reversed": reversed_, "evidence_without_fact": loose, "evidence_twice": twice, "invalidated_before_ingested": early, "survivor_unresolved": unresolved(entities, survivors)}
    out = None
    for name, df in checks.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out
