"""Set-based maintenance of testimony, evidence counts and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomstone.operators.temporal import instant


def recount(facts: DataFrame, evidence: DataFrame, key: str = "relation_id") -> DataFrame:
    """(key, evidence_count, contradict_count) of the facts whose counts change.

    A count is the number of distinct documents with a current claim of the stance.
    """
    live = lambda stance: F.count_distinct(F.when((F.col("stance") == stance) & F.col("is_current"), F.col("doc_id")))
    fresh = evidence.groupBy(key).agg(live("supports").alias("n"), live("contradicts").alias("m"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = facts.join(fresh, key, "left").withColumns({"n": zero("n"), "m": zero("m")})
    return out.where(~F.col("n").eqNullSafe(F.col("evidence_count")) | ~F.col("m").eqNullSafe(F.col("contradict_count"))).select(
        key, F.col("n").alias("evidence_count"), F.col("m").alias("contradict_count")
    )


def currency(events: DataFrame) -> DataFrame:
    """(claim_id, is_current): the last event of each claim decides."""
    return events.groupBy("claim_id").agg(F.max_by("became_current", F.struct("seq", "event_id")).alias("is_current"))


def cache_audit(claims: DataFrame, events: DataFrame) -> DataFrame:
    """Claims whose cached mark contradicts the ledger."""
    return claims.join(currency(events).withColumnRenamed("is_current", "ledger"), "claim_id").where("is_current <> ledger").select("claim_id", "is_current", "ledger")


def apply_transitions(claims: DataFrame, events: DataFrame, transitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims with their new mark, ledger with the new events); known events change nothing, of one event's transitions the first by seq counts, and the last event of a claim owns its mark."""
    row = F.struct(*transitions.columns)
    once = transitions.groupBy("event_id").agg(F.min_by(row, F.struct("seq", F.to_json(row))).alias("_t")).select("_t.*")
    new = once.join(events.select("event_id"), "event_id", "left_anti")
    last = new.groupBy("claim_id").agg(F.max_by("became_current", F.struct("seq", "event_id")).alias("_now"))
    marked = claims.join(last, "claim_id", "left").withColumn("is_current", F.coalesce("_now", "is_current")).drop("_now")
    return marked, events.unionByName(new.select(*events.columns))


def stale_by_supersession(claims: DataFrame, occurrences: DataFrame, latest: DataFrame) -> DataFrame:
    """Current claims of living lineages that the lineage's latest version no longer carries: (claim_id, lineage_id)."""
    carried = occurrences.join(latest.select("lineage_id", "version_no"), ["lineage_id", "version_no"], "left_semi").select("claim_id").distinct()
    living = latest.where("mode = 'living'").select("lineage_id")
    return claims.where("is_current").join(living, "lineage_id", "left_semi").join(carried, "claim_id", "left_anti").select("claim_id", "lineage_id")


def stale_by_reextraction(claims: DataFrame, basis: DataFrame) -> DataFrame:
    """Current claims whose extraction basis is no longer the lineage's basis and that the new basis does not carry."""
    now = basis.select("lineage_id", F.col("extractor").alias("_now"))
    old = claims.where("is_current").join(now, "lineage_id").where(~F.col("extractor").eqNullSafe(F.col("_now")))
    return old.join(claims.join(now, "lineage_id").where(F.col("extractor").eqNullSafe(F.col("_now"))).select("content_key"), "content_key", "left_anti").select("claim_id", "lineage_id")


def stale_by_deletion(claims: DataFrame, occurrences: DataFrame, versions: DataFrame) -> DataFrame:
    """Current claims carried by a deleted version and by no other live one."""
    live = versions.where("deleted_at is null").select("lineage_id", "version_no")
    gone = versions.where("deleted_at is not null").select("lineage_id", "version_no")
    on = ["lineage_id", "version_no"]
    hit = occurrences.join(gone, on, "left_semi").select("claim_id").distinct()
    kept = occurrences.join(live, on, "left_semi").select("claim_id").distinct()
    return claims.where("is_current").join(hit, "claim_id", "left_semi").join(kept, "claim_id", "left_anti").select("claim_id")


def regained(claims: DataFrame, occurrences: DataFrame, latest: DataFrame) -> DataFrame:
    """Claims that are not current but stand in their lineage's latest version."""
    carried = occurrences.join(latest.select("lineage_id", "version_no"), ["lineage_id", "version_no"], "left_semi").select("claim_id")
    return claims.where(~F.col("is_current")).join(carried, "claim_id", "left_semi").select("claim_id")


def affected_facts(evidence: DataFrame, changed: DataFrame, key: str = "relation_id") -> DataFrame:
    """Facts with evidence from changed claims."""
    return evidence.join(changed.select("claim_id"), "claim_id", "left_semi").select(key).distinct()


def zero_support(facts: DataFrame, evidence: DataFrame, flagged: DataFrame, key: str = "relation_id", open_only: bool = True) -> DataFrame:
    """Believed facts without a current supporting document and without an open flag; relations only while their window is open."""
    support = evidence.where("is_current and stance = 'supports'").select(key)
    live = facts.where("invalidated_at is null" + (" and valid_until is null" if open_only else ""))
    return live.join(support, key, "left_anti").join(flagged.select(key), key, "left_anti").select(key)


def close_relations(relations: DataFrame, closing: DataFrame, at: str) -> DataFrame:
    """Relations lose their support by ending: valid_until becomes the instant where it shortens the window."""
    hit = closing.select("relation_id").distinct().withColumn("_c", F.lit(True))
    shorter = F.col("_c") & (F.col("valid_until").isNull() | (F.col("valid_until") > instant(at)))
    return relations.join(hit, "relation_id", "left").withColumn("valid_until", F.when(shorter, instant(at)).otherwise(F.col("valid_until"))).drop("_c")


def close_observations(observations: DataFrame, closing: DataFrame, at: str) -> DataFrame:
    """Observations lose their support by disbelief: invalidated_at becomes the instant."""
    hit = closing.select("observation_id").distinct().withColumn("_c", F.lit(True))
    return observations.join(hit, "observation_id", "left").withColumn("invalidated_at", F.when(F.col("_c"), F.coalesce("invalidated_at", instant(at))).otherwise(F.col("invalidated_at"))).drop("_c")


def finalisable(cycles: DataFrame, work: DataFrame) -> DataFrame:
    """Complete, unfinalised, lossless cycles without work in flight."""
    busy = work.where(F.col("status").isin("pending", "running")).select("cycle_id")
    return cycles.where("completed_at is not null and finalised_at is null and failures = 0").join(busy, "cycle_id", "left_anti").select("cycle_id")


def reconcile(claims: DataFrame, ledger: DataFrame, transitions: DataFrame, evidence: DataFrame, relations: DataFrame, flagged: DataFrame, at: str, lossy: bool = False) -> dict[str, DataFrame]:
    """One cycle's consequences: marks and ledger, then the counts of the touched facts, then the end of those left without support.

    Evidence is (relation_id, claim_id, doc_id, stance). A lossy cycle, which did not
    see all it should have, counts but closes nothing.
    """
    marked, events = apply_transitions(claims, ledger, transitions)
    now = evidence.join(marked.select("claim_id", "is_current"), "claim_id")
    touched = affected_facts(now, transitions)
    mine = relations.join(touched, "relation_id", "left_semi")
    counts = recount(mine, now.join(touched, "relation_id", "left_semi"))
    fresh = relations.join(counts.select("relation_id", F.col("evidence_count").alias("_n"), F.col("contradict_count").alias("_m")), "relation_id", "left")
    fresh = fresh.withColumns({"evidence_count": F.coalesce("_n", "evidence_count"), "contradict_count": F.coalesce("_m", "contradict_count")}).drop("_n", "_m")
    closing = zero_support(mine, now, flagged)
    return {"claims": marked, "ledger": events, "relations": fresh if lossy else close_relations(fresh, closing, at), "closed": closing.limit(0) if lossy else closing}


def bound(pairs: DataFrame, claims: DataFrame, relations: DataFrame) -> DataFrame:
    """Links (claim_id, relation_id) of which both ends exist here; a link into another deployment's tables has none."""
    return pairs.join(claims.select("claim_id"), "claim_id", "left_semi").join(relations.select("relation_id"), "relation_id", "left_semi")


def repoint(versions: DataFrame) -> DataFrame:
    """(lineage_id, current_version): the latest ready and live version of each lineage."""
    return versions.where("deleted_at is null and ready").groupBy("lineage_id").agg(F.max("version_no").alias("current_version"))


def exclusive(facts: DataFrame, evidence: DataFrame, doc_id: str, key: str = "relation_id") -> DataFrame:
    """Facts that only one document gives evidence for; they go when it is forgotten."""
    mine = evidence.where(F.col("doc_id") == doc_id).select(key)
    others = evidence.where(F.col("doc_id") != doc_id).select(key)
    return facts.join(mine, key, "left_semi").join(others, key, "left_anti").select(key)


def forget(tables: dict[str, DataFrame], doc_id: str) -> dict[str, DataFrame]:
    """Every table without the rows of one document; tables without doc_id stay as they are."""
    return {name: df.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id))) if "doc_id" in df.columns else df for name, df in tables.items()}


def left_behind(tables: dict[str, DataFrame], doc_id: str) -> DataFrame:
    """(table_name, n) of rows that a purge missed; empty after a complete one."""
    parts = [df.where(F.col("doc_id") == doc_id).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items() if "doc_id" in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


def supersede(facts: DataFrame) -> DataFrame:
    """The deterministic policy for change-prone facts: each (subject, predicate) version ends where the next begins, only if that shortens it."""
    w = Window.partitionBy("subject", "predicate").orderBy("valid_from", "relation_id")
    follow = F.lead("valid_from").over(w)
    shorter = follow.isNotNull() & (F.col("valid_until").isNull() | (F.col("valid_until") > follow))
    return facts.withColumn("valid_until", F.when(shorter, follow).otherwise(F.col("valid_until")))
