"""The read primitives: nominate, confirm, and answer at one grain."""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from loomstone.operators import temporal as t

CO_MEMBERS, CLAIM_CHARS, DELTA_CHARS = 25, 120, 80
AGGREGATES = ("count", "group_by_predicate", "group_by_object", "timeline", "delta_top_entities", "typed_absence")
#: Aggregates of which a limited number of rows is shown.
BOUNDED = ("group_by_predicate", "group_by_object", "delta_top_entities", "typed_absence")


class Boundary(ValueError):
    """A limit of the engine: the question is well formed but cannot be answered."""


def resolve(aliases: DataFrame, entities: DataFrame, survivors: DataFrame, relations: DataFrame, lemma: str, entity_type: str | None = None, context: tuple[str, ...] = ()) -> DataFrame:
    """Active entities behind a name: (entity_id, canonical_name, type, context_hits), best first.

    Aliases of the exact lemma follow the merge redirects (``survivors``: id,
    root_id). ``context`` entities (at most 8) that are related to a candidate, in
    either direction, count as hits; more hits come first, then name, then id.
    """
    if len(context) > 8:
        raise Boundary("at most 8 context entities")
    named = aliases.where(F.col("lemma") == lemma.lower()).select("entity_id").distinct()
    found = named.join(survivors.select(F.col("id").alias("entity_id"), "root_id"), "entity_id").select(F.col("root_id").alias("entity_id")).distinct()
    active = entities.where((F.col("status") == "active") & t.only(type=entity_type)).select("entity_id", "canonical_name", "type")
    found = found.join(active, "entity_id")
    near = relations.where(t.believed())
    ends = near.select(F.col("subject").alias("entity_id"), F.col("object").alias("focal")).unionByName(near.select(F.col("object").alias("entity_id"), F.col("subject").alias("focal")))
    hits = ends.where(F.col("focal").isin(*context) if context else F.lit(False)).groupBy("entity_id").agg(F.count_distinct("focal").alias("hits"))
    out = found.join(hits, "entity_id", "left").select("entity_id", "canonical_name", "type", F.coalesce("hits", F.lit(0)).cast("long").alias("context_hits"))
    return out.orderBy(F.desc("context_hits"), "canonical_name", "entity_id")


def lookup_relations(relations: DataFrame, valid_at: str | datetime, subject: str | None = None, predicate: str | None = None, object_: str | None = None) -> DataFrame:
    """Believed relations valid at the instant; best supported first, then oldest, then id."""
    keep = t.only(subject=subject, predicate=predicate, object=object_) & t.valid_at(valid_at) & t.believed()
    return relations.where(keep).orderBy(F.desc("evidence_count"), "ingested_at", "relation_id")


def lookup_observations(observations: DataFrame, entity: str, valid_at: str | datetime) -> DataFrame:
    """Believed observations of one entity valid at the instant."""
    keep = t.only(subject=entity) & t.valid_at(valid_at) & t.believed()
    return observations.where(keep).orderBy(F.desc("evidence_count"), "ingested_at", "observation_id")


def confirm(nominated: DataFrame, truth: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows in nominated order, number dropped) of nominated (key, position) re-read from the truth."""
    kept = nominated.join(truth, key).orderBy("position")
    dropped = nominated.join(truth, key, "left_anti").agg(F.count(F.lit(1)).alias("dropped_by_hydration"))
    return kept, dropped


def hydrate_relation(relation_id: str, relations: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """The supporting claims of one fact, invalidated or not, oldest first: (claim_id, doc_id, claim_text, ...)."""
    fact = relations.where(F.col("relation_id") == relation_id).select("relation_id", "subject", "predicate", "object")
    support = evidence.where((F.col("relation_id") == relation_id) & (F.col("stance") == "supports")).select("relation_id", "claim_id")
    out = fact.join(support, "relation_id").join(claims.select("claim_id", "doc_id", "claim_text", "ingested_at"), "claim_id")
    return out.orderBy("ingested_at", "claim_id")


def transcript(kind: str, subject_id: str, decisions: DataFrame) -> DataFrame:
    """Decisions (kind, subject_id, related_id, outcome, decided_at, decision_id) that touch a subject, oldest first; related_id is the other side."""
    if kind not in ("relation", "observation", "entity", "k_page"):
        raise Boundary(f"no transcript of {kind}")
    mine = decisions.where((F.col("kind") == kind) & ((F.col("subject_id") == subject_id) | (F.col("related_id") == subject_id)))
    other = F.when(F.col("subject_id") == subject_id, F.col("related_id")).otherwise(F.col("subject_id"))
    return mine.select("decision_id", "outcome", "decided_at", other.alias("related_id")).orderBy("decided_at", "decision_id")


def encode_cursor(at: str, ident: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([at, ident]).encode()).decode()


def decode_cursor(token: str) -> tuple[str, str]:
    try:
        at, ident = json.loads(base64.urlsafe_b64decode(token.encode()))
    except ValueError as e:
        raise Boundary("unreadable continuation") from e
    return at, ident


def feed(relations: DataFrame, observations: DataFrame, claims: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """All changes as (kind, change, id, label, at): new, invalidated and capped facts, new claims, recompiled pages."""
    part = lambda df, kind, change, ident, text, at: df.where(F.col(at).isNotNull()).select(
        F.lit(kind).alias("kind"), F.lit(change).alias("change"), F.col(ident).alias("id"), text.alias("label"), F.col(at).cast("timestamp_ntz").alias("at")
    )
    named, said = F.coalesce("fact_label", "predicate"), F.col("statement")
    parts = [
        part(relations, "relation", "new", "relation_id", named, "ingested_at"),
        part(relations, "relation", "invalidated", "relation_id", named, "invalidated_at"),
        part(relations, "relation", "capped", "relation_id", named, "valid_until"),
        part(observations, "observation", "new", "observation_id", said, "ingested_at"),
        part(observations, "observation", "invalidated", "observation_id", said, "invalidated_at"),
        part(observations, "observation", "capped", "observation_id", said, "valid_until"),
        part(claims, "claim", "new", "claim_id", F.left(F.col("claim_text"), F.lit(DELTA_CHARS)), "ingested_at"),
    ]
    if pages is not None:
        parts.append(part(pages, "page", "recompiled", "page_id", F.col("title"), "compiled_at"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def delta(changes: DataFrame, since: str, kinds: tuple[str, ...] = (), limit: int = 500, continuation: str | None = None) -> DataFrame:
    """One page of changes after ``since``, newest first, ties by id then change; read limit + 1 to see whether more follow.

    The cursor is the (at, id, change) of the last row of the page before, compared
    strictly, so no tied row is lost or repeated.
    """
    page = changes.where(F.col("at") > t.instant(since))
    if kinds:
        page = page.where(F.col("kind").isin(*kinds))
    if continuation:
        at, rest = decode_cursor(continuation)
        page = page.where(F.struct("at", F.concat_ws("\x1f", "id", "change")) < F.struct(t.instant(at), F.lit(rest)))
    return page.orderBy(F.desc("at"), F.desc("id"), F.desc("change")).limit(limit + 1)


def scan(kind: str, frame: DataFrame) -> DataFrame:
    """(kind, id, label, at) of every row of a kind, oldest first, without any liveness filter."""
    shape = {
        "relation": ("relation_id", F.coalesce(F.col("fact_label"), F.col("predicate"))),
        "observation": ("observation_id", F.col("statement")),
        "claim": ("claim_id", F.left(F.col("claim_text"), F.lit(CLAIM_CHARS))),
    }
    if kind not in shape or frame is None:
        raise Boundary(f"no scan of {kind}")
    ident, text = shape[kind]
    return frame.select(F.lit(kind).alias("kind"), F.col(ident).alias("id"), text.alias("label"), F.col("ingested_at").alias("at")).orderBy("at", "id")


def aggregate(form: str, relations: DataFrame, observations: DataFrame | None = None, entities: DataFrame | None = None, subject: str | None = None,
              predicate: str | None = None, entity_type: str | None = None, since: str | None = None, limit: int = 50) -> DataFrame:
    """The enumerated aggregates; bounded forms return limit + 1 rows so that a cut shows.

    They look at belief only, never at valid time; ``delta_top_entities`` at
    neither. Missing arguments and unknown forms are boundaries.
    """
    need = {"group_by_predicate": ("subject",), "group_by_object": ("subject",), "timeline": ("subject",), "delta_top_entities": ("since",), "typed_absence": ("predicate", "entity_type")}
    given = {"subject": subject, "predicate": predicate, "entity_type": entity_type, "since": since}
    if form not in AGGREGATES:
        raise Boundary(f"no aggregate {form}")
    if missing := [n for n in need.get(form, ()) if given[n] is None]:
        raise Boundary(f"{form} needs {', '.join(missing)}")
    if limit < 1:
        raise Boundary("the limit must be at least 1")
    live = relations.where(t.believed())
    top = lambda df, *order: df.orderBy(*order).limit(limit + 1)
    if form == "count":
        return live.where(t.only(subject=subject, predicate=predicate)).agg(F.count(F.lit(1)).alias("n"))
    if form == "group_by_predicate":
        return top(live.where(t.only(subject=subject)).groupBy("predicate").agg(F.count(F.lit(1)).alias("n")), F.desc("n"), "predicate")
    if form == "group_by_object":
        named = entities.select(F.col("entity_id").alias("object"), "canonical_name")
        per = live.where(t.only(subject=subject, predicate=predicate)).groupBy("object").agg(F.count(F.lit(1)).alias("n"))
        return top(per.join(named, "object").select("object", "canonical_name", "n"), F.desc("n"), "canonical_name", "object")
    if form == "timeline":
        year = lambda df: df.select(F.date_format(F.coalesce("valid_from", "ingested_at"), "yyyy").alias("year"))
        mine = live.where((F.col("subject") == subject) | (F.col("object") == subject))
        both = year(mine).unionByName(year(observations.where(t.believed() & t.only(subject=subject))))
        return both.groupBy("year").agg(F.count(F.lit(1)).alias("n")).orderBy("year")
    if form == "delta_top_entities":
        fresh = relations.where(F.col("ingested_at") > t.instant(since))
        ends = fresh.select(F.explode(F.array("subject", "object")).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
        said = observations.where(F.col("ingested_at") > t.instant(since)).groupBy(F.col("subject").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
        return top(ends.unionByName(said).groupBy("entity_id").agg(F.sum("n").alias("n")), F.desc("n"), "entity_id")
    has = live.where(F.col("predicate") == predicate).select(F.col("subject").alias("entity_id"))
    typed = entities.where((F.col("status") == "active") & (F.col("type") == entity_type))
    return top(typed.join(has, "entity_id", "left_anti").select("entity_id", F.lit(1).cast("long").alias("n")), "entity_id")


def co_members(facts: DataFrame, relations: DataFrame, cap: int = CO_MEMBERS) -> DataFrame:
    """(relation_id, other_id, co_total) for facts in a contradiction group: the first ``cap`` believed others by id, and how many there are.

    Each group is ranked once; its first ``cap`` + 1 members, one more than are
    shown in case the fact is among them, are all that meets its facts.
    """
    group = relations.where(t.believed() & F.col("contradiction_group").isNotNull()).select("contradiction_group", "relation_id").distinct()
    ranked = group.withColumn("_r", F.row_number().over(Window.partitionBy("contradiction_group").orderBy("relation_id"))).where(F.col("_r") <= cap + 1)
    first = ranked.groupBy("contradiction_group").agg(F.sort_array(F.collect_list("relation_id")).alias("_ids"))  # cap + 1 ids
    size = group.groupBy("contradiction_group").agg(F.count(F.lit(1)).alias("_n"))
    mine = facts.select("relation_id", "contradiction_group").join(group.withColumn("_in", F.lit(1)), ["relation_id", "contradiction_group"], "left")
    shown = mine.join(first.join(size, "contradiction_group"), "contradiction_group").withColumn("_ids", F.slice(F.array_remove("_ids", F.col("relation_id")), 1, cap))
    return shown.select("relation_id", F.explode("_ids").alias("other_id"), (F.col("_n") - F.coalesce("_in", F.lit(0))).cast("long").alias("co_total"))


def withdrawn(facts: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Facts with ``support``: withdrawn under an open review flag (candidate JSON names the fact), else current."""
    open_ = reviews.where(F.col("status").isin("pending", "deferred")).select(F.get_json_object("candidate", "$.fact_id").alias(key)).where(F.col(key).isNotNull()).distinct()
    return facts.join(open_.withColumn("_flag", F.lit(True)), key, "left").withColumn("support", F.when(F.col("_flag"), "withdrawn").otherwise("current")).drop("_flag")


def enriched(facts: DataFrame, relations: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Facts with what speaks against them: ``contradicts`` (at most CO_MEMBERS ids of the group, in order), ``contradicts_total`` and ``support``."""
    rivals = co_members(facts, relations).groupBy("relation_id").agg(F.sort_array(F.collect_list("other_id")).alias("contradicts"), F.max("co_total").alias("contradicts_total"))
    out = facts.join(rivals, "relation_id", "left").withColumns({"contradicts": F.coalesce("contradicts", F.array().cast("array<string>")), "contradicts_total": F.coalesce("contradicts_total", F.lit(0).cast("long"))})
    return withdrawn(out, reviews, "relation_id") if reviews is not None else out.withColumn("support", F.lit("current"))


def merge_decisions(entities: DataFrame) -> DataFrame:
    """Merge redirects as decisions: (kind, decision_id, subject_id, related_id, outcome, decided_at); the instant is unknown."""
    gone = entities.where(F.col("merged_into").isNotNull())
    return gone.select(F.lit("entity").alias("kind"), F.concat(F.lit("merge:"), "entity_id").alias("decision_id"), F.col("entity_id").alias("subject_id"), F.col("merged_into").alias("related_id"), F.lit("merged").alias("outcome"), F.lit(None).cast("timestamp_ntz").alias("decided_at"))


def pages_about(pages: DataFrame, rules: DataFrame, keys: DataFrame, flags: DataFrame, key_kind: str, key_value: str) -> DataFrame:
    """Live pages whose active rules watch a key, newest first, with stale and open-flag marks: (page_id, title, is_stale, open_flags, redact)."""
    watched = keys.where((F.col("key_kind") == key_kind) & (F.col("key_value") == key_value)).join(rules.where("active"), "rule_id").select("page_id").distinct()
    open_ = flags.where(F.col("status") == "open").groupBy("page_id").agg(F.count(F.lit(1)).alias("open_flags"), F.bool_or("redact").alias("redact"))
    out = pages.where(F.col("status") != "tombstoned").join(watched, "page_id", "left_semi").join(open_, "page_id", "left")
    out = out.select("page_id", "title", "compiled_at", (~F.col("inputs_hash").eqNullSafe(F.col("current_hash"))).alias("is_stale"), F.coalesce("open_flags", F.lit(0)).alias("open_flags"), F.coalesce("redact", F.lit(False)).alias("redact"))
    return out.orderBy(F.desc_nulls_last("compiled_at"), "page_id")


def believed_at_boundary(believed_at: datetime, horizon: datetime | None) -> None:
    """Raises for an instant before a finite belief horizon; no horizon never raises."""
    if horizon is not None and believed_at < horizon:
        raise Boundary(f"beliefs before {horizon} are not kept")
