"""Gates, upserts and adjudication of relations and observations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomstone.operators import hierarchy

OTHER = r"^other:[a-z][a-z0-9_]{1,40}$"
NOVEL, LADDER, SAFE = 0.3, 5, 0.8


def predicate_gate(proposed: DataFrame, core: DataFrame) -> DataFrame:
    """Proposed facts whose predicate is in the core list or has the ``other:`` form."""
    known = core.select("predicate").distinct().withColumn("_core", F.lit(True))
    return proposed.join(known, "predicate", "left").where(F.col("_core") | F.col("predicate").rlike(OTHER)).drop("_core")


def type_gate(proposed: DataFrame, types: DataFrame, signatures: DataFrame) -> DataFrame:
    """Facts (predicate, subject_type, object_type) that a signature allows at any ancestor of either type.

    A predicate without signatures is unconstrained; an unknown type fails.
    """
    tree = hierarchy.resolve(types, "type", "parent", with_path=True).select(F.col("id").alias("type"), F.explode("path").alias("above"))
    above = lambda side: tree.select(F.col("type").alias(f"{side}_type"), F.col("above").alias(f"{side}_above"))
    allowed = signatures.select("predicate", F.col("subject_type").alias("subject_above"), F.col("object_type").alias("object_above"))
    fine = above("subject").join(allowed, "subject_above").join(above("object"), "object_above").select("predicate", "subject_type", "object_type").distinct()
    free = proposed.join(signatures.select("predicate").distinct(), "predicate", "left_anti").join(above("subject").select("subject_type").distinct(), "subject_type", "left_semi")
    free = free.join(above("object").select("object_type").distinct(), "object_type", "left_semi")
    return proposed.join(fine, ["predicate", "subject_type", "object_type"], "left_semi").unionByName(free)


def upsert_relations(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """(subject, predicate, object, relation_id, is_new, valid_from) for each distinct proposed fact.

    A believed fact whose window is open is reused; else a new one begins where the
    last closed window of the same fact ended. New ids are hashes of the fact and
    its begin.
    """
    on = ["subject", "predicate", "object"]
    want = proposed.select(*on).distinct()
    have = existing.groupBy(*on).agg(
        F.min(F.when(F.col("invalidated_at").isNull() & F.col("valid_until").isNull(), F.col("relation_id"))).alias("open_id"), F.max("valid_until").alias("ended")
    )
    out = want.join(have, on, "left")
    fresh = F.sha2(F.concat_ws("\x1f", *on, F.coalesce(F.col("ended").cast("string"), F.lit(""))), 256)
    return out.select(*on, F.coalesce("open_id", fresh).alias("relation_id"), F.col("open_id").isNull().alias("is_new"), F.when(F.col("open_id").isNull(), F.col("ended")).alias("valid_from"))


def upsert_observations(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """(subject, statement, observation_id, is_new) for each distinct proposed statement: a believed, open one of the same words is reused."""
    on = ["subject", "statement"]
    live = existing.where("invalidated_at is null and valid_until is null").groupBy(*on).agg(F.min("observation_id").alias("known"))
    out = proposed.select(*on).where("subject is not null and statement is not null").distinct().join(live, on, "left")
    return out.select(*on, F.coalesce("known", F.sha2(F.concat_ws("\x1f", *on), 256)).alias("observation_id"), F.col("known").isNull().alias("is_new"))


def apply_outcomes(relations: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, decisions) after outcomes (relation_id, outcome, related_id, at) of new facts against older ones.

    supersede ends the older window at the earliest such instant, only where that
    shortens it, else the decision is a noop; contradict puts both into the older
    one's group, or into a new one named after it; all else leaves both as they are.
    A fact in several contradictions takes the smallest group. Decisions are
    (relation_id, related_id, outcome, done).
    """
    old = relations.select(F.col("relation_id").alias("related_id"), F.col("valid_until").alias("_until"), F.col("contradiction_group").alias("_group"))
    told = outcomes.distinct().join(old, "related_id")
    shorter = F.col("_until").isNull() | (F.col("_until") > F.col("at"))
    done = F.when(F.col("outcome") == "supersede", F.when(shorter, "supersede").otherwise("noop")).when(F.col("outcome") == "contradict", "contradict").otherwise("noop")
    told = told.withColumn("done", done)
    ends = told.where("done = 'supersede'").groupBy(F.col("related_id").alias("relation_id")).agg(F.min("at").alias("_end"))
    group = F.coalesce("_group", F.sha2(F.concat(F.lit("group:"), "related_id"), 256)).alias("_named")
    named = told.where("done = 'contradict'").select(F.explode(F.array("relation_id", "related_id")).alias("relation_id"), group).groupBy("relation_id").agg(F.min("_named").alias("_named"))
    out = relations.join(ends, "relation_id", "left").join(named, "relation_id", "left")
    out = out.withColumns({"valid_until": F.coalesce("_end", "valid_until"), "contradiction_group": F.coalesce("contradiction_group", "_named")}).drop("_end", "_named")
    return out, told.select("relation_id", "related_id", "outcome", "done")


def evidence_once(evidence: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed (fact_id, claim_id) links that are not there yet, each once."""
    on = ["fact_id", "claim_id"]
    return proposed.dropDuplicates(on).join(evidence.select(*on), on, "left_anti")


def supersession_candidates(new: DataFrame, relations: DataFrame, survivors: DataFrame) -> DataFrame:
    """(relation_id, candidate_id, same_object): open believed facts of the same predicate whose subject is one being with the new fact's, itself excluded."""
    root = survivors.select(F.col("id").alias("subject"), F.col("root_id").alias("being"))
    obj = survivors.select(F.col("id").alias("object"), F.col("root_id").alias("thing"))
    shape = lambda df, name: df.join(root, "subject").join(obj, "object", "left").select("being", "predicate", F.coalesce("thing", "object").alias(f"{name}_object"), F.col("relation_id").alias(name))
    live = relations.where("invalidated_at is null and valid_until is null")
    pairs = shape(new, "relation_id").join(shape(live, "candidate_id"), ["being", "predicate"]).where("relation_id <> candidate_id")
    return pairs.select("relation_id", "candidate_id", (F.col("relation_id_object") == F.col("candidate_id_object")).alias("same_object"))


def adjudicate(new: DataFrame, candidates: DataFrame, change_prone: list[str]) -> DataFrame:
    """(relation_id, outcome, related_id) by the fixed ladder.

    add if the predicate is not change-prone or nothing competes; noop if a
    candidate states the same object; else supersede the candidates (all of them).
    """
    per = candidates.groupBy("relation_id").agg(F.min(F.when(F.col("same_object"), F.col("candidate_id"))).alias("same"), F.sort_array(F.collect_set(F.when(~F.col("same_object"), F.col("candidate_id")))).alias("rivals"))
    out = new.join(per, "relation_id", "left")
    prone = F.col("predicate").isin(*change_prone) if change_prone else F.lit(False)
    outcome = F.when(~prone | (F.col("same").isNull() & (F.coalesce(F.size("rivals"), F.lit(0)) <= 0)), "add").when(F.col("same").isNotNull(), "noop").otherwise("supersede")
    return out.withColumn("outcome", outcome).select(
        "relation_id", "outcome", F.explode_outer(F.when(F.col("outcome") == "noop", F.array("same")).when(F.col("outcome") == "supersede", F.col("rivals"))).alias("related_id")
    )


def _words(text: str) -> set[str]:
    return set(text.lower().split())


def rule_judge(old: str, new: str) -> tuple[str, float]:
    """The judge's seat, filled by a rule: the same words but for numbers contradict, more words of the same supersede, else coexist."""
    a, b = _words(old), _words(new)
    plain = lambda s: {w for w in s if not any(c.isdigit() for c in w)}
    if plain(a) == plain(b) and a != b:
        return "contradict", 0.9
    if a < b:
        return "supersede", 0.85
    return "coexist", 0.5


def observation_batch(observations: DataFrame, judge=rule_judge) -> DataFrame:
    """(subject, observation_id, outcome, related_id) of a batch of (subject, observation_id, statement, seq), in order within each subject.

    An identical open statement takes the evidence; nothing open, or no word
    similarity of NOVEL, adds; else the LADDER most similar go to the judge and the
    first decisive outcome stands. Supersede needs a confidence of SAFE, else the
    two coexist. Each subject is one sequential stream, which replaces a lock.
    """
    schema = "subject string, observation_id string, outcome string, related_id string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        live: dict[str, str] = {}
        rows = []
        for r in pdf.sort_values(["seq", "observation_id"]).itertuples():
            same = next((k for k, s in live.items() if s == r.statement), None)
            if same:
                rows.append((r.subject, r.observation_id, "evidence", same))
                continue
            w = _words(r.statement)
            near = sorted(((len(w & _words(s)) / len(w | _words(s)) if w else 0.0, k) for k, s in live.items()), key=lambda x: (-x[0], x[1]))[:LADDER]
            outcome, related = "add", None
            for score, k in near:
                if score < NOVEL:
                    break
                verdict, sure = judge(live[k], r.statement)
                if verdict == "supersede" and sure < SAFE:
                    verdict = "coexist"
                if verdict != "coexist":
                    outcome, related = verdict, k
                    break
                outcome = "coexist"
            if outcome == "supersede":
                del live[related]
            live[r.observation_id] = r.statement
            rows.append((r.subject, r.observation_id, outcome, related))
        return pd.DataFrame(rows, columns=["subject", "observation_id", "outcome", "related_id"])

    return observations.select("subject", "observation_id", "statement", "seq").groupBy("subject").applyInPandas(run, schema)
