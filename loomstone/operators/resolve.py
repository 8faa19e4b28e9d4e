"""Entity resolution: exact, trigram and phonetic blocking, similarity bands, clustering and merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomstone.functions import text as tx
from loomstone.operators.ranking import cosine

FLOOR, CANDIDATES = 0.3, 10
ACCEPT, REJECT, ESCALATIONS = 0.88, 0.60, 3
SURE = 0.75
CUT, POCKET, BLAST = 0.15, 50, 100


def exact(surfaces: DataFrame, aliases: DataFrame) -> DataFrame:
    """(surface, entity_id): the oldest alias of an active entity with the same lemma."""
    first = aliases.groupBy("lemma").agg(F.min_by("entity_id", F.struct("first_seen", "entity_id")).alias("entity_id"))
    return surfaces.join(first, "lemma").select("surface", "entity_id")


def trigram_candidates(surfaces: DataFrame, aliases: DataFrame, floor: float = FLOOR, k: int = CANDIDATES) -> DataFrame:
    """(surface, entity_id, score, rank): the k entities of largest trigram similarity of at least ``floor``, over their best alias.

    Two sets of similarity f share a trigram among the |x| - ceil(f |x|) + 1 rarest
    of each, so only those prefixes are joined; rarity is counted over all aliases.
    The score is then computed in full. Texts without trigrams match nothing.
    """
    left = surfaces.select("surface").distinct().withColumn("x", tx.trigrams(F.col("surface")))
    right = aliases.select("entity_id", "alias_text").distinct().withColumn("y", tx.trigrams(F.col("alias_text")))
    seen = right.select(F.explode("y").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))

    def prefix(df: DataFrame, grams: str, *keys: str) -> DataFrame:
        each = df.select(*keys, F.size(grams).alias("m"), F.explode(grams).alias("g")).join(seen, "g", "left")
        w = Window.partitionBy(*keys).orderBy(F.coalesce("n", F.lit(0)), "g")
        return each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("m") - F.ceil(F.col("m") * floor) + 1).select(*keys, "g")

    pairs = prefix(left, "x", "surface").join(prefix(right, "y", "entity_id", "alias_text"), "g").select("surface", "entity_id", "alias_text").distinct()
    scored = pairs.withColumn("score", tx.similarity(F.col("surface"), F.col("alias_text"))).where(F.col("score") >= floor)
    best = scored.groupBy("surface", "entity_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("surface").orderBy(F.desc("score"), "entity_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def phonetic_candidates(surfaces: DataFrame, aliases: DataFrame) -> DataFrame:
    """(surface, entity_id) that share a Daitch-Mokotoff code."""
    left = surfaces.select("surface").distinct().select("surface", F.explode(tx.sounds("surface")).alias("code"))
    right = aliases.select("entity_id", "alias_text").distinct().select("entity_id", F.explode(tx.sounds("alias_text")).alias("code"))
    return left.join(right.distinct(), "code").select("surface", "entity_id").distinct()


def block(surfaces: DataFrame, aliases: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Candidates of both blockings: (surface, entity_id, tier, score); trigram (T1) wins over phonetic (T2), at most k each surface."""
    one = trigram_candidates(surfaces, aliases, k=k).select("surface", "entity_id", F.lit("T1").alias("tier"), "score")
    two = phonetic_candidates(surfaces, aliases).join(one, ["surface", "entity_id"], "left_anti")
    best = two.join(aliases.select("entity_id", "alias_text"), "entity_id").groupBy("surface", "entity_id").agg(F.max(tx.similarity(F.col("surface"), F.col("alias_text"))).alias("score"))
    both = one.unionByName(best.select("surface", "entity_id", F.lit("T2").alias("tier"), "score"))
    w = Window.partitionBy("surface").orderBy(F.desc("score"), "entity_id")
    return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def band(score: Column) -> Column:
    """accept from ACCEPT, reject up to REJECT, else escalate; a missing score escalates."""
    return F.when(score >= ACCEPT, "accept").when(score <= REJECT, "reject").otherwise("escalate")


def decide(candidates: DataFrame) -> DataFrame:
    """(mention_id, entity_id, verdict): the first accepted candidate by score, else the first ESCALATIONS to look at, else mint a new entity.

    Input (mention_id, entity_id, score, embedding_score).
    """
    w = Window.partitionBy("mention_id").orderBy(F.desc_nulls_last("score"), "entity_id")
    banded = candidates.withColumn("band", band(F.col("embedding_score"))).withColumn("r", F.row_number().over(w))
    has = F.max(F.when(F.col("band") == "accept", 1).otherwise(0)).over(Window.partitionBy("mention_id"))
    first = F.min(F.when(F.col("band") == "accept", F.col("r"))).over(Window.partitionBy("mention_id"))
    escalated = F.sum(F.when(F.col("band") == "escalate", 1).otherwise(0)).over(w)
    any_open = F.max(F.when(F.col("band") == "escalate", 1).otherwise(0)).over(Window.partitionBy("mention_id"))
    judged = banded.withColumns({"has": has, "first": first, "esc": escalated, "open": any_open})
    verdict = (
        F.when((F.col("has") == 1) & (F.col("r") == F.col("first")), "link").when((F.col("has") == 0) & (F.col("band") == "escalate") & (F.col("esc") <= ESCALATIONS), "escalate")
        .when((F.col("open") == 0) & (F.col("has") == 0) & (F.col("r") == 1), "mint")
    )
    out = judged.withColumn("verdict", verdict).where("verdict is not null")
    return out.select("mention_id", F.when(F.col("verdict") != "mint", F.col("entity_id")).alias("entity_id"), "verdict")


def judge_pair(pairs: DataFrame) -> DataFrame:
    """Pairs (surface_a, surface_b, vector_a, vector_b) with ``outcome``: equal lemma matches, no trigram or sound in common rejects, else the band of the cosine."""
    same = tx.lemma("surface_a") == tx.lemma("surface_b")
    reach = (tx.similarity(F.col("surface_a"), F.col("surface_b")) >= FLOOR) | F.arrays_overlap(tx.sounds("surface_a"), tx.sounds("surface_b"))
    score = F.when(F.col("vector_a").isNotNull() & F.col("vector_b").isNotNull(), cosine(F.col("vector_a"), F.col("vector_b")))
    return pairs.withColumn("outcome", F.when(same, "accept").when(~reach, "reject").otherwise(band(score)))


def agglomerate(ids: list[str], vectors: list, cut: float = CUT) -> list[list[str]]:
    """Centroid clusters: the closest two within the cut (cosine distance) join until none are; a joint centroid is the plain mean of the two.

    More than POCKET members halve the cut; members without a vector stay alone; ties go by id.
    """
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    groups = [[ids[i]] for i in order if vectors[i] is not None]
    alone = [[ids[i]] for i in order if vectors[i] is None]
    m = [np.asarray(vectors[i], float) for i in order if vectors[i] is not None]
    cut = cut / 2 if len(ids) > POCKET else cut
    while len(groups) > 1:
        unit = np.array([v / (np.linalg.norm(v) or 1.0) for v in m])
        dist = 1 - unit @ unit.T
        dist[np.tril_indices(len(groups))] = np.inf
        i, j = divmod(int(np.argmin(dist)), len(groups))
        if dist[i, j] > cut:
            break
        groups[i] = sorted(groups[i] + groups[j])
        m[i] = (m[i] + m[j]) / 2
        del groups[j], m[j]
    return sorted(groups + alone)


def pockets(members: DataFrame, cut: float = CUT) -> DataFrame:
    """(pocket, id, cluster): each pocket of (pocket, id, vector) clustered on its own; cluster is its smallest id. Pockets are neighbourhoods, small by construction."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = agglomerate(list(pdf["id"]), list(pdf["vector"]), cut)
        return pd.DataFrame([(pdf["pocket"].iloc[0], i, g[0]) for g in groups for i in g], columns=["pocket", "id", "cluster"])

    kinds = members.schema
    return members.select("pocket", "id", "vector").groupBy("pocket").applyInPandas(run, f"pocket {kinds['pocket'].dataType.simpleString()}, id string, cluster string")


def merges(clusters: DataFrame) -> DataFrame:
    """(cluster, survivor, absorbed, blast, route): the oldest member survives, ties by id; a blast radius above BLAST goes to review.

    Input (cluster, id, first_seen, mention_count, graph_degree).
    """
    survivor = F.min_by("id", F.struct("first_seen", "id"))
    out = clusters.groupBy("cluster").agg(survivor.alias("survivor"), F.sort_array(F.collect_set("id")).alias("ids"), F.coalesce(F.sum(F.col("mention_count") + F.col("graph_degree")), F.lit(0)).alias("blast"))
    return out.where(F.size("ids") > 1).select(
        "cluster", "survivor", F.array_remove("ids", F.col("survivor")).alias("absorbed"), F.col("blast").cast("long").alias("blast"), F.when(F.col("blast") > BLAST, "review").otherwise("apply").alias("route")
    )


def unmerge(entities: DataFrame, survivor: str) -> DataFrame:
    """Entities with those merged into one survivor active again."""
    back = F.col("merged_into") == survivor
    return entities.withColumns({"status": F.when(back, "active").otherwise(F.col("status")), "merged_into": F.when(~back, F.col("merged_into"))})


def two_judges(pairs: DataFrame) -> DataFrame:
    """Pairs (verdict, confidence, second_verdict, second_confidence) with ``outcome`` and ``judge``: the first judge stands from SURE, else the second is heard; none that is sure means apart."""
    first = F.col("confidence") >= SURE
    outcome = F.when(first, F.col("verdict")).when(F.col("second_verdict").isNotNull(), F.col("second_verdict")).otherwise("apart")
    return pairs.withColumns({"outcome": outcome, "judge": F.when(first, "first").otherwise("second")})


def mint(unmatched: DataFrame) -> DataFrame:
    """(entity_id, canonical_name, lemma, type, rejected_by) of one new entity for each lemma and type of (surface, type, rejected_by); named as its first surface, rejected by the strictest tier."""
    named = unmatched.where("surface is not null").withColumn("lemma", tx.lemma("surface")).where("lemma <> ''")
    out = named.groupBy("lemma", "type").agg(F.min("surface").alias("canonical_name"), F.max("rejected_by").alias("rejected_by"))
    return out.select(F.sha2(F.concat_ws("\x1f", F.lit("entity"), "lemma", "type"), 256).alias("entity_id"), "canonical_name", "lemma", "type", "rejected_by")


def neighbourhood(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """(surface, entity_id, root_id) of candidates with their current identity: themselves if active, or the active entity that a merge sent them to."""
    active = entities.where("status = 'active'").select(F.col("entity_id").alias("root_id"))
    known = candidates.select("surface", "entity_id").distinct().join(entities.select("entity_id", F.coalesce("merged_into", "entity_id").alias("root_id")), "entity_id")
    return known.join(active, "root_id", "left_semi").select("surface", "entity_id", "root_id")


def ripple(decisions: DataFrame, relations: DataFrame, parts: DataFrame) -> DataFrame:
    """Supersede decisions (relation_id, related_id) between facts whose subjects a split puts into different parts (entity_id, part); they must be judged anew."""
    side = lambda key, name: relations.select(F.col("relation_id").alias(key), F.col("subject").alias("entity_id")).join(parts, "entity_id").select(key, F.col("part").alias(name))
    both = decisions.where("outcome = 'supersede'").join(side("relation_id", "own"), "relation_id").join(side("related_id", "other"), "related_id")
    return both.where("own <> other").select("relation_id", "related_id")
