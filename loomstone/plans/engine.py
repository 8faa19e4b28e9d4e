"""The query surface: primitives bound to one set of tables, answers with their envelope, recipes run over them."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomstone.functions import text as tx
from loomstone.operators import graph, primitives as P, ranking
from loomstone.plans import recipes
from loomstone.sources.spine import frame


@dataclass
class Answer:
    """One lazy payload with what was applied to get it; ``negative`` is unknown_entity, known_empty or boundary."""

    grain: str
    rows: DataFrame | None
    valid_at: str | None = None
    believed_at: str | None = None
    truncated: bool | None = None
    continuation: str | None = None
    negative: str | None = None
    explanation: str | None = None
    applied: dict[str, Any] = field(default_factory=dict)


class Engine:
    """Tables are given as a dict of DataFrames named like the spine, without its prefix."""

    def __init__(self, tables: dict[str, DataFrame], now: str):
        self.t, self.now = tables, now
        self._survivors: DataFrame | None = None

    @classmethod
    def over(cls, spark: SparkSession, d: str, now: str) -> Engine:
        names = ("entities", "aliases", "relations", "observations", "claims", "evidence")
        return cls({n: frame(spark, d, f"s_{n}") for n in names}, now)

    @property
    def survivors(self) -> DataFrame:
        if self._survivors is None:  # one write a session, read by every identity question
            self._survivors = graph.survivors(self.t["entities"])
        return self._survivors

    def resolve(self, name: str, entity_type: str | None = None, context: tuple[str, ...] = ()) -> Answer:
        rows = P.resolve(self.t["aliases"], self.t["entities"], self.survivors, self.t["relations"], name, entity_type, context)
        return self._checked(Answer("entity", rows), "unknown_entity", f"no active entity is called {name}")

    def lookup_relations(self, valid_at: str | None = None, **filters: Any) -> Answer:
        rows = P.lookup_relations(self.t["relations"], valid_at or self.now, filters.get("subject"), filters.get("predicate"), filters.get("object"))
        if "contradiction_group" in rows.columns:
            rows = P.enriched(rows, self.t["relations"], self.t.get("reviews")).orderBy(F.desc("evidence_count"), "ingested_at", "relation_id")
        return self._checked(Answer("fact", rows, valid_at=valid_at), "known_empty", "no believed fact is valid then")

    def lookup_observations(self, entity: str, valid_at: str | None = None) -> Answer:
        return self._checked(Answer("fact", P.lookup_observations(self.t["observations"], entity, valid_at or self.now), valid_at=valid_at), "known_empty", "no believed observation is valid then")

    def search_claims(self, text: str, k: int = 10, channel: str = "words") -> Answer:
        """Current claims nearest to a text: by shared words or shared trigrams over all of either."""
        grams = (lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))) if channel == "words" else tx.trigrams
        claims = self.t["claims"].where("is_current").withColumn("_g", grams(F.col("claim_text")))
        q = grams(F.lit(text))
        score = F.size(F.array_intersect("_g", q)) / F.size(F.array_union(F.col("_g"), q))
        rows = claims.select("claim_id", "doc_id", "claim_text", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "claim_id").limit(k)
        return self._checked(Answer("evidence", rows), "known_empty", "no current claim shares a word")

    def hydrate_relation(self, relation_id: str) -> Answer:
        rows = P.hydrate_relation(relation_id, self.t["relations"], self.t["evidence"], self.t["claims"])
        return self._checked(Answer("evidence", rows), "unknown_entity", f"no supported fact {relation_id}")

    def delta(self, since: str, limit: int = 500, kinds: tuple[str, ...] = (), continuation: str | None = None) -> Answer:
        feed = P.feed(self.t["relations"], self.t["observations"], self.t["claims"])
        page = P.delta(feed, since, kinds, limit, continuation)
        last = page.offset(limit - 1).limit(2).select(F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.concat_ws("\x1f", "id", "change").alias("rest")).collect()  # two rows
        more = len(last) == 2
        return Answer("change", page.limit(limit), truncated=more, continuation=P.encode_cursor(*last[0]) if more else None, applied={"since": since})

    def aggregate(self, form: str, **kwargs: Any) -> Answer:
        try:
            rows = P.aggregate(form, self.t["relations"], self.t["observations"], self.t["entities"], **kwargs)
        except P.Boundary as e:
            return Answer("aggregate", None, negative="boundary", explanation=str(e))
        limit = kwargs.get("limit", 50)
        more = form in P.BOUNDED and rows.count() > limit  # limit + 1 rows at most
        return Answer("aggregate", rows.limit(limit) if more else rows, truncated=more, applied={"form": form, "limit": limit if form in P.BOUNDED else None})

    def scan(self, kind: str) -> Answer:
        try:
            return Answer("scan", P.scan(kind, self.t[f"{kind}s"]) if f"{kind}s" in self.t else P.scan(kind, None))
        except P.Boundary as e:
            return Answer("scan", None, negative="boundary", explanation=str(e))

    def transcript(self, kind: str, subject_id: str) -> Answer:
        """Decisions on a subject; those on an entity are braided with the merges that its redirects tell of."""
        told = self.t.get("decisions")
        if kind == "entity":
            merged = P.merge_decisions(self.t["entities"])
            told = merged if told is None else told.select(*merged.columns).unionByName(merged)
        if told is None:
            return Answer("decision", None, negative="boundary", explanation=f"no decisions on {kind} are kept")
        try:
            return self._checked(Answer("decision", P.transcript(kind, subject_id, told)), "known_empty", "nothing was decided on it")
        except P.Boundary as e:
            return Answer("decision", None, negative="boundary", explanation=str(e))

    def pages_about(self, key_kind: str, key_value: str) -> Answer:
        names = ("pages", "rules", "rule_keys", "flags")
        if missing := [n for n in names if n not in self.t]:
            return Answer("page", None, negative="boundary", explanation=f"no {missing[0]} are kept")
        return self._checked(Answer("page", P.pages_about(*(self.t[n] for n in names), key_kind, key_value)), "known_empty", "no page watches it")

    def rerank(self, answer: Answer, signal: str) -> Answer:
        """A scored answer ordered by one of its signals first."""
        if signal not in answer.rows.columns:
            return Answer(answer.grain, None, negative="boundary", explanation=f"no signal {signal}")
        return Answer(answer.grain, ranking.rerank(answer.rows, signal), applied={"signal": signal})

    def _edges(self, valid_at: str | None, believed_at: str | None = None, predicates: tuple[str, ...] = ()) -> DataFrame:
        from loomstone.operators.temporal import believed, valid_at as within

        edges = graph.relates(self.t["relations"], self.survivors, self.t["entities"]).where(within(valid_at or self.now) & believed(believed_at))
        return edges.where(F.col("predicate").isin(*predicates)) if predicates else edges

    def neighborhood(self, start: str, hops: int = 2, limit: int = 500, valid_at: str | None = None, believed_at: str | None = None, predicates: tuple[str, ...] = (), continuation: str | None = None) -> Answer:
        """One page of the nodes around a start, nearest first, with the exact total; a continuation is bound to the question it came from."""
        asked = [start, hops, valid_at or self.now, believed_at, sorted(predicates)]
        offset = 0
        if continuation:
            question, offset = json.loads(base64.urlsafe_b64decode(continuation.encode()))
            if question != asked:
                return Answer("entity", None, negative="boundary", explanation="the continuation belongs to another question")
        names = self.t["entities"].select(F.col("entity_id").alias("id"), "canonical_name")
        if names.where(F.col("id") == start).isEmpty():
            return Answer("entity", None, negative="unknown_entity", explanation=f"no entity {start}")
        around = graph.neighborhood(self._edges(valid_at, believed_at, predicates), start, hops)
        total = around.count()
        more = total > offset + limit
        token = base64.urlsafe_b64encode(json.dumps([asked, offset + limit]).encode()).decode() if more else None
        rows = around.join(names, "id").orderBy("hops", "canonical_name", "id").offset(offset).limit(limit)
        applied = {"hops": max(1, min(hops, graph.MAX_HOPS)), "returned": max(0, min(limit, total - offset)), "total": total, "exact": True}
        return Answer("entity", rows, valid_at=valid_at or self.now, believed_at=believed_at, truncated=more, continuation=token, applied=applied)

    def path(self, start: str, end: str, max_hops: int = 4, valid_at: str | None = None) -> Answer:
        rows = graph.path(self._edges(valid_at).withColumnRenamed("relation_id", "edge_id"), start, end, max_hops)
        return self._checked(Answer("entity", rows, valid_at=valid_at or self.now), "known_empty", "no path within the hops")

    def _checked(self, answer: Answer, kind: str, why: str) -> Answer:
        if answer.rows.isEmpty():
            answer.negative, answer.explanation = kind, why
        return answer

    def recipe(self, name: str, /, **arguments: Any) -> Answer:
        """The answer of a canonical recipe."""
        ops = {op: (lambda inputs, _f=getattr(self, op), **kw: _f(**kw)) for op in ("resolve", "lookup_relations", "lookup_observations", "search_claims", "hydrate_relation", "delta", "neighborhood", "path", "transcript", "pages_about")}
        ops |= {"fuse": self._fuse, "rerank": lambda inputs, **kw: self.rerank(inputs[0], **kw)}
        return recipes.run(recipes.seeds().latest(name), arguments, ops)

    def _fuse(self, inputs: list[Answer], k: int = ranking.RRF_K) -> Answer:
        from pyspark.sql import Window

        parts = None
        for i, a in enumerate(inputs):
            w = Window.orderBy(F.desc("score"), "claim_id")  # a limited ranking
            one = a.rows.select(F.lit(str(i)).alias("channel"), F.col("claim_id").alias("id"), F.row_number().over(w).alias("rank"))
            parts = one if parts is None else parts.unionByName(one)
        return Answer("evidence", ranking.fuse(parts, k))
