"""Recipes: linted, typed chains of read primitives that compile to lazy DataFrames."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any


class RecipeError(ValueError):
    """A chain or an argument that the linter rejects."""


@dataclass(frozen=True)
class Op:
    grain: str
    filters_validity: bool = False


#: The twelve operations, what they return and whether they test valid time. Fixed values.
OPS = {
    "resolve": Op("entity"), "lookup_relations": Op("fact", True), "lookup_observations": Op("fact", True), "search_claims": Op("evidence"), "hydrate_relation": Op("evidence"),
    "transcript": Op("decision"), "fuse": Op("evidence"), "rerank": Op("evidence"), "delta": Op("change"), "pages_about": Op("page"), "neighborhood": Op("entity"), "path": Op("entity"),
}
#: Which columns of a step's result carry a ranking for fuse, in order of preference. Fixed values.
RANKED = ("ranking", "evidence", "facts", "entities", "nodes", "changes", "pages")


@dataclass(frozen=True)
class Param:
    name: str
    kind: str = "string"
    required: bool = True
    default: Any = None
    least: int | None = None
    most: int | None = None


@dataclass(frozen=True)
class Step:
    name: str
    op: str
    settings: dict = field(default_factory=dict)
    bind: dict = field(default_factory=dict)
    inputs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Recipe:
    name: str
    version: int
    grain: str
    intent: str
    steps: tuple[Step, ...]
    params: tuple[Param, ...] = ()


def lint(recipe: Recipe) -> None:
    """Raises for unknown operations, inputs that are no earlier step, a wrong final grain, unbound parameters and broken intents."""
    if not recipe.steps:
        raise RecipeError("a recipe needs a step")
    seen: set[str] = set()
    known = {p.name for p in recipe.params}
    for s in recipe.steps:
        if s.op not in OPS:
            raise RecipeError(f"unknown operation {s.op}")
        if s.name in seen:
            raise RecipeError(f"step {s.name} stands twice")
        if bad := [i for i in s.inputs if i not in seen]:
            raise RecipeError(f"{s.name} takes {bad[0]}, which is no earlier step")
        if bad := [v for v in s.bind.values() if v not in known]:
            raise RecipeError(f"{s.name} binds {bad[0]}, which is no parameter")
        if set(s.bind) & set(s.settings):
            raise RecipeError(f"{s.name} binds a frozen setting")
        seen.add(s.name)
    last = OPS[recipe.steps[-1].op]
    if last.grain != recipe.grain:
        raise RecipeError(f"it ends at the grain {last.grain}, not {recipe.grain}")
    ops = [s.op for s in recipe.steps]
    if recipe.intent == "current_facts" and not all(OPS[o].filters_validity and OPS[o].grain == "fact" for o in ops):
        raise RecipeError("current facts need validity-filtered fact steps only")
    if recipe.intent == "assertion_history" and last.grain != "evidence":
        raise RecipeError("an assertion history ends at evidence")
    if recipe.intent == "change_feed" and ops[-1] != "delta":
        raise RecipeError("a change feed ends on delta")
    if recipe.intent == "audit" and ops[-1] not in ("transcript", "hydrate_relation"):
        raise RecipeError("an audit ends on transcript or hydrate_relation")


def coerce(params: tuple[Param, ...], given: dict[str, Any]) -> dict[str, Any]:
    """Typed arguments; unknown, missing and out-of-range ones are errors, omitted optional ones stay out."""
    if unknown := set(given) - {p.name for p in params}:
        raise RecipeError(f"unknown argument {min(unknown)}")
    out: dict[str, Any] = {}
    for p in params:
        value = given.get(p.name, p.default)
        if value is None:
            if p.required:
                raise RecipeError(f"{p.name} is missing")
            continue
        try:
            value = {"string": str, "integer": int, "uuid": lambda v: str(uuid.UUID(str(v))), "timestamp": lambda v: datetime.fromisoformat(str(v)).isoformat(sep=" ")}[p.kind](value)
        except ValueError as e:
            raise RecipeError(f"{p.name} is no {p.kind}") from e
        if p.least is not None and value < p.least or p.most is not None and value > p.most:
            raise RecipeError(f"{p.name} must be between {p.least} and {p.most}")
        out[p.name] = value
    return out


class Registry:
    """Recipes by name and version; the latest version answers a name."""

    def __init__(self) -> None:
        self._all: dict[tuple[str, int], Recipe] = {}

    def register(self, recipe: Recipe) -> bool:
        """Lints and stores; a known (name, version) changes nothing and gives False."""
        lint(recipe)
        return self._all.setdefault((recipe.name, recipe.version), recipe) is recipe

    def latest(self, name: str) -> Recipe:
        found = [r for (n, _), r in self._all.items() if n == name]
        if not found:
            raise RecipeError(f"no recipe {name}")
        return max(found, key=lambda r: r.version)

    def names(self) -> list[str]:
        return sorted({n for n, _ in self._all})


def run(recipe: Recipe, arguments: dict[str, Any], operations: dict[str, Any]) -> Any:
    """The last step's result. ``operations[op](inputs, **kwargs)`` gives a lazy DataFrame; inputs are the earlier results a step names."""
    bound = coerce(recipe.params, arguments)
    results: dict[str, Any] = {}
    for s in recipe.steps:
        kwargs = dict(s.settings) | {k: bound[v] for k, v in s.bind.items() if v in bound}
        results[s.name] = operations[s.op]([results[i] for i in s.inputs], **kwargs)
    return results[recipe.steps[-1].name]


def descriptor(recipe: Recipe) -> dict:
    """The JSON Schema of a recipe as a tool."""
    kinds = {"string": {"type": "string"}, "integer": {"type": "integer"}, "uuid": {"type": "string", "format": "uuid"}, "timestamp": {"type": "string", "format": "date-time"}}
    props = {}
    for p in recipe.params:
        limits = {k: v for k, v in (("minimum", p.least), ("maximum", p.most), ("default", p.default)) if v is not None}
        props[p.name] = kinds[p.kind] | limits
    return {"name": recipe.name, "inputSchema": {"type": "object", "properties": props, "required": [p.name for p in recipe.params if p.required], "additionalProperties": False}}


def seeds() -> Registry:
    """The canonical recipes."""
    registry = Registry()
    entity, when, k = Param("entity_id"), Param("valid_at", "timestamp", required=False), Param("k", "integer", required=False, default=10, least=1, most=50)
    for r in (
        Recipe("resolve_entity", 1, "entity", "lookup", (Step("resolve", "resolve", bind={"name": "name", "entity_type": "entity_type"}),), (Param("name"), Param("entity_type", required=False))),
        Recipe("relation_current", 1, "fact", "current_facts", (Step("facts", "lookup_relations", bind={"subject": "entity_id", "predicate": "predicate", "valid_at": "valid_at"}),), (entity, Param("predicate", required=False), when)),
        Recipe("observation_current", 1, "fact", "current_facts", (Step("facts", "lookup_observations", bind={"entity": "entity_id", "valid_at": "valid_at"}),), (entity, when)),
        Recipe("entity_timeline", 1, "change", "change_feed", (Step("feed", "delta", bind={"since": "since"}),), (Param("since", "timestamp"),)),
        Recipe("claims_verbatim", 2, "evidence", "assertion_history", (Step("claims", "search_claims", bind={"text": "text", "k": "k"}),), (Param("text"), k)),
        Recipe("claims_hybrid_rrf", 2, "evidence", "assertion_history",
               (Step("a", "search_claims", {"channel": "words"}, {"text": "text", "k": "k"}), Step("b", "search_claims", {"channel": "trigrams"}, {"text": "text", "k": "k"}), Step("fused", "fuse", {"k": 60}, inputs=("a", "b"))), (Param("text"), k)),
        Recipe("explain", 1, "evidence", "audit", (Step("why", "hydrate_relation", bind={"relation_id": "relation_id"}),), (Param("relation_id"),)),
        Recipe("identity_as_of", 1, "decision", "audit", (Step("history", "transcript", {"kind": "entity"}, {"subject_id": "entity_id"}),), (entity,)),
        Recipe("changed_since", 1, "change", "change_feed", (Step("feed", "delta", bind={"since": "since", "limit": "limit"}),), (Param("since", "timestamp"), Param("limit", "integer", False, 500, 1, 5000))),
        Recipe("pages_about", 1, "page", "lookup", (Step("pages", "pages_about", {"key_kind": "entity"}, {"key_value": "entity_id"}),), (entity,)),
        Recipe("graph_neighborhood", 1, "entity", "lookup", (Step("near", "neighborhood", bind={"start": "entity_id", "hops": "hops", "limit": "limit"}),), (entity, Param("hops", "integer", False, 2, 1, 4), Param("limit", "integer", False, 30, 1, 50))),
        Recipe("graph_path", 1, "entity", "lookup", (Step("path", "path", bind={"start": "entity_id", "end": "to_id", "max_hops": "max_hops"}),), (entity, Param("to_id"), Param("max_hops", "integer", False, 4, 1, 6))),
    ):
        registry.register(r)
    return registry
