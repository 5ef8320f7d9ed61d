"""User rules: a graph of typed nodes, checked, then compiled to column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text

Compiler = Callable[[dict, list[Column]], Column]
#: Node type to a function of its parameters and its parents' columns. Add a type here to extend the rules.
TYPES: dict[str, Compiler] = {
    "source": lambda p, up: F.coalesce(F.col(p.get("field", "kind")).isin(*p["kinds"]), F.lit(False)),
    "filter": lambda p, up: _all(up) & text.ops(p["op"], F.col(p["field"]), F.lit(p.get("value"))),
    "and": lambda p, up: _all(up),
    "or": lambda p, up: _any(up),
    "near": lambda p, up: _all(up) & F.coalesce(F.col(p["flag"]), F.lit(False)),
    "alert": lambda p, up: _all(up),
}


def _all(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def validate(graph: dict) -> list[str]:
    """Node ids in an order in which parents come first. Raises ValueError on a graph that can't run."""
    nodes = {n["id"]: n for n in graph["nodes"]}
    kinds = [n["type"] for n in nodes.values()]
    if unknown := set(kinds) - set(TYPES):
        raise ValueError(f"unknown node types: {sorted(unknown)}")
    if kinds.count("source") != 1:
        raise ValueError("a rule has one source")
    if "alert" not in kinds:
        raise ValueError("a rule has an alert")
    parents: dict[str, set[str]] = {n: set() for n in nodes}
    for a, b in graph["edges"]:
        if a not in nodes or b not in nodes:
            raise ValueError(f"an edge leads nowhere: {a} to {b}")
        parents[b].add(a)
    order: list[str] = []
    while len(order) < len(nodes):
        ready = [n for n in nodes if n not in order and parents[n] <= set(order)]
        if not ready:
            raise ValueError("a rule has no cycles")
        order += ready
    return order


def compile_rule(graph: dict) -> dict[str, Column]:
    """A truth column for each node; every node but the source also needs the source."""
    nodes = {n["id"]: n for n in graph["nodes"]}
    made: dict[str, Column] = {}
    for n in validate(graph):
        up = [made[a] for a, b in graph["edges"] if b == n]
        made[n] = TYPES[nodes[n]["type"]](nodes[n].get("params", {}), up)
    source = made[next(n for n in nodes if nodes[n]["type"] == "source")]
    return {n: c if nodes[n]["type"] == "source" else source & c for n, c in made.items()}


def evaluate(df: DataFrame, graph: dict) -> DataFrame:
    """df with a column pass_<node> for each node, in one projection."""
    if not graph.get("enabled", True):
        return df.select("*", *(F.lit(False).alias(f"pass_{n['id']}") for n in graph["nodes"]))
    return df.select("*", *(c.alias(f"pass_{n}") for n, c in compile_rule(graph).items()))


def counters(df: DataFrame, graph: dict, by: tuple[str, ...] = ()) -> DataFrame:
    """How many rows passed each node, in one aggregate; for each entity if keys are given."""
    ids = [n["id"] for n in graph["nodes"]]
    return evaluate(df, graph).groupBy(*by).agg(*(F.count_if(F.col(f"pass_{n}")).alias(n) for n in ids))
