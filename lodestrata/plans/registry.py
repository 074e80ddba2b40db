"""Operators by name, user operators, and workflow graphs that are built lazily."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

from ..functions.values import Rejected
from ..operators import charts, cleaning, events, geo, glm, graph, ml, monitor, privacy, profile, project, quality, relational, sets, signals, stats, survival, text, timeseries, windows

KINDS = ("importer", "transform", "stat", "model", "chart")
REGISTRY: dict[str, Callable] = {}
_USER: dict[str, tuple[str, Callable]] = {}

for _module in (charts, cleaning, events, geo, glm, graph, ml, monitor, privacy, profile, project, quality, relational, sets, signals, stats, survival, text, timeseries, windows):
    for _name, _f in inspect.getmembers(_module, inspect.isfunction):
        if _f.__module__ == _module.__name__ and not _name.startswith("_"):
            REGISTRY[f"{_module.__name__.rsplit('.', 1)[1]}.{_name}"] = _f


def register(name: str, kind: str) -> Callable[[Callable], Callable]:
    """Decorator for an operator of one's own: a function from DataFrames to a DataFrame."""
    if kind not in KINDS:
        raise Rejected(kind)

    def add(f: Callable) -> Callable:
        if name in REGISTRY or name in _USER:
            raise Rejected(f"{name!r} is taken")
        _USER[name] = (kind, f)
        return f

    return add


def find(name: str) -> Callable:
    if name in REGISTRY:
        return REGISTRY[name]
    if name in _USER:
        return _USER[name][1]
    raise Rejected(f"no operator {name!r}")


def run(nodes: dict[str, dict], inputs: dict[str, DataFrame], limit: int = 24) -> dict[str, DataFrame]:
    """Results of a graph of nodes ``{op, inputs: [names], params: {}}``.

    Nodes are checked first (names, cycles, size), then built in order.  They
    are lazy: nothing is written between them, so plans fuse.
    """
    if len(nodes) > limit or set(nodes) & set(inputs):
        raise Rejected("too many nodes, or a name used twice")
    known = set(nodes) | set(inputs)
    for name, node in nodes.items():
        find(node["op"])
        if missing := set(node.get("inputs", ())) - known:
            raise Rejected(f"{name}: no {sorted(missing)}")
    try:
        order = list(TopologicalSorter({n: [i for i in node.get("inputs", ()) if i in nodes] for n, node in nodes.items()}).static_order())
    except CycleError as e:
        raise Rejected(f"a cycle: {e.args[1]}") from e
    done = dict(inputs)
    for name in order:
        node = nodes[name]
        done[name] = find(node["op"])(*[done[i] for i in node.get("inputs", ())], **node.get("params", {}))
    return {n: done[n] for n in nodes}


def replay(steps: list[dict], df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """A recipe (operators with parameters, one after the other) on other data; ``columns`` maps names that differ."""

    def mapped(x):
        if isinstance(x, str):
            return (columns or {}).get(x, x)
        if isinstance(x, dict):
            return {mapped(k): mapped(v) for k, v in x.items()}
        return type(x)(mapped(v) for v in x) if isinstance(x, (list, tuple)) else x

    for s in steps:
        df = find(s["op"])(df, **mapped(s.get("params", {})))
    return df
