"""Named series-to-graph transforms: ``name -> function(series) -> edges``. New graph types register here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidegraph.operators.graphs import horizontal_visibility, natural_visibility, recurrence_graph

Transform = Callable[..., DataFrame]
_GRAPHS: dict[str, Transform] = {
    "hvg": horizontal_visibility,
    "nvg": natural_visibility,
    "recurrence": lambda series, **kw: recurrence_graph(series, **kw)[1],
}


def register(name: str, transform: Transform) -> None:
    if name in _GRAPHS:
        raise ValueError(f"graph type {name} exists")
    _GRAPHS[name] = transform


def names() -> list[str]:
    return sorted(_GRAPHS)


def build(name: str, series: DataFrame, **kw) -> DataFrame:
    if name not in _GRAPHS:
        raise ValueError(f"unknown graph type {name}; known: {names()}")
    return _GRAPHS[name](series, **kw)
