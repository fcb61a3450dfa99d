"""The whole chain: series -> components -> quality and graphs -> metrics, keyed by series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.core import cut
from tidegraph.operators import aggregates, decompose, graphs, metrics, reduce

GKEYS = ("series_id", "method", "component")


@dataclass(frozen=True)
class PanelConfig:
    method: str = "band"
    params: Mapping = field(default_factory=lambda: {"k": 5, "dc": 1})
    kinds: Sequence[str] = ("hvg", "nvg", "recurrence")
    tau_max: int = 50
    d_max: int = 10


def run_panel(series: DataFrame, config: PanelConfig = PanelConfig()) -> dict[str, DataFrame]:
    """Tables ``components``, ``quality``, ``nodes``, ``edges``, ``metrics`` for all series at once."""
    comps = cut(decompose.decompose(series, config.method, config.params))
    quality = aggregates.quality(comps, series)
    parts = comps.select(*GKEYS, "t", "x")
    nodes, edges, _ = graphs.all_graphs(parts, config.kinds, config.tau_max, config.d_max, keys=GKEYS)
    nodes, edges = cut(nodes), cut(edges)
    table = metrics.graph_metrics(nodes, edges, keys=(*GKEYS, "graph"))
    return {"components": comps, "quality": quality, "nodes": nodes, "edges": edges, "metrics": table}


def ica_panel(matrix: DataFrame, p: int, k: int, kinds: Sequence[str] = ("hvg", "nvg"), *, seed: int = 42, max_rounds: int = 200) -> DataFrame:
    """One row for each key of ``matrix`` (series_id, t, vec of p values), independent component and graph type: sizes and
    degrees of the graph, and whether the components converged."""
    keys = ("series_id", "component")
    model = reduce.ica_model(matrix, p, k, seed=seed, max_rounds=max_rounds)
    channels = cut(reduce.as_components(reduce.transform(matrix, model, p, k)).select(*keys, "t", "x"))
    nodes, edges, _ = graphs.all_graphs(channels, kinds, keys=keys)
    nodes, edges = cut(nodes.drop("features")), cut(edges)
    table = metrics.size_metrics(nodes, edges, keys=(*keys, "graph")).join(metrics.degree_metrics(nodes, edges, keys=(*keys, "graph")), [*keys, "graph"])
    return table.join(model.select("series_id", "converged"), "series_id")


def flagship(series: DataFrame) -> DataFrame:
    """Per series: volatility of returns and the structure of its horizontal visibility graph."""
    from tidegraph.operators.aggregates import price_summary

    nodes = graphs.visibility_nodes(series)
    edges = cut(graphs.horizontal_visibility(series))
    return (
        price_summary(series).select("series_id", "ret_mean", "ret_std", "vol_mean", "vol_max")
        .join(metrics.size_metrics(nodes, edges), "series_id")
        .join(metrics.degree_metrics(nodes, edges), "series_id")
        .select("*", (F.col("degree_max") - F.col("degree_min")).alias("degree_range"))
    )
