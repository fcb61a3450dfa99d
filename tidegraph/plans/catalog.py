"""All registered queries and their SQL."""

from __future__ import annotations

from tidegraph.plans import queries_components as components
from tidegraph.plans import queries_files as files
from tidegraph.plans import queries_graphs as graphs
from tidegraph.plans import queries_series as series
from tidegraph.plans import queries_tests as tests

QUERIES = {**series.QUERIES, **tests.QUERIES, **components.QUERIES, **graphs.QUERIES, **files.QUERIES}
SQL = {**series.SQL, **tests.SQL, **components.SQL, **graphs.SQL, **files.SQL}
