"""Registered queries: each operator applied to the fixture tables, with its DuckDB SQL."""

from quern.queries import collection, datasets, environment, episodes, incremental, metrics, relational, retrieval, scoring, storage, trajectories  # noqa: F401
from quern.queries.base import REGISTRY, SQL


def queries():
    return dict(REGISTRY)


def oracle_sql():
    return dict(SQL)
