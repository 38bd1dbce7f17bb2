"""Registered queries: each binds operators to the given tables, next to its DuckDB SQL."""

from . import (  # noqa: F401
    datasets, evaluations, features, functions, grids, landing, packs, quality, seasons, stations, streams, tables, texts,
)
from .base import ORACLES, QUERIES  # noqa: F401
