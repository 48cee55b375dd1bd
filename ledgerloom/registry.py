"""Name -> query and name -> SQL, over the tables of the fixture folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import evaluation_queries, experiment_queries, function_queries, sampling_queries, stage_queries, vote_queries

_MODULES = (vote_queries, evaluation_queries, sampling_queries, function_queries, stage_queries, experiment_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
