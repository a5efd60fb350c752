"""Registered queries: name -> (Spark job over the given tables, SQL counterpart or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Job], Job]:
    def keep(job: Job) -> Job:
        QUERIES[name] = job
        if oracle is not None:
            ORACLES[name] = oracle
        return job

    return keep


def load() -> None:
    """Import the modules that register queries."""
    from . import (  # noqa: F401
        answer_queries,
        feature_queries,
        io_queries,
        label_queries,
        metric_queries,
        model_queries,
        outline_queries,
        workflow_queries,
    )
