"""Named user programs over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

_JOBS: dict[str, Callable[..., DataFrame]] = {}


def register_job(name: str, job: Callable[..., DataFrame]) -> None:
    """A program from DataFrames to a DataFrame, to be run by name."""
    _JOBS[name] = job


def run_job(name: str, *tables: DataFrame, **settings) -> DataFrame:
    return _JOBS[name](*tables, **settings)
