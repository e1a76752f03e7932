"""Registered queries on the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog, categories, corrections, evidence, matching, projection, reads, replay, text
from .listings import ALL
from .oracles import ORACLES as _LISTINGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL} | catalog.QUERIES | categories.QUERIES | reads.QUERIES | text.QUERIES | projection.QUERIES | replay.QUERIES | evidence.QUERIES | matching.QUERIES | corrections.QUERIES
ORACLES: dict[str, str] = _LISTINGS | catalog.ORACLES | categories.ORACLES | reads.ORACLES | text.ORACLES | projection.ORACLES | replay.ORACLES | evidence.ORACLES | matching.ORACLES | corrections.ORACLES

__all__ = ["ORACLES", "QUERIES"]
