"""Every registered query over the given tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelquarry.plans import answers, language, pictures, projection, records, scenes, spectral

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (spectral, scenes, language, answers, records, projection, pictures)


def queries() -> dict[str, Query]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in m.SQL.items()}
