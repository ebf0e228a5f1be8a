"""Query registration: a builder over the stand-in dataset plus, where it exists, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tallycell.functions.numeric import rounded
from tallycell.plans.standin import Standin

Builder = Callable[[Standin], DataFrame]
_BUILDERS: dict[str, Builder] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register ``fn(standin) -> DataFrame`` under ``name``."""
    def keep(fn: Builder) -> Builder:
        if name in _BUILDERS:
            raise ValueError(f"query {name} registered twice")
        _BUILDERS[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return keep


def six(df: DataFrame) -> DataFrame:
    """Round every floating column to six places."""
    return df.select(*[rounded(f.name).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
                       else F.col(f.name) for f in df.schema.fields])


def _bind(fn: Builder) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Standin(spark, sf_dir))


def _load() -> None:
    from tallycell.plans import catalog
    catalog.load()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _bind(fn) for name, fn in _BUILDERS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
