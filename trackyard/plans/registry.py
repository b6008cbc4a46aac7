"""Registry of named queries: a Spark builder and, where SQL can say it,
the equivalent DuckDB SQL over the same driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackyard.plans.rail_sql import with_rail
from trackyard.sources.tables import RailTables, rail


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def output(df: DataFrame) -> DataFrame:
    """Output edge: decimals leave as doubles (as the source's driver returns them)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, rail_sql: bool = True):
    """Register ``fn(t: RailTables) -> DataFrame`` under ``name``."""
    def deco(fn: Callable[[RailTables], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return output(fn(rail(spark, sf_dir)))
        full = None if sql is None else (with_rail(sql) if rail_sql else sql)
        REGISTRY[name] = Query(name, build, full, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the plan modules fills REGISTRY
    from trackyard.plans import (q_views, q_metrics, q_seats, q_mutate,  # noqa: F401
                                 q_quality, q_materialize, q_streaming)
    return REGISTRY
