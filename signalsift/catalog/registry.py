"""Registered queries: a name, a Spark plan, and the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsift.session import shared_folder

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def keep(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, because sums differ in the last bits between engines;
    adding 0 turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f.name)
            for f in df.schema
        ]
    )


def asked(ctes: str, body: str, doubles: Sequence[str] = (), others: Sequence[str] = (), digits: int = 6) -> str:
    """SQL text: ``body`` over common table expressions, doubles rounded."""
    cells = [f"round(CAST({c} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {c}" for c in doubles] + list(others)
    with_ = f"WITH {ctes} " if ctes else ""
    return f"{with_}SELECT {', '.join(cells)} FROM ({body}) AS answer"


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the shared checkpoint folder, for queries about sinks."""
    return shared_folder(spark, what)
