"""Registered queries: a builder over the Parquet tables and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from projectpulse.functions.scalars import rounded
from projectpulse.session import configure
from projectpulse.skew import spread

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[list[str], str]] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable[[Builder], Builder]:
    """Register a query; ``uses`` names the shared CTEs its SQL is written against."""

    def register(build: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(uses, sql)
        return build

    return register


def cte(name: str, body: str, uses: tuple[str, ...] = ()) -> None:
    CTES[name] = (list(uses), body)


def with_ctes(uses: tuple[str, ...], sql: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in CTES[name][0]:
            visit(other)
        ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return sql.strip()
    parts = ",\n".join(f"{name} AS ({CTES[name][1].strip()})" for name in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {parts},\n{body[len('WITH'):].strip()}"
    return f"WITH {parts}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, spread over the cores when its file is one scan task."""
    return spread(table(spark, sf_dir, name))


def ts_text(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_ts(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


def sql_round(expression: str, digits: int) -> str:
    """Half-up rounding after dropping float noise, as the library rounds."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Timestamps as text and doubles rounded, so that two engines can be compared."""
    columns = []
    for name, kind in df.dtypes:
        if kind in ("timestamp", "timestamp_ntz"):
            columns.append(ts_text(name).alias(name))
        elif kind == "date":
            columns.append(F.date_format(name, "yyyy-MM-dd").alias(name))
        elif kind == "double":
            columns.append(rounded(name, digits).alias(name))
        elif kind == "int":
            columns.append(F.col(name).cast("bigint").alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)
