"""Query registry: a DataFrame builder and, where SQL can say it, its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[["Tables"], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SQL_VIEWS: dict[str, str] = {}
_SPARK_VIEWS: dict[str, Build] = {}


class Tables:
    """Lazy access to the input tables and to the views built on them."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self._memo: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in _SPARK_VIEWS:
            if name not in self._memo:
                self._memo[name] = _SPARK_VIEWS[name](self)
            return self._memo[name]
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")


def view(name: str, sql: str) -> Callable[[Build], Build]:
    """Register a view: Spark builder plus the same view as a SQL CTE body."""

    def add(fn: Build) -> Build:
        _SPARK_VIEWS[name] = fn
        SQL_VIEWS[name] = sql
        return fn

    return add


def sql_view(name: str, sql: str) -> None:
    """Register a view that only oracle SQL uses."""
    SQL_VIEWS[name] = sql


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs of every view it mentions, in order."""
    pool = {**SQL_VIEWS, **(extra or {})}
    order: list[str] = []

    seen: set[str] = set()

    def visit(text: str) -> None:
        for name, body in pool.items():
            if name not in seen and re.search(rf"(?<![.'])\b{name}\b", text):
                seen.add(name)
                visit(body)
                order.append(name)

    visit(sql)
    if not order:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({pool[n]})" for n in order) + "\n" + sql


def _nudge(n: int) -> float:
    """Moves exact decimal ties off the rounding edge, alike on both sides."""
    return 2.3e-3 * 10.0**-n


def query(name: str, cols: str, sql: str | None = None, **ctes: str) -> Callable[[Build], Build]:
    """Register a query.

    ``cols`` lists the output: ``name`` as is, ``name:r`` rounded to six places
    (``name:r2`` to two), ``name:i`` as BIGINT.  The same projection closes both sides.
    """
    items = [(c.split(":") + [""])[:2] for c in cols.split()]

    def add(fn: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, directory: str) -> DataFrame:
            df = fn(Tables(spark, directory))
            out = []
            for c, kind in items:
                if kind[:1] == "r":
                    n = int(kind[1:] or 6)
                    out.append((F.round(F.col(c).cast("double") + F.lit(_nudge(n)), n) + F.lit(0.0)).alias(c))
                elif kind == "i":
                    out.append(F.col(c).cast("bigint").alias(c))
                else:
                    out.append(F.col(c))
            return df.select(*out)

        QUERIES[name] = run
        if sql is not None:
            sel = []
            for c, kind in items:
                if kind[:1] == "r":
                    n = int(kind[1:] or 6)
                    sel.append(f"round(CAST({c} AS DOUBLE) + CAST({_nudge(n)!r} AS DOUBLE), {n}) + CAST(0 AS DOUBLE) AS {c}")
                elif kind == "i":
                    sel.append(f"CAST({c} AS BIGINT) AS {c}")
                else:
                    sel.append(c)
            ORACLES[name] = with_views(f"SELECT {', '.join(sel)} FROM ({sql})", ctes)
        return fn

    return add
