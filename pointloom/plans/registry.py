"""Where queries and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The views and tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(name: str) -> Column:
    """A double rounded so that the order of sums doesn't show, and without negative zero."""
    return (F.round(F.col(name), 6) + F.lit(0.0)).alias(name)


def sql6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0e0 AS {name}"


def r9(name: str) -> Column:
    """As r6, for means and variances of whole millimetres, whose ties at six places are exact."""
    return (F.round(F.col(name), 9) + F.lit(0.0)).alias(name)


def sql9(expr: str, name: str) -> str:
    return f"round({expr}, 9) + 0e0 AS {name}"


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def whole(name: str) -> Column:
    return F.col(name).cast("int").alias(name)
