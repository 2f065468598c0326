"""Helpers that the operators share: tables, materialised intermediates, let-binding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.scratch import Scratch, materialize, shared_dir

__all__ = ["Scratch", "beside", "let", "materialize", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(df: DataFrame, **columns: str) -> DataFrame:
    """The whole rows of df as the struct column ``row`` and beside it some of its columns under names of our
    own: whatever else df's columns are called can't clash with what an operator adds."""
    own = lambda c: F.col(f"`{c}`")
    return df.select(F.struct(*map(own, df.columns)).alias("row"), *[own(c).alias(name) for name, c in columns.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row.

    Inside a higher-order function Catalyst re-evaluates an outer expression for every element; a
    lambda variable bound to a one-element array is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
