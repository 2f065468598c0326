"""Relational reads: roll-ups, lookups, anti-joins, ordered lists and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.text import ascii_nocase


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Rows with a key; none if there is none."""
    return df.where(F.col(key) == value)


def children_of(df: DataFrame, key: str, value, order: str) -> DataFrame:
    return df.where(F.col(key) == value).orderBy(order)


def activity_rollup(parents: DataFrame, children: DataFrame, key: str, child_key: str, counted: str, interaction: Column, at: str) -> DataFrame:
    """Parents with the number of their children and the time of the last interaction. Children are
    aggregated before the join, so that it moves a row per parent only."""
    totals = children.groupBy(F.col(child_key).alias(key)).agg(F.count(counted).alias("observation_count"), F.max(F.when(interaction, F.col(at))).alias("last_interaction_at"))
    joined = parents.join(totals, key, "left")
    return joined.withColumn("observation_count", F.coalesce("observation_count", F.lit(0)))


def newest_by_hash(df: DataFrame, text: str, id_: str) -> DataFrame:
    """Content hash, newest id with it, and how many share it."""
    return df.groupBy(F.sha2(F.col(text), 256).alias("sha256")).agg(F.max(id_).alias("newest_id"), F.count(F.lit(1)).alias("copies"))


def missing_in(df: DataFrame, other: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.join(other.select(key), key, "left_anti")


def summaries(df: DataFrame, id_: str, name: str, columns: list[str]) -> DataFrame:
    """Chosen columns, by name (A-Z and a-z alike), then id."""
    return df.select(*columns, ascii_nocase(F.col(name)).alias("sort_name")).orderBy("sort_name", id_)


def same_or_both_null(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).eqNullSafe(F.col(b)))


def priority_order(df: DataFrame, column: str, order: list[str], then: str, out: str = "priority") -> DataFrame:
    """Rows by the place of a value in a list (unknown ones last), then by a column."""
    rank = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        rank = F.when(F.col(column) == v, F.lit(i)).otherwise(rank)
    return df.withColumn(out, rank).orderBy(out, then)


def integrity_report(child: DataFrame, parent: DataFrame, fk: str, pk: str, enum: str, allowed: list[str]) -> DataFrame:
    """Rows that break the foreign key, and rows whose value isn't allowed, as (check, violations)."""
    keys = parent.select(F.col(pk).alias(fk)).distinct()
    orphans = child.where(F.col(fk).isNotNull()).join(keys, fk, "left_anti")
    first = orphans.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("foreign_key").alias("check"), "violations")
    second = child.agg(F.count_if(~F.col(enum).isin(allowed) | F.col(enum).isNull()).alias("violations")).select(F.lit("enum").alias("check"), "violations")
    return first.unionByName(second)


def safe_ids(df: DataFrame, raw: str) -> DataFrame:
    """Rows whose text is a positive integer below 2^53."""
    value = F.col(raw).try_cast("long")
    return df.withColumn("id", value).where((value > 0) & (value < 2**53))
