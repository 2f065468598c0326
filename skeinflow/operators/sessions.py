"""Window-shaped operators over logs and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.operators import scan


def sessions(log: DataFrame, key: str, order: list[str], opens: Column, out: str = "session") -> DataFrame:
    """Numbers sessions: each marker opens one; what comes before the first is session 0."""
    return scan.running(scan.in_ranges(log, [key], order), [key], order, F.when(opens, 1).otherwise(0), out).drop("_range")


def session_tail(log: DataFrame, key: str, order: list[str], opens: Column, quiet: Column) -> DataFrame:
    """Per key the last session: its number, its rows, and whether it ended without a quiet last row."""
    numbered = sessions(log, key, order, opens).withColumn("_quiet", quiet)
    ends = numbered.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.struct(*order, "_quiet")).alias("_last"))
    last = ends.groupBy(key).agg(F.max(F.struct("session", "n_rows", "_last")).alias("_s"))
    return last.select(key, F.col("_s.session").alias("session"), F.col("_s.n_rows").alias("n_rows"), (~F.col("_s._last._quiet")).alias("abnormal"))


def gap_groups(df: DataFrame, key: str, order: list[str], gap: Column, limit: float, out: str = "gap_group") -> DataFrame:
    """A new group starts where the gap to the row before reaches the limit. ``gap`` may use ``_prev``,
    the row before."""
    dealt = scan.previous(scan.in_ranges(df, [key], order), [key], order, df.columns, "_prev")
    new = F.when(gap >= limit, 1).otherwise(0)
    return scan.running(dealt, [key], order, new, out).drop("_prev", "_range")


def newest(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The newest k rows of the whole table; a sort with limit keeps k rows per task."""
    return df.orderBy(*order).limit(k)


def sticky_flag(log: DataFrame, key: str, order: list[str], raises: Column, clears: Column, out: str = "flag") -> DataFrame:
    """Whether something failed since the last row that clears (which counts as cleared itself)."""
    dealt = scan.in_ranges(log, [key], order).withColumn("_raise", F.when(raises, 1).otherwise(0))
    raised = scan.running(dealt, [key], order, F.col("_raise"), "_raised")
    # what had been raised before the last row that clears
    before = F.when(clears, F.col("_raised") - F.col("_raise")).otherwise(0)
    rows = scan.running(raised, [key], order, before, "_cleared", "max")
    return rows.withColumn(out, F.col("_raised") > F.col("_cleared")).drop("_raise", "_raised", "_cleared", "_range")


def slot_reorder(df: DataFrame, key: str, slot: str, placed: Column, geometry: list[str]) -> DataFrame:
    """Rows with a place exchange slots so that they stand in geometric order; the others keep theirs."""
    rows = df.withColumn("_placed", placed)
    by_slot = Window.partitionBy(key, "_placed").orderBy(slot)
    by_place = Window.partitionBy(key, "_placed").orderBy(*geometry, slot)
    ranked = rows.withColumns({"_s": F.row_number().over(by_slot), "_g": F.row_number().over(by_place)})
    slots = ranked.select(key, "_placed", F.col("_s").alias("_g"), F.col(slot).alias("new_slot"))
    moved = ranked.join(slots, [key, "_placed", "_g"])
    return moved.withColumn("new_slot", F.when(F.col("_placed"), F.col("new_slot")).otherwise(F.col(slot))).drop("_placed", "_s", "_g")
