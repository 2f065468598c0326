"""Running values per key that don't need a key's rows in one task: a segmented prefix scan.

Rows are dealt to ranges of (key, order), so a key with many rows fills many ranges, each of bounded size. A
window runs within each part of a key; what the parts before add up to is one row per key and range, and joins
back by key and range. A key that holds the whole table runs in all tasks.

Orders should be unique within a key. Rows with a null key form a key of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.scratch import materialize

#: How running values of parts combine.
COMBINE: dict[str, Callable[[Column, Column], Column]] = {"sum": lambda a, b: a + b, "max": F.greatest}


def in_ranges(df: DataFrame, key: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """df, written, with ``_range``: the number of its range of (key, order); later rows of a key are in the same
    or a later range."""
    columns = [*key, *order]
    dealt = df.repartitionByRange(ranges, *columns) if ranges else df.repartitionByRange(*columns)
    return materialize(dealt.withColumn("_range", F.spark_partition_id()))


def joined_by_part(df: DataFrame, parts: DataFrame, key: list[str]) -> DataFrame:
    """df with the other columns of parts, of the same key (null is one) and range."""
    other = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_range").alias("_r"), *[c for c in parts.columns if c not in (*key, "_range")])
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(other, same, "left").drop("_r", *[f"_k{i}" for i in range(len(key))])


def running(dealt: DataFrame, key: list[str], order: list[str], value: Column, out: str, how: str = "sum") -> DataFrame:
    """dealt (``in_ranges``) with the running sum or maximum of a value that is never null."""
    agg, both = getattr(F, how), COMBINE[how]
    rows = dealt.withColumn("_v", value)
    w = Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*key, "_range").agg(agg("_v").alias("_t")).withColumn("_before", agg("_t").over(earlier)).drop("_t")
    found = joined_by_part(rows.withColumn("_own", agg("_v").over(w)), before, key)
    return found.withColumn(out, F.coalesce(both(F.col("_own"), F.col("_before")), "_own")).drop("_v", "_own", "_before")


def previous(dealt: DataFrame, key: list[str], order: list[str], columns: list[str], out: str) -> DataFrame:
    """dealt (``in_ranges``) with the struct of columns of the row before, of the key's first row null."""
    row = F.struct(*columns)
    w = Window.partitionBy(*key, "_range").orderBy(*order)
    last = dealt.groupBy(*key, "_range").agg(F.max_by(row, F.struct(*order)).alias("_l"))
    last = last.withColumn("_before", F.lag("_l").over(Window.partitionBy(*key).orderBy("_range"))).drop("_l")
    found = joined_by_part(dealt.withColumn("_own", F.lag(row).over(w)), last, key)
    return found.withColumn(out, F.coalesce("_own", "_before")).drop("_own", "_before")


def composed(dealt: DataFrame, key: list[str], order: list[str], action: str, legal: dict[tuple[str, str], str], start: str) -> DataFrame:
    """key, status, n_events of a state machine: a legal action moves the state, others leave it.

    An action is a map from states to states, and maps compose: each part of a key becomes the map of all its
    actions in order, the parts' maps are composed in the order of ranges."""
    states = list(dict.fromkeys([start, *[s for s, _ in legal], *legal.values()]))
    number = {s: i for i, s in enumerate(states)}
    move = lambda s, a: F.coalesce(F.element_at(moves, F.concat_ws("\t", s.cast("string"), a)), s)
    moves = F.create_map(*[F.lit(x) for (s, a), t in legal.items() for x in (f"{number[s]}\t{a}", number[t])]) if legal else F.create_map().cast("map<string,int>")
    acts = dealt.groupBy(*key, "_range").agg(F.sort_array(F.collect_list(F.struct(*order, action))).alias("_a"))
    of = F.array(*[F.aggregate("_a", F.lit(i), lambda s, a: move(s, a[action])) for i in range(len(states))])
    maps = acts.select(*key, "_range", of.alias("_m"), F.size("_a").cast("long").alias("_n"))
    parts = maps.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_range", "_m"))).alias("_p"), F.sum("_n").alias("n_events"))
    end = F.aggregate("_p", F.lit(0), lambda s, p: F.get(p["_m"], s))
    return parts.select(*key, F.get(F.array(*[F.lit(s) for s in states]), end).alias("status"), "n_events")
