"""Keep-first and merge aggregations. All combine on the map side; none depends on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.text import distinct_strings, trimmed


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, which should be unique within the key."""
    row = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select("_row.*")


def keep_first_shortest(df: DataFrame, keys: list[str], order: str, quote: str) -> DataFrame:
    """Per key the first row's order value and the shortest quote (the earliest of equals)."""
    return df.groupBy(*keys).agg(F.min(order).alias(order), F.min_by(quote, F.struct(F.length(quote), order)).alias(quote))


def ordered_join(df: DataFrame, keys: list[str], order: list[str], value: str, separator: str = "\n\n", out: str = "joined") -> DataFrame:
    """Distinct trimmed values of a key in order, joined."""
    rows = F.sort_array(F.collect_list(F.struct(*order, value)))
    return df.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.array_join(distinct_strings(F.col(f"_rows.{value}")), separator).alias(out))


def highest_confidence(df: DataFrame, keys: list[str], confidence: str, out: str = "confidence") -> DataFrame:
    """high if any is high, else medium if any is medium, else low."""
    rank = F.max(F.when(F.col(confidence) == "high", 2).when(F.col(confidence) == "medium", 1).otherwise(0))
    return df.groupBy(*keys).agg(rank.alias("_r")).select(*keys, F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("_r") + 1).alias(out))


def mode_peak(df: DataFrame, keys: list[str], value: str, first: str, out: str = "peak") -> DataFrame:
    """The commonest value of a key; of equals the one seen first by ``first``."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(first).alias("_first"))
    return counts.groupBy(*keys).agg(F.min_by(F.struct(value, "_n"), F.struct(-F.col("_n"), F.col("_first"), F.col(value))).alias("_p")).select(*keys, F.col(f"_p.{value}").alias(out), F.col("_p._n").alias("votes"))


def share_over(df: DataFrame, keys: list[str], hit: Column, limit: float, out: str = "flagged") -> DataFrame:
    """Whether the share of rows with ``hit`` exceeds the limit; unknown counts below the line only."""
    return df.groupBy(*keys).agg((F.count_if(hit) / F.count(F.lit(1))).alias("share")).withColumn(out, F.col("share") > limit)


def guarded_median(df: DataFrame, keys: list[str], value: str, bright: Column, least: int, out: str = "median") -> DataFrame:
    """Exact median of the bright values if there are enough of them, else of all."""
    enough = F.count_if(bright) >= least
    return df.groupBy(*keys).agg(F.count_if(bright).alias("n_bright"), F.when(enough, F.median(F.when(bright, F.col(value)))).otherwise(F.median(value)).alias(out))


def batch_status(df: DataFrame, keys: list[str], ok: Column, failed: Column) -> DataFrame:
    """Counts of a batch, and success, failed or partial_success."""
    counted = df.groupBy(*keys).agg(F.count_if(ok).alias("n_ok"), F.count_if(failed).alias("n_failed"))
    return counted.withColumn("status", F.when(F.col("n_failed") == 0, "success").when(F.col("n_ok") == 0, "failed").otherwise("partial_success"))


def consensus(df: DataFrame, keys: list[str], agrees: Column, target: str, out: str = "target") -> DataFrame:
    """The one target that all rows of a key agree on, else null."""
    one = F.bool_and(F.coalesce(agrees, F.lit(False))) & (F.count_distinct(target) == 1) & (F.count(target) == F.count(F.lit(1)))
    return df.groupBy(*keys).agg(F.when(one, F.min(target)).alias(out))


def set_consensus(df: DataFrame, keys: list[str], ids: str, out: str = "ids") -> DataFrame:
    """The set of ids that all rows of a key agree on, whatever its order, else null; a row without one (null)
    agrees with nothing."""
    sets = F.array_sort(F.array_distinct(ids))
    one = (F.count_distinct(sets) == 1) & (F.count(ids) == F.count(F.lit(1)))
    return df.groupBy(*keys).agg(F.when(one, F.min(sets)).alias(out))


def affected(df: DataFrame, keys: list[str], ids: str, out: str = "affected") -> DataFrame:
    """The distinct ids of all arrays of a key, ascending."""
    found = df.select(*keys, F.explode(ids).alias("_id")).distinct()
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list("_id")).alias(out))


def last_writer(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Per field the last value that isn't blank."""
    last = [F.max_by(trimmed(F.col(f)), F.when(trimmed(F.col(f)) != "", F.struct(*order))).alias(f) for f in fields]
    return df.groupBy(*keys).agg(*last)


def merged_evidence(df: DataFrame, key: str, order: str, quotes: str) -> DataFrame:
    """Union of the quotes of a key, in order, and the last order value."""
    rows = F.sort_array(F.collect_list(F.struct(order, quotes)))
    return df.groupBy(key).agg(F.max(order).alias(order), F.array_distinct(F.flatten(rows[quotes])).alias(quotes))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark limits each group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
