"""Reproducible shuffle and sharding by a Feistel permutation over global row numbers, in DataFrame
functions only.

Rows get gapless numbers without a total sort: a hash of the row's content deals them into buckets (1024,
or as many as keep about BUCKET_ROWS in each), the bucket counts give each bucket its offset,
and a row number inside the bucket does the rest. All of it depends on content alone, so a task that
runs again after a lost executor gives the same numbers. A keyed Feistel network over Z_a x Z_b with
a * b just above the number of rows permutes the numbers; what leaves the range walks its cycle until
it is back. Shard and slot are the rest and the quotient of the permuted number: shard sizes in rows
differ by one at most (law ``rows``).

Cases: a null text has no bytes (size 1, CRC 0); a null id is a value of its own; repeated rows, equal
in all that is numbered, are interchangeable and each gets its own slot; an empty table gives an empty
result; no text travels, only its size and CRC. The result has only its own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.llm.common import let

ROUNDS = 6
BUCKET_ROWS = 1_000_000
#: Steps of a cycle walk. Fewer than sqrt(rows) numbers lie outside the range, so a walk of k steps
#: has a chance of rows^(-k/2); a longer one fails loudly.
WALK = 32


def feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the network: a bijection of 0 .. a*b-1."""
    mixed = lambda v, r: F.xxhash64(v, r, F.lit(seed))
    left = lambda s, r: F.pmod(s["l"] + F.pmod(mixed(s["r"], r), a), a)
    right = lambda s, r: F.pmod(s["r"] + F.pmod(mixed(s["l"], r), b), b)
    turn = lambda s, r: F.when(r % 2 == 0, F.struct(left(s, r).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), right(s, r).alias("r")))
    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def permuted(x: Column, rows: Column, a: Column, b: Column, seed: int) -> Column:
    """The place of row number x among ``rows`` rows."""
    walk = lambda y, _: F.when(y < rows, y).otherwise(feistel(y, a, b, seed))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(x, a, b, seed), walk)
    return let(walked, lambda y: F.when(y < rows, y).otherwise(F.raise_error(F.lit("cycle walk too long: use another seed")).cast("long")))


def row_numbers(df: DataFrame, by: list[str], buckets: int | None = None) -> DataFrame:
    """df with ``row_no``, gapless from 0, and ``rows``, by content alone. The number of buckets follows the
    number of rows; equal rows, however many, share one."""
    buckets = buckets or max(1024, df.count() // BUCKET_ROWS)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)))
    counts = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # at most `buckets` rows from here
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("rows"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*by)).cast("long")
    return dealt.withColumn("_inside", inside).join(F.broadcast(offsets), "_bucket").withColumn("row_no", F.col("_offset") + F.col("_inside") - 1).drop("_bucket", "_inside", "_offset")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 20_24, buckets: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is ``rows``)."""
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
    )
    numbered = row_numbers(sized, ["doc_id", "size", "text_crc32"], buckets)
    numbered = numbered.withColumn("_a", F.ceil(F.sqrt(F.col("rows"))).cast("long"))
    numbered = numbered.withColumn("_b", F.ceil(F.col("rows") / F.col("_a")).cast("long"))
    placed = numbered.withColumn("_place", permuted(F.col("row_no"), F.col("rows"), F.col("_a"), F.col("_b"), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
