"""Writes as folds: each makes a new snapshot from an old one and a table of changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.text import trimmed
from skeinflow.operators import scan


def changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new) of the fields that differ, null-safe, as text."""
    o = old.select(key, *[F.col(f).cast("string").alias(f"_o_{f}") for f in fields])
    n = new.select(key, *[F.col(f).cast("string").alias(f"_n_{f}") for f in fields])
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_o_{f}").alias("old"), F.col(f"_n_{f}").alias("new")) for f in fields])
    changed = F.filter(entries, lambda e: ~e["old"].eqNullSafe(e["new"]))
    return o.join(n, key).select(key, F.explode(changed).alias("_c")).select(key, "_c.field", "_c.old", "_c.new")


def appended(current: Column, added: Column, separator: str = "；") -> Column:
    """Agenda with the fragments that it doesn't hold yet; fragments end at semicolons or newlines."""
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[；;\n]"), lambda x: trimmed(x)), lambda x: x != "")
    return F.array_join(F.array_distinct(F.concat(split(current), split(added))), separator)


def rebased(base: Column, current: Column, wanted: Column) -> Column:
    """Three-way rebase: what was wanted, if nothing changed meanwhile; else the current text with the
    fragments that were added."""
    return F.when(current.eqNullSafe(base), wanted).otherwise(appended(current, wanted))


def folded_status(events: DataFrame, key: str, order: list[str], action: str, legal: dict[tuple[str, str], str], start: str) -> DataFrame:
    """State machine per key: each action moves the state if the pair (state, action) is legal, else it is
    ignored. n_events: how many there were."""
    return scan.composed(scan.in_ranges(events.select(key, *order, action), [key], order), [key], order, action, legal, start)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows take the place of all old rows of their keys; other keys stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def overlaid(base: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """Rows of base, each replaced by the latest version if there is one."""
    fields = [c for c in base.columns if c != key]
    found = latest.select(key, F.struct(*fields).alias("_new"))
    return base.join(found, key, "left").select(key, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def upserted(versions: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The latest version of each key."""
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in versions.columns if c not in keys]), F.struct(*version)).alias("_v")).select(*keys, "_v.*")


def without(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Cascade: each table without the rows whose key is gone."""
    return {name: df.join(gone.select(F.col(key).alias(fk)).distinct(), fk, "left_anti") for name, (df, fk) in tables.items()}


def without_participant(participants: Column, contact_id: Column) -> Column:
    return F.filter(participants, lambda p: ~p["contact_id"].eqNullSafe(contact_id))


def merged_participants(existing: Column, incoming: Column) -> Column:
    """Existing participants, replaced by incoming ones of the same id (or, without both ids, name), then
    the incoming ones that are new."""
    same = lambda a, b: F.when(a["contact_id"].isNotNull() & b["contact_id"].isNotNull(), a["contact_id"] == b["contact_id"]).otherwise(a["name"] == b["name"])
    kept = F.transform(existing, lambda e: F.coalesce(F.get(F.filter(incoming, lambda i: same(e, i)), F.lit(0)), e))
    return F.concat(kept, F.filter(incoming, lambda i: ~F.exists(existing, lambda e: same(e, i))))


def patched(df: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Edits by presence flags: a field changes where its ``has_`` flag is set, also to null."""
    p = patch.select(key, *[F.col(f).alias(f"_p_{f}") for f in fields], *[F.col(f"has_{f}").alias(f"_h_{f}") for f in fields])
    joined = df.join(p, key, "left")
    edits = {f: F.when(F.coalesce(F.col(f"_h_{f}"), F.lit(False)), F.col(f"_p_{f}")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(edits).select(*df.columns)


def backfilled(known: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Known rows, and of the wanted ones those whose key is missing."""
    return known.unionByName(wanted.join(known.select(key), key, "left_anti"))


def newest_first(batches: list[DataFrame], key: str, position: str) -> DataFrame:
    """Lists merged by key: of a key the row of the first list, there the first row."""
    tagged = reduce(DataFrame.unionByName, [df.withColumn("_list", F.lit(i)) for i, df in enumerate(batches)])
    w = Window.partitionBy(key).orderBy("_list", position)
    return tagged.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_list")
