"""Event log as a stream: whitelisted, truncated, sampled, cut into sessions, deduplicated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = "t timestamp, kind string, detail string"
#: Kinds whose details may be longer than usual.
LONG_DETAIL = {"crash": 400, "previous_exit": 400, "error": 200, "upload_result": 200}
USUAL_DETAIL = 120


def accepted(log: DataFrame, kinds: list[str]) -> DataFrame:
    """Entries of known kinds, with details cut to their kind's length in code points."""
    length = F.lit(USUAL_DETAIL)
    for kind, n in LONG_DETAIL.items():
        length = F.when(F.col("kind") == kind, F.lit(n)).otherwise(length)
    return log.where(F.col("kind").isin(kinds)).withColumn("detail", F.substring("detail", F.lit(1), length))


def with_samples(log: DataFrame, kind: str = "upload_progress", sample: str = "mem") -> DataFrame:
    """Behind each entry of a kind a sample entry of the same time."""
    twin = F.struct("t", F.lit(sample).alias("kind"), F.lit(None).cast("string").alias("detail"))
    own = F.struct("t", "kind", "detail")
    return log.select(F.explode(F.when(F.col("kind") == kind, F.array(own, twin)).otherwise(F.array(own))).alias("e")).select("e.*")


def session_stream(log: DataFrame, key: str, time: str, kind: str, opens: str, quiet: str) -> DataFrame:
    """key, session, n_rows, abnormal: the state of each key's session after every batch, abnormal as long
    as its last entry isn't the quiet kind. Only the session's numbers are kept as state."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, rows, last = state.get if state.exists else (0, 0, "")
        entries = pd.concat(list(batches)).sort_values(time, kind="stable")
        for entry in entries[kind]:
            if entry == opens:
                session, rows = session + 1, 0
            rows, last = rows + 1, entry
        state.update((session, rows, last))
        yield pd.DataFrame({key: [k[0]], "session": [session], "n_rows": [rows], "abnormal": [last != quiet]})

    out = f"{key} {log.schema[key].dataType.simpleString()}, session long, n_rows long, abnormal boolean"
    return log.groupBy(key).applyInPandasWithState(fold, out, "session long, n_rows long, last string", "update", GroupStateTimeout.NoTimeout)


class _LastEntries(StatefulProcessor):
    """The last entries of a key as a list state; what is older leaves it."""

    def __init__(self, keep: int, out: str):
        self.keep, self.out = keep, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", LOG)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        old = list(self.kept.get()) if self.kept.exists() else []
        new = [tuple(r) for frame in rows for r in frame[["t", "kind", "detail"]].itertuples(index=False)]
        entries = sorted([*old, *new], key=lambda e: (pd.Timestamp(e[0]), *(str(x) for x in e[1:])))
        gone, entries = len(entries) - min(len(entries), self.keep), entries[-self.keep :]
        self.kept.put(entries)
        yield pd.DataFrame({self.out: [key[0]] * len(entries), "place": range(1, len(entries) + 1), "t": [pd.Timestamp(e[0]) for e in entries], "kind": [e[1] for e in entries], "detail": [e[2] for e in entries], "evicted": [gone] * len(entries)})

    def close(self) -> None:
        pass


def last_entries(log: DataFrame, key: str, keep: int = 200) -> DataFrame:
    """key, place, t, kind, detail, evicted: after every batch the last entries of each key that had new ones, oldest
    first, and how many left in this batch. The session needs the RocksDB state store provider."""
    out = f"{key} {log.schema[key].dataType.simpleString()}, place long, {LOG}, evicted long"
    return log.select(key, "t", "kind", "detail").groupBy(key).transformWithStateInPandas(_LastEntries(keep, key), out, "Update", "None")


def first_uploads(stream: DataFrame, time: str, content_hash: str, lateness: str = "1 day") -> DataFrame:
    """Uploads whose content wasn't seen within the lateness."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([content_hash])


def batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a step on each batch, in order, exactly once per batch number as far as the step is
    idempotent by it."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_retry(first: DataFrame, retry: DataFrame, key: str = "index") -> DataFrame:
    """Results of a batch after its failed items were tried again."""
    again = retry.select(key, F.struct(*[c for c in first.columns if c != key]).alias("_r"))
    return first.join(again, key, "left").select(key, *[F.coalesce(f"_r.{c}", c).alias(c) for c in first.columns if c != key])
