"""Batches of evidence before confirmation: pending people under negative ids, deferred dependencies,
merges into the first card of a person, duplicates and lineage."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.text import norm_compare
from skeinflow.scratch import materialize

DEPENDENCY = "array<struct<kind:string,anchor_card_id:bigint,participant_index:int,candidate_index:int>>"


def anchors(cards: DataFrame, batch: str = "batch", order: str = "id") -> DataFrame:
    """cards with ``anchor``: of create cards of one name in a batch the first is the anchor; a later one
    names it, the first names itself."""
    w = Window.partitionBy(batch, "_n").orderBy(order)
    rows = cards.withColumn("_n", norm_compare(F.col("name")))
    return rows.withColumn("anchor", F.first(order).over(w)).drop("_n")


def resolved_anchors(dependencies: DataFrame, cards: DataFrame) -> DataFrame:
    """dependencies (card_id, anchor_card_id) with ``contact_id``: of a confirmed anchor its contact, of a
    pending one its negative card id, else null."""
    at = cards.select(F.col("id").alias("anchor_card_id"), F.col("status").alias("_s"), "resolved_contact_id")
    found = F.when(F.col("_s") == "confirmed", F.col("resolved_contact_id")).when(F.col("_s") == "pending", -F.col("anchor_card_id"))
    return dependencies.join(at, "anchor_card_id", "left").withColumn("contact_id", found).drop("_s", "resolved_contact_id")


def confirmed_in_order(cards: DataFrame, needs: DataFrame) -> DataFrame:
    """card_id, round, outcome of cards (card_id, failed) that need others (card_id, needs) before them.

    A card is confirmed in the round after the last card that it needs; ``failed`` ones fail by themselves. What
    needs a card that failed, or that isn't there, gets ``dependency``, and so does all that needs it in turn; what
    waits for itself gets ``cycle``. Each round is written; there are as many as the longest chain has cards."""
    cards, edges = materialize(cards.select("card_id", "failed").dropDuplicates(["card_id"])), materialize(needs.select("card_id", "needs").distinct())
    done = cards.limit(0).select("card_id", F.lit(0).alias("round"), F.lit("").alias("outcome"))
    for no in count():
        open_ = cards.join(done, "card_id", "left_anti")
        state = edges.join(cards.select(F.col("card_id").alias("needs"), F.lit(True).alias("_there")), "needs", "left").join(done.select(F.col("card_id").alias("needs"), F.col("outcome").alias("_o")), "needs", "left")
        bad = F.col("_there").isNull() | F.coalesce(F.col("_o") != "confirmed", F.lit(False))
        met = state.groupBy("card_id").agg(F.bool_or(bad).alias("_bad"), F.bool_and(F.coalesce(F.col("_o") == "confirmed", F.lit(False))).alias("_met"))
        verdict = F.when(F.col("failed"), "failed").when(F.col("_bad"), "dependency").when(F.coalesce("_met", F.lit(True)), "confirmed")
        now = materialize(open_.join(met, "card_id", "left").select("card_id", F.lit(no).alias("round"), verdict.alias("outcome")).where("outcome is not null"))
        if now.isEmpty():
            return done.unionByName(open_.select("card_id", F.lit(no).alias("round"), F.lit("cycle").alias("outcome")))
        done = materialize(done.unionByName(now))


def pending_dependents(cards: DataFrame, raw: str = "disambiguation") -> DataFrame:
    """anchor_card_id and the number of pending interaction cards that wait for it; damaged JSON is
    nothing."""
    waits = F.coalesce(F.from_json(raw, DEPENDENCY), F.array())
    rows = cards.where("type = 'record_interaction' and status = 'pending'").select("id", F.explode(F.array_distinct(F.transform(waits, lambda d: d["anchor_card_id"]))).alias("anchor_card_id"))
    return rows.where("anchor_card_id is not null").groupBy("anchor_card_id").agg(F.count(F.lit(1)).alias("waiting"))


def inserted(candidates: Column, position: Column, contact_id: Column) -> Column:
    """Candidate list with an id at a position (0-based, at most the end), without repeats."""
    rest = F.filter(candidates, lambda c: c != contact_id)
    at = F.least(F.greatest(position, F.lit(0)), F.size(rest))
    return F.concat(F.slice(rest, F.lit(1), at), F.array(contact_id), F.slice(rest, at + 1, F.size(rest)))


def duplicate_uploads(uploads: DataFrame, cards: DataFrame) -> DataFrame:
    """uploads (upload_no, sha256, screenshot_id) that repeat an earlier content: the earlier screenshot
    and the cards still pending there."""
    w = Window.partitionBy("sha256").orderBy("upload_no")
    first = F.first("screenshot_id").over(w)
    rows = uploads.withColumns({"original": first, "_k": F.row_number().over(w)}).where("_k > 1").drop("_k")
    waiting = cards.groupBy(F.col("screenshot_id").alias("original")).agg(F.count_if(F.col("status") == "pending").alias("pending"))
    return rows.join(waiting, "original", "left").withColumn("pending", F.coalesce("pending", F.lit(0)))


def lineage(cards: DataFrame, evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """card_id, sources: labels of a card's own screenshot and of those merged into it, in order, once
    each; a screenshot without a label goes by its number."""
    own = cards.select(F.col("id").alias("card_id"), F.lit(-1).alias("pos"), "screenshot_id")
    rows = own.unionByName(evidence.select("card_id", "pos", "screenshot_id"))
    first = rows.groupBy("card_id", "screenshot_id").agg(F.min("pos").alias("pos")).join(labels, "screenshot_id", "left")
    named = F.struct("pos", "screenshot_id", F.coalesce("label", F.col("screenshot_id").cast("string")).alias("label"))
    return first.groupBy("card_id").agg(F.transform(F.sort_array(F.collect_list(named)), lambda x: x["label"]).alias("sources"))


def notices(rows: DataFrame, key: str, order: str, label: str, notice: str) -> DataFrame:
    """One notice as it is, several as 'label：notice' in order, joined."""
    all_ = F.sort_array(F.collect_list(F.struct(order, label, notice)))
    packed = rows.groupBy(key).agg(all_.alias("_a"))
    many = F.array_join(F.transform("_a", lambda x: F.concat(x[label], F.lit("："), x[notice])), "；")
    return packed.select(key, F.when(F.size("_a") == 1, F.get("_a", F.lit(0))[notice]).otherwise(many).alias("notice"))


def progress(batch: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """key, done, total, settled, next: how far a batch is, and its first item that isn't final."""
    final = F.col(status).isin("success", "failure", "confirmed", "rejected", "cancelled")
    return batch.groupBy(key).agg(F.count_if(final).alias("done"), F.count(F.lit(1)).alias("total"), F.bool_and(final).alias("settled"), F.min(F.when(~final, F.col(order))).alias("next"))
