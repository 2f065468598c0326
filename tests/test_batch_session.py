"""Batch sessions: the fold on one case, its rows against SQL (in test_oracle), and the stream against the fold."""

import random

import pytest
from pyspark.sql import functions as F

from skeinflow.streaming import batch_session as bs

STEP = "batch long, step int, card_id long, action string, type string, name string, aliases array<string>, fields map<string,string>, people array<string>, kind string, time_text string, time_iso string, source_quote string, contact_id long"


def step(batch, no, card, action="propose", type_=None, name=None, aliases=(), fields=None, people=(), kind=None, time_text=None, time_iso=None, quote=None, contact=None):
    return (batch, no, card, action, type_, name, list(aliases), fields, list(people), kind, time_text, time_iso, quote, contact)


CASE = [
    step(1, 1, 10, type_="create_contact", name=" Wang Min ", aliases=["Min"], fields={"company": "A", "phone": " "}, quote="q1"),
    step(1, 1, 11, type_="record_interaction", name="Wang Min"),  # the same screenshot: not known yet
    step(1, 1, 12, type_="create_meeting", kind="other", people=["Wang Min"], time_text="礼拜三", quote="please bring the signed contract"),
    step(1, 2, 20, type_="create_contact", name="wang min", fields={"company": "B", "title": "CTO"}, quote="q2"),
    step(1, 2, 21, type_="record_interaction", name="MIN"),
    step(1, 2, 22, type_="create_meeting", kind="other", people=["Min", "Lee"], time_text="星期三", time_iso="2026-09-02T15:00:00+08:00", quote="Please, bring the signed contracts!"),
    step(1, 2, 23, type_="create_meeting", kind="other", people=["Min", "Lee"], time_text="星期四", quote="please bring the signed contract"),
    step(1, 3, 21, "confirm"),
    step(1, 4, 10, "confirm", contact=77),
    step(1, 5, 21, "confirm"),
    step(1, 6, 60, type_="create_contact", name="Min"),
    step(1, 7, 12, "reject"),
    step(1, 8, 80, type_="create_meeting", kind="other", time_text=" 礼拜 三", quote="please bring the signed contract"),
    step(1, 9, 81, type_="create_contact", name="Lee"),
    step(1, 10, 82, type_="record_interaction", name="Lee"),
    step(1, 11, 81, "reject"),
    step(1, 12, 82, "confirm"),
    step(1, 13, 81, "reopen"),
    step(1, 14, 82, "confirm"),
    step(2, 1, 10, type_="create_contact", name="Wang Min"),
    step(None, 1, 1, type_="create_contact", name="x"),
]


def test_a_batch_from_proposal_to_confirmation(spark):
    found = {(r["batch"], r["step"], r["card_id"]): r for r in bs.fold_batches(spark.createDataFrame(CASE, STEP)).collect()}
    assert len(found) == len(CASE) - 1
    of = lambda no, card: found[1, no, card]
    assert (of(1, 10)["outcome"], of(1, 10)["temporary_id"]) == ("anchor", -1)
    assert of(1, 11)["depends"] == of(1, 12)["depends"] == []
    assert (of(2, 20)["outcome"], of(2, 20)["target"]) == ("merged", 10) and of(2, 20)["merged"] == '{"company": "B", "title": "CTO", "quotes": 2}'
    assert (of(2, 21)["outcome"], of(2, 21)["depends"], of(2, 21)["contact_ids"]) == ("kept", [10], [-1])
    assert (of(2, 22)["outcome"], of(2, 22)["target"], of(2, 22)["merged"]) == ("duplicate", 12, "2026-09-02T15:00:00+08:00")
    assert (of(2, 23)["outcome"], of(2, 23)["depends"]) == ("kept", [10])
    assert (of(3, 21)["outcome"], of(3, 21)["depends"]) == ("waiting", [10])
    assert of(4, 10)["outcome"] == "confirmed"
    assert (of(5, 21)["outcome"], of(5, 21)["contact_ids"]) == ("confirmed", [77])
    assert (of(6, 60)["outcome"], of(6, 60)["contact_ids"]) == ("known", [77])
    assert (of(8, 80)["outcome"], of(8, 80)["target"]) == ("duplicate", 12)  # a rejected item keeps its repeats out
    assert of(12, 82)["outcome"] == "broken" and of(13, 81)["temporary_id"] == -3 and of(14, 82)["outcome"] == "waiting"
    assert found[2, 1, 10]["temporary_id"] == -1


@pytest.mark.parametrize("a,b,expected", [("abcdefgh", "abcdefgx", True), ("abcdef", "abcdeg", False), ("", "", False), ("a" * 40, "a" * 34, True), ("a" * 40, "a" * 33, False), ("你好吗今天去", "你好吗今天去", True)])
def test_similarity_with_a_limit(a, b, expected):
    assert bs.similar(a, b) == bs.similar(b, a) == expected


def test_similarity_equals_the_column(spark):
    from skeinflow.functions.text import at_least_similar, edit_similarity

    r = random.Random(4)
    data = [("".join(r.choice("ab") for _ in range(r.randint(0, 30))),) * 2 for _ in range(300)]
    data = [(a, "".join(r.choice("ab") if r.random() < 0.08 else c for c in b) + r.choice(["", "", "a"])) for a, b in data]
    found = spark.createDataFrame(data, "a string, b string").select("a", "b", at_least_similar(F.col("a"), F.col("b"), 0.85).alias("x"), (edit_similarity(F.col("a"), F.col("b")) >= 0.85).alias("y")).collect()
    assert all(r["x"] == r["y"] == bs.similar(r["a"], r["b"]) for r in found) and 20 < sum(r["x"] for r in found) < 280


def random_steps(seed):
    r, rows = random.Random(seed), []
    for batch in range(4):
        cards = []
        for no in range(24):
            if cards and r.random() < 0.4:
                rows.append(step(batch, no, r.choice(cards), r.choice(["confirm", "confirm", "reject", "reopen"]), contact=r.choice([None, 100 + no])))
                continue
            for k in range(r.randint(1, 3)):
                card = 100 * no + k
                cards.append(card)
                kind = r.choice(["create_contact", "update_contact", "create_meeting", "record_interaction"])
                rows.append(step(batch, no, card, type_=kind, name=r.choice("ABC"), aliases=r.choice([[], ["D"], ["C"]]), fields=r.choice([None, {"company": f"co{no}"}]), people=r.sample("ABCD", 2), kind=r.choice(["other", "meeting"]), time_text=r.choice(["t", "u"]), time_iso=r.choice([None, "2026"]), quote=r.choice(["north wind review", "north wind reviews", "x"])))
    return rows


def test_stream_equals_fold_across_a_restart(spark, tmp_path):
    """Screenshots arrive in six files; the stream stops after three of them and starts again."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, inbox, out = random_steps(9), tmp_path / "in", str(tmp_path / "out")
    try:
        for half in (range(0, 3), range(3, 6)):
            for k in half:
                part = [x for x in rows if x[1] // 4 == k]
                spark.createDataFrame(part, STEP).coalesce(1).write.mode("append").json(str(inbox))
                stream = bs.batch_session_stream(spark.readStream.schema(STEP).option("maxFilesPerTrigger", 1).json(str(inbox)))
                q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
                q.awaitTermination(300)
                assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    key = lambda r: (r["batch"], r["step"], r["card_id"])
    streamed, folded = (sorted(df.collect(), key=key) for df in (spark.read.parquet(out), bs.fold_batches(spark.createDataFrame(rows, STEP))))
    assert streamed == folded and len(folded) == len(rows)
    assert {r["outcome"] for r in folded} >= {"anchor", "merged", "duplicate", "waiting", "confirmed", "known"}


def test_the_last_entries_of_a_log_stay(spark, tmp_path):
    """Three files, one micro-batch each; a key keeps its last four entries."""
    from skeinflow.streaming import logs

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    inbox, seen = str(tmp_path / "in"), {}
    schema = "k string, t timestamp, kind string, detail string"
    try:
        for part in range(3):
            data = [(k, f"2026-01-01 00:{part:02d}:{i:02d}", "x", f"{part}{i}") for k in "ab"[: 2 - part % 2] for i in range(3)]
            spark.createDataFrame(data, "k string, t string, kind string, detail string").coalesce(1).write.mode("append").json(inbox)
            stream = logs.last_entries(spark.readStream.schema(schema).json(inbox), "k", keep=4)
            q = stream.writeStream.foreachBatch(lambda df, _: seen.update({(r["k"], r["place"]): (r["detail"], r["evicted"]) for r in df.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(300)
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [seen["a", i] for i in range(1, 5)] == [("12", 3), ("20", 3), ("21", 3), ("22", 3)]
    assert [seen["b", i] for i in range(1, 5)] == [("02", 2), ("20", 2), ("21", 2), ("22", 2)]
