"""Running values over ranges against plain folds: one key with all rows, null keys, many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import scan, sessions, snapshots

LEGAL = {("pending", "confirm"): "confirmed", ("pending", "reject"): "rejected", ("rejected", "reopen"): "pending"}


def log(keys, n, seed=1):
    r = random.Random(seed)
    return [(r.choice(keys), i, r.choice(["open", "work", "fail", "quiet", "confirm", "reject", "reopen"]), r.randint(0, 9)) for i in r.sample(range(10 * n), n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, kind string, v int").repartition(3)


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda x: x[1]):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("keys,n", [(["hot"], 400), (["hot"] * 8 + ["a", "b", None], 300), (["a"], 1)])
def test_scans_equal_plain_folds(spark, keys, n):
    rows = log(keys, n)
    dealt = scan.in_ranges(table(spark, rows), ["k"], ["t"], 7)
    if n == 400:
        assert dealt.groupBy("k").agg(F.count_distinct("_range").alias("n")).first()["n"] >= 6  # the one key runs in many tasks
        assert dealt.groupBy("_range").count().agg(F.max("count")).first()[0] < 150
    running = scan.running(scan.running(dealt, ["k"], ["t"], F.col("v"), "total"), ["k"], ["t"], F.col("v"), "top", "max")
    found = {r["t"]: r for r in scan.previous(running, ["k"], ["t"], ["t", "kind"], "prev").collect()}
    states = {r["k"]: (r["status"], r["n_events"]) for r in scan.composed(dealt, ["k"], ["t"], "kind", LEGAL, "pending").collect()}
    assert len(found) == n
    for key, own in by_key(rows).items():
        total, top, before, status = 0, 0, None, "pending"
        for _, t, kind, v in own:
            total, top = total + v, max(top, v)
            assert (found[t]["total"], found[t]["top"]) == (total, top)
            assert (found[t]["prev"] and tuple(found[t]["prev"])) == before
            before, status = (t, kind), LEGAL.get((status, kind), status)
        assert states[key] == (status, len(own))


def test_sessions_gaps_and_flags(spark):
    rows = log(["hot"] * 5 + ["a", None], 250, 3)
    df = table(spark, rows)
    session = {r["t"]: r["session"] for r in sessions.sessions(df, "k", ["t"], F.col("kind") == "open").collect()}
    gaps = {r["t"]: r["gap_group"] for r in sessions.gap_groups(df, "k", ["t"], F.col("t") - F.col("_prev.t"), 20).collect()}
    flags = {r["t"]: r["flag"] for r in sessions.sticky_flag(df, "k", ["t"], F.col("kind") == "fail", F.col("kind") == "open").collect()}
    for own in by_key(rows).values():
        no, group, flag, last = 0, 0, False, None
        for _, t, kind, _ in own:
            no += kind == "open"
            group += last is not None and t - last >= 20
            flag = (False if kind == "open" else flag) or kind == "fail"
            last = t
            assert (session[t], gaps[t], flags[t]) == (no, group, flag)


def test_empty_table(spark):
    assert sessions.sessions(table(spark, log(["a"], 1)).limit(0), "k", ["t"], F.lit(True)).count() == 0
    assert snapshots.folded_status(table(spark, log(["a"], 1)).limit(0), "k", ["t"], "kind", LEGAL, "pending").count() == 0
