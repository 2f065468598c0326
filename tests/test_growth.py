"""Operators whose joins must not hold a row per pair, or be broadcast, however often a value repeats."""

from pyspark.sql import functions as F

from skeinflow.operators import match


def joined_rows(df):
    """Rows of df and the rows that the joins of its last step gave."""
    found, total, nodes = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            if kind.endswith("JoinExec"):
                total += node.metrics().apply("numOutputRows").value()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found, total


def test_near_matches_are_not_broadcast_and_come_once(spark, tmp_path):
    def stored(rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / schema[0]))
        return spark.read.parquet(str(tmp_path / schema[0]))

    a = stored([(1, "aab"), (1, "aab"), (2, "ab"), (3, "ba")], "l long, x string")
    b = stored([(7, "aabb"), (7, "aabb"), (8, "ab"), (9, "bab"), (9, "aab")], "r long, y string")
    found = match.near_matches(a, b, "l", "x", "r", "y")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 7), (1, 8), (1, 9)]  # a key of 2 only matches one of 2


def test_near_matches_share_one_deletion_key(spark):
    from itertools import product

    words = ["".join(w) for n in (2, 3, 4) for w in product("ab", repeat=n)]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", match.deletions(F.col("w")).alias("k"))
    pairs = df.crossJoin(df.select(F.col("w").alias("v"), F.col("k").alias("m"))).where(F.levenshtein("w", "v") == 1)
    assert [r[0] for r in pairs.select(F.size(F.array_intersect("k", "m")).alias("n")).distinct().collect()] == [1]


def test_first_match_takes_one_contact_a_name(spark):
    contacts = spark.range(300).select("id", F.lit("Ann").alias("name"), F.array().cast("array<string>").alias("aliases"))
    found, joined = joined_rows(match.first_match(spark.range(200).select(F.col("id").alias("p"), F.lit(" ann").alias("n")), contacts, "p", "n", "id", "name", "aliases"))
    assert len(found) == 200 and {r["id"] for r in found} == {0} and joined <= 1000


def test_duplicate_meetings_of_one_title_make_no_pairs(spark):
    known = spark.range(300).select(F.col("id").alias("k"), F.lit("meeting").alias("kind"), F.when(F.col("id") < 299, "weekly review of plans").otherwise("one of its kind").alias("title"), F.lit("2026-01-01").alias("day"))
    title = F.when(F.col("id") % 3 == 0, "weekly review of plans").when(F.col("id") % 3 == 1, "one of its kind").otherwise("weekly review of plan")
    new = spark.range(300).select("id", F.lit(None).cast("string").alias("kind"), title.alias("title"), F.lit("2026-01-01").alias("day"))
    found, joined = joined_rows(match.duplicate_meetings(new, known, "id", "k", "kind", "title", "day"))
    assert {(r["id"] % 3, r["k"], r["tier"]) for r in found} == {(1, 299, "exact")} and len(found) == 100 and joined <= 3000
    alone = match.duplicate_meetings(new, known.where("k = 0 or k = 299"), "id", "k", "kind", "title", "day")
    assert {(r["id"] % 3, r["k"], r["tier"]) for r in alone.collect()} == {(0, 0, "exact"), (1, 299, "exact"), (2, 0, "similar")}


def test_overlap_matches_of_one_day_make_no_pairs(spark):
    meetings = spark.range(300).select(F.col("id").alias("m"), F.lit("d").alias("day"), F.when(F.col("id") == 7, F.array(F.lit("only"), F.lit("both"))).otherwise(F.array(F.lit("all"))).alias("names"))
    notices = spark.range(300).select(F.col("id").alias("n"), F.lit("d").alias("day"), F.when(F.col("id") % 2 == 0, F.array(F.lit("only"), F.lit("both"))).otherwise(F.array(F.lit("only"), F.lit("all"))).alias("names"))
    found, joined = joined_rows(match.overlap_matches(notices, meetings, "n", "m", "day", "names"))
    assert sorted(map(tuple, found)) == [(i, 7) for i in range(0, 300, 2)] and joined <= 3000


def test_batches_hold_items_of_many_users(spark, tmp_path):
    from skeinflow import catalog

    rows = [(1, 1, "click", 5.0), (2, 11, "click", 5.5), (3, 2, "click", 5.0), (4, 21, "view", 5.0)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in catalog.queries()["batch_duplicates"](spark, str(tmp_path)).collect()] == [(2, 1)]


def test_texts_of_few_quotes_make_no_pieces(spark, monkeypatch):
    texts = spark.range(300).select("id", (F.col("id") % 30).alias("k"), F.concat(F.lit("see the agenda of room "), (F.col("id") % 40).cast("string")).alias("t"))
    quotes = spark.range(30).select(F.col("id").alias("k"), F.lit("the agenda of room 7").alias("q"))
    held = {(r["id"]) for r in match.uncovered(texts, quotes, "id", "k", "t", "q", heads=0).collect()}
    monkeypatch.setattr(match, "_postings", None)  # no piece is made
    assert {r["id"] for r in match.uncovered(texts, quotes, "id", "k", "t", "q").collect()} == held and 0 < len(held) < 300


def test_large_keys_are_held_against_every_quote(spark):
    import random

    from skeinflow.functions import rules, text

    r = random.Random(4)
    base = ["明天下午三点在三楼会议室开会", "please send the report by friday", "short", "合同已经寄出请注意查收谢谢", "the north wind blows"]
    texts = [(i, i % 3, r.choice(base)[: r.randint(0, 40)] + r.choice(["", "!", " ok", "好"])) for i in range(80)] + [(80, 3, "one alone")]
    quotes = [(i % 4, r.choice(base)[r.randint(0, 6) :] + r.choice(["", "。", "…and more to come"])) for i in range(40)]
    a, b = spark.createDataFrame(texts, "i long, k long, t string"), spark.createDataFrame(quotes, "k long, q string")
    every = a.crossJoin(b.withColumnRenamed("k", "k2")).where("k = k2").where(rules.covered_by(text.norm_contact(F.col("t")), rules.coverage(F.array("q"))))
    held = {r["i"] for r in every.select("i").collect()}
    for heads in (0, 2, 32):
        assert {r["i"] for r in match.uncovered(a, b, "i", "k", "t", "q", heads=heads).collect()} == set(range(81)) - held


def test_items_of_one_form_make_no_pieces(spark, monkeypatch):
    monkeypatch.setattr(match, "_postings", None)  # no piece is made
    items = spark.range(600).select("id", F.lit("k").alias("k"), F.concat(F.lit("2024-01-01 value "), (F.col("id") + 100).cast("string")).alias("q"))
    found = match.batch_duplicates(items, "k", "id", "q").collect()
    assert sorted(map(tuple, found)) == [(i, 0) for i in range(1, 600)]


def test_items_meet_all_earlier_ones(spark, monkeypatch):
    import random

    from skeinflow.functions import text

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(24))
    some = [word() for _ in range(12)]
    spoiled = lambda w: w[: (i := r.randint(0, 20))] + r.choice(["", "x", "xy"]) + w[i + r.randint(0, 2) :]
    forms = {"pieces": [spoiled(r.choice(some)) if r.random() < 0.5 else word() for _ in range(90)], "batch": [f"2024-01-{r.randint(1, 30):02} value {r.randint(0, 150)}" for _ in range(90)]}
    monkeypatch.setattr(match, "PART", 7)
    for form, quotes in forms.items():
        df = spark.createDataFrame([(i, "ab"[i % 2], q) for i, q in enumerate(quotes)] + [(90, "c", "")], "i long, k string, q string")
        b = df.selectExpr("i as j", "k as k2", "q as q2")
        held = df.crossJoin(b).where((F.col("k") == F.col("k2")) & (F.col("j") < F.col("i")) & (text.edit_similarity(F.col("q"), F.col("q2")) >= 0.85)).groupBy("i").agg(F.min("j").alias("first"))
        expected = sorted(map(tuple, held.collect()))
        for earliest in ((1, 2), (3,), (32, 256)):
            assert sorted(map(tuple, match.batch_duplicates(df, "k", "i", "q", earliest=earliest).collect())) == expected, form
        assert len(expected) > 10


def test_documents_are_parsed_once(spark, monkeypatch):
    from skeinflow.plans import evidence, fixtures_queries

    class Built(Exception):
        pass

    def stop(*_):
        raise Built

    seen, parsed = [], evidence.parsed
    monkeypatch.setattr(evidence, "parsed", lambda *a: seen.append(1) or parsed(*a))
    monkeypatch.setattr(fixtures_queries.execute, "execute", stop)
    try:
        fixtures_queries.execute_pipeline(spark, "")
    except Built:
        pass
    assert len(seen) == 1


def test_keys_of_acknowledgements_are_made_once_a_text(spark):
    from skeinflow.functions import rules

    said = spark.createDataFrame([("收到！",), ("好的收到了",), ("大家都已到 了",), ("报价单我明天整理好发给您" * 9,), ("🙂",), (None,)], "t string")
    found = said.select("t", rules.pure_acknowledgement(F.col("t")).alias("a"))
    assert [r["a"] for r in found.collect()] == [True, True, True, False, True, None]
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1


def test_meetings_are_named_once_and_those_of_other_lengths_make_no_pieces(spark, monkeypatch):
    from skeinflow.plans import fixtures_queries, propose

    held, pairs = [], match.similar_pairs
    monkeypatch.setattr(match, "similar_pairs", lambda a, b, *more: held.append(sorted(r["_text"] for r in b.select("_text").collect())) or pairs(a, b, *more))
    notices = spark.createDataFrame([(1, "abcdefghij")], "n long, t string")
    titles = [w[:k] for w in ("abcdefghijklmnopqrstuvwxyz",) for k in range(1, 27)] + ["", None]
    known = spark.createDataFrame(list(enumerate(titles)), "m long, u string")
    found = match.similar_ends(notices, known, "n", "t", "m", "u", 0.9).collect()
    assert [tuple(r) for r in found] == [(1, 8, 10)]  # of 9, 10 and 11 characters
    assert {len(t) for t in held[0]} >= {9, 10, 11} and {len(t) for t in held[0]} <= set(range(8, 14))
    sizes = (1, 2, 5, 9, 18, 81, 90, 99, 729, 1000)  # texts of lengths at the very limit meet
    left = spark.createDataFrame([(n, "x" * n) for n in sizes], "n long, t string")
    right = spark.createDataFrame([(n, "x" * int(n / 0.9 + 1e-9)) for n in sizes], "m long, u string")
    ends = match.similar_ends(left, right, "n", "t", "m", "u", 0.9).collect()
    assert {r["n"] for r in ends} == set(sizes) and held[-1] == sorted(r["u"] for r in right.collect())
    named = propose.named_meetings(fixtures_queries.meetings(spark))
    assert propose.named_meetings(named) is named
