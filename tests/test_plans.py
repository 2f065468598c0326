"""Composite pipelines on literal evidence, and operators on small cases."""

from pyspark.sql import functions as F

from skeinflow.functions import contacts, rules, text
from skeinflow.operators import dedup, geometry, match, snapshots
from skeinflow.plans import evidence, execute, fixtures_queries, propose, resolve


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_resolution(spark):
    found = {r["name"]: r for r in fixtures_queries.resolve_pipeline(spark, "").collect()}
    assert (found["林舟"]["status"], found["林舟"]["contact_id"], found["林舟"]["source"]) == ("same_as", 1, "exact")
    assert (found["林州"]["status"], found["林州"]["candidate_ids"], found["林州"]["source"]) == ("unsure", [1], "near_match")
    assert (found["Ada"]["status"], found["Ada"]["source"]) == ("new", "llm")
    assert "我" not in found


def test_resolution_in_an_empty_library(spark):
    people = spark.createDataFrame([(1, 0, "Ada", False)], "screenshot_id long, pos int, name string, is_self boolean")
    none = spark.createDataFrame([], fixtures_queries.CONTACTS)
    assert rows(resolve.resolve_participants(people, none), "status", "source") == [("new", "empty_db")]


def test_damaged_documents_are_null_and_old_ones_repaired(spark):
    docs = fixtures_queries.documents(spark)
    assert rows(docs.where("evidence is null"), "screenshot_id") == [(3,)]
    own = evidence.children(docs, "participants").where("is_self")
    assert rows(own, "name", "confidence") == [("我", "high")]


def test_self_names(spark):
    docs = evidence.with_self_names(fixtures_queries.documents(spark), [" ada "])
    assert rows(evidence.children(docs, "participants").where("is_self"), "name") == [("Ada",), ("我",)]
    known = spark.createDataFrame([("Ada",)], "known_name string")
    docs = evidence.with_self_names(fixtures_queries.documents(spark), [" ada "], known)
    assert rows(evidence.children(docs, "participants").where("is_self"), "name") == [("我",)]


def test_proposed_cards(spark):
    cards = fixtures_queries.propose_pipeline(spark, "")
    kinds = rows(cards, "screenshot_id", "type")
    assert kinds.count((1, "update_contact")) == 1 and kinds.count((1, "create_contact")) == 1
    assert (2, "create_contact") in kinds and (1, "record_interaction") in kinds
    names = {r["payload"].get("contact_name") for r in cards.where("type = 'record_interaction'").collect()}
    assert names == {"林舟", "林州", "王敏"}  # Ada only acknowledges, the department is a mere mention
    meeting = cards.where("type = 'create_meeting' and payload['agenda_append'] is null").first()
    assert meeting["payload"]["duplicate_of_meeting_id"] == "7"
    assert cards.where("screenshot_id is null").count() == 0


def test_executed_cards(spark):
    seen = fixtures_queries.execute_pipeline(spark, "")
    told = rows(seen, "kind", "content")
    assert ("status_change", '公司由 "北辰" 变为 "北辰科技"') in told
    assert ("fact", "公司: 北辰科技") not in told and ("fact", "电话: 13800000000") in told and ("fact", "职位: CTO") in told
    assert ("preference", "喜欢安静的会议室") in told
    assert seen.where("kind = 'interaction'").count() == 3


def test_card_errors(spark):
    schema = "card_id long, screenshot_id long, type string, payload map<string,string>, status string"
    cards = spark.createDataFrame([(1, 1, "create_contact", {"name": " "}, "pending"), (2, 1, "update_contact", {"contact_id": "x"}, "pending"), (3, 1, "record_interaction", {"summary": "a"}, "confirmed")], schema)
    assert rows(execute.card_errors(cards), "card_id", "errors") == [(1, ["name"]), (2, ["contact_id"]), (3, ["not_pending"])]


def test_insights_rest_on_own_observations(spark):
    schema = "contact_id long, pos int, kind string, content string, based_on array<long>, generated_at string"
    old = spark.createDataFrame([(1, "a", "old", [1], "t"), (2, "a", "stays", [9], "t")], "contact_id long, kind string, content string, based_on array<long>, generated_at string")
    new = spark.createDataFrame([(1, 0, "a", " x  y ", [1, 1, 5], "u"), (1, 1, "a", "z", [7], "u"), (2, 0, "a", "none", [1], "u")], schema)
    seen = spark.createDataFrame([(1, 1), (1, 5), (2, 9)], "contact_id long, id long")
    assert rows(execute.grounded_insights(old, new, seen), "contact_id", "content", "based_on") == [(1, "x y", [1, 5]), (2, "stays", [9])]


def test_near_matches_are_one_edit_apart(spark):
    a = spark.createDataFrame([(i, x) for i, x in enumerate(["张伟", "欧阳娜", "ab", "a"])], "l long, x string")
    b = spark.createDataFrame([(i, x) for i, x in enumerate(["张伟", "张玮", "张伟东", "欧阳", "abc", "b"])], "r long, y string")
    assert rows(match.near_matches(a, b, "l", "x", "r", "y"), "l", "r") == [(0, 1), (1, 3)]


def near(s, t):
    """Whether two texts are one edit apart, by trying all edits."""
    if len(s) > len(t):
        s, t = t, s
    cuts = [t[:i] + t[i + 1 :] for i in range(len(t))]
    return s in cuts if len(s) < len(t) else len(s) == len(t) and sum(x != y for x, y in zip(s, t, strict=True)) == 1


def test_near_matches_of_whole_tables_equal_brute_force(spark, tmp_path):
    words = ["longestwordofall", "longestwordofal", "longestwordofell", "gärten", "garten", "gärte", "aab", "ab", "abb", "ba", "bb", "bcd", "abc", "𝔘x", "𝔘y", "z"]
    docs = spark.createDataFrame([(i, f"{x} {x}, {words[0]}", lang) for i, (x, lang) in enumerate(zip(words, ["en", "fr", None, "zh"] * 4, strict=True))], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    from skeinflow import catalog

    words = [text for (text,) in spark.createDataFrame([(w,) for w in words], "w string").select(text.norm_contact(F.col("w"))).collect()]
    expected = lambda known: sorted(((s, t) for s in known for t in known if near(s, t) and min(len(s), len(t)) >= 2 and (len(s) > 2 or len(t) == 2)), key=repr)
    assert rows(catalog.queries()["unicode_near_match"](spark, str(tmp_path)), "a", "b") == expected(words)

    names = {"customer": ["ann lee", "anne lee", "bo"], "supplier": ["ann lea", "bob", "bi"], "part": ["anne lea", "box", "ann lee"]}
    for table, found in names.items():
        spark.createDataFrame([(x,) for x in found], f"{table[0]}_name string").write.parquet(str(tmp_path / f"{table}.parquet"))
    found = rows(catalog.queries()["name_near_match"](spark, str(tmp_path)), "a", "b")
    assert sorted(((a.replace(" ", ""), b.replace(" ", "")) for a, b in found), key=repr) == expected(sorted({x.replace(" ", "") for v in names.values() for x in v}))


def test_near_matches_need_no_nested_loop(spark):
    a = spark.createDataFrame([(1, "abc")], "l long, x string")
    b = spark.createDataFrame([(1, "abd")], "r long, y string")
    plan = match.near_matches(a, b, "l", "x", "r", "y")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_similar_pairs_find_every_pair(spark):
    from itertools import product

    words = ["north wind review", "north wind rewiew", "orth wind review", "north wind reviews", "south wind review", "x", "y", "", "north wind"]
    df = spark.createDataFrame(list(enumerate(words)), "i long, t string")

    def distance(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            last, row = row, [i]
            for j, d in enumerate(t, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    expected = [(i, j) for (i, s), (j, t) in product(enumerate(words), repeat=2) if s and t and 1 - distance(s, t) / max(len(s), len(t)) >= 0.9]
    other = df.select(F.col("i").alias("j"), F.col("t").alias("u"))
    assert rows(match.similar_pairs(df, other, "i", "t", "j", "u", 0.9), "i", "j") == expected


def test_text_functions(spark):
    assert values(spark, text.norm_compare, "　Ada ", "X") == ["ada", "x"]
    assert values(spark, text.norm_contact, "Ａ. 林·舟") == ["a林舟"]
    assert values(spark, text.cjk_ratio, "林a舟b", "12") == [0.5, 0.0]
    assert values(spark, lambda c: text.edit_similarity(c, F.lit("")), "a") == [0.0]
    assert values(spark, lambda c: text.without_speaker(c, F.array(F.lit("林舟"))), "林舟：好", "林舟：", "别的") == ["好", "", "别的"]
    assert values(spark, lambda c: text.composed_of(c, F.array(F.lit("ab"), F.lit("c"))), "abcab", "abd", "") == [True, False, False]
    assert values(spark, text.without_fence, "```json\n{}\n```") == ["{}"]
    assert values(spark, text.alias_list, "a, b、a，c") == [["a", "b", "c"]]
    assert values(spark, text.masked, "secret1234") == ["****1234"]


def test_rules(spark):
    assert values(spark, rules.pure_acknowledgement, "收到！", "我一会ル出来", "荀导已到", "已到账五万元", "报价单已发") == [True, True, True, False, False]
    assert values(spark, rules.direct_progress, "合同已提交", "想提交") == [True, False]
    assert values(spark, rules.observation_kind, "喜欢茶", "住在城东") == ["preference", "fact"]
    assert values(spark, lambda c: rules.meeting_notice(F.lit("other"), c), "通知：开会", "开会") == [True, False]


def test_bubbles(spark):
    schema = "screenshot_id long, pos int, text string, confidence double, x double, y double, width double, height double, placed boolean"
    data = [(1, 1, "a", None, 20.0, 0.0, 300.0, 30.0, True), (1, 2, "b", None, 79.0, 61.0, 300.0, 30.0, True), (1, 3, "c", None, 20.0, 123.0, 300.0, 30.0, True), (1, 4, "10:30", None, 20.0, 125.0, 9.0, 9.0, True), (1, 5, "d", None, 80.0, 123.0, 300.0, 30.0, True)]
    found = geometry.bubbles(spark.createDataFrame(data, schema))
    assert rows(found, "text", "bubble") == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]


def test_snapshot_folds(spark):
    df = spark.createDataFrame([("a；b", "b;c")], "x string, y string")
    assert df.select(snapshots.appended(F.col("x"), F.col("y"))).first()[0] == "a；b；c"
    assert df.select(snapshots.rebased(F.col("x"), F.col("x"), F.col("y"))).first()[0] == "b;c"


def test_streams(spark, tmp_path):
    from skeinflow.streaming import logs

    path = str(tmp_path / "in")
    data = [("u", "2026-01-01 00:00:00", "app_start"), ("u", "2026-01-01 00:01:00", "work"), ("u", "2026-01-01 00:02:00", "app_start"), ("u", "2026-01-01 00:03:00", "background"), ("v", "2026-01-01 00:00:00", "work")]
    spark.createDataFrame(data, "k string, t string, kind string").select("k", F.col("t").cast("timestamp").alias("t"), "kind").write.json(path)
    stream = spark.readStream.schema("k string, t timestamp, kind string").json(path)
    q = logs.session_stream(stream, "k", "t", "kind", "app_start", "background").writeStream.format("memory").queryName("sessions").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert rows(spark.table("sessions"), "k", "session", "n_rows", "abnormal") == [("u", 2, 2, False), ("v", 0, 1, True)]


def test_sources(spark, tmp_path):
    from skeinflow.sources import tables

    lines = tables.pasted_lines(spark.createDataFrame([(1, "a\r\n \nb c")], "id long, text string"), "id", "text")
    assert rows(lines, "pos", "text") == [(0, "a"), (1, "b c")]
    assert lines.first()["uri"].endswith("a%0D%0A%20%0Ab%20c")
    old = spark.createDataFrame([], tables.SCHEMAS["meetings"]).drop("kind")
    assert "kind" in tables.migrated("meetings", old).columns
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text('{"id": "a", "screenshot_id": 1, "started_at": "1", "finished_at": "2"}')
    (tmp_path / "t/b.json").write_text("{broken")
    assert rows(tables.traces(spark, str(tmp_path / "t")), "id") == [("a",)]


def test_names_are_no_patterns(spark):
    names = F.array(F.lit("li(n"), F.lit("a\\E"))
    assert values(spark, lambda c: text.mentions(c, names), "@ li(n hi", "@a\\E", "@b", "li(n") == [True, True, False, False]
    assert values(spark, lambda c: text.without_speaker(c, names), "dept li(n", "a\\E: x", "x li(n y a\\E z", "li(n") == ["", " x", "z", "li(n"]
    assert values(spark, lambda c: text.composed_of(c, names), "li(na\\Eli(n", "li(n ") == [True, False]


def test_labels_stay_on_one_line(spark):
    assert values(spark, text.label_of, "组长：好", "a\n：b", "a: b\nc", "12: x") == ["组长", "", "", ""]
    assert values(spark, text.content_key, "组长：好 的！", "a: b\nc") == ["好的", "abc"]
    assert values(spark, text.label_key, "组 长: x", "x") == ["组长", None]


def test_notices_and_changes_are_read_normalised(spark):
    other = F.lit("other")
    assert values(spark, lambda c: rules.meeting_notice(other, c), "【通知】开会", "会议 时间：三点", "开会") == [True, True, False]
    assert values(spark, rules.meeting_change, "改 到周四", "开会") == [True, False]
    assert values(spark, lambda c: rules.timeless_communication(other, F.lit(False), F.lit("　"), c), "联-系客户", "吃饭") == [True, False]


def test_coverage(spark):
    def covered(quote):
        return lambda c: rules.covered_by(text.norm_contact(c), rules.coverage(F.array(F.lit(quote))))

    assert values(spark, covered("原定于8月24日上午9:30…会议开场时间调整为9:00"), "他说原定于8月24日上午9：30，会议开场时间调整为9:00！", "原定于8月24日上午9:30") == [True, False]
    assert values(spark, covered("明天下午三点开会讨论"), "明天 下午，三点开会讨论。好", "明天下午三点开会讨沦", "明天下午") == [True, True, False]
    assert values(spark, covered("的...了"), "的了", "") == [False, False]


def test_uncovered_equals_every_pair(spark):
    import random

    r = random.Random(1)
    base = ["明天下午三点在三楼会议室开会", "please send the report by friday", "short", "", "合同已经寄出请注意查收谢谢"]
    texts = [(i, i % 3, r.choice(base)[: r.randint(0, 40)] + r.choice(["", "!", " ok", "好"])) for i in range(60)]
    quotes = [(i % 3, r.choice(base)[r.randint(0, 3) :] + r.choice(["", "。", "…and more to come"])) for i in range(20)]
    a, b = spark.createDataFrame(texts, "i long, k long, t string"), spark.createDataFrame(quotes, "k long, q string")
    found = {x for (x,) in rows(match.uncovered(a, b, "i", "k", "t", "q"), "i")}
    held = a.crossJoin(b.withColumnRenamed("k", "k2")).where("k = k2").where(rules.covered_by(text.norm_contact(F.col("t")), rules.coverage(F.array("q"))))
    assert found == {i for i, _, _ in texts} - {x for (x,) in rows(held, "i")} and 0 < len(found) < 60


def test_batch_duplicates_equal_every_pair(spark):
    import random

    r = random.Random(2)
    data = [(i, "ab"[i % 2], "".join(r.choice("xyz ") for _ in range(r.randint(0, 4))) + r.choice(["north wind review", "south wind review", "x"])) for i in range(80)]
    df = spark.createDataFrame(data, "i long, k string, q string")
    a, b = df, df.selectExpr("i as j", "k as k2", "q as q2")
    held = a.crossJoin(b).where((F.col("k") == F.col("k2")) & (F.col("j") < F.col("i")) & (text.edit_similarity(F.col("q"), F.col("q2")) >= 0.85)).groupBy("i").agg(F.min("j").alias("first"))
    assert rows(match.batch_duplicates(df, "k", "i", "q"), "i", "first") == rows(held, "i", "first")


def test_first_match_looks_at_aliases(spark):
    contacts = spark.createDataFrame([(1, "Zed", ["Al  Li"]), (2, "abe", ["al li"]), (3, "Bea", [])], "id long, name string, aliases array<string>")
    people = spark.createDataFrame([(1, " AL LI "), (2, "bea"), (3, "")], "p long, n string")
    assert rows(match.first_match(people, contacts, "p", "n", "id", "name", "aliases"), "p", "id") == [(1, 2), (2, 3)]


def test_last_writer_knows_blanks_of_any_script(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "　\n"), (1, 3, "\t")], "k long, o long, f string")
    assert rows(dedup.last_writer(df, ["k"], ["o"], ["f"]), "f") == [("a",)]


def test_aliases_and_notes_that_say_nothing_new():
    names, fields = ["林舟", "Lin Zhou"], ["北辰科技", "产品 经理"]
    assert [contacts.derived(a, names, fields) for a in ("林舟", "林·舟", "北辰科技林舟", "林舟经理", "林舟北辰", "舟舟", "产品经理", "老林头", "林舟技术部")] == [True, True, True, True, True, False, True, False, False]
    assert contacts.free_parts("电话13800，喜欢茶", ["13800"]) == ["喜欢茶"]
    assert contacts.free_parts("13800", ["13800"]) == [] and contacts.free_parts("喜欢茶，不喝酒", ["13800"]) == ["喜欢茶，不喝酒"]
    assert contacts.free_parts("北辰 总监：爱跑步。北辰和总监", ["北辰", "总监"]) == ["爱跑步"]
    assert contacts.collected([(None, ["a"]), ("q1", ["a"]), ("q2", ["b", "b"]), ("q3", ["c", "b"])]) == (["a", "b", "c"], ["q2", "q3"])


def test_notices_change_a_meeting_of_the_same_screenshot_and_discard_evidence(spark):
    event = "screenshot_id long, pos int, kind string, title string, time_text string, time_iso string, has_time_signal boolean, location string, participant_names array<string>, agenda string, confidence string, source_quote string"
    make = lambda pos, kind, title, quote, day=None, who=(): (1, pos, kind, title, "", day, False, None, list(who), None, "high", quote)
    events = spark.createDataFrame([make(0, "meeting", "季度预算评审", "季度预算评审", "2026-09-02T10:00", ["林舟"]), make(1, "other", "通知改到周四", "通知：预算会改到周四", None, ["林舟"]), make(2, "other", "联系客户", "联系客户李总"), make(3, "other", "通知：周一", "通知：周一")], event)
    none = spark.createDataFrame([], fixtures_queries.MEETINGS)
    routed = propose.routed_events(events)
    assert rows(routed, "pos", "route") == [(0, "keep"), (1, "notice"), (2, "timeless_dropped"), (3, "no_change")]
    stored = propose.notice_targets(routed, none)
    targets = propose.batch_targets(routed, stored)
    assert stored.count() == 0 and rows(targets, "pos", "target") == [(1, 0)]
    kept = propose.changed_targets(routed, targets)
    assert rows(kept, "pos", "agenda", "source_quote") == [(0, "通知：预算会改到周四", "季度预算评审\n\n通知：预算会改到周四")]
    told = spark.createDataFrame([(1, q) for q in ("预算会改到周四", "小王：联系客户李总", "联系客户李总了吗", "合同已提交", "周一")], "screenshot_id long, source_quote string")
    assert rows(propose.without_discarded(told, routed), "source_quote") == [("合同已提交",)]


def test_cards_are_checked_settled_and_seen_by_siblings(spark):
    schema = "card_id long, screenshot_id long, type string, payload map<string,string>, status string, source_quote string, resolved_at string"
    cards = spark.createDataFrame([(1, 1, "create_contact", {"name": "Ada", "aliases": "Bo，C"}, "pending", "q", "t"), (2, 1, "record_interaction", {"contact_name": "我", "summary": "s"}, "pending", "q", "t"), (3, 1, "create_meeting", {"title": "m", "kind": "party"}, "pending", "q", "t"), (4, 1, "create_contact", {"name": "D", "color": "x"}, "pending", "q", "t")], schema)
    assert rows(execute.card_errors(cards), "card_id", "errors") == [(1, []), (2, ["self_name"]), (3, ["kind"]), (4, ["field"])]
    names = spark.createDataFrame([(1, " bo "), (1, "nobody")], "screenshot_id long, shown string")
    assert rows(execute.sibling_cards(names, cards), "shown", "name", "status") == [(" bo ", "Ada", "pending")]
    none = lambda schema: spark.createDataFrame([], schema)
    seen = none("contact_id long, screenshot_id long, kind string, content string, source_quote string, observed_at string")
    done = execute.execute(cards, none(fixtures_queries.CONTACTS), none(fixtures_queries.MEETINGS), seen)
    assert rows(done["cards"], "card_id", "status", "resolved_contact_id") == [(1, "confirmed", 1)]


def test_ids_are_gapless_and_follow_the_rows(spark):
    df, old = spark.range(300).withColumnRenamed("id", "card_id"), spark.createDataFrame([(7,)], "id long")
    first = rows(execute.next_ids(df, old, "card_id"), "card_id", "new_id")
    assert sorted(n for _, n in first) == list(range(8, 308)) and first == rows(execute.next_ids(df.repartition(5), old, "card_id"), "card_id", "new_id")


def test_snapshots_seed_and_come_back(spark, tmp_path):
    from skeinflow.sources import tables

    seed = tables.seeded(spark, {"contacts": [{"id": 1, "canonical_name": "Ada", "aliases": ["A"]}], "screenshots": [{"id": 5}, {"id": 6}], "action_cards": [{"id": 9, "screenshot_id": 5}]})
    left = tables.without_uploads(seed, seed["screenshots"].where("id = 5"))
    tables.write_snapshot(left, str(tmp_path / "s"))
    found = tables.read_snapshot(spark, str(tmp_path / "s"))
    assert set(found) == set(tables.SCHEMAS) and rows(found["contacts"], "id", "aliases") == [(1, ["A"])]
    assert rows(found["screenshots"], "id") == [(6,)] and found["action_cards"].count() == 0


def test_traces_are_archived_only_when_they_change(spark):
    from skeinflow.sources import tables

    row = lambda end, error: ("a", 1, "1", end, [], error)
    found = spark.createDataFrame([row("3", "x"), row("2", "x"), row("1", "y")], tables.TRACE)
    now, old = tables.kept_traces(found)
    assert rows(now, "finished_at", "error") == [("3", "x")] and rows(old, "finished_at", "error") == [("1", "y")]
