"""Queries of composite pipelines over evidence documents, and of time phrases. A document is made of every
conversation (turns as people, quotes, facts and events), customers are the library, purchases the known
meetings; a few literal documents, which tests read alone, come along."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.functions import chinese_time
from skeinflow.plans import evidence, execute, propose, resolve
from skeinflow.registry import Tables
from skeinflow.scratch import materialize

CONTACTS = "id long, canonical_name string, aliases array<string>, company string, title string, phone string, wechat_id string, notes string, created_at string, updated_at string"
MEETINGS = "id long, kind string, title string, time_iso string, time_text string, location string, participants array<struct<contact_id:long,name:string>>, agenda string, status string, created_at string"


def person(name: str, **more) -> dict:
    return {"name": name, "is_self": False, "confidence": "high", "source_quote": f"{name}：", **more}


def event(kind: str, title: str, **more) -> dict:
    return {"kind": kind, "title": title, "time_text": "", "time_iso": None, "has_time_signal": False, "participant_names": [], "confidence": "high", "source_quote": title, **more}


DOCUMENTS = {
    1: {
        "participants": [person("林舟", company="北辰科技", source_quote="林舟：方案下周三前给您"), person("Ada", title="CTO", source_quote="Ada：收到"), {"name": "我", "source_quote": "我：好的"}],
        "events": [event("meeting", "北辰科技方案评审会议", time_text="9月2日下午3点", time_iso="2026-09-02T15:00:00+08:00", has_time_signal=True, participant_names=["林舟", "我"])],
        "facts": [{"subject_name": "林舟", "field": "phone", "value": "13800000000", "confidence": "high", "source_quote": "电话13800000000"}, {"subject_name": "Ada", "field": "other", "value": "喜欢安静的会议室", "confidence": "medium", "source_quote": "Ada喜欢安静的会议室"}],
        "quotes": [{"speaker_name": "林舟", "text": "报价单我明天整理好发给您", "source_quote": "报价单我明天整理好发给您"}, {"speaker_name": "Ada", "text": "收到", "source_quote": "收到"}],
    },
    2: {
        "participants": [person("林州", source_quote="林州：合同已提交"), person("财务部", role="mentioned", source_quote="财务部"), person("王敏", speech_act="initiate", source_quote="王敏：新产品目录想请你先看看")],
        "events": [event("other", "通知：评审会议改到周四", source_quote="通知：北辰科技方案评审会议改到周四"), event("other", "联系客户确认", source_quote="联系客户确认")],
        "facts": [],
        "quotes": [{"speaker_name": "王敏", "text": "新产品目录想请你先看看", "source_quote": "新产品目录想请你先看看"}, {"speaker_name": "林州", "text": "合同已提交", "source_quote": "合同已提交"}],
    },
}


OFFSET = 1000  #: ids from the tables lie above those of the literal rows
NOW = "2026-08-28T10:00:00+08:00"
SAID = ["【通知】评审会议改到周四", "合同已提交", "联系客户确认", "预算评审会议", "收到", "地点换到三楼", "客户拜访"]


def _literal(spark: SparkSession) -> DataFrame:
    rows = [(k, json.dumps(v, ensure_ascii=False)) for k, v in DOCUMENTS.items()] + [(3, "{damaged")]
    return spark.createDataFrame(rows, "screenshot_id long, raw_extraction string")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """screenshot_id, raw_extraction: a document of every conversation, as a model would give it."""
    t = Tables(spark, sf_dir)
    people = t.customer.select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")
    rows = t.conversations.withColumn("k", (F.col("conv_id") * 7 + F.col("turn")) % max(1, t.customer.count()) + 1).join(people, "k")
    no, text = F.col("conv_id") + F.col("turn"), F.coalesce("text", F.lit(""))
    said = F.get(F.array(*[F.lit(x) for x in SAID]), (no % len(SAID)).cast("int"))
    name = F.when(no % 4 == 0, F.concat("c_name", F.lit("x"))).when(no % 4 == 1, F.concat(F.lit("新客户"), "c_name")).otherwise(F.col("c_name"))
    own = F.col("role") == "system"
    nothing = F.lit(None).cast("string")
    person = F.struct(name.alias("name"), own.alias("is_self"), F.when(no % 5 == 0, "mentioned").alias("role"), F.when(no % 3 == 0, "respond").otherwise("initiate").alias("speech_act"), F.when(no % 2 == 0, F.col("c_mktsegment")).alias("company"), F.when(no % 7 == 0, F.concat("c_mktsegment", F.lit("，"), said)).alias("notes"), said.alias("interaction_summary"), F.lit("high").alias("confidence"), F.concat(name, F.lit("："), text).alias("source_quote"))
    quote = F.struct(name.alias("speaker_name"), F.concat(said, F.lit(" "), text).alias("text"), F.concat(said, F.lit(" "), text).alias("source_quote"))
    fact = F.struct(name.alias("subject_name"), F.get(F.array(*[F.lit(f) for f in ("phone", "alias", "other", "title", "notes")]), (no % 5).cast("int")).alias("field"), F.when(no % 5 == 1, F.concat("c_name", F.col("c_mktsegment"))).otherwise(F.concat(said, F.col("k").cast("string"))).alias("value"), F.lit("medium").alias("confidence"), F.concat(said, text).alias("source_quote"))
    event_ = F.struct(F.when(no % 2 == 0, "other").otherwise("meeting").alias("kind"), said.alias("title"), F.concat((F.col("turn") % 12 + 1).cast("string"), F.lit("月2日3点")).alias("time_text"), F.lit("2026-09-02T15:00:00+08:00").alias("time_iso"), F.lit(False).alias("has_time_signal"), nothing.alias("location"), F.array(name).alias("participant_names"), F.lit("high").alias("confidence"), F.concat(said, F.lit("："), text).alias("source_quote"))
    each = lambda x, where=F.lit(True): F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("turn", x.alias("x"))))), lambda r: r["x"])
    doc = rows.groupBy("conv_id").agg(each(person).alias("participants"), each(event_, F.col("turn") % 3 == 0).alias("events"), each(fact).alias("facts"), each(quote).alias("quotes"))
    return doc.select((F.col("conv_id") + OFFSET).alias("screenshot_id"), F.to_json(F.struct("participants", "events", "facts", "quotes")).alias("raw_extraction"))


def documents(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    raw = _literal(spark)
    return evidence.parsed(raw.unionByName(_conversations(spark, sf_dir)) if sf_dir else raw)


def contacts(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    at = "2026-08-01T09:00:00+08:00"
    rows = [(1, "林舟", ["Lin Zhou"], "北辰", None, None, None, None, at, at), (2, "陈默", ["Mo"], None, None, None, None, None, at, at)]
    own = spark.createDataFrame(rows, CONTACTS)
    if not sf_dir:
        return own
    empty = F.lit(None).cast("string")
    more = Tables(spark, sf_dir).customer.select((F.col("c_custkey") + OFFSET).alias("id"), F.col("c_name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.col("c_mktsegment").alias("company"), *[empty.alias(c) for c in ("title", "phone", "wechat_id", "notes")], F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"))
    return own.unionByName(more)


def meetings(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    rows = [(7, "meeting", "北辰科技方案评审会议", "2026-09-02T15:00:00+08:00", "9月2日", None, [(1, "林舟")], "看报价", "upcoming", "2026-08-20T09:00:00+08:00")]
    own = spark.createDataFrame(rows, MEETINGS)
    if not sf_dir:
        return own
    empty, id_ = F.lit(None).cast("string"), F.col("event_id")
    who = F.array(F.struct(F.lit(None).cast("long").alias("contact_id"), F.concat(F.lit("Customer#"), F.lpad((id_ % max(1, Tables(spark, sf_dir).customer.count()) + 1).cast("string"), 9, "0")).alias("name")))
    more = Tables(spark, sf_dir).events.where("event_type = 'purchase'").select((id_ + OFFSET).alias("id"), F.lit("meeting").alias("kind"), F.concat(F.lit("预算评审会议 第"), id_.cast("string"), F.lit("次")).alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss+08:00").alias("time_iso"), F.lit("").alias("time_text"), empty.alias("location"), who.alias("participants"), empty.alias("agenda"), F.lit("upcoming").alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss+08:00").alias("created_at"))
    return own.unionByName(more)


def model(spark: SparkSession, sf_dir: str = "", people: DataFrame | None = None) -> DataFrame:
    """What a model decided; people: the participants of all documents, if they are at hand."""
    rows = [(1, 1, "new", None, []), (2, 0, "new", None, []), (2, 1, "new", None, []), (2, 2, "new", None, [])]
    own = spark.createDataFrame(rows, "screenshot_id long, pos int, decision string, contact_id long, candidate_ids array<long>")
    if not sf_dir:
        return own
    if people is None:
        people = evidence.children(evidence.parsed(_conversations(spark, sf_dir)), "participants")
    people = people.where(f"screenshot_id >= {OFFSET}")
    return own.unionByName(people.select("screenshot_id", "pos", F.lit("new").alias("decision"), F.lit(None).cast("long").alias("contact_id"), F.array().cast("array<bigint>").alias("candidate_ids")))


def _parts(spark: SparkSession, sf_dir: str = "") -> dict[str, DataFrame]:
    docs = materialize(documents(spark, sf_dir))
    return {p: evidence.children(docs, p) for p in evidence.PARTS}


def resolve_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _parts(spark, sf_dir)["participants"]
    return resolve.resolve_participants(people, contacts(spark, sf_dir), model(spark, sf_dir, people))


def progress_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    return resolve.progress_fragments(p["participants"], p["facts"], p["events"], p["quotes"]).drop("place")


def propose_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of all documents. The model takes fragments of the literal rows for progress of their meeting, those of
    the tables for progress of one of the newest meetings."""
    return _proposed(spark, sf_dir, _parts(spark, sf_dir))


def _proposed(spark: SparkSession, sf_dir: str, p: dict[str, DataFrame]) -> DataFrame:
    resolved = resolve.resolve_participants(p["participants"], contacts(spark, sf_dir), model(spark, sf_dir, p["participants"]))
    related = evidence.related(p["participants"], p["facts"], p["quotes"])
    told = resolve.progress_fragments(p["participants"], p["facts"], p["events"], p["quotes"]).withColumn("fragment_id", F.xxhash64("screenshot_id", "content", "source_quote"))
    newest = resolve.progress_candidates(meetings(spark, sf_dir)).select(F.col("id").alias("meeting_id"), (F.row_number().over(Window.orderBy("id")) - 1).alias("_no"))
    told = materialize(told)
    matches = told.where(f"screenshot_id >= {OFFSET}").withColumn("_no", F.pmod("fragment_id", F.lit(resolve.LATEST_MEETINGS))).join(newest, "_no").select("fragment_id", "meeting_id")
    matches = matches.unionByName(told.where("screenshot_id = 2").select("fragment_id", F.lit(7).cast("long").alias("meeting_id")))
    found = resolve.progress_resolutions(told, matches.withColumn("confidence", F.lit("high")))
    return propose.propose(p, related, resolved, contacts(spark, sf_dir), meetings(spark, sf_dir), found, F.lit(NOW).cast("timestamp"))


def execute_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations after all proposed cards were confirmed."""
    p = _parts(spark, sf_dir)
    cards = _proposed(spark, sf_dir, p).select((F.col("screenshot_id") * 1000 + F.col("card_no")).alias("card_id"), "screenshot_id", "type", "payload", "source_quote", F.lit("pending").alias("status"), F.lit(NOW).alias("resolved_at"))
    facts = p["facts"].select("screenshot_id", "subject_name", "field", "value", "source_quote", F.lit(NOW).alias("observed_at"))
    people = p["participants"].where("not is_self").withColumn("observed_at", F.lit(NOW))
    none = spark.createDataFrame([], "contact_id long, screenshot_id long, kind string, content string, source_quote string, observed_at string")
    return execute.execute(materialize(cards), contacts(spark, sf_dir), meetings(spark, sf_dir), none, facts, people)["observations"]


PHRASES = ["今天", "今晚12点", "下周三下午3点半", "本周三", "周三3点", "9月2日晚上8点", "1月2号", "改天", "第2号方案", "下周三点半", "礼拜五上午十点一刻"]


def timeparse_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases as of one moment and, of the tables, one phrase as of every event."""
    rows = spark.createDataFrame([(p,) for p in PHRASES], "phrase string").withColumn("now", F.lit("2026-08-27 02:00:00").cast("timestamp"))
    if sf_dir:
        phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("event_id") % len(PHRASES)).cast("int"))
        rows = rows.unionByName(Tables(spark, sf_dir).events.select(phrase.alias("phrase"), F.col("ts").cast("timestamp").alias("now")))
    rows = rows.withColumn("iso", chinese_time.resolve_time(F.col("phrase"), F.col("now")))
    return rows.select("phrase", "iso", chinese_time.confirm_label(F.col("iso"), F.col("phrase")).alias("label"))


def queries() -> dict:
    return {f.__name__: f for f in (resolve_pipeline, progress_fragments, propose_pipeline, execute_pipeline, timeparse_golden)}
