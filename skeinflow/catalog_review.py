"""More queries over the driver tables: review of batches, resolution, texts, times and small projections.
Orders stand for cards, customers for batches and contacts, events for lines, items and log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.functions import chinese_time, rules
from skeinflow.functions import text as tx
from skeinflow.operators import batch, dedup, geometry, reads, review, snapshots
from skeinflow.plans import execute, resolve
from skeinflow.catalog import _LETTERS
from skeinflow.registry import AT, Tables, at, query
from skeinflow.sources import tables

# --- agreement


@query("""
    WITH r AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN NULL ELSE list_sort(list_distinct([l_suppkey % 2, l_linenumber % 3])) END AS ids FROM lineitem)
    SELECT l_orderkey, CASE WHEN count(DISTINCT ids) = 1 AND count(ids) = count(*) THEN array_to_string(min(ids), ',') END AS ids FROM r GROUP BY l_orderkey""")
def candidate_consensus(t: Tables) -> DataFrame:
    ids = F.when(F.col("l_returnflag") != "A", F.array(F.col("l_suppkey") % 2, (F.col("l_linenumber") % 3).cast("long")))
    found = dedup.set_consensus(t.lineitem.select("l_orderkey", ids.alias("a")), ["l_orderkey"], "a")
    return found.select("l_orderkey", F.array_join("ids", ",").alias("ids"))


@query("""
    SELECT user_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS affected FROM (SELECT DISTINCT user_id, unnest([event_id % 5, event_id % 17]) AS i FROM events) GROUP BY user_id""")
def affected_ids(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.expr("array(event_id % 5, event_id % 17)").alias("ids"))
    return dedup.affected(rows, ["user_id"], "ids").select("user_id", F.array_join("affected", ",").alias("affected"))


# --- review of a batch


def _cards(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", (F.col("o_orderkey") % 3).alias("g"), F.col("o_orderkey").alias("card"), (F.col("o_orderkey") % 5).alias("shot"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("confirmed").alias("status"))


_CARDS = "SELECT o_custkey, o_orderkey % 3 AS g, o_orderkey AS card, o_orderkey % 5 AS shot, o_orderstatus = 'P' AS pending FROM orders"


@query(f"SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY g, card) - 1 AS INTEGER) AS place, g, card FROM ({_CARDS})")
def review_sequence(t: Tables) -> DataFrame:
    return review.review_sequence(_cards(t), "o_custkey", "g", "card")


@query(f"SELECT o_custkey, first(card ORDER BY g, card) AS card FROM ({_CARDS}) WHERE pending GROUP BY o_custkey")
def current_card(t: Tables) -> DataFrame:
    return review.current_pending(_cards(t), "o_custkey", "g", "card", "status")


@query(f"""
    WITH p AS (SELECT * FROM ({_CARDS}) WHERE pending), n AS (SELECT c_custkey AS o_custkey, c_custkey % 5 AS now FROM customer)
    SELECT o_custkey, CASE WHEN NOT coalesce(bool_or(shot = now), false) THEN first(shot ORDER BY g, card) END AS shot FROM n LEFT JOIN p USING (o_custkey) GROUP BY o_custkey""")
def auto_follow(t: Tables) -> DataFrame:
    now = t.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 5).alias("shot"))
    return review.auto_follow(_cards(t), now, "o_custkey", "g", "card", "shot", "status")


def _items(t: Tables) -> DataFrame:
    own = F.when(F.col("event_type") != "view", F.col("event_id") % 300)
    return t.events.select("event_id", (F.col("user_id") % 20).alias("batch"), own.alias("shot"), F.when(F.col("event_type") == "view", F.col("event_id") * 7 % 400).alias("original"), (F.col("event_id") % 3).alias("pending"))


_ITEMS = "SELECT event_id, user_id % 20 AS batch, CASE WHEN event_type <> 'view' THEN event_id % 300 END AS shot, CASE WHEN event_type = 'view' THEN event_id * 7 % 400 END AS original, event_id % 3 AS pending FROM events"


@query(f"""
    WITH i AS ({_ITEMS}) SELECT event_id, batch, original FROM i WHERE shot IS NULL AND original IS NOT NULL AND pending > 0 AND NOT EXISTS (SELECT 1 FROM i j WHERE j.batch = i.batch AND j.shot = i.original)""")
def unopened_duplicates(t: Tables) -> DataFrame:
    return review.unopened_duplicates(_items(t), "batch", "shot", "original", "pending").select("event_id", "batch", "original")


@query(f"""
    WITH i AS ({_ITEMS}), f AS (SELECT batch, s AS shot, first(event_id ORDER BY tier, event_id) AS item FROM (SELECT batch, shot AS s, 0 AS tier, event_id FROM i WHERE shot IS NOT NULL UNION ALL SELECT batch, original, 1, event_id FROM i WHERE shot IS NULL AND original IS NOT NULL) GROUP BY batch, s),
    w AS (SELECT DISTINCT user_id % 20 AS batch, event_id % 450 AS shot FROM events)
    SELECT batch, shot, item FROM w LEFT JOIN f USING (batch, shot)""")
def item_lookup(t: Tables) -> DataFrame:
    wanted = t.events.select((F.col("user_id") % 20).alias("batch"), (F.col("event_id") % 450).alias("shot")).distinct()
    return review.item_for(_items(t), wanted, "batch", "shot", "original", "event_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 20")
def batch_cap(t: Tables) -> DataFrame:
    return review.capped(t.events.select("user_id", "event_id"), "user_id", "event_id")


@query(rf"""
    WITH l AS (SELECT user_id, event_id, event_id % 977 AS y, event_id % 31 AS x, CASE event_id % 4 WHEN 0 THEN ' ' || month(ts) || '月' || day(ts) || '日 ' || strftime(ts, '%H:%M') || ' ' WHEN 1 THEN '昨天 ' || strftime(ts, '%H:%M') WHEN 2 THEN strftime(ts, '%H:%M') || '见' ELSE event_type END AS text, event_id % 5 > 0 AS placed FROM events)
    SELECT user_id, string_agg(trim(text), '|' ORDER BY y, x, text) AS hints FROM l WHERE placed AND regexp_matches(trim(text), '^\d+月\d+日 \d\d:\d\d$') GROUP BY user_id""")
def timestamp_hints(t: Tables) -> DataFrame:
    clock, kind = F.date_format("ts", "HH:mm"), F.col("event_id") % 4
    day = F.concat(F.lit(" "), F.month("ts").cast("string"), F.lit("月"), F.dayofmonth("ts").cast("string"), F.lit("日 "), clock, F.lit(" "))
    text = F.when(kind == 0, day).when(kind == 1, F.concat(F.lit("昨天 "), clock)).when(kind == 2, F.concat(clock, F.lit("见"))).otherwise(F.col("event_type"))
    lines = t.events.select("user_id", (F.col("event_id") % 977).alias("y"), (F.col("event_id") % 31).alias("x"), text.alias("text"), (F.col("event_id") % 5 > 0).alias("placed"))
    return review.timestamp_hints(lines, "user_id").select("user_id", F.array_join("hints", "|").alias("hints"))


@query("SELECT c_custkey, c_name FROM customer")
def matched_contacts(t: Tables) -> DataFrame:
    rolled = reads.activity_rollup(t.customer.select("c_custkey", "c_name"), t.orders, "c_custkey", "o_custkey", "o_orderkey", F.col("o_orderstatus") == "O", "o_orderdate")
    return review.without_computed(rolled)


@query("""
    WITH r AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN k || ',' || (k + 1) WHEN 3 THEN '' WHEN 4 THEN '-' || event_id END AS ids FROM r""")
def insight_references(t: Tables) -> DataFrame:
    k, kind = F.get_json_object("props", "$.k").cast("long"), F.col("event_id") % 5
    quoted = F.concat(F.lit("["), k.cast("string"), F.lit(', "'), (k + 1).cast("string"), F.lit('"]'))
    raw = F.when(kind == 0, quoted).when(kind == 1, '["x", 1]').when(kind == 2, "[1.5, 9007199254740992]").when(kind == 4, F.concat(F.lit('[" -'), F.col("event_id").cast("string"), F.lit(' "]')))
    return t.events.select("event_id", F.array_join(review.references(raw), ",").alias("ids"))


@query("""
    WITH c AS (SELECT c_custkey, ' ' || c_name || '"' AS name FROM customer)
    SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE trim(name) || '（联系人 ' || c_custkey || '）、b' END AS shown,
      CASE WHEN c_custkey % 7 = 0 THEN '[]' ELSE '[[' || c_custkey || ',' || to_json(trim(name)) || '],[null,"b"]]' END AS canonical FROM c""")
def participants_shown(t: Tables) -> DataFrame:
    one = F.struct(F.col("c_custkey").alias("contact_id"), F.concat(F.lit(" "), "c_name", F.lit('"')).alias("name"))
    two = F.struct(F.lit(None).cast("long").alias("contact_id"), F.lit("b ").alias("name"))
    people = F.when(F.col("c_custkey") % 7 != 0, F.array(one, two)).otherwise(F.array().cast("array<struct<contact_id:bigint,name:string>>"))
    c = t.customer.select("c_custkey", people.alias("p"))
    return c.select("c_custkey", review.participants_text(F.col("p")).alias("shown"), review.participants_json(F.col("p")).alias("canonical"))


# --- reads


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def one_contact(t: Tables) -> DataFrame:
    return reads.by_key(t.customer, "c_custkey", 7).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def children_of_one(t: Tables) -> DataFrame:
    return reads.children_of(t.orders, "o_custkey", 7, "o_orderkey").select("o_orderkey", "o_custkey")


@query("""
    SELECT 'screenshots' AS "table", count(*) AS rows FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'action_cards', count(*) FROM labels WHERE doc_id % 10 <> 0 UNION ALL SELECT 'contacts', count(*) FROM customer""")
def upload_cleanup(t: Tables) -> DataFrame:
    now = {"screenshots": t.documents.select(F.col("doc_id").alias("id")), "action_cards": t.labels.select(F.col("doc_id").alias("screenshot_id")), "contacts": t.customer.select(F.col("c_custkey").alias("id"))}
    left = tables.without_uploads(now, now["screenshots"].where("id % 10 = 0"))
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"""
    WITH p AS (SELECT user_id, event_id AS pos, 'k' || event_id % 2 AS kind, 'c ' || event_id % 5 AS content, list_distinct([event_id, event_id + 1]) AS refs, {AT("ts")} AS generated_at FROM events WHERE event_type = 'click'),
    r AS (SELECT user_id, pos, kind, content, generated_at, unnest(refs) AS ref FROM p), o AS (SELECT user_id, event_id AS ref FROM events WHERE event_id % 3 <> 1),
    g AS (SELECT user_id, pos, kind, content, generated_at, list(ref ORDER BY ref) AS based_on FROM r JOIN o USING (user_id, ref) GROUP BY ALL),
    d AS (SELECT user_id, kind, content, based_on, min(pos) AS pos, min(generated_at) AS generated_at FROM g GROUP BY user_id, kind, content, based_on),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rn FROM d),
    old AS (SELECT user_id, 'old' AS kind, 'x' AS content, '1' AS based_on, 't' AS generated_at FROM events GROUP BY user_id)
    SELECT user_id AS contact_id, kind, content, array_to_string(based_on, ',') AS based_on, generated_at FROM k WHERE rn <= 3
    UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM k)""")
def grounded_insights(t: Tables) -> DataFrame:
    old = t.events.select(F.col("user_id").alias("contact_id")).distinct().select("contact_id", F.lit("old").alias("kind"), F.lit("x").alias("content"), F.array(F.lit(1).cast("long")).alias("based_on"), F.lit("t").alias("generated_at"))
    new = t.events.where("event_type = 'click'").select(F.col("user_id").alias("contact_id"), F.col("event_id").alias("pos"), F.concat(F.lit("k"), (F.col("event_id") % 2).cast("string")).alias("kind"), F.concat(F.lit(" c  "), (F.col("event_id") % 5).cast("string")).alias("content"), F.expr("array(event_id, event_id + 1, event_id)").alias("based_on"), at("ts").alias("generated_at"))
    seen = t.events.where("event_id % 3 <> 1").select(F.col("user_id").alias("contact_id"), F.col("event_id").alias("id"))
    return execute.grounded_insights(old, new, seen).withColumn("based_on", F.array_join(F.array_sort("based_on"), ","))


# --- resolution


_NAMED = """SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN ' ' || upper(c_name) WHEN 1 THEN 'Alias ' || c_custkey % 50 WHEN 2 THEN c_name || 'x' WHEN 3 THEN 'Nobody' || conv_id ELSE c_name END AS name, role = 'system' AS is_self
      FROM conversations JOIN customer ON c_custkey = (conv_id * 7 + turn) % (SELECT count(*) FROM customer) + 1"""


@query(rf"""
    WITH p AS ({_NAMED}), l AS (SELECT c_custkey AS id, c_name AS n FROM customer UNION ALL SELECT c_custkey, 'alias ' || c_custkey FROM customer),
    e AS (SELECT conv_id, turn, list_sort(list(DISTINCT id)) AS ids FROM p JOIN l ON lower(trim(p.name)) = lower(trim(l.n)) GROUP BY conv_id, turn),
    k AS (SELECT conv_id, turn, lower(regexp_replace(name, '[\p{{P}}\s]+', '', 'g')) AS k FROM p), m AS (SELECT DISTINCT id, lower(regexp_replace(n, '[\p{{P}}\s]+', '', 'g')) AS c FROM l),
    x AS (SELECT conv_id, turn, list_sort(list(DISTINCT id)) AS ids FROM k, m WHERE abs(length(k) - length(c)) <= 1 AND length(k) > 2 AND levenshtein(k, c) = 1 GROUP BY conv_id, turn)
    SELECT conv_id, turn, CASE WHEN len(e.ids) = 1 THEN 'same_as' WHEN len(e.ids) > 1 OR x.ids IS NOT NULL THEN 'unsure' ELSE 'new' END AS status, CASE WHEN len(e.ids) = 1 THEN e.ids[1] END AS contact_id,
      CASE WHEN len(e.ids) = 1 THEN 'exact' WHEN len(e.ids) > 1 THEN 'exact_multiple' WHEN x.ids IS NOT NULL THEN 'near_match' ELSE 'llm' END AS source, CASE WHEN len(e.ids) = 1 THEN '' ELSE coalesce(array_to_string(coalesce(e.ids, x.ids), ','), '') END AS candidates
    FROM p LEFT JOIN e USING (conv_id, turn) LEFT JOIN x USING (conv_id, turn) WHERE NOT is_self""")
def resolved_turns(t: Tables) -> DataFrame:
    """All turns as participants, customers as contacts; the model calls all others new."""
    rows = t.conversations.withColumn("c_custkey", (F.col("conv_id") * 7 + F.col("turn")) % max(1, t.customer.count()) + 1).join(t.customer.select("c_custkey", "c_name"), "c_custkey")
    kind, key = (F.col("conv_id") + F.col("turn")) % 5, F.col("c_custkey")
    name = F.when(kind == 0, F.concat(F.lit(" "), F.upper("c_name"))).when(kind == 1, F.concat(F.lit("Alias "), (key % 50).cast("string"))).when(kind == 2, F.concat("c_name", F.lit("x"))).when(kind == 3, F.concat(F.lit("Nobody"), F.col("conv_id").cast("string"))).otherwise(F.col("c_name"))
    people = rows.select("conv_id", F.col("turn").alias("pos"), name.alias("name"), (F.col("role") == "system").alias("is_self"))
    contacts = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"), F.array(F.concat(F.lit("alias "), key.cast("string"))).alias("aliases"))
    model = people.select("conv_id", "pos", F.lit("new").alias("decision"), F.lit(None).cast("long").alias("contact_id"), F.array().cast("array<bigint>").alias("candidate_ids"))
    found = resolve.resolve_participants(people, contacts, model, "conv_id")
    return found.select("conv_id", F.col("pos").alias("turn"), "status", "contact_id", "source", F.array_join("candidate_ids", ",").alias("candidates"))


# --- texts


_SPOKEN = ["li(n：", "x a\\E ", "@ li(n ", "no", "＠a\\E", "dept li(n"]
_SPOKE = f"SELECT conv_id, turn, {_SPOKEN!r}[(conv_id + turn) % 6 + 1] || CASE WHEN (conv_id + turn) % 6 = 5 THEN '' ELSE text END AS text FROM conversations".replace("\\\\", "\\")


@query(rf"""
    WITH s AS ({_SPOKE})
    SELECT conv_id, turn, regexp_matches(text, '@\s*(li\(n|a\\E)') AS mentioned,
      md5(trim(CASE WHEN regexp_matches(text, '[\p{{P}}\s]li\(n$') THEN '' WHEN regexp_matches(text, '(?s)(li\(n|a\\E)[\p{{P}}\s]') THEN regexp_replace(text, '(?s)^.*(li\(n|a\\E)[\p{{P}}\s]', '') ELSE text END, ' ' || chr(10))) AS said,
      regexp_full_match(text, '(li\(n|a\\E|：|dept| )+') AS composed FROM s""")
def spoken_parts(t: Tables) -> DataFrame:
    """Speakers, mentions and chains of words, with names that hold characters of patterns."""
    kind = (F.col("conv_id") + F.col("turn")) % 6
    text = F.concat(F.get(F.array(*[F.lit(x) for x in _SPOKEN]), kind.cast("int")), F.when(kind == 5, "").otherwise(F.col("text")))
    s, names = t.conversations.select("conv_id", "turn", text.alias("text")), F.array(F.lit("li(n"), F.lit("a\\E"))
    c, words = F.col("text"), F.array(*[F.lit(x) for x in ("li(n", "a\\E", "：", "dept", " ")])
    return s.select("conv_id", "turn", tx.mentions(c, names).alias("mentioned"), F.md5(tx.trimmed(tx.without_speaker(c, names))).alias("said"), tx.composed_of(c, words).alias("composed"))


@query(r"""
    SELECT event_id, nullif(trim(CASE WHEN event_id % 4 = 0 THEN '  ' ELSE ' ' || event_type || ' ' END), '') AS optional, event_type || '|' || user_id AS aliases, '{"k": ' || event_id || '}' AS bare,
      CASE event_id % 3 WHEN 0 THEN '[side=me] ' || event_type WHEN 1 THEN '[side=me time_anchor=9:00] ' || event_type ELSE event_type END AS line, CAST(event_id AS VARCHAR) AS value, 'at a|at b' AS frames,
      '****' || right('secret' || (1000 + event_id % 9000), 4) AS masked, 'data:text/plain,' || event_type || '%20' || event_id || '%2F%E4%BD%A0' AS uri FROM events""")
def text_forms(t: Tables) -> DataFrame:
    id_, kind = F.col("event_id").cast("string"), F.col("event_id") % 3
    fenced = F.concat(F.lit('```json\n{"k": '), id_, F.lit("}\n```  "))
    detail = F.concat(F.lit("v=1\nnone\n v = "), id_)
    anchor, side = F.when(kind == 1, "9:00"), F.when(kind < 2, "me")
    return t.events.select(
        "event_id", tx.optional(F.when(F.col("event_id") % 4 == 0, " 　").otherwise(F.concat(F.lit("　"), "event_type", F.lit(" ")))).alias("optional"),
        F.array_join(tx.alias_list(F.concat(F.lit(" "), "event_type", F.lit("，、"), F.col("user_id").cast("string"), F.lit("\n"), "event_type")), "|").alias("aliases"), tx.without_fence(fenced).alias("bare"),
        tx.annotated_line(F.col("event_type"), side, anchor).alias("line"), tx.key_values(detail)["v"].alias("value"), F.array_join(tx.stack_frames(F.lit("Error: x\n  at a\n at b\nsee at c")), "|").alias("frames"),
        tx.masked(F.concat(F.lit("secret"), (F.col("event_id") % 9000 + 1000).cast("string"), F.lit(" "))).alias("masked"), tx.data_uri(F.concat(F.lit("\n"), "event_type", F.lit(" "), id_, F.lit("/你 "))).alias("uri"),
    )


@query("""
    SELECT event_id, CASE WHEN s IN (401, 403) THEN 'auth' WHEN s = 404 THEN 'missing' WHEN s = 409 THEN 'conflict' WHEN s = 429 THEN 'busy' WHEN s >= 500 THEN 'server' WHEN contains(m, 'timeout') THEN 'timeout' WHEN contains(m, 'network') THEN 'network' ELSE 'other' END AS category
    FROM (SELECT event_id, 400 + event_id % 120 AS s, CASE event_type WHEN 'view' THEN 'read timeout' WHEN 'click' THEN 'network down' ELSE '' END AS m FROM events)""")
def error_categories(t: Tables) -> DataFrame:
    message = F.when(F.col("event_type") == "view", "Read TIMEOUT").when(F.col("event_type") == "click", "Network down")
    return t.events.select("event_id", rules.error_category(400 + F.col("event_id") % 120, message).alias("category"))


# --- times, numbers, arrays


@query("""
    SELECT event_id, month(l) || '月' || day(l) || '日（' || ['周一', '周二', '周三', '周四', '周五', '周六', '周日'][isodow(l)] || '）' || CASE WHEN strftime(l, '%H:%M') = '00:00' THEN '晚上' ELSE strftime(l, '%H:%M') END AS label,
      strftime(ts, '%Y-%m-%d') AS day, strftime(l, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS prompt, CAST(round(floor(value * 1000) / 1024) AS BIGINT) AS kb
    FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) + INTERVAL 16 HOUR ELSE date_trunc('second', ts) END + INTERVAL 8 HOUR AS l FROM events)""")
def time_labels(t: Tables) -> DataFrame:
    now = F.when(F.col("event_id") % 3 == 0, F.date_trunc("day", "ts") + F.expr("INTERVAL 16 HOURS")).otherwise(F.date_trunc("second", "ts")).cast("timestamp")
    iso = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.events.select("event_id", chinese_time.confirm_label(iso, F.lit("今天晚上")).alias("label"), chinese_time.calendar_day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("day"), chinese_time.prompt_time(now).alias("prompt"), review.kilobytes(F.floor(F.col("value") * 1000)).alias("kb"))


@query("""
    SELECT event_id, greatest(0, floor(x)) AS px, greatest(0, floor(y)) AS py, greatest(1, least(1000, ceil(x + w)) - greatest(0, floor(x))) AS pw, greatest(1, least(2000, ceil(y + 30)) - greatest(0, floor(y))) AS ph
    FROM (SELECT event_id, (event_id % 131) * 10.25 - 20 AS x, (event_id % 977) * 2.5 - 3 AS y, 40.5 AS w FROM events)""")
def pixel_rectangles(t: Tables) -> DataFrame:
    frames = t.events.select("event_id", ((F.col("event_id") % 131) * 10.25 - 20).alias("x"), ((F.col("event_id") % 977) * 2.5 - 3).alias("y"), F.lit(40.5).alias("width"), F.lit(30.0).alias("height"), F.lit(1000).alias("iw"), F.lit(2000).alias("ih"))
    return geometry.pixel_rectangle(frames, "iw", "ih").select("event_id", "px", "py", "pw", "ph")


@query("""
    WITH r AS (SELECT event_id, list_filter([user_id, user_id + 1, user_id + 2], lambda x: x <> event_id % 200) AS rest, event_id % 200 AS new, event_id % 6 - 1 AS p FROM events),
    a AS (SELECT *, least(greatest(p, 0), len(rest)) AS k FROM r)
    SELECT event_id, array_to_string(list_concat(rest[1:k], [new], rest[k + 1:len(rest)]), ',') AS ids, CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 'a；c；b' END AS agenda FROM a""")
def hydrated_candidates(t: Tables) -> DataFrame:
    ids = batch.inserted(F.expr("array(user_id, user_id + 1, user_id + 2)"), (F.col("event_id") % 6 - 1).cast("int"), F.col("event_id") % 200)
    current = F.when(F.col("event_id") % 2 == 0, "a").otherwise("a；c")
    return t.events.select("event_id", F.array_join(ids, ",").alias("ids"), snapshots.rebased(F.lit("a"), current, F.lit("b")).alias("agenda"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '7:x' ELSE '7:a' END || CASE WHEN o_orderkey % 2 = 0 THEN ',0:b' ELSE ',0:b,0:c' END || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',8:x' END AS people FROM orders""")
def merged_people(t: Tables) -> DataFrame:
    kind = "array<struct<contact_id:bigint,name:string>>"
    person = lambda id_, name: F.struct(id_.cast("long").alias("contact_id"), name.alias("name"))
    old = F.array(person(F.lit(7), F.lit("a")), person(F.lit(None), F.lit("b")), person(F.lit(9), F.lit("gone")))
    one = person(F.when(F.col("o_orderkey") % 3 == 0, 7).otherwise(8), F.lit("x"))
    new = F.when(F.col("o_orderkey") % 2 == 0, F.array(one)).otherwise(F.array(person(F.lit(None), F.lit("c")), one)).cast(kind)
    people = snapshots.merged_participants(snapshots.without_participant(old.cast(kind), F.lit(9)), new)
    return t.orders.select("o_orderkey", F.array_join(F.transform(people, lambda p: F.concat(F.coalesce(p["contact_id"], F.lit(0)).cast("string"), F.lit(":"), p["name"])), ",").alias("people"))


# --- batch sessions

_STEPS = """SELECT conv_id, turn AS step, conv_id * 1000 + turn AS card, 'propose' AS action, turn % 3 AS kind, 'P' || (conv_id + turn * 7) % 2 AS name, 'day ' || turn % 2 AS day, CASE WHEN turn % 2 = 1 THEN 'About P' || (conv_id + turn * 7) % 2 || ' and the plan.' ELSE text END AS text, NULL::BIGINT AS contact FROM conversations
      UNION ALL SELECT conv_id, 900, conv_id * 1000, CASE WHEN conv_id % 5 < 3 THEN 'confirm' ELSE 'reject' END, -1, NULL, NULL, NULL, conv_id FROM conversations WHERE turn = 0
      UNION ALL SELECT conv_id, 901 + turn, conv_id * 1000 + turn, 'confirm', -1, NULL, NULL, NULL, NULL FROM conversations WHERE turn % 3 > 0"""
_SAME = f"1 - levenshtein({_LETTERS('s.k')}, {_LETTERS('x.k')}) / CAST(greatest(length(s.k), length(x.k)) AS DOUBLE) >= 0.85"


@query(f"""
    WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY step, card) AS i, lower(regexp_replace(coalesce(text, ''), '[\\p{{P}}\\p{{Z}}\\x09-\\x0D\\x{{85}}]+', '', 'g')) AS k FROM ({_STEPS})),
    f AS (SELECT conv_id, 0::BIGINT AS i, []::STRUCT(card BIGINT, name VARCHAR, real BIGINT, gone BOOLEAN)[] AS people, []::STRUCT(card BIGINT, k VARCHAR, day VARCHAR)[] AS items, []::STRUCT(card BIGINT, anchor BIGINT)[] AS waits,
        NULL::BIGINT AS step, NULL::BIGINT AS card, NULL::VARCHAR AS outcome, NULL::BIGINT AS target FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL SELECT conv_id, i,
        CASE WHEN outcome = 'anchor' THEN list_append(people, struct_pack(card := card, name := name, real := NULL::BIGINT, gone := false))
          WHEN action = 'reject' THEN list_transform(people, lambda p: struct_pack(card := p.card, name := p.name, real := p.real, gone := p.gone OR p.card = card))
          WHEN outcome = 'confirmed' AND contact IS NOT NULL THEN list_transform(people, lambda p: struct_pack(card := p.card, name := p.name, real := CASE WHEN p.card = card THEN contact ELSE p.real END, gone := p.gone)) ELSE people END,
        CASE WHEN outcome = 'kept' AND kind = 1 THEN list_append(items, struct_pack(card := card, k := k, day := day)) ELSE items END,
        CASE WHEN outcome = 'kept' AND kind > 0 AND met IS NOT NULL THEN list_append(waits, struct_pack(card := card, anchor := met.card)) ELSE waits END,
        step, card, outcome, CASE outcome WHEN 'anchor' THEN card WHEN 'merged' THEN met.card WHEN 'duplicate' THEN said.card END
      FROM (SELECT *, CASE WHEN action = 'reject' THEN 'rejected' WHEN action = 'confirm' THEN CASE WHEN anchor IS NULL THEN 'confirmed' WHEN anchor.gone THEN 'broken' WHEN anchor.real IS NULL THEN 'waiting' ELSE 'confirmed' END
          WHEN kind = 0 AND met IS NULL THEN 'anchor' WHEN kind = 0 THEN 'merged' WHEN kind = 1 AND said IS NOT NULL THEN 'duplicate' ELSE 'kept' END AS outcome
        FROM (SELECT *, list_filter(people, lambda p: p.card = wait.anchor)[1] AS anchor FROM (
          SELECT s.*, people, items, waits, list_filter(people, lambda p: NOT p.gone AND p.name = s.name)[1] AS met, list_filter(items, lambda x: x.day = s.day AND x.k <> '' AND s.k <> '' AND {_SAME})[1] AS said, list_filter(waits, lambda w: w.card = s.card)[1] AS wait
          FROM f JOIN s ON s.conv_id = f.conv_id AND s.i = f.i + 1))))
    SELECT conv_id AS batch, CAST(step AS INTEGER) AS step, card AS card_id, outcome, target FROM f WHERE i > 0""")
def batch_session(t: Tables) -> DataFrame:
    """Conversations as batches: turns as cards of contacts, other items and interactions, then a confirmation or
    rejection of the first card and confirmations of those that may depend on people."""
    from skeinflow.streaming.batch_session import fold_batches

    turn, none = F.col("turn"), lambda kind: F.lit(None).cast(kind)
    kind = turn % 3
    name = F.concat(F.lit("P"), ((F.col("conv_id") + turn * 7) % 2).cast("string"))
    quote = F.when(turn % 2 == 1, F.concat(F.lit("about "), name, F.lit(" and the plan"))).otherwise(F.col("text"))
    blank = {"type": "string", "name": "string", "aliases": "array<string>", "fields": "map<string,string>", "people": "array<string>", "kind": "string", "time_text": "string", "time_iso": "string", "source_quote": "string", "contact_id": "bigint"}

    def steps(rows: DataFrame, step, action, **given) -> DataFrame:
        columns = [given.get(c, none(k)).alias(c) for c, k in blank.items()]
        return rows.select(F.col("conv_id").alias("batch"), step.alias("step"), (F.col("conv_id") * 1000 + turn).alias("card_id"), action.alias("action"), *columns)

    proposed = {"type": F.when(kind == 0, "create_contact").when(kind == 1, "create_meeting").otherwise("record_interaction"), "name": name, "people": F.array(name), "kind": F.lit("other"), "time_text": F.concat(F.lit("day "), (turn % 2).cast("string")), "source_quote": quote}
    rows = t.conversations
    all_ = steps(rows, turn, F.lit("propose"), **proposed)
    all_ = all_.unionByName(steps(rows.where("turn = 0"), F.lit(900), F.when(F.col("conv_id") % 5 < 3, "confirm").otherwise("reject"), contact_id=F.col("conv_id")))
    all_ = all_.unionByName(steps(rows.where("turn % 3 > 0"), turn + 901, F.lit("confirm")))
    return fold_batches(all_).select("batch", "step", "card_id", "outcome", "target")
