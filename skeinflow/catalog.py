"""The queries of the library's own operators over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow import registry
from skeinflow.functions import rules
from skeinflow.functions import text as tx
from skeinflow.operators import dedup, match, reads, sessions, snapshots
from skeinflow.registry import AT, Tables, at, query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from skeinflow import catalog_review  # noqa: F401  registers its own
    from skeinflow.plans import fixtures_queries

    return registry.QUERIES | fixtures_queries.queries()


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(registry.SQL)


# --- relational reads


@query(f"""
    SELECT c_custkey, c_name, count(o_orderkey) AS observation_count,
           {AT("max(CASE WHEN o_orderstatus = 'O' THEN o_orderdate END)")} AS last_interaction_at
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def contact_rollup(t: Tables) -> DataFrame:
    rolled = reads.activity_rollup(t.customer.select("c_custkey", "c_name"), t.orders, "c_custkey", "o_custkey", "o_orderkey", F.col("o_orderstatus") == "O", "o_orderdate")
    return rolled.withColumn("last_interaction_at", at("last_interaction_at")).orderBy(F.desc("last_interaction_at"), F.desc("c_custkey"))


@query("SELECT sha256(text) AS sha256, max(doc_id) AS newest_id, count(*) AS copies FROM documents GROUP BY 1")
def hash_latest_match(t: Tables) -> DataFrame:
    return reads.newest_by_hash(t.documents, "text", "doc_id")


@query("SELECT doc_id, source FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_hash_antijoin(t: Tables) -> DataFrame:
    return reads.missing_in(t.documents, t.labels, "doc_id", F.col("text").isNotNull()).select("doc_id", "source")


@query("SELECT p_partkey, p_name, p_brand, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS sort_name FROM part")
def nocase_summaries(t: Tables) -> DataFrame:
    return reads.summaries(t.part, "p_partkey", "p_name", ["p_partkey", "p_name", "p_brand"])


@query(f"""
    SELECT o_orderkey, time_iso, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY time_iso NULLS LAST, o_orderkey DESC) AS INTEGER) AS place
    FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN {AT("o_orderdate")} END AS time_iso FROM orders)""")
def nulls_last_agenda(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", at("o_orderdate")).alias("time_iso"))
    return dedup.top_k(rows, ["o_custkey"], [F.asc_nulls_last("time_iso"), F.desc("o_orderkey")], 1 << 30, "place").drop("o_custkey")


@query(f"SELECT event_id, user_id, {AT('ts')} AS at, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events")
def timeline_rank(t: Tables) -> DataFrame:
    return dedup.top_k(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 1 << 30).select("event_id", "user_id", at("ts").alias("at"), "rank")


@query("""
    SELECT event_id, user_id, rank FROM (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events)
    WHERE rank <= 5""")
def recent_topk(t: Tables) -> DataFrame:
    return dedup.top_k(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id", "rank")


@query("""
    SELECT o_orderkey, a, b FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS a, nullif(CASE WHEN o_orderkey % 3 = 0 THEN 'O' ELSE 'P' END, 'P') AS b FROM orders)
    WHERE a IS NOT DISTINCT FROM b""")
def null_safe_filter(t: Tables) -> DataFrame:
    other = F.when(F.col("o_orderkey") % 3 == 0, "O").otherwise("P")
    rows = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("a"), F.nullif(other, F.lit("P")).alias("b"))
    return reads.same_or_both_null(rows, "a", "b")


@query("""
    SELECT event_id, event_type, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS priority FROM events""")
def exec_order(t: Tables) -> DataFrame:
    return reads.priority_order(t.events.select("event_id", "event_type"), "event_type", ["signup", "purchase", "click"], "event_id")


@query("""
    SELECT 'foreign_key' AS "check", count(*) AS violations FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'enum', count(*) FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'F')""")
def check_fk_validation(t: Tables) -> DataFrame:
    return reads.integrity_report(t.orders, t.customer, "o_custkey", "c_custkey", "o_orderstatus", ["O", "F"])


@query("SELECT event_id, CAST(raw AS BIGINT) AS id FROM (SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 'x' || event_id WHEN event_id % 3 = 1 THEN CAST(event_id AS VARCHAR) ELSE '-' || event_id END AS VARCHAR) AS raw FROM events) WHERE TRY_CAST(raw AS BIGINT) > 0")
def safe_id_filter(t: Tables) -> DataFrame:
    id_ = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), id_)).when(F.col("event_id") % 3 == 1, id_).otherwise(F.concat(F.lit("-"), id_))
    return reads.safe_ids(t.events.select("event_id", raw.alias("raw")), "raw").select("event_id", "id")


# --- matching


@query("""
    WITH people AS (SELECT c_custkey AS pid, CASE WHEN c_custkey % 2 = 0 THEN '  ' || upper(c_name) || ' ' ELSE 'alias ' || c_custkey END AS name FROM customer),
    keys AS (SELECT c_custkey, lower(trim(c_name)) AS k FROM customer UNION SELECT c_custkey, lower('Alias ' || c_custkey) FROM customer)
    SELECT DISTINCT pid, c_custkey FROM people JOIN keys ON lower(trim(name)) = k""")
def exact_name_match(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    name = F.when(key % 2 == 0, F.concat(F.lit("  "), F.upper("c_name"), F.lit(" "))).otherwise(F.concat(F.lit("alias "), key.cast("string")))
    people = t.customer.select(key.alias("pid"), name.alias("name"))
    contacts = t.customer.select("c_custkey", "c_name", F.array(F.concat(F.lit("Alias "), key.cast("string"))).alias("aliases"))
    return match.exact_matches(people, contacts, "pid", "name", "c_custkey", "c_name", "aliases")


@query("""
    WITH p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'segment ' || s_nationkey % 5 ELSE ' ALSO  ' || s_nationkey || ' ' END AS name FROM supplier),
    c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Segment   ' ELSE 'segment ' END || c_nationkey AS c_name, 'also ' || (c_nationkey + c_custkey % 3) AS alias FROM customer),
    k AS (SELECT c_custkey, c_name, lower(regexp_replace(trim(c_name), '\\s+', ' ', 'g')) AS k FROM c UNION SELECT c_custkey, c_name, alias FROM c)
    SELECT s_suppkey, first(c_custkey ORDER BY lower(c_name), c_custkey) AS c_custkey FROM p JOIN k ON lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) = k GROUP BY s_suppkey""")
def first_match(t: Tables) -> DataFrame:
    nation = F.col("s_nationkey")
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("segment "), (nation % 5).cast("string"))).otherwise(F.concat(F.lit(" ALSO  "), nation.cast("string"), F.lit(" ")))
    named = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Segment   ").otherwise("segment "), F.col("c_nationkey").cast("string"))
    contacts = t.customer.select("c_custkey", named.alias("c_name"), F.array(F.concat(F.lit("also "), (F.col("c_nationkey") + F.col("c_custkey") % 3).cast("string"))).alias("aliases"))
    return match.first_match(t.supplier.select("s_suppkey", name.alias("name")), contacts, "s_suppkey", "name", "c_custkey", "c_name", "aliases")


@query("""
    WITH a AS (SELECT CAST(s_suppkey AS VARCHAR) AS x FROM supplier), b AS (SELECT CAST(p_partkey AS VARCHAR) AS y FROM part)
    SELECT x, y FROM a, b WHERE levenshtein(x, y) = 1 AND length(x) >= 2 AND length(y) >= 2 AND (length(x) > 2 OR length(y) = 2)""")
def near_match_edit1(t: Tables) -> DataFrame:
    """All supplier keys against all part keys, as text."""
    a, b = t.supplier.select(F.col("s_suppkey").cast("string").alias("x")), t.part.select(F.col("p_partkey").cast("string").alias("y"))
    return match.near_matches(a.withColumn("kx", F.col("x")), b.withColumn("ky", F.col("y")), "x", "kx", "y", "ky")


@query()
def name_near_match(t: Tables) -> DataFrame:
    """Pairs of all names; a cross join in SQL would be too slow for this."""
    names = t.customer.select(F.col("c_name").alias("name")).union(t.supplier.select("s_name")).union(t.part.select("p_name")).distinct()
    keyed = names.withColumn("key", tx.norm_contact(F.col("name")))
    return match.near_matches(keyed.withColumnRenamed("name", "a"), keyed.withColumnRenamed("name", "b"), "a", "key", "b", "key")


@query()
def unicode_near_match(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(F.array_distinct(F.split("text", "[^\\p{L}]+"))).alias("w")).distinct()
    words = words.select(tx.norm_contact(F.col("w")).alias("key")).where("length(key) >= 2").distinct()
    a, b = words.select(F.col("key").alias("a"), "key"), words.select(F.col("key").alias("b"), "key")
    return match.near_matches(a, b, "a", "key", "b", "key")


_MEETINGS = """SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type WHEN event_id % 4 = 0 THEN NULL ELSE 'meeting' END AS kind,
      CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type || ' about ' || (user_id % 40) || ' and ' || (event_id % 7) END AS title, strftime(ts, '%Y-%m-%d') AS day FROM events"""


@query(f"""
    WITH m AS ({_MEETINGS}),
    n AS (SELECT event_id, coalesce(kind, 'meeting') AS kind, title, day FROM m WHERE event_id % 2 = 0), k AS (SELECT event_id AS kid, kind AS kk, title AS kt, day AS kd FROM m WHERE event_id % 2 = 1),
    e AS (SELECT event_id, count(DISTINCT kid) AS c, min(kid) AS kid FROM n JOIN k ON kind = kk AND title = kt WHERE title <> '' GROUP BY event_id),
    s AS (SELECT event_id, kid FROM n JOIN k ON kind = kk AND day = kd WHERE event_id NOT IN (SELECT event_id FROM e) AND length(title) >= 8 AND length(kt) >= 8
          AND 1 - levenshtein(title, kt) / CAST(greatest(length(title), length(kt)) AS DOUBLE) >= 0.9)
    SELECT event_id, kid, 'exact' AS tier FROM e WHERE c = 1 UNION ALL SELECT event_id, min(kid), 'similar' FROM s GROUP BY event_id HAVING count(DISTINCT kid) = 1""")
def duplicate_event_match(t: Tables) -> DataFrame:
    """Events as new and known meetings, some without a title or a kind."""
    title = F.concat("event_type", F.lit(" about "), (F.col("user_id") % 40).cast("string"), F.lit(" and "), (F.col("event_id") % 7).cast("string"))
    kind = F.when(F.col("event_type") != "view", F.col("event_type")).when(F.col("event_id") % 4 != 0, "meeting")
    m = t.events.select("event_id", kind.alias("kind"), F.when(F.col("event_id") % 13 == 0, "").otherwise(title).alias("title"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    known = m.where("event_id % 2 = 1").withColumnRenamed("event_id", "kid")
    return match.duplicate_meetings(m.where("event_id % 2 = 0"), known, "event_id", "kid", "kind", "title", "day")


@query(f"""
    WITH v AS (SELECT event_id % 97 AS id, {AT('ts')} AS created_at, event_type AS title, CASE WHEN event_type = 'error' THEN 'past' ELSE 'upcoming' END AS status FROM events),
    n AS (SELECT id, max(created_at) AS created_at FROM v WHERE status = 'upcoming' GROUP BY id)
    SELECT id, created_at FROM n ORDER BY created_at DESC, id DESC LIMIT 20""")
def upcoming_candidates(t: Tables) -> DataFrame:
    """Events as versions of meetings: of each the newest, of these the newest 20."""
    from skeinflow.plans.resolve import progress_candidates

    status = F.when(F.col("event_type") == "error", "past").otherwise("upcoming")
    return progress_candidates(t.events.select((F.col("event_id") % 97).alias("id"), at("ts").alias("created_at"), F.col("event_type").alias("title"), status.alias("status"))).select("id", "created_at")


@query("""
    WITH n AS (SELECT event_id, strftime(ts, '%m-%d') AS day, [user_id % 50, user_id % 9] AS names FROM events WHERE event_type = 'view'),
    m AS (SELECT o_orderkey, strftime(o_orderdate, '%m-%d') AS day, [o_custkey % 50, o_custkey % 11] AS names FROM orders WHERE o_orderstatus = 'O'),
    p AS (SELECT DISTINCT event_id, o_orderkey FROM n JOIN m USING (day) WHERE list_has_any(n.names, m.names))
    SELECT event_id, min(o_orderkey) AS o_orderkey FROM p GROUP BY event_id HAVING count(*) = 1""")
def notice_match(t: Tables) -> DataFrame:
    n = t.events.where("event_type = 'view'").select("event_id", F.date_format("ts", "MM-dd").alias("day"), F.expr("array(user_id % 50, user_id % 9)").alias("names"))
    m = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", F.date_format("o_orderdate", "MM-dd").alias("day"), F.expr("array(o_custkey % 50, o_custkey % 11)").alias("names"))
    return match.overlap_matches(n, m, "event_id", "o_orderkey", "day", "names")


@query("""
    SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey
    HAVING bool_and(l_returnflag = 'N') AND count(DISTINCT l_suppkey) = 1""")
def progress_consensus(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_suppkey", F.when(F.col("l_returnflag") == "N", "high").otherwise("low").alias("confidence"))
    return match.progress_targets(rows, "l_orderkey", "l_suppkey", "confidence")


@query("""
    SELECT o_custkey, CASE WHEN bool_and(o_orderstatus <> 'P') AND count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS target
    FROM orders GROUP BY o_custkey""")
def resolution_consensus(t: Tables) -> DataFrame:
    return dedup.consensus(t.orders, ["o_custkey"], F.col("o_orderstatus") != "P", "o_orderpriority")


_KEY = r"lower(regexp_replace({}, '[\p{{P}}\p{{Z}}\x09-\x0D\x{{85}}]+', '', 'g'))".format
#: The letters beyond ASCII of the texts, and for each a byte that no key has: the other engine's edit distance counts bytes.
_LETTERS = "translate({}, 'éçêèüßäöóíñ明天开会，', 'ABCDEFGHIJKLMNOP')".format
_ALIKE = f"1 - levenshtein({_LETTERS('{0}')}, {_LETTERS('{1}')}) / CAST(greatest(length({{0}}), length({{1}})) AS DOUBLE) >= 0.85".format


@query(rf"""
    WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') || CASE WHEN turn % 4 = 0 THEN '，明天 开会' ELSE '' END AS text FROM conversations),
    q AS (SELECT DISTINCT conv_id, CASE turn % 3 WHEN 0 THEN replace(text, 'ion ', 'oin ') WHEN 1 THEN substr(text, 5) ELSE substr(text, 1, 30) || '…' || substr(text, 61) END AS quote FROM c WHERE role = 'user'),
    e AS (SELECT conv_id, turn, {_KEY("text")} AS k FROM c),
    h AS (SELECT conv_id, {_KEY("quote")} AS k, regexp_matches(quote, '\.{{3,}}|…') AS cut,
      list_filter(list_transform(string_split(regexp_replace(quote, '\.{{3,}}|…', chr(1), 'g'), chr(1)), lambda x: {_KEY("x")}), lambda x: length(x) >= 4) AS parts FROM q)
    SELECT conv_id, turn FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.conv_id = e.conv_id AND e.k <> '' AND h.k <> '' AND CASE WHEN cut THEN len(parts) > 0 AND len(list_filter(parts, lambda x: contains(e.k, x))) = len(parts)
      ELSE (least(length(e.k), length(h.k)) >= 8 AND (contains(e.k, h.k) OR contains(h.k, e.k))) OR {_ALIKE("e.k", "h.k")} END)""")
def coverage_antijoin(t: Tables) -> DataFrame:
    """All turns, some with a Chinese sentence behind, against the user turns of their conversation, each
    misspelt, cut or with an ellipsis."""
    more = F.when(F.col("turn") % 4 == 0, "，明天 开会").otherwise("")
    c = t.conversations.select("conv_id", "turn", "role", F.concat(F.coalesce("text", F.lit("")), more).alias("text"))
    text, kind = F.col("text"), F.col("turn") % 3
    elided = F.concat(F.substring(text, 1, 30), F.lit("…"), F.substring(text, F.lit(61), F.length(text)))
    quote = F.when(kind == 0, F.replace(text, F.lit("ion "), F.lit("oin "))).when(kind == 1, F.substring(text, F.lit(5), F.length(text))).otherwise(elided)
    quotes = c.where("role = 'user'").select("conv_id", quote.alias("quote"))
    turns = c.select(F.struct("conv_id", "turn").alias("id"), "conv_id", "turn", "text")
    return match.uncovered(turns, quotes, "id", "conv_id", "text", "quote").select("conv_id", "turn")


@query("""
    WITH i AS (SELECT event_id, event_type || (user_id % 10) AS k, strftime(ts, '%Y-%m-%d') || ' value ' || CAST(floor(value) AS BIGINT) AS quote FROM events)
    SELECT a.event_id, min(b.event_id) AS first FROM i a JOIN i b ON a.k = b.k AND b.event_id < a.event_id
    WHERE 1 - levenshtein(a.quote, b.quote) / CAST(greatest(length(a.quote), length(b.quote)) AS DOUBLE) >= 0.85 GROUP BY a.event_id""")
def batch_duplicates(t: Tables) -> DataFrame:
    """Events as items of 50 batches, which grow with the table."""
    quote = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" value "), F.floor("value").cast("string"))
    items = t.events.select("event_id", F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("k"), quote.alias("quote"))
    return match.batch_duplicates(items, "k", "event_id", "quote")


@query("""
    WITH p AS (SELECT o_orderkey, o_custkey % 20 AS g, [CAST(o_orderkey % 7 AS VARCHAR), CAST(o_orderkey % 11 AS VARCHAR)] AS names FROM orders),
    h AS (SELECT g, names FROM p WHERE list_has_any(names, ['3', '8']))
    SELECT g, array_to_string(list_sort(list_distinct(flatten(list(names)))), ',') AS related FROM h GROUP BY g""")
def related_expansion(t: Tables) -> DataFrame:
    people = t.orders.select((F.col("o_custkey") % 20).alias("g"), F.expr("array(cast(o_orderkey % 7 as string), cast(o_orderkey % 11 as string))").alias("names"))
    seeds = t.spark.sql("SELECT * FROM VALUES ('3'), ('8') AS t(seed)")
    return match.related(people, seeds, "g", "names", "seed").select("g", F.array_join("related", ",").alias("related"))


@query("""
    WITH r AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
    i AS (SELECT event_id, user_id, unnest([k, k + 1, k, 5]) AS ref, unnest([0, 1, 2, 3]) AS pos FROM r), o AS (SELECT DISTINCT user_id, k AS ref FROM r WHERE event_id % 2 = 0),
    f AS (SELECT event_id, ref, min(pos) AS pos FROM i JOIN o USING (user_id, ref) GROUP BY event_id, ref)
    SELECT event_id, string_agg(CAST(ref AS VARCHAR), ',' ORDER BY pos) AS based_on FROM f GROUP BY event_id""")
def grounding(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    insights = rows.select("event_id", "user_id", F.expr("array(k, k + 1, k, 5L)").alias("based_on"))
    found = match.grounded(insights, rows.where("event_id % 2 = 0"), "event_id", "user_id", "based_on", "k")
    return found.select("event_id", F.array_join(F.col("based_on").cast("array<string>"), ",").alias("based_on"))


@query("""
    WITH r AS (SELECT o_custkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS rank FROM orders),
    b AS (SELECT *, min(rank) OVER (PARTITION BY o_custkey) AS best FROM r)
    SELECT o_custkey, min(o_orderpriority) AS o_orderpriority FROM b WHERE rank = best GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 1""")
def status_priority_pick(t: Tables) -> DataFrame:
    return match.one_by_status(t.orders, "o_custkey", "o_orderstatus", ["F", "P", "O"], "o_orderpriority")


# --- aggregation and dedup


@query("SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text")
def first_wins_dedup(t: Tables) -> DataFrame:
    return dedup.keep_first(t.documents.select("text", "doc_id", "source", "lang"), ["text"], ["doc_id"]).select("doc_id", "source", "lang")


@query("""
    SELECT user_id, event_type, min(event_id) AS event_id, arg_min(props, length(props) * 1000000000000 + event_id) AS props FROM events GROUP BY user_id, event_type""")
def content_dedup_shortest(t: Tables) -> DataFrame:
    return dedup.keep_first_shortest(t.events, ["user_id", "event_type"], "event_id", "props")


_SEEN = f"""SELECT user_id AS contact_id, event_id % 50 AS screenshot_id, CASE event_type WHEN 'click' THEN 'fact' WHEN 'view' THEN 'preference' WHEN 'purchase' THEN 'interaction' ELSE 'status_change' END AS kind,
      CASE WHEN event_type = 'error' THEN '公司由 "a" 变为 "' || CAST(floor(value / 10) AS BIGINT) || '"' WHEN event_type = 'click' THEN '公司: ' || CAST(floor(value / 10) AS BIGINT) ELSE 'v' || CAST(floor(value / 10) AS BIGINT) END AS content, repeat('q', CAST(event_id % 13 AS INTEGER) + 1) AS source_quote, {AT("ts")} AS observed_at FROM events"""


@query(f"""
    WITH o AS ({_SEEN}), gone AS (SELECT DISTINCT contact_id, '公司: ' || regexp_extract(content, '变为 "(.*)"$', 1) AS content FROM o WHERE kind = 'status_change' AND starts_with(content, '公司由'))
    SELECT contact_id, kind, content, arg_min(screenshot_id, (observed_at, screenshot_id)) AS screenshot_id, arg_min(source_quote, (length(source_quote), observed_at)) AS source_quote, min(observed_at) AS observed_at
    FROM o WHERE kind IN ('fact', 'preference') AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.contact_id = o.contact_id AND gone.content = o.content) GROUP BY contact_id, kind, content
    UNION ALL SELECT contact_id, kind, arg_min(content, (observed_at, content)), screenshot_id, arg_min(source_quote, (observed_at, content)), min(observed_at) FROM o WHERE kind = 'interaction' GROUP BY contact_id, screenshot_id, kind
    UNION ALL SELECT contact_id, kind, content, screenshot_id, source_quote, min(observed_at) FROM o WHERE kind = 'status_change' GROUP BY contact_id, screenshot_id, kind, content, source_quote""")
def provenance_dedup(t: Tables) -> DataFrame:
    """Events as observations: users as contacts, 50 screenshots."""
    from skeinflow.plans.execute import deduplicated

    kind = F.when(F.col("event_type") == "click", "fact").when(F.col("event_type") == "view", "preference").when(F.col("event_type") == "purchase", "interaction").otherwise("status_change")
    v = F.floor(F.col("value") / 10).cast("string")
    content = F.when(F.col("event_type") == "error", F.concat(F.lit('公司由 "a" 变为 "'), v, F.lit('"'))).when(F.col("event_type") == "click", F.concat(F.lit("公司: "), v)).otherwise(F.concat(F.lit("v"), v))
    seen = t.events.select(F.col("user_id").alias("contact_id"), (F.col("event_id") % 50).alias("screenshot_id"), kind.alias("kind"), content.alias("content"), F.repeat(F.lit("q"), (F.col("event_id") % 13 + 1).cast("int")).alias("source_quote"), at("ts").alias("observed_at"))
    return deduplicated(seen)


@query("""
    WITH f AS (SELECT conv_id, text, min(turn) AS turn FROM (SELECT conv_id, turn, trim(text, ' \n\t\r') AS text FROM conversations) WHERE text <> '' GROUP BY conv_id, text)
    SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS joined FROM f GROUP BY conv_id""")
def ordered_quotes(t: Tables) -> DataFrame:
    return dedup.ordered_join(t.conversations, ["conv_id"], ["turn"], "text").select("conv_id", F.md5("joined").alias("joined"))


@query("""
    WITH s AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[。！？!?.\n]'), lambda x: trim(x, ' \t\r\n')), lambda x: contains(x, ' th') AND x <> '') AS parts FROM documents),
    e AS (SELECT doc_id, min(length(p)) AS n FROM (SELECT doc_id, unnest(parts) AS p FROM s) GROUP BY doc_id)
    SELECT doc_id, md5(coalesce(list_filter(parts, lambda x: length(x) = n)[1], text)) AS sentence FROM s LEFT JOIN e USING (doc_id)""")
def shortest_sentence(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.shortest_sentence(F.col("text"), F.lit(" th"))).alias("sentence"))


@query("""
    SELECT lang, CASE max(CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
    FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def confidence_max(t: Tables) -> DataFrame:
    rank = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "high").when(F.col("quality") == 1, "medium").otherwise("low")
    return dedup.highest_confidence(t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").withColumn("c", rank), ["lang"], "c")


@query("""
    WITH c AS (SELECT l_partkey, l_quantity, count(*) AS votes, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY l_partkey, l_quantity)
    SELECT l_partkey, l_quantity AS peak, votes FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, f, l_quantity) = 1""")
def mode_peak(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return dedup.mode_peak(rows, ["l_partkey"], "l_quantity", "pos")


@query("SELECT user_id, round(count(*) FILTER (value < 50) / count(*)::DOUBLE, 9) AS share, count(*) FILTER (value < 50) / count(*)::DOUBLE > 0.6 AS flagged FROM events GROUP BY user_id")
def ratio_threshold(t: Tables) -> DataFrame:
    return dedup.share_over(t.events, ["user_id"], F.col("value") < 50, 0.6).withColumn("share", F.round("share", 9))


@query("""
    SELECT user_id, count(*) FILTER (value > 80) AS n_bright, round(CASE WHEN count(*) FILTER (value > 80) >= 20 THEN median(value) FILTER (value > 80) ELSE median(value) END, 6) AS median
    FROM events GROUP BY user_id""")
def median_guard(t: Tables) -> DataFrame:
    return dedup.guarded_median(t.events, ["user_id"], "value", F.col("value") > 80, 20).withColumn("median", F.round("median", 6))


@query("""
    SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_ok, count(*) FILTER (o_orderstatus = 'P') AS n_failed,
           CASE WHEN count(*) FILTER (o_orderstatus = 'P') = 0 THEN 'success' WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'failed' ELSE 'partial_success' END AS status
    FROM orders GROUP BY o_custkey""")
def batch_status(t: Tables) -> DataFrame:
    return dedup.batch_status(t.orders, ["o_custkey"], F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P")


@query("""
    SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS event_type, arg_max(props, event_id) AS props
    FROM events GROUP BY user_id""")
def last_writer_merge(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("event_type"), "props")
    return dedup.last_writer(rows, ["user_id"], ["event_id"], ["event_type", "props"])


@query("""
    WITH q AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY user_id, event_type)
    SELECT q.user_id, max(m) AS event_id, string_agg(event_type, ',' ORDER BY f) AS quotes FROM q JOIN (SELECT user_id, max(event_id) AS m FROM events GROUP BY user_id) USING (user_id) GROUP BY q.user_id""")
def evidence_merge(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.array("event_type").alias("quotes"))
    return dedup.merged_evidence(rows, "user_id", "event_id", "quotes").withColumn("quotes", F.array_join("quotes", ","))


# --- windows


@query("""
    WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM events),
    l AS (SELECT *, max(session) OVER (PARTITION BY user_id) AS m FROM s)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_rows, arg_max(event_type, struct_pack(a := ts, b := event_id)) <> 'view' AS abnormal FROM l WHERE session = m GROUP BY user_id, session""")
def session_tail(t: Tables) -> DataFrame:
    return sessions.session_tail(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "view")


@query("""
    WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 21600 THEN 1 ELSE 0 END AS n FROM events)
    SELECT event_id, user_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS gap_group FROM g""")
def gap_groups(t: Tables) -> DataFrame:
    gap = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.col("_prev.ts").cast("timestamp")) / 1e6
    return sessions.gap_groups(t.events, "user_id", ["ts", "event_id"], gap, 21600).select("event_id", "user_id", "gap_group")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def retention_lastn(t: Tables) -> DataFrame:
    return sessions.newest(t.events.select("event_id", "event_type", "ts"), [F.desc("ts"), F.desc("event_id")], 200).drop("ts")


@query("""
    WITH e AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM events)
    SELECT event_id, user_id, bool_or(event_type = 'error') OVER (PARTITION BY user_id, era ORDER BY ts, event_id) AS flag FROM e""")
def sticky_flag(t: Tables) -> DataFrame:
    return sessions.sticky_flag(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "signup").select("event_id", "user_id", "flag")


@query("""
    WITH r AS (SELECT event_id, user_id, event_id % 3 > 0 AS placed, value FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, placed ORDER BY event_id) AS s, row_number() OVER (PARTITION BY user_id, placed ORDER BY value, event_id) AS g FROM r)
    SELECT a.event_id, CASE WHEN a.placed THEN b.event_id ELSE a.event_id END AS new_slot FROM k a JOIN k b ON a.user_id = b.user_id AND a.placed = b.placed AND a.g = b.s""")
def slot_reorder(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "value")
    return sessions.slot_reorder(rows, "user_id", "event_id", F.col("event_id") % 3 > 0, ["value"]).select("event_id", "new_slot")


# --- text and rules


_SPACE = r"\p{Z}\x09-\x0D\x{85}"


@query(rf"""
    SELECT doc_id, md5(lower(regexp_replace(regexp_replace(text, '^[{_SPACE}\x{{FEFF}}]+|[{_SPACE}\x{{FEFF}}]+$', '', 'g'), '[{_SPACE}]+', ' ', 'g'))) AS lookup, length(text) AS n, substr(text, 1, 120) AS head FROM documents""")
def norm_text(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", F.md5(tx.norm_lookup(c)).alias("lookup"), F.length(c).cast("long").alias("n"), tx.truncated(c, 120).alias("head"))


@query(rf"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[\p{{P}}{_SPACE}]+'), lambda x: x <> '')) AS n_tokens FROM documents WHERE text IS NOT NULL")
def tokenize(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(r"""
    WITH d AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN '明天の会議' WHEN 1 THEN '한글' ELSE '' END AS text FROM documents)
    SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) AS letters, round(len(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]')) / greatest(len(regexp_extract_all(text, '\p{L}')), 1)::DOUBLE, 12) AS cjk FROM d""")
def letter_ratio(t: Tables) -> DataFrame:
    """All documents, two thirds of them with some CJK letters behind."""
    kind = F.col("doc_id") % 3
    d = t.documents.select("doc_id", F.concat("text", F.when(kind == 0, "明天の会議").when(kind == 1, "한글").otherwise("")).alias("text"))
    return d.select("doc_id", F.regexp_count("text", F.lit("\\p{L}")).cast("long").alias("letters"), F.round(tx.cjk_ratio(F.col("text")), 12).alias("cjk"))


#: Phrases that the rules are about, and some that they are not about.
PHRASES = [
    "【通知】评审会议改到周四", "通 知：大家开会", "会议 时间调整为 3 点", "联系客户-确认", "对接 一下", "合同已 提交", "王总到了", "晚到十分钟，等我", "想提交合同", "地点换到三楼", "今天天气不错", "参加会议",
]
_PHRASED = f"SELECT *, {PHRASES!r}[(conv_id + turn) % {len(PHRASES)} + 1] AS phrase FROM conversations"
_WORDS = lambda ws: "|".join(ws)


@query(rf"""
    WITH c AS ({_PHRASED}), k AS (SELECT conv_id, turn, phrase, {_KEY("phrase || text")} AS title, {_KEY("phrase")} AS quote FROM c)
    SELECT conv_id, turn, regexp_matches(title, '^({_WORDS(rules.NOTICE_STARTS)})|{_WORDS(rules.NOTICE_WORDS)}') OR regexp_matches(quote, '^({_WORDS(rules.NOTICE_STARTS)})|{_WORDS(rules.NOTICE_WORDS)}') AS notice,
      regexp_matches(title, '{_WORDS(rules.CHANGE_WORDS)}') AS change, conv_id % 2 = 0 AND regexp_matches(title, '{_WORDS(rules.TIMELESS_WORDS)}') AS timeless,
      length(phrase) <= 60 AND regexp_matches(phrase, '{_WORDS(rules.LOGISTICS_WORDS)}') AS logistics, regexp_matches(phrase, '{_WORDS(f"({p})" for p in rules.PROGRESS)}') AS progress,
      CASE WHEN regexp_matches(phrase, '{_WORDS(rules.PREFERENCE_WORDS)}') THEN 'preference' ELSE 'fact' END AS observed FROM k""")
def classifier_flags(t: Tables) -> DataFrame:
    """The rules on all turns, each behind one of the phrases."""
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), ((F.col("conv_id") + F.col("turn")) % len(PHRASES)).cast("int"))
    c = t.conversations.select("conv_id", "turn", "text", phrase.alias("phrase"))
    title, p, kind = F.concat("phrase", "text"), F.col("phrase"), F.lit("other")
    return c.select(
        "conv_id", "turn", rules.meeting_notice(kind, title, p).alias("notice"), rules.meeting_change(title).alias("change"),
        rules.timeless_communication(kind, F.lit(False), F.when(F.col("conv_id") % 2 == 1, "room").otherwise("　"), title).alias("timeless"),
        rules.meeting_logistics(p).alias("logistics"), rules.direct_progress(p).alias("progress"), rules.observation_kind(p).alias("observed"),
    )


@query(r"""
    WITH w AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z]', '', 'g') AS k FROM conversations)
    SELECT conv_id, turn, length(k) <= 2 OR k IN ('the', 'noted', 'thanks') OR (length(k) >= 4 AND (levenshtein(k, 'noted') <= 1 OR levenshtein(k, 'thanks') <= 1)) AS acknowledged FROM w""")
def ack_filter(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("k", F.regexp_replace(F.lower("text"), "[^a-z]", ""))
    return rows.select("conv_id", "turn", rules.acknowledges(F.col("k"), ["the", "noted", "thanks"], 4).alias("acknowledged"))


_LABELLED = r"'^([^:：\n\d]{1,20})[:：]\s*([^\n\r\x{2028}\x{2029}]*)$'"


@query(rf"""
    WITH q AS (SELECT conv_id, turn, role || CASE turn % 4 WHEN 0 THEN ': ' WHEN 1 THEN ' 组：' WHEN 2 THEN chr(10) || '：' ELSE '7: ' END || replace(text, chr(10), CASE WHEN turn % 3 = 0 THEN ' ' ELSE chr(10) END) AS quote FROM conversations)
    SELECT conv_id, turn, regexp_extract(quote, {_LABELLED}, 1) AS label, md5(coalesce({_KEY(f"nullif(regexp_extract(quote, {_LABELLED}, 1), '')")}, '')) AS label_key,
      md5({_KEY(f"CASE WHEN regexp_extract(quote, {_LABELLED}, 1) <> '' THEN regexp_extract(quote, {_LABELLED}, 2) ELSE quote END")}) AS content_key FROM q""")
def evidence_label(t: Tables) -> DataFrame:
    turn = F.col("turn")
    mark = F.when(turn % 4 == 0, ": ").when(turn % 4 == 1, " 组：").when(turn % 4 == 2, "\n：").otherwise("7: ")
    text = F.when(turn % 3 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(" "))).otherwise(F.col("text"))
    q = t.conversations.select("conv_id", "turn", F.concat("role", mark, text).alias("quote"))
    c = F.col("quote")
    return q.select("conv_id", "turn", tx.label_of(c).alias("label"), F.md5(F.coalesce(tx.label_key(c), F.lit(""))).alias("label_key"), F.md5(tx.content_key(c)).alias("content_key"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) > 50 AS over FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_props(t: Tables) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return t.events.select("event_id", k.alias("k"), (k > 50).alias("over")).where("k is not null")


# --- snapshots


@query("""
    WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS k, coalesce(text, '') AS text FROM conversations)
    SELECT conv_id, turn, CASE WHEN k = 1 THEN 'quotes: mood: unknown' WHEN k = 4 THEN 'json' ELSE array_to_string(list_sort(list_filter([
      CASE k WHEN 2 THEN 'quotes: speaker_name: missing' WHEN 3 THEN 'quotes: speaker_name: type' END, CASE WHEN text = '' THEN 'quotes: text: empty' END, CASE WHEN text = '' THEN 'quotes: source_quote: empty' END], lambda x: x IS NOT NULL)), '|') END AS errors FROM c""")
def strict_documents(t: Tables) -> DataFrame:
    """Turns as documents of one quote: whole, with a key too many, without one, with a number for a name, cut, and
    with null for a name."""
    from skeinflow.functions.strict import document_errors
    from skeinflow.plans.evidence import STRICT

    k, text = (F.col("conv_id") + F.col("turn")) % 6, F.coalesce("text", F.lit(""))
    head = F.when(k == 1, '"mood":1,"speaker_name":"a",').when(k == 2, "").when(k == 3, '"speaker_name":7,').when(k == 5, '"speaker_name":null,').otherwise('"speaker_name":"a",')
    body = F.regexp_replace(F.to_json(F.struct(text.alias("text"), text.alias("source_quote"))), "^\\{", "")
    raw = F.concat(F.lit('{"quotes":[{'), head, body, F.when(k == 4, "").otherwise("]}"))
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_sort(document_errors(raw, STRICT)), "|").alias("errors"))


_NEW = "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END"


@query(f"""
    WITH n AS (SELECT c_custkey, c_name, {_NEW} AS seg, c_nationkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS nat, c_mktsegment, c_nationkey FROM customer)
    SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS old, seg AS new FROM n WHERE c_mktsegment IS DISTINCT FROM seg
    UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR), CAST(nat AS VARCHAR) FROM n WHERE c_nationkey IS DISTINCT FROM nat""")
def change_map(t: Tables) -> DataFrame:
    new = t.customer.withColumns({"c_mktsegment": F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")), "c_nationkey": F.col("c_nationkey") + F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(0)})
    return snapshots.changes(t.customer, new, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query("""
    WITH b AS (SELECT conv_id, turn, list_filter(list_transform(string_split(replace(text, '.', ';'), ';'), lambda x: trim(x)), lambda x: x <> '') AS f FROM (SELECT conv_id, turn, replace(coalesce(text, ''), chr(10), ';') AS text FROM conversations))
    SELECT a.conv_id, a.turn, md5(array_to_string(list_distinct_ordered, '；')) AS agenda FROM (
      SELECT x.conv_id, x.turn, list_filter(list_concat(x.f, y.f), lambda e, i: list_position(list_concat(x.f, y.f), e) = i) AS list_distinct_ordered
      FROM b x JOIN b y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1) a""")
def agenda_append(t: Tables) -> DataFrame:
    """Each turn as an agenda to which the next one is added."""
    turns = t.conversations.select("conv_id", "turn", F.translate("text", ".", ";").alias("f"))
    a, b = turns.withColumnRenamed("f", "a"), turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("f").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.md5(snapshots.appended(F.col("a"), F.col("b"))).alias("agenda"))


@query("""
    WITH RECURSIVE o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'pending' AS status, n FROM o UNION ALL
      SELECT o.user_id, o.i, CASE WHEN f.status = 'pending' AND event_type = 'purchase' THEN 'confirmed' WHEN f.status = 'pending' AND event_type = 'error' THEN 'rejected' WHEN f.status = 'rejected' AND event_type = 'signup' THEN 'pending' ELSE f.status END, f.n
      FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
    SELECT user_id, status, n AS n_events FROM f WHERE i = n""")
def state_fold(t: Tables) -> DataFrame:
    legal = {("pending", "purchase"): "confirmed", ("pending", "error"): "rejected", ("rejected", "signup"): "pending"}
    return snapshots.folded_status(t.events, "user_id", ["ts", "event_id"], "event_type", legal, "pending")


@query("""
    WITH d AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'R' THEN 'O' END AS expected, min('s' || l_linenumber) AS status FROM lineitem GROUP BY 1, 2)
    SELECT o_orderkey AS id, coalesce(d.status, o_orderstatus) AS status FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders) LEFT JOIN d ON d.id = o_orderkey AND d.expected IS NOT DISTINCT FROM o_orderstatus""")
def compare_and_set(t: Tables) -> DataFrame:
    """Items as decisions on their orders, which count where the order's status is the one they expect."""
    from skeinflow.sources.library import reviewed

    expected = F.when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "R", "O")
    decisions = t.lineitem.select(F.col("l_orderkey").alias("id"), expected.alias("expected"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("status"))
    return reviewed(t.orders.select(F.col("o_orderkey").cast("long").alias("id"), F.nullif("o_orderstatus", F.lit("P")).alias("status")), decisions)


@query("""
    SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 1 - quality, 0 FROM labels WHERE doc_id % 5 = 0""")
def replace_by_key(t: Tables) -> DataFrame:
    new = t.labels.where("doc_id % 5 = 0").select("doc_id", (1 - F.col("quality")).cast("int").alias("quality"), F.lit(0).cast("int").alias("toxic"))
    return snapshots.replaced(t.labels, new, "doc_id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'new ' || s_name ELSE s_name END AS s_name, s_nationkey FROM supplier")
def overlay_latest(t: Tables) -> DataFrame:
    base = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    latest = base.where("s_suppkey % 4 = 0").withColumn("s_name", F.concat(F.lit("new "), F.col("s_name")))
    return snapshots.overlaid(base, latest, "s_suppkey")


@query("""
    SELECT 'orders' AS "table", count(*) AS rows FROM orders WHERE o_custkey % 7 <> 0
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0)""")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.customer.where("c_custkey % 7 = 0").unionByName(t.orders.where("o_custkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey")), allowMissingColumns=True).select("c_custkey").distinct()
    orders = snapshots.without({"o": (t.orders, "o_custkey")}, gone, "c_custkey")["o"]
    gone_orders = t.orders.join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    items = snapshots.without({"l": (t.lineitem, "l_orderkey")}, gone_orders, "o_orderkey")["l"]
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
    return count(orders, "orders").unionByName(count(items, "lineitem"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type")
def upsert_latest(t: Tables) -> DataFrame:
    return snapshots.upserted(t.events.select("user_id", "event_type", "event_id", "props"), ["user_id", "event_type"], ["event_id"])


@query("SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def hash_backfill(t: Tables) -> DataFrame:
    return snapshots.backfilled(t.labels.select("doc_id", "quality"), t.documents.select("doc_id", F.lit(-1).alias("quality")), "doc_id")


@query("""
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_name END AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN 7 ELSE s_nationkey END AS s_nationkey FROM supplier""")
def edit_patch(t: Tables) -> DataFrame:
    base = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    key = F.col("s_suppkey")
    patch = base.select("s_suppkey", F.lit(None).cast("string").alias("s_name"), F.lit(7).alias("s_nationkey"), (key % 2 == 0).alias("has_s_name"), (key % 3 == 0).alias("has_s_nationkey"))
    return snapshots.patched(base, patch, "s_suppkey", ["s_name", "s_nationkey"])


@query("""
    WITH a AS (SELECT event_id % 500 AS k, event_id, 0 AS l FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id % 500, event_id, 1 FROM events WHERE event_id % 2 = 1 OR event_id % 500 < 100)
    SELECT k, event_id FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY l, event_id) = 1""")
def newest_first_merge(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("event_id") % 500).alias("k"), "event_id")
    return snapshots.newest_first([rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1 or k < 100")], "k", "event_id")


# --- batches: orders as cards, customers as batches


@query("""
    WITH c AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status, o_custkey AS r FROM orders),
    d AS (SELECT l_orderkey * 10 + l_linenumber AS card_id, l_orderkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END AS a FROM lineitem)
    SELECT card_id, a AS anchor_card_id, CASE status WHEN 'confirmed' THEN r WHEN 'pending' THEN -a END AS contact_id FROM d LEFT JOIN c ON c.id = a""")
def anchor_resolution(t: Tables) -> DataFrame:
    from skeinflow.operators.batch import resolved_anchors

    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    cards = t.orders.select(F.col("o_orderkey").cast("long").alias("id"), status.alias("status"), F.col("o_custkey").alias("resolved_contact_id"))
    far = F.when(F.col("l_linenumber") == 7, 100_000_000).otherwise(0)
    waits = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("card_id"), (F.col("l_orderkey") + far).alias("anchor_card_id"))
    return resolved_anchors(waits, cards)


@query("""
    SELECT a AS anchor_card_id, count(*) AS waiting FROM (SELECT DISTINCT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS a FROM events WHERE event_type = 'view') GROUP BY a""")
def pending_dependents(t: Tables) -> DataFrame:
    from skeinflow.operators.batch import pending_dependents as waiting

    deps = F.concat(F.lit('[{"kind":"x","anchor_card_id":'), F.get_json_object("props", "$.k"), F.lit("}]"))
    kind = F.when(F.col("event_type") == "view", "record_interaction").otherwise("create_contact")
    return waiting(t.events.select(F.col("event_id").alias("id"), kind.alias("type"), F.lit("pending").alias("status"), deps.alias("disambiguation")))


@query("""
    WITH u AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k, min(doc_id) OVER (PARTITION BY text) AS original FROM documents)
    SELECT doc_id AS screenshot_id, original, coalesce((SELECT count(*) FROM labels l WHERE l.doc_id = original AND l.quality = 0), 0) AS pending FROM u WHERE k > 1""")
def duplicate_uploads(t: Tables) -> DataFrame:
    from skeinflow.operators.batch import duplicate_uploads as repeats

    uploads = t.documents.select(F.col("doc_id").alias("upload_no"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("screenshot_id"))
    cards = t.labels.select(F.col("doc_id").alias("screenshot_id"), F.when(F.col("quality") == 0, "pending").otherwise("confirmed").alias("status"))
    return repeats(uploads, cards).select("screenshot_id", "original", "pending")


@query("""
    WITH a AS (SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS anchor FROM events) SELECT event_id AS id, anchor FROM a""")
def batch_anchors(t: Tables) -> DataFrame:
    from skeinflow.operators.batch import anchors

    cards = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("batch"), F.concat(F.lit(" "), F.upper("event_type")).alias("name"))
    return anchors(cards).select("id", "anchor")


@query("""
    WITH r AS (SELECT o_orderkey AS card_id, o_custkey AS s, -1 AS pos FROM orders UNION ALL SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem),
    f AS (SELECT card_id, s, min(pos) AS pos FROM r GROUP BY card_id, s)
    SELECT card_id, string_agg(coalesce(s_name, CAST(s AS VARCHAR)), ',' ORDER BY pos, s) AS sources FROM f LEFT JOIN supplier ON s_suppkey = s GROUP BY card_id""")
def card_lineage(t: Tables) -> DataFrame:
    from skeinflow.operators.batch import lineage

    cards = t.orders.select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").alias("screenshot_id"))
    more = t.lineitem.select(F.col("l_orderkey").alias("card_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("screenshot_id"))
    labels = t.supplier.select(F.col("s_suppkey").alias("screenshot_id"), F.col("s_name").alias("label"))
    return lineage(cards, more, labels).withColumn("sources", F.array_join("sources", ","))


@query("""
    SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(o_orderpriority) ELSE string_agg(o_orderstatus || '：' || o_orderpriority, '；' ORDER BY o_orderkey) END AS notice FROM orders GROUP BY o_custkey""")
def notice_concat(t: Tables) -> DataFrame:
    from skeinflow.operators.batch import notices

    return notices(t.orders, "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""
    SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS done, count(*) AS total, bool_and(o_orderstatus <> 'P') AS settled, min(CAST(o_orderkey AS BIGINT)) FILTER (o_orderstatus = 'P') AS next FROM orders GROUP BY o_custkey""")
def batch_progress(t: Tables) -> DataFrame:
    from skeinflow.operators.batch import progress

    status = F.when(F.col("o_orderstatus") == "P", "open").otherwise("success")
    return progress(t.orders.select("o_custkey", F.col("o_orderkey").cast("long").alias("o_orderkey"), status.alias("status")), "o_custkey", "o_orderkey", "status")


# --- layouts: events as lines of a page, users as images


def _lines(t: Tables) -> DataFrame:
    x = F.when(F.col("event_id") % 3 == 0, 20.0).when(F.col("event_id") % 3 == 1, 22.0).otherwise(400.0)
    w = F.when(F.col("event_id") % 3 == 2, 560.0).otherwise(300.0 + F.col("event_id") % 2)
    return t.events.select(F.col("user_id").alias("screenshot_id"), F.col("event_id").cast("int").alias("pos"), F.col("event_type").alias("text"), (F.col("value") / 100).alias("confidence"), x.alias("x"), (F.col("event_id") % 977 * 1.0).alias("y"), w.alias("width"), F.lit(30.0).alias("height"), F.lit(True).alias("placed"))


@query("""
    SELECT user_id AS screenshot_id, round(count(*) FILTER (value / 100 < 0.5) / count(*)::DOUBLE, 9) AS share, count(*) FILTER (value / 100 < 0.5) / count(*)::DOUBLE > 0.6 AS poor FROM events GROUP BY user_id""")
def ocr_quality(t: Tables) -> DataFrame:
    from skeinflow.operators.geometry import poor_quality

    return poor_quality(_lines(t)).withColumn("share", F.round("share", 9))


@query("""
    WITH l AS (SELECT user_id AS screenshot_id, event_id, CASE event_id % 3 WHEN 0 THEN 20.0 WHEN 1 THEN 22.0 ELSE 400.0 END AS x, CASE WHEN event_id % 3 = 2 THEN 560.0 ELSE 300.0 + event_id % 2 END AS w FROM events),
    a AS (SELECT screenshot_id, x AS v, count(*) AS n, min(event_id) AS f FROM l WHERE x < 500 GROUP BY screenshot_id, x QUALIFY row_number() OVER (PARTITION BY screenshot_id ORDER BY count(*) DESC, min(event_id), x) = 1),
    b AS (SELECT screenshot_id, x + w AS v, count(*) AS n, min(event_id) AS f FROM l WHERE x + w > 500 GROUP BY screenshot_id, x + w QUALIFY row_number() OVER (PARTITION BY screenshot_id ORDER BY count(*) DESC, min(event_id), x + w) = 1)
    SELECT screenshot_id, CAST(a.v AS DOUBLE) AS left_peak, CAST(b.v AS DOUBLE) AS right_peak FROM a FULL JOIN b USING (screenshot_id)""")
def alignment_peaks(t: Tables) -> DataFrame:
    from skeinflow.operators.geometry import alignment_peaks as peaks

    return peaks(_lines(t), 1000.0)


@query()
def bubble_grouping(t: Tables) -> DataFrame:
    from skeinflow.operators import geometry

    lines = _lines(t)
    return geometry.bubble_sides(geometry.bubbles(lines), geometry.alignment_peaks(lines, 1000.0))


@query("""
    SELECT user_id, event_type, CASE WHEN r - 0 > 245 AND g > 245 AND b > 245 AND NOT g - b > 40 THEN 'them' WHEN g - b > 40 THEN 'me' END AS side FROM (
      SELECT user_id, event_type, CASE WHEN n >= 20 THEN rb ELSE ra END AS r, CASE WHEN n >= 20 THEN gb ELSE ga END AS g, CASE WHEN n >= 20 THEN bb ELSE ba END AS b FROM (
        SELECT user_id, event_type, count(*) FILTER (x) AS n, median(r) AS ra, median(g) AS ga, median(b) AS ba, median(r) FILTER (x) AS rb, median(g) FILTER (x) AS gb, median(b) FILTER (x) AS bb
        FROM (SELECT *, r + g + b > 450 AS x FROM (SELECT user_id, event_type, event_id % 256 AS r, event_id * 7 % 256 AS g, event_id * 13 % 256 AS b FROM events)) GROUP BY user_id, event_type))""")
def region_colors(t: Tables) -> DataFrame:
    from skeinflow.operators.geometry import sampled_colors

    pixels = t.events.select("user_id", "event_type", (F.col("event_id") % 256).alias("r"), (F.col("event_id") * 7 % 256).alias("g"), (F.col("event_id") * 13 % 256).alias("b"))
    return sampled_colors(pixels, ["user_id", "event_type"]).select("user_id", "event_type", "side")


# --- streams and sources


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, md5(text) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM (SELECT doc_id, replace(replace(replace(replace(text, '. ', '.' || chr(13)), ', ', ',' || chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents)) WHERE trim(text, ' \t') <> ''")
def pasted_text_lines(t: Tables) -> DataFrame:
    from skeinflow.sources.tables import pasted_lines

    # both kinds of foreign line ends, made of the sentences
    rows = t.documents.select("doc_id", F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\r")), F.lit(", "), F.lit(",\r\n")).alias("text"))
    return pasted_lines(rows, "doc_id", "text").select("doc_id", "pos", F.md5("text").alias("line"))


@query(f"""
    SELECT {AT('ts')} AS at, unnest(CASE WHEN event_type = 'click' THEN [event_type, 'mem'] ELSE [event_type] END) AS kind FROM events WHERE event_type IN ('click', 'view')""")
def log_samples(t: Tables) -> DataFrame:
    from skeinflow.streaming import logs

    log = t.events.select(F.col("ts").alias("t"), F.col("event_type").alias("kind"), F.col("props").alias("detail"))
    return logs.with_samples(logs.accepted(log, ["click", "view"]), "click").select(at("t").alias("at"), "kind")
