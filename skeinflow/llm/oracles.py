"""SQL that computes the results of the queries that SQL can express."""

from __future__ import annotations

from skeinflow.llm.chat_format import ChatConfig
from skeinflow.llm.quality_rules import CLASSES, QualityConfig

_CHAT = ChatConfig()
_ESCAPED = r"(length({0}) + length({0}) - length(replace({0}, '\', '')) + len(regexp_extract_all({0}, '<\||</?s>|<</?SYS>>|\[/?INST\]')))".format
_DIGEST = "sha256(coalesce(string_agg({0}, '' ORDER BY no){1}, ''))".format

OP1 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM (SELECT unnest([0, 1]) AS i)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS no,
  len(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}]+|[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]')) + {_CHAT.turn_overhead} AS tokens,
  27 + {_ESCAPED("role")} + {_ESCAPED("text")} AS chars FROM t),
s AS (SELECT *, no = 1 AND role = 'system' AS sys FROM n),
e AS (SELECT *, CASE WHEN sys THEN 0 ELSE tokens END AS new, max(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS head, max(CASE WHEN sys THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS head_chars FROM s),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY no) AS upto, greatest({_CHAT.budget - _CHAT.history} - head, {_CHAT.least_room}) AS room FROM e),
b AS (SELECT *, CAST(floor(greatest(upto - 1, 0) / room) AS BIGINT) AS block FROM r),
d AS (SELECT *, NOT sys AND upto - new < block * room AND sum(new) OVER (PARTITION BY conv_id, block) > room AS alone FROM b),
w AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY block, CASE WHEN alone THEN 0 ELSE 1 END) - 1 AS win,
  lag(tokens, 1) OVER c AS t1, lag(chars, 1) OVER c AS c1, lag(sys, 1) OVER c AS s1, lag(tokens, 2) OVER c AS t2, lag(chars, 2) OVER c AS c2, lag(sys, 2) OVER c AS s2 FROM d WINDOW c AS (PARTITION BY conv_id ORDER BY no)),
o AS (SELECT *, win > 0 AND row_number() OVER (PARTITION BY conv_id, win ORDER BY no) = 1 AS opens FROM w)
SELECT conv_id, count(*) AS n_turns, {_DIGEST("role || chr(10) || text || chr(10)", "")} AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, {_DIGEST("text", " FILTER (role = 'assistant')")} AS loss_sha256,
  CAST(sum(chars + CASE WHEN opens THEN head_chars + CASE WHEN NOT s1 AND t1 <= {_CHAT.history} THEN c1 ELSE 0 END
    + CASE WHEN NOT s2 AND t1 + t2 <= {_CHAT.history} THEN c2 ELSE 0 END ELSE 0 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id"""

_Q = QualityConfig()
_COUNT = "length(regexp_replace(t, '[^{0}]+', '', 'g'))".format
_SPACE = "length(t) - length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))"
_CLASS = [_COUNT(c.replace("'", "''")) for c in CLASSES.values()] + [_SPACE]
_SUM = "(SELECT lang, list(v ORDER BY i) AS {1} FROM (SELECT lang, i, sum(x) AS v FROM (SELECT lang, unnest({0}) AS x, unnest(range(len({0}))) AS i FROM b WHERE lang IS NOT NULL AND NOT base_failed AND n_words >= {2}) GROUP BY lang, i) GROUP BY lang)".format


def _distance(hist: str, ref: str) -> str:
    term = "CASE WHEN x.{0} > 0 THEN x.{0} * log2(2 * x.{0} / (x.p + x.q)) ELSE 0 END"
    pairs = f"list_transform(range(1, len({hist}) + 1), lambda i: struct_pack(p := {hist}[i] / CAST(list_sum({hist}) AS DOUBLE), q := {ref}[i] / CAST(list_sum({ref}) AS DOUBLE)))"
    both = f"list_sum(list_transform({pairs}, lambda x: {term.format('p')} + {term.format('q')}))"
    return f"CASE WHEN list_sum({hist}) > 0 THEN sqrt(greatest(0, {both} / 2)) ELSE 1 END"


OP6 = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 4], ' ')) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM s)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM g JOIN (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1) USING (doc_id, gram)) GROUP BY doc_id),
k AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(w)) AS word FROM s WHERE lang IS NOT NULL AND len(w) >= {_Q.min_words}) GROUP BY lang, word)),
u AS (SELECT coalesce(list(DISTINCT word ORDER BY word), []) AS words FROM k WHERE place <= {_Q.common}),
e AS (SELECT s.*, list_transform(words, lambda x: len(list_filter(w, lambda y: y = x))) AS counts FROM s, u),
f AS (SELECT e.doc_id, lang, len(w) AS n_words, length(t) - ({_SPACE}) AS word_chars, {_COUNT(CLASSES["symbol"])} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  [{", ".join(_CLASS)}, length(t) - ({" + ".join(f"({x})" for x in _CLASS)})] AS ch, list_append(counts, len(w) - coalesce(list_sum(counts), 0)) AS wh FROM e LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
r AS {_SUM("ch", "rc", _Q.min_words)},
q AS {_SUM("wh", "rw", _Q.min_words)},
j AS (SELECT doc_id, {_distance("ch", "rc")} AS jc, {_distance("wh", "rw")} AS jw, {_Q.slack} / sqrt(greatest(n_words, 1)) AS noise FROM b, r JOIN q USING (lang)),
h AS (SELECT doc_id, bool_or(jc <= {_Q.max_class_distance} + noise AND jw <= {_Q.max_word_distance} + noise) AS near FROM j GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (n_words < {_Q.min_words} OR coalesce(near, true)) AS kept
FROM b LEFT JOIN h USING (doc_id)"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TERMS} AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v))),
h AS (SELECT doc_id, i, k, item FROM g JOIN v USING (k, gram)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

_PIECE = rf"unnest(regexp_split_to_array(coalesce({_LOWER}, ''), '[.,;:!?\x0A-\x0D]'))"

OP13 = rf"""
WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, {_PIECE} AS piece FROM documents)),
g AS (SELECT lang, w[i:i + k - 1] AS s, k FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k))),
c AS (SELECT lang, k, array_to_string(s, ' ') AS phrase, any_value(s) AS s, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
x AS (SELECT lang, phrase, k, f AS a, s, unnest(range(1, k)) AS cut FROM c WHERE k > 1 AND f >= 10),
y AS (SELECT x.lang, x.phrase, x.k, x.a, x.s, x.cut, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * x.a * x.a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM x JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(x.s[1:cut], ' ') JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(x.s[cut + 1:], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, part AS phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(s[1:2], ' ') AS part FROM z WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(s[2:3], ' ') FROM z WHERE k = 3) GROUP BY lang, part),
o AS (SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.phrase) AS rank FROM z LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""

SQL = {"op1_chat_format": OP1, "op6_quality_rules": OP6, "op9_decontamination": OP9, "op13_collocations": OP13}
