"""Rule classifiers over text: word lists and patterns, and the boolean columns made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinflow.functions.text import at_least_similar, norm_contact, norm_contacts, once, tokens, trimmed

# What the rules look for.
SELF_NAME = "我"
ACKNOWLEDGEMENTS = ["收到", "好的", "好", "嗯", "嗯嗯", "OK", "ok", "好嘞", "了解", "明白", "知道了", "谢谢", "收到谢谢", "好的收到"]
WAITING = [
    "稍等", "稍等一下", "稍等片刻", "等下", "等一下", "等我一下", "你们等下", "你们等一下", "马上", "马上到", "马上来", "马上过来",
    "一会", "一会儿", "一会出来", "一会儿出来", "我一会出来", "我一会儿出来", "在路上", "快到了", "稍后", "稍后回复", "稍后回", "晚点回",
]
GENERIC_NAMES = ["大家", "各位", "全体", "同事们", "同学们", "各位同事", "各位领导", "领导们", "全体员工"]
ORGANIZATION_ENDS = ["部", "处", "科", "室", "办", "办公室", "公司", "集团", "中心", "委员会", "工作部", "事业部", "小组"]
NOTICE_STARTS = ["通知", "告知", "转发", "提醒"]
NOTICE_WORDS = ["会议时间", "时间调整", "时间变更", "改到", "改为"]
TIMELESS_WORDS = ["确认", "对接", "沟通", "联系"]
CHANGE_WORDS = ["调整", "变更", "改到", "改为", "改成", "改期", "取消", "延期", "推迟", "提前", "换到", "地点"]
LOGISTICS_WORDS = ["参会", "参加", "晚到", "晚点", "迟到", "过来", "过去", "到会", "开会", "会议", "会议室", "办公室", "谈完", "等我", "准时", "散会", "结束后", "先谈"]
PREFERENCE_WORDS = ["喜欢", "偏好", "偏向", "倾向", "习惯", "想要", "希望", "最好", "更喜欢", "方便"]
ARRIVAL = "(?:已|己|巳)到(?!账|期)|到了|到啦|到位|到齐|人齐"
PROGRESS = [
    r"(?:已|已经|现已|均已|都已|刚|刚刚)\s*(?:到(?:达|场|位)?|抵达|就位|完成|办妥|补齐|准备好|改完|处理完|提交|发送|发出|交付|确认|通过|批准|签署|签完|上线|开工|开始|结束|取消|延期|回复|联系)(?:了)?",
    r"(?:总|导|老师|主任|经理|先生|女士|哥|姐|嘉宾|客户|领导|同事|团队)\s*(?:到了|到达了|抵达了)",
    r"(?:完成|办妥|补齐|就位|准备好|改完|处理完|提交|发送|发出|交付|确认|批准|签署|签完|上线|开工|开始|结束|取消|延期|回复|联系)(?:了|啦|完毕)",
]
#: Punctuation, white space and pictographs, with their joiners and selectors.
NOISE = r"(?U)[0-9#*]\x{FE0F}?\x{20E3}|[\p{P}\s\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}\x{200D}\x{20E3}\x{FE0E}\x{FE0F}\x{E0020}-\x{E007F}©®™]"


def any_of(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(words))


def denoised(c: Column) -> Column:
    return F.regexp_replace(c, NOISE, "")


def acknowledges(key: Column, words: list[str], least: int = 4) -> Column:
    """Whether a text, reduced to its key, only acknowledges: almost nothing, one of the words, or (from
    ``least`` characters on) one edit from one of them, so no more than one character longer than all."""
    near = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.levenshtein(key, w) <= 1)
    return (F.length(key) <= 2) | key.isin(words) | (F.length(key).between(least, max(map(len, words)) + 1) & near)


def reports_arrival(c: Column) -> Column:
    return once(denoised(c), _arrival)


def _arrival(key: Column) -> Column:
    return (F.length(key) <= 10) & key.rlike(ARRIVAL)


def pure_acknowledgement(c: Column) -> Column:
    """Whether a text only acknowledges or reports an arrival. Its key is bound, or each word would make it anew."""
    return once(denoised(c), lambda key: acknowledges(key, ACKNOWLEDGEMENTS + WAITING) | _arrival(key))


def direct_progress(c: Column) -> Column:
    return any_of(c, [f"(?:{p})" for p in PROGRESS])


def meeting_notice(kind: Column, *texts: Column) -> Column:
    """An event of another kind with a title or quote that starts like a notice or tells of a new time."""
    starts = lambda c: c.rlike("^(?:" + "|".join(NOTICE_STARTS) + ")") | any_of(c, NOTICE_WORDS)
    return (kind == "other") & _any(texts, starts)


def meeting_change(*texts: Column) -> Column:
    """Whether a title or quote names a change."""
    return _any(texts, lambda c: any_of(c, CHANGE_WORDS))


def _any(texts: tuple[Column, ...], test) -> Column:
    found = F.lit(False)
    for c in texts:
        found = found | F.coalesce(test(norm_contact(c)), F.lit(False))
    return found


def timeless_communication(kind: Column, has_time: Column, location: Column, title: Column) -> Column:
    return (kind == "other") & ~has_time & (trimmed(F.coalesce(location, F.lit(""))) == "") & any_of(norm_contact(title), TIMELESS_WORDS)


def meeting_logistics(c: Column) -> Column:
    return (F.length(c) <= 60) & any_of(c, LOGISTICS_WORDS)


def observation_kind(c: Column) -> Column:
    return F.when(any_of(c, PREFERENCE_WORDS), "preference").otherwise("fact")


def suppressed_mention(role: Column, name: Column, has_identity: Column, has_facts: Column) -> Column:
    """Mentioned parties that aren't people worth a contact: generic names, organisations, or nothing
    known about them."""
    key = norm_contact(name)
    organisation = (F.length(key) >= 3) & key.rlike("(?:" + "|".join(ORGANIZATION_ENDS) + ")$")
    return F.coalesce(role == "mentioned", F.lit(False)) & (key.isin(GENERIC_NAMES) | organisation | (~has_identity & ~has_facts))


def redundant_value(old: Column, new: Column) -> Column:
    """Whether a company or title says no more than the known one: equal, contained, its words a subset,
    or one edit apart (3 characters or more, of 3 only one as long). A longer text that contains the known
    one says more."""
    a, b = norm_contact(F.coalesce(old, F.lit(""))), norm_contact(F.coalesce(new, F.lit("")))
    said = tokens(F.coalesce(new, F.lit("")))
    subset = (F.size(said) > 0) & (F.size(F.array_except(said, tokens(F.coalesce(old, F.lit(""))))) == 0)
    more = F.contains(b, a) & (F.length(b) > F.length(a))
    close = (F.levenshtein(a, b) == 1) & (F.length(b) >= 3) & ((F.length(b) != 3) | (F.length(a) == 3))
    return (a == b) | ((a != "") & (b != "") & ~more & (F.contains(a, b) | subset | close))


ELLIPSIS = "\\.{3,}|…"


def coverage(quotes: Column) -> Column:
    """What ``covered_by`` takes, of an array of quotes: their keys and, of a quote with an ellipsis, the
    segments of 4 characters or more around it."""
    marked = norm_contacts(F.transform(quotes, lambda q: F.regexp_replace(q, ELLIPSIS, "\u0001")))
    parts = lambda k: F.filter(F.split(k, "\u0001"), lambda s: F.length(s) >= 4)
    return F.transform(marked, lambda k: F.struct(F.replace(k, F.lit("\u0001"), F.lit("")).alias("key"), F.when(F.contains(k, F.lit("\u0001")), parts(k)).alias("segments")))


def holds(key: Column, quote: Column, least: int = 8, similarity: float = 0.85) -> Column:
    """Whether one quote (key and segments, as ``coverage`` gives them) covers the text of a key: all its
    segments stand in it; without an ellipsis, containment of ``least`` characters or more, or similarity."""
    other = quote["key"]
    long = (F.least(F.length(key), F.length(other)) >= least) & (F.contains(key, other) | F.contains(other, key))
    elided = (F.size(quote["segments"]) > 0) & F.forall(quote["segments"], lambda s: F.contains(key, s))
    return (key != "") & (other != "") & F.when(quote["segments"].isNotNull(), elided).otherwise(long | at_least_similar(key, other, similarity))


def covered_by(key: Column, quotes: Column, least: int = 8, similarity: float = 0.85) -> Column:
    """Whether one of the quotes (``coverage``) covers the text with this norm_contact key. Both are bound
    outside the lambda, since keys come from Python."""
    each = lambda x: F.exists(x["quotes"], lambda q: holds(x["key"], q, least, similarity))
    return F.get(F.transform(F.array(F.struct(key.alias("key"), quotes.alias("quotes"))), each), F.lit(0))


def discarded(quote_key: Column, label: Column, content: Column, gone: Column) -> Column:
    """Whether a quote (its key, and those of its label and content) is one of the discarded ones (structs of
    key, label, content): equal, equal but for a label that one of them lacks, or contained (4 characters)."""
    same = lambda g: (content != "") & (content == g["content"]) & (label.isNull() | g["label"].isNull())
    inside = lambda g: (F.least(F.length(quote_key), F.length(g["key"])) >= 4) & (F.contains(quote_key, g["key"]) | F.contains(g["key"], quote_key))
    return F.exists(F.filter(gone, lambda g: g["key"] != ""), lambda g: (quote_key == g["key"]) | same(g) | inside(g))


def interaction_text(summary: Column, fallback: Column, ratio) -> Column:
    """The summary, unless it is hardly CJK (below 0.3) where the fallback is (0.5 or more)."""
    return F.when((ratio(fallback) >= 0.5) & (ratio(summary) < 0.3), fallback).otherwise(F.coalesce(F.nullif(trimmed(summary), F.lit("")), fallback))


def error_category(status: Column, message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status.isin(401, 403), "auth").when(status == 404, "missing").when(status == 409, "conflict").when(status == 429, "busy")
        .when(status >= 500, "server").when(m.rlike("timeout|timed out|超时"), "timeout").when(m.rlike("network|fetch|连接"), "network").otherwise("other")
    )
