"""Chat formatting in budgeted windows, in DataFrame functions only.

The turns of a conversation, in order, are cut into windows of whole turns by prefix sums of their
tokens: with S tokens of room per window, a turn that ends in (k*S, (k+1)*S] belongs to block k. A turn
that starts before its block opens the block's window if all fit into S, else it is a window of its own;
so a window exceeds its room only if a single turn does. Each later window starts with the system turn
and a few of the turns just before it, as context: repeated turns carry no loss, so each assistant text
is a target exactly once.

Template: <|start|> role <|message|> text <|end|>. Inside roles and texts each backslash is doubled, and
one is put behind the first character of whatever could open a control string, of this template or of
other common ones; taking single backslashes out again restores the text.

Cases: a null role or text counts as empty; turns with equal numbers go by role, then text; equal rows
are turns of their own; a null turn number sorts first; a null conversation id is a conversation; a
system turn only counts as such in first place; an empty table gives an empty result; other columns are
dropped. A conversation's turns meet in one task because its digest and order are asked for; windows
themselves are bounded by the budget.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: Openings of control strings, as (first character, what follows it).
GUARDED = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


@dataclass(frozen=True)
class ChatConfig:
    budget: int = 1024  #: tokens of a window, with what it repeats
    history: int = 128  #: tokens of repeated turns, the system turn aside
    history_turns: int = 2
    least_room: int = 64  #: room for new turns under a long system turn
    turn_overhead: int = 3  #: tokens for the marks of a turn


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), GUARDED, r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def token_count(c: Column, config: ChatConfig) -> Column:
    """Words and marks; native stand-in for a tokenizer."""
    return (F.regexp_count(c, F.lit(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]")) + config.turn_overhead).cast("long")


def format_chat(turns: DataFrame, config: ChatConfig = ChatConfig(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per window: conv_id, window_no, formatted, n_tokens, over_budget, turns (turn_no, repeated,
    loss, start, length of its part of ``formatted``) and loss_spans (start, length), in code points."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    conv = Window.partitionBy("conv_id").orderBy("_turn", "role", "text")
    to_here = conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"no": F.row_number().over(conv).cast("long"), "tokens": token_count(F.col("text"), config)})
    rows = rows.withColumn("system", (F.col("no") == 1) & (F.col("role") == "system"))
    rows = rows.withColumns({
        "_new": F.when(F.col("system"), F.lit(0)).otherwise(F.col("tokens")).cast("long"),
        "_turn_": F.struct("no", "role", "text", "tokens", "system"),
    })
    rows = rows.withColumns({
        "_end": F.sum("_new").over(to_here),
        "_first": F.first("_turn_").over(to_here),
        "_before": F.array(*[F.lag("_turn_", k).over(conv) for k in range(1, config.history_turns + 1)]),
    })
    head = F.when(F.col("_first.system"), F.col("_first.tokens")).otherwise(F.lit(0))
    rows = rows.withColumn("_room", F.greatest(F.lit(config.budget - config.history) - head, F.lit(config.least_room)))
    rows = rows.withColumn("_block", F.floor(F.greatest(F.col("_end") - 1, F.lit(0)) / F.col("_room")).cast("long"))
    rows = rows.withColumn("_straddles", ~F.col("system") & (F.col("_end") - F.col("_new") < F.col("_block") * F.col("_room")))
    block = Window.partitionBy("conv_id", "_block")
    rows = rows.withColumn("_total", F.sum("_new").over(block))
    rows = rows.withColumn("_alone", F.col("_straddles") & (F.col("_total") > F.col("_room")))
    rows = rows.withColumn("window_no", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("_block", F.when(F.col("_alone"), 0).otherwise(1))) - 1)
    opens = F.row_number().over(Window.partitionBy("conv_id", "window_no").orderBy("no")) == 1
    rows = rows.withColumn("_opens", opens & (F.col("window_no") > 0))
    own = lambda t, again: F.struct(t["no"].alias("no"), t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"), F.lit(again).alias("repeated"))
    none = F.array().cast("array<struct<no:bigint,role:string,text:string,tokens:bigint,repeated:boolean>>")
    past, used = none, F.lit(0).cast("long")
    for k in range(config.history_turns):  # nearest first, while they fit without a gap
        t = F.get("_before", k)
        used = used + F.coalesce(t["tokens"], F.lit(0))
        past = F.when(t.isNotNull() & ~t["system"] & (used <= config.history), F.concat(past, F.array(own(t, True)))).otherwise(past)
    again = F.when(F.col("_opens"), F.concat(F.when(F.col("_first.system"), F.array(own(F.col("_first"), True))).otherwise(none), past)).otherwise(none)
    parts = rows.select("conv_id", "window_no", F.explode(F.concat(again, F.array(own(F.col("_turn_"), False)))).alias("t"))
    parts = parts.select("conv_id", "window_no", "t.no", "t.repeated", "t.tokens", (~F.col("t.repeated") & (F.col("t.role") == "assistant")).alias("loss"), F.concat(F.lit(START), escape(F.col("t.role")), F.lit(MESSAGE)).alias("_head"), escape(F.col("t.text")).alias("_body"))
    parts = parts.withColumns({"_part": F.concat("_head", "_body", F.lit(END)), "_skip": F.length("_head").cast("long"), "_chars": F.length("_body").cast("long")})
    parts = parts.withColumn("length", F.length("_part").cast("long"))
    ahead = Window.partitionBy("conv_id", "window_no").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("start", F.sum("length").over(ahead) - F.col("length"))
    packed = parts.groupBy("conv_id", "window_no").agg(F.sort_array(F.collect_list(F.struct("no", "repeated", "loss", "start", "length", "_skip", "_chars", "_part"))).alias("_t"), F.sum("tokens").alias("n_tokens"))
    return packed.select(
        "conv_id",
        F.col("window_no").cast("int").alias("window_no"),
        F.array_join(F.col("_t._part"), "").alias("formatted"),
        "n_tokens",
        (F.col("n_tokens") > config.budget).alias("over_budget"),
        F.transform("_t", lambda t: F.struct(t["no"].alias("turn_no"), t["repeated"].alias("repeated"), t["loss"].alias("loss"), t["start"].alias("start"), t["length"].alias("length"))).alias("turns"),
        F.transform(F.filter("_t", lambda t: t["loss"]), lambda t: F.struct((t["start"] + t["_skip"]).alias("start"), t["_chars"].alias("length"))).alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """A row per conversation, from the formatted windows alone: conv_id, n_turns, turns_text (role,
    newline, text, newline per turn), loss_text and formatted_chars."""
    cut = lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))

    def plain(part: Column) -> Column:
        role = F.substring_index(F.substring(part, len(START) + 1, 1 << 30), MESSAGE, 1)
        body = F.substring_index(F.substring_index(part, MESSAGE, -1), END, 1)
        return F.concat(unescape(role), F.lit("\n"), unescape(body), F.lit("\n"))

    fresh = F.filter("turns", lambda t: ~t["repeated"])
    read = windows.select(
        "conv_id", "window_no",
        F.size(fresh).cast("long").alias("n"),
        F.array_join(F.transform(fresh, lambda t: plain(cut(t))), "").alias("turns_text"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(cut(s))), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window_no", "turns_text", "loss_text"))).alias("_w"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", F.array_join(F.col("_w.turns_text"), "").alias("turns_text"), F.array_join(F.col("_w.loss_text"), "").alias("loss_text"), "formatted_chars")
