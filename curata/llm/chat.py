"""Chat formatting in budgeted windows that begin and end at turns. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's own marks, and control strings of common chat templates that texts must not show as they are.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = r"\||s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]"
#: What a turn's marks cost, in tokens.
MARKS = 4


def escape(text: Column) -> Column:
    """text without control strings: a backslash goes behind the first character of each; backslashes are doubled before."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?={CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    """What escape() was given. A lone backslash between bracket and control string is always escape()'s own."""
    return F.regexp_replace(F.regexp_replace(text, rf"([<\[])\\(?={CONTROL})", "$1"), r"\\\\", r"\\")


def token_count(text: Column) -> Column:
    """Words and single other marks, as the budget counts them."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, chunk: int = 64) -> DataFrame:
    """Formats conversations (conv_id, turn, role, text) as windows of whole turns.

    Prefix sums of the turns' tokens place every turn into exactly one window as its own: the turns that begin and end
    within the same stretch of budget - history tokens share one, and a turn that runs over the end of a stretch has
    one to itself, so a window's own turns exceed the stretch only where a single turn does. A window begins with its
    conversation's system turn (the first turn, if its role is system), then repeats the whole turns that lie within
    the history tokens before it. The system turn comes off the budget first, and history and stretch share the rest as
    they share the whole budget elsewhere: a window exceeds the budget only by a single own turn that is longer than the
    stretch, or where the system turn alone leaves no room. The loss mask covers the texts of own assistant turns; repeated ones are masked.

    A conversation may be of any length: its prefix sums are taken first over chunks of turn numbers, then within each,
    and its windows are built apart from each other. Turns are ordered by turn, role, text, nulls first; a null role or
    text is empty; a null conv_id is a conversation of its own; equal rows count as turns of their own; further columns
    are ignored; an empty table gives no rows. Returns conv_id, window (rising along the conversation), formatted,
    n_context (turns at its head that are repeated), n_own, loss_spans (start and end in code points of formatted).
    """
    if budget <= history or history < 0:
        raise ValueError("the budget must exceed the history")
    # The chunk of a turn must not depend on other rows, so it is taken from its number; nulls come first.
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(2**62))))
    rows = rows.withColumn("tokens", token_count(F.col("text")) + token_count(F.col("role")) + MARKS)
    ahead = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # Of several first turns with one number and role the longest counts for the system turn's share of the budget.
    first = F.min(F.struct("turn", "role", (-F.col("tokens")).alias("less")))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.sum("tokens").alias("in_chunk"), F.count("*").alias("n_chunk"), first.alias("first"))
    head = F.min("first").over(Window.partitionBy("conv_id"))
    room = F.greatest(F.lit(1), budget - F.when(head["role"] == "system", -head["less"]).otherwise(0))
    chunks = chunks.select("conv_id", "chunk", F.coalesce(F.sum("in_chunk").over(ahead), F.lit(0)).alias("tokens_ahead"), F.coalesce(F.sum("n_chunk").over(ahead), F.lit(0)).alias("n_ahead"), room.alias("room"))
    chunks = chunks.withColumn("history", F.floor(F.col("room") * history / budget)).withColumn("stretch", F.greatest(F.lit(1), F.col("room") - F.col("history")))
    order = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    c = chunks.select(F.col("conv_id").alias("c_id"), F.col("chunk").alias("c_chunk"), "tokens_ahead", "n_ahead", "history", "stretch")
    rows = rows.join(c, F.col("conv_id").eqNullSafe(F.col("c_id")) & (F.col("chunk") == F.col("c_chunk")))
    rows = rows.withColumn("end", F.col("tokens_ahead") + F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("pos", F.col("n_ahead") + F.row_number().over(order) - 1).withColumn("begin", F.col("end") - F.col("tokens"))
    first, last = F.floor(F.col("begin") / F.col("stretch")), F.floor((F.col("end") - 1) / F.col("stretch"))
    rows = rows.withColumn("window", 2 * first + (first != last).cast("long")).select("conv_id", "pos", "role", "text", "begin", "end", "window", "history", "stretch")

    # History: a turn may be repeated by the windows that begin up to history tokens after it began, a few at most.
    starts = rows.groupBy("conv_id", "window").agg(F.min("begin").alias("w_begin")).select(F.col("conv_id").alias("w_conv"), F.col("window").alias("w_window"), "w_begin")
    nearest = F.greatest(F.col("window") + 1, 2 * F.floor(F.col("end") / F.col("stretch")))
    farthest = F.greatest(nearest, 2 * F.floor((F.col("begin") + F.col("history")) / F.col("stretch")) + 1)
    spread = rows.where(F.col("end") - F.col("begin") <= F.col("history")).withColumn("w", F.explode(F.sequence(nearest, farthest)))
    spread = spread.join(starts, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("w") == F.col("w_window")))
    is_system = (F.col("pos") == 0) & (F.col("role") == "system")
    repeated = spread.where((F.col("begin") >= F.col("w_begin") - F.col("history")) & (F.col("end") <= F.col("w_begin")) & ~is_system)
    heads = rows.where(is_system).select(F.col("conv_id").alias("h_conv"), F.col("pos"), "role", "text", F.col("window").alias("h_window"))
    kept = starts.join(heads, F.col("w_conv").eqNullSafe(F.col("h_conv")) & (F.col("w_window") > F.col("h_window")))
    segments = (
        rows.select("conv_id", "window", "pos", "role", "text", F.lit(True).alias("own"))
        .unionByName(repeated.select("conv_id", F.col("w").alias("window"), "pos", "role", "text", F.lit(False).alias("own")))
        .unionByName(kept.select(F.col("w_conv").alias("conv_id"), F.col("w_window").alias("window"), "pos", "role", "text", F.lit(False).alias("own")))
    )

    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    segments = segments.select("conv_id", "window", "pos", "own", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    segments = segments.withColumn("size", F.length("head") + F.length("body") + len(END))
    before = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("own") & (F.col("role") == "assistant"), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    whole = segments.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.concat("head", "body", F.lit(END)).alias("said")))).alias("parts"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
        F.sum((~F.col("own")).cast("int")).alias("n_context"),
        F.sum(F.col("own").cast("int")).alias("n_own"),
    )
    return whole.select("conv_id", "window", F.array_join("parts.said", "").alias("formatted"), "n_context", "n_own", "loss_spans")


def read_turns(formatted: DataFrame) -> DataFrame:
    """The own turns of windows(), read back from their text: conv_id, window, pos (in the window), role, text."""
    parts = F.slice(F.split("formatted", rf"\Q{END}\E"), F.col("n_context") + 1, F.col("n_own"))
    said = formatted.select("conv_id", "window", F.posexplode(parts).alias("pos", "said"))
    pair = F.split(F.substring(F.col("said"), len(TURN) + 1, 2**31 - 1), rf"\Q{BODY}\E", 2)
    return said.select("conv_id", "window", "pos", unescape(pair[0]).alias("role"), unescape(pair[1]).alias("text"))


def read_targets(formatted: DataFrame) -> DataFrame:
    """The texts under the loss mask of windows(): conv_id, window, pos, text."""
    spans = formatted.select("conv_id", "window", "formatted", F.posexplode("loss_spans").alias("pos", "span"))
    return spans.select("conv_id", "window", "pos", unescape(F.substring(F.col("formatted"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))).alias("text"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from windows(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = read_turns(formatted).select("conv_id", F.struct("window", "pos", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said")).alias("turn"), F.lit(None).cast("struct<window:bigint,pos:int,text:string>").alias("target"), F.lit(0).alias("chars"))
    targets = read_targets(formatted).select("conv_id", F.lit(None).cast("struct<window:bigint,pos:int,said:string>").alias("turn"), F.struct("window", "pos", "text").alias("target"), F.lit(0).alias("chars"))
    sizes = formatted.select("conv_id", F.lit(None).cast("struct<window:bigint,pos:int,said:string>").alias("turn"), F.lit(None).cast("struct<window:bigint,pos:int,text:string>").alias("target"), F.length("formatted").alias("chars"))
    found = turns.unionByName(targets).unionByName(sizes).groupBy("conv_id").agg(
        F.count("turn").alias("n_turns"),
        F.array_join(F.array_sort(F.collect_list("turn")).said, "").alias("all_turns"),
        F.array_join(F.array_sort(F.collect_list("target")).text, "").alias("all_targets"),
        F.sum("chars").alias("formatted_chars"),
    )
    return found.select("conv_id", "n_turns", F.sha2("all_turns", 256).alias("turns_sha256"), F.length("all_targets").cast("long").alias("loss_chars"), F.sha2("all_targets", 256).alias("loss_sha256"), "formatted_chars")
