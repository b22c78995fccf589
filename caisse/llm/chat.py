"""Chat formatting in budgeted windows, with DataFrame functions only.

Running sums of turn tokens cut each conversation into turn-aligned spans: each
is the longest run of turns that fits. A window holds the system turn, a
limited history of the turns before its span, and the span; all three count in
its budget. The loss mask covers the assistant turns of the span; repeated
turns are masked out, so every assistant text is a target exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caisse.llm.common import require

#: Tokens of one window, and of the history repeated in it at most.
SPAN = 1024
HISTORY = 256
#: Turns that are cut into spans together; a span ends with them, so no array grows with a conversation.
CHUNK = 1024

#: Turn marks of the template (fixed values): <|turn|>role, line feed, text, <|end|>, line feed.
TURN, END = "<|turn|>", "<|end|>"
#: Places where a control string may begin; a backslash behind the first character breaks it.
_CONTROL = r"(?i)([<\[])(?=\||/?s>|/?INST\]|/?<SYS>>|<SYS>>|<?/SYS>>|begin|end|unk>|pad>|bos>|eos>|mask>)"


def escape(text: Column) -> Column:
    """Text without control strings: backslashes doubled, ``<|`` becomes ``<\\|``, ``</s>`` becomes ``<\\/s>``, and so on."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _tokens(text: Column) -> Column:
    """Tokens of a turn, estimated: words and punctuation characters, and four for the marks."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("long") + 4


def _spans(rows: DataFrame, span: int, history: int) -> DataFrame:
    """``rows`` (conv_id, seq, lead, role, body, t, system) with window, the number of their span.

    A span takes turns as long as their tokens fit beside the system turn and,
    but for the first, the history. The running sum decides within CHUNK turns,
    over their token counts alone; it notes where spans begin, and a span's
    number is how many have begun before it in the conversation.
    """
    turn = F.struct("seq", "lead", "role", "body", "t")
    chunks = rows.groupBy("conv_id", F.expr(f"(seq - 1) div {CHUNK}").alias("chunk")).agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.max("system").alias("system"))
    # The system turn, first of its chunk, has no tokens of its own and begins the first span with the turn after it.
    chunks = chunks.withColumns({"lone": F.when(F.col("turns")[0]["lead"], 1).otherwise(0), "room": F.lit(span).cast("long") - F.col("system")})

    def step(s, t):
        room = F.col("room") - F.when((F.col("chunk") == 0) & (F.size(s["starts"]) == 1), 0).otherwise(history)
        more = (s["i"] > F.element_at(s["starts"], -1) + F.col("lone") * F.when(F.size(s["starts"]) == 1, 1).otherwise(0)) & (s["acc"] + t > room)
        return F.struct((s["i"] + 1).alias("i"), (F.when(more, 0).otherwise(s["acc"]) + t).alias("acc"), F.when(more, F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"]).alias("starts"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("acc"), F.array(F.lit(0)).alias("starts"))
    cut = chunks.withColumn("starts", F.aggregate("turns.t", start, step, lambda s: s["starts"]))
    placed = cut.select("conv_id", "system", "starts", F.posexplode("turns").alias("i", "x")).select("conv_id", "x.*", "system", F.array_contains("starts", F.col("i")).cast("long").alias("begins"))
    begun = F.sum("begins").over(W.partitionBy("conv_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("window", begun - 1).drop("begins")


def format_windows(turns: DataFrame, span: int = SPAN, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, loss) per window of each conversation.

    ``turns`` has conv_id, turn, role, text. n_repeated: leading turns of the
    window that an earlier window held; loss: (start, length) in code points
    of each target inside ``formatted``. The turns of a window have at most
    ``span`` tokens, by the estimate of ``_tokens``, unless its system turn and
    a single turn have more; no turn is cut. Up to ``history`` of them are
    repeated turns, as far as the span leaves room.
    Null text and role are empty; a null conv_id is one conversation; turns of
    equal number go by role, then text; repeated rows are turns of their own.
    Other columns are ignored.
    """
    require(turns, "conv_id", "turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    rows = rows.withColumn("seq", F.row_number().over(order)).withColumn("lead", (F.col("seq") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("t", F.when(F.col("lead"), 0).otherwise(_tokens(F.col("body"))))
    system = F.coalesce(F.max(F.when(F.col("lead"), _tokens(F.col("body")))).over(W.partitionBy("conv_id")), F.lit(0))
    rows = _spans(rows.withColumn("system", system), span, history)
    upto = F.sum("t").over(W.partitionBy("conv_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    # A span's last prefix sum is where the next one begins, whose tokens leave room for some history.
    ahead = F.sum("t").over(W.partitionBy("conv_id").orderBy("window").rangeBetween(1, 1))
    rows = rows.withColumns({"upto": upto, "ahead": ahead}).withColumn("border", F.max("upto").over(W.partitionBy("conv_id", "window")))
    room = F.least(F.lit(history), F.lit(span) - F.col("system") - F.col("ahead"))
    again = ~F.col("lead") & F.col("ahead").isNotNull() & (F.col("border") - (F.col("upto") - F.col("t")) <= room)
    rows = rows.withColumn("at", F.when(again, F.array("window", F.col("window") + 1)).otherwise(F.array("window")))
    placed = rows.select("conv_id", "seq", "lead", "role", "body", F.col("window").alias("own"), F.explode("at").alias("window"))
    system = rows.filter("lead").select(F.col("conv_id").alias("c"), F.col("role").alias("sys_role"), F.col("body").alias("sys_body"))
    mark = F.concat(F.lit(TURN), escape(F.col("role")), F.lit("\n"), F.col("body"), F.lit(END + "\n"))
    held = placed.withColumns({"new": F.col("own") == F.col("window"), "mark": mark})
    turn = F.struct("seq", "new", "mark", (F.col("new") & (F.col("role") == "assistant")).alias("target"), F.length(escape(F.col("role"))).alias("r"))
    windows = held.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    windows = windows.join(system, (F.col("window") > 0) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    first = F.when(F.col("sys_body").isNotNull(), F.array(F.struct(F.lit(0).alias("seq"), F.lit(False).alias("new"), F.concat(F.lit(TURN), escape(F.col("sys_role")), F.lit("\n"), F.col("sys_body"), F.lit(END + "\n")).alias("mark"), F.lit(False).alias("target"), F.lit(0).alias("r"))))
    windows = windows.withColumn("turns", F.when(F.col("sys_body").isNotNull(), F.concat(first, "turns")).otherwise(F.col("turns")))
    # Offsets of the turns inside the window: prefix sums of their lengths, one pass over parallel arrays.
    windows = windows.select("conv_id", "window", "turns", F.posexplode("turns").alias("pos", "one"))
    before = F.coalesce(F.sum(F.length("one.mark")).over(W.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    windows = windows.select("conv_id", "window", "pos", "one", before.alias("before"))
    begin = F.col("before") + len(TURN) + F.col("one.r") + 1
    target = F.when(F.col("one.target"), F.struct("pos", begin.cast("long").alias("start"), (F.length("one.mark") - len(TURN) - F.col("one.r") - 1 - len(END) - 1).cast("long").alias("length")))
    windows = windows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("pos", "one.mark"))).alias("m"), F.sort_array(F.collect_list(target)).alias("l"), F.count(F.when(~F.col("one.new"), 1)).alias("n_repeated"))
    return windows.select("conv_id", "window", F.array_join("m.mark", "").alias("formatted"), "n_repeated", F.transform("l", lambda x: F.struct(x["start"], x["length"])).alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, parsed from the formatted windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parts = F.split("formatted", r"<\|end\|>\n")
    new = F.expr(f"slice(parts, n_repeated + 1, size(parts) - 1 - n_repeated)")  # noqa: F541
    said = windows.withColumn("parts", parts).withColumn("new", new)
    body = F.transform("new", lambda x: unescape(F.substr(x, F.lit(len(TURN) + 1))))
    loss = F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    said = said.select("conv_id", "window", F.size("new").alias("n"), F.array_join(F.transform(body, lambda x: F.concat(x, F.lit("\n"))), "").alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").alias("chars"))
    whole = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"))
    turns, loss = F.array_join("w.turns", ""), F.array_join("w.loss", "")
    return whole.select("conv_id", "n_turns", F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formats ``turns`` and reads the result back, one row per conversation."""
    return read_back(format_windows(turns))
