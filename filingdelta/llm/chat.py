"""Chat formatting: budgeted, turn-aligned windows with a loss mask, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filingdelta.llm.common import written

# Control strings of the template; none of them can come out of an escaped text.
OPEN, CLOSE, HEAD, HEAD_END = "<s>", "</s>", "[INST] ", " [/INST]"
BUDGET, HISTORY = 2048, 256
CHUNK_TURNS = 64
TURN_OVERHEAD = 4
LEAST_SHARE = 8
TARGET, SYSTEM = "assistant", "system"


def escape(text: Column) -> Column:
    r"""Put a backslash behind every ``<``, ``[`` and backslash, which breaks all control strings."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def turn_tokens(text: Column) -> Column:
    """Estimated tokens of a turn: a quarter of its characters, and the template's marks."""
    return F.ceil(F.length(text) / 4) + TURN_OVERHEAD


def _prefix_sums(turns: DataFrame) -> DataFrame:
    """``before``: tokens of all earlier turns of the conversation.

    Conversations are cut into chunks of turn numbers; chunk totals are summed first, then turns inside a chunk,
    so that one conversation with a large share of all turns is spread over many tasks.
    """
    chunk = turns.withColumn("chunk", F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK_TURNS))
    totals = chunk.groupBy("conv_id", "chunk").agg(F.sum("tokens").alias("total"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "chunk", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    chunk = chunk.withColumn("n", F.row_number().over(inside)).withColumn(
        "inside", F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = totals.withColumnRenamed("conv_id", "c").withColumnRenamed("chunk", "k")
    return chunk.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))).select(
        "conv_id", "turn", "role", "text", "tokens", (F.col("inside") + F.col("offset")).alias("before"))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of ``conversations(conv_id, turn, role, text)``: conv_id, window, formatted, loss, n_repeated, over_budget.

    Turns are placed by the sum of tokens before them: half of what the system turns and the history leave of the
    budget is one stretch, so a stretch and its last turn fit; a longer turn is a window of its own. No turn is cut and
    none is lost. A window starts with the conversation's first system turn, however long, and further system turns met before
    it (up to half the budget together), then earlier turns of up to ``history`` tokens; these are repeats, ``n_repeated`` in number,
    and not under the loss. A long system turn makes stretches shorter, down to ``1 / LEAST_SHARE`` of the room; a window that
    all of its turns take past the budget is marked ``over_budget``. ``loss`` lists ``(start, length)`` of the assistant's
    new texts in ``formatted``, in code points. A null text is empty, a null role is an empty one, a null turn
    comes first; turns with equal numbers stand in the order of role and text. A null conv_id is one more
    conversation. Other columns are not read.
    """
    clean = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.withColumn("tokens", turn_tokens(F.col("text")).cast("long"))
    turns = _prefix_sums(clean)
    first = F.min_by("tokens", F.struct(F.coalesce("turn", F.lit(-(1 << 62))), "text"))
    system = clean.where(F.col("role") == SYSTEM).groupBy(F.col("conv_id").alias("s_conv")).agg(
        F.greatest(F.least(F.sum("tokens"), F.lit(budget // 2)), first).alias("s_tokens"))
    turns = turns.join(system, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left").drop("s_conv")
    room = budget - history
    stride = F.greatest(F.floor((F.lit(room) - F.coalesce("s_tokens", F.lit(0))) / 2), F.lit(max(room // LEAST_SHARE, TURN_OVERHEAD + 1)))
    turns = turns.withColumn("stride", stride).withColumn("large", (F.col("tokens") > F.col("stride")).cast("int"))
    turns = turns.withColumn("window", 2 * F.floor(F.col("before") / F.col("stride")) + F.col("large"))
    turns = written(turns.drop("s_tokens"), "turns")

    starts = turns.groupBy("conv_id", "window").agg(F.min("before").alias("from"))
    new = turns.select("conv_id", "window", F.lit(2).alias("part"), "before", "turn", "role", "text", "tokens")
    # A turn can be history of windows that start between its end and `history` tokens after its start.
    end = F.col("before") + F.col("tokens")
    reach = turns.where(F.col("tokens") <= history).select(
        F.col("conv_id").alias("h_conv"), "before", "turn", "role", "text", "tokens", end.alias("end"),
        F.explode(F.sequence(2 * F.floor(end / F.col("stride")), 2 * F.floor((F.col("before") + history) / F.col("stride")) + 1)).alias("h_window"))
    met = reach.join(starts, F.col("h_conv").eqNullSafe(F.col("conv_id")) & (F.col("h_window") == F.col("window")))
    met = met.where((F.col("end") <= F.col("from")) & (F.col("before") >= F.col("from") - history))
    past = met.where(F.col("role") != SYSTEM).select("conv_id", "window", F.lit(1).alias("part"), "before", "turn", "role", "text", "tokens")
    # The first system turn goes to the head of every later window, others while all stay within half the budget.
    earlier = Window.partitionBy("conv_id").orderBy("before")
    leading = turns.where(F.col("role") == SYSTEM).withColumn("sum", F.sum("tokens").over(earlier)).withColumn("nth", F.row_number().over(earlier))
    leading = leading.where((F.col("nth") == 1) | (F.col("sum") <= budget // 2)).select(F.col("conv_id").alias("l_conv"), "before", "turn", "role", "text", "tokens")
    head = leading.join(starts, F.col("l_conv").eqNullSafe(F.col("conv_id")) & (F.col("before") < F.col("from")))
    head = head.select("conv_id", "window", F.lit(0).alias("part"), "before", "turn", "role", "text", "tokens")

    piece = F.concat(F.lit(OPEN + HEAD), escape(F.col("role")), F.lit(HEAD_END), escape(F.col("text")), F.lit(CLOSE))
    prefix = F.length(F.concat(F.lit(OPEN + HEAD), escape(F.col("role")), F.lit(HEAD_END)))
    rows = head.unionByName(past).unionByName(new).select(
        "conv_id", "window", F.struct("part", "before", F.coalesce("turn", F.lit(-1)).alias("turn"), "role", piece.alias("piece"), prefix.alias("prefix"), "tokens").alias("t"))
    windows = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def step(acc: Column, t: Column) -> Column:
        length = F.length(t["piece"])
        span = F.struct((acc["at"] + t["prefix"]).alias("start"), (length - t["prefix"] - len(CLOSE)).alias("length"))
        targeted = (t["role"] == TARGET) & (t["part"] == 2)
        return F.struct((acc["at"] + length).alias("at"), F.when(targeted, F.concat(acc["loss"], F.array(span))).otherwise(acc["loss"]).alias("loss"))

    return windows.select(
        "conv_id", "window", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"),
        F.aggregate("ts", start, step, lambda acc: acc["loss"]).alias("loss"),
        F.size(F.filter("ts", lambda t: t["part"] < 2)).alias("n_repeated"),
        (F.aggregate("ts", F.lit(0).cast("long"), lambda acc, t: acc + t["tokens"]) > budget).alias("over_budget"))


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of every conversation say: conv_id, n_turns, turns, loss_text, formatted_chars.

    ``turns`` has role and text on lines of their own for each turn that is not a repeat, ``loss_text`` all text under
    the loss; both unescaped and in order.
    """
    close = r"</s>"
    pieces = F.slice(F.split("formatted", close), F.col("n_repeated") + 1, F.size(F.split("formatted", close)))
    pieces = F.filter(pieces, lambda p: p != "")
    head = len(OPEN + HEAD)

    def turn(p: Column) -> Column:
        # Escaped texts hold no "[/INST]", so the first one ends the role.
        body = F.substring(p, head + 1, F.length(p))
        role = F.substring_index(body, HEAD_END, 1)
        return F.concat(unescape(role), F.lit("\n"), unescape(F.substring(body, F.length(role) + len(HEAD_END) + 1, F.length(body))), F.lit("\n"))

    loss = F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"]))), "")
    parts = windows.select("conv_id", "window", F.length("formatted").alias("chars"), F.size(pieces).alias("n"), F.array_join(F.transform(pieces, turn), "").alias("turns"), loss.alias("loss"))
    joined = parts.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("all"), F.sum("chars").cast("long").alias("formatted_chars"))
    return joined.select("conv_id", "n_turns", F.array_join(F.col("all.turns"), "").alias("turns"), F.array_join(F.col("all.loss"), "").alias("loss_text"), "formatted_chars")
