"""Chat formatting in budgeted windows.

Every conversation becomes windows of a token budget.  Prefix sums of the turns'
tokens choose turn-aligned spans; the system turn, if the conversation begins
with one, is retained at the head of every window; up to `history` turns before
the span are repeated as context; and repeated targets are masked, so that each
assistant text is under the loss once.  All of it is DataFrame expressions.

A window is text: for each turn `<|im_start|>role\\ntext<|im_end|>\\n`.  A
control string inside a text or role is escaped reversibly: `<`, any number of
backslashes and `|` get one more backslash, so no text holds `<|`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 256
TARGET = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def tokens_of(text: Column) -> Column:
    """Tokens by the estimate used here: runs of word characters and single other marks, and four for a turn's frame."""
    return (F.regexp_count(text, F.lit(r"\w+|[^\w\s]")) + 4).cast("long")


def format_windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text).

    Returns conv_id, window (0, 1, ...), formatted, context (leading turns that
    an earlier window holds too), n_turns and loss (array of (start, end) in
    code points of formatted: what the model learns, without repeated targets).

    A span holds turns whose prefix sums of tokens begin in the same stretch of
    half the room that the system turn and the history leave; turns longer than a
    stretch stand alone.  So a window exceeds the budget only by a single turn
    that does, and no turn is cut.

    A null text or role counts as empty; turns are taken by turn, role and text,
    a null turn first, so ties and repeated rows keep a fixed order and all stay;
    rows with a null conv_id are one conversation; an empty table gives no
    windows; other columns are not read.
    """
    own = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = own.withColumn("tokens", tokens_of(F.col("text")))
    own = own.withColumn("i", F.row_number().over(by))
    own = own.withColumn("through", F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("is_system", (F.col("i") == 1) & (F.col("role") == "system"))
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("system", F.first(F.when(F.col("is_system"), F.struct("role", "text", "tokens"))).over(whole))
    room = F.greatest(F.lit(2), F.lit(budget - history_tokens) - F.coalesce(F.col("system.tokens"), F.lit(0)))
    stretch = F.floor(room / 2)
    own = own.withColumn("long", F.col("tokens") > stretch)
    own = own.withColumn("cell", F.floor((F.col("through") - F.col("tokens")) / stretch))
    before = F.lag("cell").over(by)
    opens = F.coalesce((F.col("cell") != before) | F.col("long") | F.lag("long").over(by), F.lit(True)).cast("long")
    own = own.withColumn("opens", opens)
    own = own.withColumn("window", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    # How far the turn stands from its span's end: what of it the next window repeats.
    back = Window.partitionBy("conv_id", "window").orderBy(F.col("i").desc())
    own = own.withColumn("turns_after", F.row_number().over(back))
    own = own.withColumn("tokens_after", F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("last_window", F.max("window").over(whole))
    again = (
        (F.col("turns_after") <= history_turns)
        & (F.col("tokens_after") <= history_tokens)
        & (F.col("window") < F.col("last_window"))
        & ~F.col("is_system")
    )
    fresh = F.struct(F.col("window").alias("window"), F.lit(2).alias("part"), F.col("i").alias("i"), F.col("role").alias("role"), F.col("text").alias("text"))
    repeated = F.struct((F.col("window") + 1).alias("window"), F.lit(1).alias("part"), F.col("i").alias("i"), F.col("role").alias("role"), F.col("text").alias("text"))
    head = F.struct(F.col("window").alias("window"), F.lit(0).alias("part"), F.lit(0).alias("i"), F.col("system.role").alias("role"), F.col("system.text").alias("text"))
    retained = (F.col("opens") == 1) & F.col("system").isNotNull() & (F.col("window") > 0)
    rows = F.array_compact(F.array(fresh, F.when(again, repeated), F.when(retained, head)))
    placed = own.select("conv_id", F.explode(rows).alias("t")).select("conv_id", "t.*")
    piece = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    placed = placed.withColumn("piece", piece)
    order = Window.partitionBy("conv_id", "window").orderBy("part", "i")
    placed = placed.withColumn("upto", F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body_end = F.col("upto") - len(END) - 1
    learnt = F.when(
        (F.col("part") == 2) & (F.col("role") == TARGET),
        F.struct((body_end - F.char_length(escape(F.col("text")))).alias("start"), body_end.alias("end")),
    )
    item = F.struct("part", "i", "piece", learnt.alias("learnt"))
    grouped = placed.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.sum((F.col("part") < 2).cast("int")).cast("int").alias("context"),
    )
    return grouped.select(
        "conv_id",
        F.col("window").cast("int").alias("window"),
        F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("formatted"),
        "context",
        F.size("items").alias("n_turns"),
        F.array_compact(F.transform("items", lambda x: x["learnt"])).alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Read the conversations back from formatted windows.

    Returns conv_id, turns (array of (role, text), context left out), learnt
    (the texts under the loss, in order) and formatted_chars.
    """
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.col("context") + 2, F.greatest(F.lit(0), F.col("n_turns") - F.col("context")))

    def parse(x: Column) -> Column:
        cut = F.instr(x, "\n")
        role, rest = x.substr(F.lit(1), cut - 1), x.substr(cut + 1, F.char_length(x))
        return F.struct(unescape_role(role).alias("role"), unescape(rest.substr(F.lit(1), F.char_length(rest) - len(END) - 1)).alias("text"))

    one = windows.select(
        "conv_id",
        "window",
        F.char_length("formatted").cast("long").alias("chars"),
        F.transform(pieces, parse).alias("turns"),
        F.transform("loss", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("learnt"),
    )
    packed = one.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "turns", "learnt"))).alias("w"),
        F.sum("chars").alias("formatted_chars"),
    )
    return packed.select(
        "conv_id",
        F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"),
        F.flatten(F.transform("w", lambda x: x["learnt"])).alias("learnt"),
        "formatted_chars",
    )


def digest(read: DataFrame) -> DataFrame:
    """The columns of the query from conversations read back."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
