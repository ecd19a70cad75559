"""Chat formatting by quotation linking, without user functions.

Lines that begin with `>` marks are quotes; runs of lines of one level are passages. A passage and each of its lines
are hashed in a normal form and looked up among the passages and lines that messages wrote themselves. The first
message of the conversation that wrote it, or else the first of all, is the original that the quoting message answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.llm.common import WORD_SPACE, integer_id, saved

MARKS = r"^[ \t]*>[> \t]*"
#: Turns of a block: a conversation of any length is ordered in windows of this many.
BLOCK = 1024
#: Lines shorter than this many characters in normal form link nothing by themselves.
LEAST_LINE = 20


def normal(text: Column) -> Column:
    """Lower case, runs of white space as one space, no space at the ends."""
    return F.lower(F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(WORD_SPACE)))


def passages(text: Column) -> Column:
    """Array of (level, body): runs of lines with equally many quote marks, level 0 being the message's own words."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"), x.alias("line")))
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["level"] != F.get(s, i - 1)["level"]))

    def runs(s: Column) -> Column:
        # begins is bound once by a transform over one element
        return F.element_at(F.transform(F.array(starts(s)), lambda b: F.transform(b, lambda at, k: F.struct(
            F.get(s, at)["level"].alias("level"),
            F.array_join(F.transform(F.slice(s, at + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - at), lambda x: F.when(x["level"] > 0, x["body"]).otherwise(x["line"])), "\n").alias("body"),
        ))), 1)

    return F.element_at(F.transform(F.array(lines), runs), 1)


def _keys(body: Column) -> Column:
    """Hashes of a passage and of its longer lines in normal form, each once; the passage's own first."""
    lines = F.filter(F.transform(F.split(body, "\n"), normal), lambda x: F.length(x) >= LEAST_LINE)
    whole = F.filter(F.array(normal(body)), lambda x: x != "")
    return F.array_distinct(F.transform(F.concat(whole, lines), lambda x: F.xxhash64(x)))


def linked(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, max_level, n_linked, reply_to_conv, reply_to_turn, linked_by, reply_position) of each message.

    text has the message's own lines only. The reply is to the original of a quoted passage ('quote'): of those that have one,
    of the least quote level, whole passages before lines, the first; else to the turn before in the conversation ('order'), else to none. Originals are earlier turns
    of the same conversation or, failing that, the first message of another one with that passage (the least conversation, then turn);
    a message is never its own original. reply_position numbers a conversation's messages from 0 without a gap in the order of the
    turns they answer and then of their own: a message comes after the one it answers and beside the others that answer it; what answers
    nothing in the conversation comes first; of one turn the order is that of the other columns.
    A null text is an empty message. A null conversation or turn links nothing and has neither reply nor position. Messages that
    repeat a turn keep a row each and share their turn's predecessor. A common passage is one row of originals, so
    that it never multiplies rows; conversations are ordered in blocks of turns. Very long messages are read whole. An empty table gives no
    rows; other columns are not read.
    """
    rows = messages.select(integer_id(messages, conv_col).alias("conv_id"), integer_id(messages, turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("body"))
    split = rows.withColumn("runs", passages(F.col("body")))
    quoted = F.filter("runs", lambda r: r["level"] > 0)
    message = F.xxhash64("conv_id", "turn", "role", "body").alias("message")
    split = split.select(
        "conv_id", "turn", "role", message, F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["body"]), "\n").alias("text"),
        quoted.alias("quotes"), F.coalesce(F.array_max(F.transform(quoted, lambda r: r["level"])), F.lit(0)).alias("max_level"),
    )
    placed = split.where("conv_id is not null and turn is not null")
    asks = placed.where(F.size("quotes") > 0).select("conv_id", "turn", "message", F.posexplode("quotes").alias("q", "quote"))
    asks = asks.select("conv_id", "turn", "message", "q", "quote.level", F.posexplode(_keys(F.col("quote.body"))).alias("part", "h"))
    asks = saved(asks.distinct())
    replies = None
    if not asks.isEmpty():
        wrote = placed.select("conv_id", "turn", F.explode(_keys(F.col("text"))).alias("h"))
        wrote = wrote.join(asks.select("h").distinct(), "h", "left_semi")
        here = wrote.groupBy("conv_id", "h").agg(F.min("turn").alias("here_turn"))
        # the first two conversations of a passage: one of them is another than the asking one (a limit of each task's rows comes before the shuffle)
        leading = here.withColumn("place", F.row_number().over(W.partitionBy("h").orderBy("conv_id"))).where("place <= 2")
        original = F.struct("conv_id", F.col("here_turn").alias("turn"))
        first = leading.groupBy("h").agg(F.min(F.when(F.col("place") == 1, original)).alias("one"), F.min(F.when(F.col("place") == 2, original)).alias("two"))
        met = asks.join(here, ["conv_id", "h"], "left").join(first, "h", "left")
        own = F.col("here_turn") < F.col("turn")
        met = met.withColumn("to", F.when(own, F.struct("conv_id", F.col("here_turn").alias("turn"))).when(F.col("one.conv_id") != F.col("conv_id"), F.col("one")).otherwise(F.col("two")))
        met = met.where("to is not null").groupBy("conv_id", "turn", "message")
        replies = met.agg(F.count_distinct("q").alias("n_linked"), F.min(F.struct("level", F.when(F.col("part") > 0, 1).otherwise(0).alias("by_line"), "q", "part", "to"))["to"].alias("to"))
    before = _turn_before(placed.select("conv_id", "turn").distinct())
    out = split.join(before, ["conv_id", "turn"], "left")
    if replies is not None:
        out = out.join(replies, ["conv_id", "turn", "message"], "left")
    else:
        out = out.withColumn("n_linked", F.lit(0).cast("long")).withColumn("to", F.lit(None).cast("struct<conv_id:bigint,turn:bigint>"))
    by = F.when(F.col("to").isNotNull(), "quote").when(F.col("prev").isNotNull(), "order")
    out = out.select(
        "conv_id", "turn", "role", "text", F.size("quotes").cast("long").alias("n_quotes"), F.col("max_level").cast("long").alias("max_level"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("to.conv_id", F.when(F.col("prev").isNotNull(), F.col("conv_id"))).alias("reply_to_conv"), F.coalesce("to.turn", "prev").alias("reply_to_turn"), by.alias("linked_by"),
    )
    return _positioned(out)


def _positioned(rows: DataFrame) -> DataFrame:
    """Linked messages with reply_position.

    No window holds a whole conversation: rows are numbered within a parent's block of turns, and the sums of the rows before come from windows
    over the blocks, those of a block of parents first, then over blocks of parents.
    """
    names, cell = rows.columns, ["conv_id", "parents", "parent", "block"]
    parent = F.when(F.col("reply_to_conv") == F.col("conv_id"), F.col("reply_to_turn"))
    rows = rows.withColumn("parent", parent).withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumn("parents", F.floor(F.col("parent") / BLOCK))
    rows = saved(rows)
    before = lambda by, order: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = rows.where("conv_id is not null and turn is not null").groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    blocks = cells.groupBy("conv_id", "parents").agg(F.sum("n").alias("n"))
    blocks = blocks.select(F.col("conv_id").alias("b_conv"), F.col("parents").alias("b_parents"), before(["conv_id"], ["parents"]).alias("b_before"))
    cells = cells.withColumn("c_before", before(["conv_id", "parents"], ["parent", "block"]))
    cells = cells.join(blocks, (F.col("conv_id") == F.col("b_conv")) & F.col("parents").eqNullSafe(F.col("b_parents")))
    cells = cells.select(F.col("conv_id").alias("c_conv"), F.col("parents").alias("c_parents"), F.col("parent").alias("c_parent"), F.col("block").alias("c_block"), (F.col("b_before") + F.col("c_before")).alias("c_before"))
    own = F.row_number().over(W.partitionBy(*cell).orderBy("turn", "role", F.sha2(F.encode("text", "UTF-8"), 256), *[c for c in names if c not in ("conv_id", "turn", "role", "text")])) - 1
    placed = rows.withColumn("own", own)
    same = (F.col("conv_id") == F.col("c_conv")) & F.col("block").eqNullSafe(F.col("c_block")) & F.col("parent").eqNullSafe(F.col("c_parent"))
    return placed.join(cells, same, "left").select(*names, F.when(F.col("turn").isNotNull(), F.col("c_before") + F.col("own")).cast("long").alias("reply_position"))


def _turn_before(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, prev): the next smaller turn of each distinct turn.

    Windows hold a block of turns; the first of a block looks for the last of the block before it, in windows that
    have a row for each block.
    """
    block = turns.withColumn("block", F.floor(F.col("turn") / BLOCK).cast("long"))
    inside = block.withColumn("prev", F.lag("turn").over(W.partitionBy("conv_id", "block").orderBy("turn")))
    ends = block.groupBy("conv_id", "block").agg(F.max("turn").alias("last"))
    earlier = ends.select("conv_id", "block", F.lag("last").over(W.partitionBy("conv_id").orderBy("block")).alias("last")).where("last is not null")
    return inside.join(earlier, ["conv_id", "block"], "left").select("conv_id", "turn", F.coalesce("prev", "last").alias("prev"))


def ordered(rows: DataFrame) -> DataFrame:
    """Linked messages dealt out and sorted by conversation and reply position, without gathering a conversation."""
    return rows.repartitionByRange("conv_id", "reply_position").sortWithinPartitions("conv_id", "reply_position")
