"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import WORD_SPACE

SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
the and of to in is it that for on with this as are was be by an or at from not have has you he she they his her
le la les des du de et un une que qui en est pour dans sur par au aux avec ce se plus pas
der die das und zu den ist von mit ein eine dem des nicht auf im für sich auch als
el los las una del al lo su por con para como más pero sus y o es
""".split()


@dataclass(frozen=True)
class Rule:
    """A measure that must lie between low and high (None: no bound) where it is defined."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", low=50),
    Rule("word length", "word_chars / n_words", low=2.0, high=12.0),
    Rule("symbols", "n_symbols / n_words", high=0.1),
    Rule("stop words", "n_stop_words / n_words", low=0.08),
    Rule("repeated lines", "n_dup_lines / n_lines", high=0.5),
    Rule("repeated words", "n_repeat_words / n_words", high=0.5),
)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """True where every measure of the table is within its bounds; an undefined measure (0 / 0) passes."""
    tests = [F.expr(f"coalesce(try_divide({a}, {b}) {sign} {bound}D, true)") if "/" in r.measure else F.expr(f"{r.measure} {sign} {bound}D") for r in rules for a, _, b in [r.measure.partition("/")] for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return reduce(lambda x, y: x & y, tests, F.lit(True))


def _stop_forms() -> list[str]:
    """Stop words as written within and at the start of a sentence; in capitals throughout they do not count."""
    return sorted({w for s in STOP_WORDS for w in (s, s.capitalize())})


def _fixed(rows: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """rows with columns computed once: filters and projections above are not rewritten in terms of their expressions.

    A generator over one element is where the optimizer stops; it costs no shuffle.
    """
    return rows.select(*keep, F.explode(F.array(F.struct(*(c.alias(k) for k, c in made.items())))).alias("made")).select(*keep, "made.*")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, columns of keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words).

    Words are runs of characters other than `[\\x20\\x09-\\x0D]`. n_lines counts lines with a word, n_dup_lines those
    equal to an earlier one, n_repeat_words the words within windows of three that occur twice or more in the text.
    A null text measures as the empty one: all zero. Each row is measured by itself: no shuffle.
    """
    blank = F.lit(WORD_SPACE)
    own = ["id", *(f"kept_{k}" for k in range(len(keep or [])))]
    rows = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep or [])), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    trimmed = F.btrim("body", blank)
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))
    rows = _fixed(rows, [*own, "body"], words=words, lines=F.filter(F.split("body", "\n"), lambda x: F.btrim(x, blank) != ""))
    n = F.size("words")
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1), F.element_at("words", i + 2))))
    rows = _fixed(
        rows, own, n_words=n.cast("long"), word_chars=F.length(F.array_join("words", "")).cast("long"), n_symbols=F.regexp_count("body", F.lit(SYMBOLS)).cast("long"),
        n_lines=F.size("lines").cast("long"), n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_stop_words=F.size(F.filter("words", lambda w: w.isin(_stop_forms()))).cast("long"), windows=windows,
    )
    ranked = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # bound once by a transform over one element, so that the lambdas below do not sort anew
    twice = F.transform(F.array(ranked), lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"])))
    at = F.sort_array(F.transform(F.element_at(twice, 1), lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(at, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])
    repeats = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(covered)
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words"]
    rows = _fixed(rows, [*own, *counts], n_repeat_words=repeats.cast("long"))
    return rows.select("id", *(F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep or [])), *counts, "n_repeat_words")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures of each row with base_failed and kept, the table's verdict where the base does not fail.

    A null, empty or blank text has no words and fails. Rows with null ids, repeated rows and very long texts are
    judged like any other; an empty table gives no rows; other columns are not read.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def passing(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the table keeps, with their columns, in one pass without a join."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return measured(whole, "row").where(compiled(rules)).select("id.*")
