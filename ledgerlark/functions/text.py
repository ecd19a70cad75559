"""Scalar expressions over text: tokens, sentences, normal forms, row patterns and table noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of rows, cells, footnotes, markers and refusals.
TOKEN = r"\w+|[^\w\s]"
TERM = r"[\p{L}\p{N}]+"
REV_ROW = r"(?i)\|\s*(?:total\s+)?(?:net\s+)?(?:revenue|net\s+sales|net\s+revenues)\s*\|"
RD_ROW = r"(?i)\|\s*research\s+and\s+development\s*\|"
NI_ROW = r"(?i)\|\s*net\s+income\s*\|"
OI_ROW = r"(?i)\|\s*(?:total\s+)?(?:operating\s+income|income\s+from\s+operations)\s*\|"
CASH_ROW = r"(?i)\|\s*(?:total\s+)?cash\s+and\s+cash\s+equivalents\s*\|"
REPEAT = r"(\|[^|]+)\1+"
TRAIL = r"(\|\s*)+$"
TOTAL_ROW = r"(?i)^\|\s*total\b"
FIN_CELL = r"^\d{5,}$|^\d{1,3}(?:,\d{3}){2,}$"
FOOTNOTE = r"^[\(\*\d\†‡§¶]"
DOC_MARK = r"<!--\s*=====\s*embedded document:.*?=====\s*-->"
REFUSAL = (
    r"(?i)cannot be found|cannot be determined|can.t be found|does not (?:explicitly )?(?:mention|state|provide|discuss|contain)"
    r"|not explicitly (?:mentioned|stated)|no relevant information|is not (?:mentioned|provided|available|explicitly stated) in the"
)


def text_of(c: str | Column) -> Column:
    """The column as a string, null as the empty one."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def token_count(c: str | Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(TOKEN))


def terms(c: str | Column) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats included."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(TERM), F.lit(0))


def sentences(c: str | Column) -> Column:
    """The text cut after each full stop, exclamation or question mark that white space follows."""
    return F.split(F.regexp_replace(text_of(c), r"([.!?])\s+", "$1\x01"), "\x01")


def normal_name(c: str | Column) -> Column:
    """Lower case with runs of anything but a-z and 0-9 as one space: how names are compared."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", " "))


def is_refusal(c: str | Column) -> Column:
    return text_of(c).rlike(REFUSAL)


def json_object(c: str | Column, schema: str) -> Column:
    """The first {...} of a reply, parsed; null where there is none or it does not parse."""
    return F.from_json(F.nullif(F.regexp_extract(text_of(c), r"(?s)\{.*\}", 0), F.lit("")), schema)


def truncated(c: str | Column, most: int, suffix: str = " …") -> Column:
    """Text of at most so many tokens, marked where it was cut."""
    pieces = F.regexp_extract_all(text_of(c), F.lit(rf"\s*(?:{TOKEN})"), F.lit(0))
    return F.when(token_count(c) > most, F.concat(F.array_join(F.slice(pieces, 1, most), ""), F.lit(suffix))).otherwise(text_of(c))


def without_noise(c: str | Column) -> Column:
    """A table's text with repeated neighbouring cells and trailing empty cells collapsed and, in tables of over three
    lines, total rows moved up beneath the first two lines. Table lines lose white space at their end; other lines stay as they are."""
    cleaned = lambda x: F.when(F.contains(x, F.lit("|")) & ~F.contains(x, F.lit("---")), F.regexp_replace(F.regexp_replace(F.regexp_replace(x, REPEAT, "$1"), r"\s+$", ""), TRAIL, "|")).otherwise(x)
    lines = F.transform(F.split(text_of(c), "\n"), cleaned)

    def arranged(own: Column) -> Column:
        rest = F.slice(own, 3, F.greatest(F.size(own) - 2, F.lit(0)))
        total = lambda x: F.ltrim(x).rlike(TOTAL_ROW)
        return F.when(F.size(own) > 3, F.concat(F.slice(own, 1, 2), F.filter(rest, total), F.filter(rest, lambda x: ~total(x)))).otherwise(own)

    return F.array_join(F.element_at(F.transform(F.array(lines), arranged), 1), "\n")
