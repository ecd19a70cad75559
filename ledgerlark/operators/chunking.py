"""Chunks of text and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.functions import text as X

MAX_TOKENS, OVERLAP, TABLE_FLOOR = 1000, 2, 50


def packed(sentences: Column, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """Array of chunks: sentences joined until the next would pass `most` tokens; the last `overlap` sentences begin
    the next chunk. A longer sentence is a chunk by itself and nothing is carried over it. Blank chunks go."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))
    joined = lambda a: F.array_join(a, " ")
    emitted = lambda out, cur: F.when(F.size(cur) > 0, F.concat(out, F.array(joined(cur)))).otherwise(out)

    def step(a: Column, s: Column) -> Column:
        t = X.token_count(s)
        cur = a["cur"]
        tail = F.slice(cur, F.greatest(F.lit(1), F.size(cur) - overlap + 1), overlap) if overlap else F.array().cast("array<string>")
        counted = F.aggregate(tail, F.lit(0), lambda n, x: n + X.token_count(x))
        alone = F.struct(F.concat(emitted(a["out"], cur), F.array(s)).alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))
        full = F.struct(emitted(a["out"], cur).alias("out"), F.concat(tail, F.array(s)).alias("cur"), (counted + t).alias("n"))
        more = F.struct(a["out"].alias("out"), F.concat(cur, F.array(s)).alias("cur"), (a["n"] + t).alias("n"))
        return F.when(t > most, alone).when((a["n"] + t > most) & (F.size(cur) > 0), full).otherwise(more)

    return F.filter(F.aggregate(sentences, start, step, lambda a: emitted(a["out"], a["cur"])), lambda x: F.trim(x) != "")


def text_chunks(docs: DataFrame, text: str = "text", most: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """docs with a row (position, chunk_text, token_count) for each chunk."""
    rows = docs.select(*[c for c in docs.columns if c != text], F.posexplode(packed(X.sentences(text), most, overlap)).alias("position", "chunk_text"))
    return rows.withColumn("token_count", X.token_count("chunk_text"))


def table_parts(text: Column, most: Column | int, figures: str = X.FIN_CELL) -> Column:
    """Array of the parts of a markdown table of more than `most` tokens. Each part repeats the first two lines and the
    rows before the first with a figure (of the first eight); what is left is cut into equal numbers of rows. figures is the pattern of a
    cell that is a figure."""
    lines = F.split(F.trim(text), "\n")
    whole = F.array(text)

    def cut(own: Column) -> Column:
        head, rows = F.slice(own, 1, 2), F.slice(own, 3, F.greatest(F.size(own) - 2, F.lit(0)))
        figure = lambda r: F.exists(F.transform(F.split(r, r"\|"), lambda x: F.trim(x)), lambda c: c.rlike(figures))
        first = F.array_position(F.transform(F.slice(rows, 1, 8), figure), True)
        context = F.when(first > 0, first - 1).otherwise(F.least(F.size(rows), F.lit(8))).cast("int")
        fixed = F.concat(head, F.slice(rows, 1, context))
        left = F.slice(rows, context + 1, F.greatest(F.size(rows), F.lit(1)))
        sample = F.slice(left, 1, 10)
        per_row = F.greatest(F.lit(1), F.floor(X.token_count(F.array_join(sample, "\n")) / F.greatest(F.size(sample), F.lit(1)))).cast("int")
        room = F.lit(most) if isinstance(most, int) else most
        step = F.greatest(F.lit(1), F.floor((room - X.token_count(F.concat(F.array_join(fixed, "\n"), F.lit("\n")))) / per_row)).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.size(left), step), lambda i: F.array_join(F.concat(fixed, F.slice(left, i, step)), "\n"))
        return F.when((F.size(own) < 3) | (F.size(left) == 0), whole).otherwise(parts)

    bound = F.element_at(F.transform(F.array(lines), cut), 1)
    return F.when(X.token_count(text) <= most, whole).otherwise(bound)


def enriched(tables: DataFrame, text: str = "text", most: int = MAX_TOKENS) -> DataFrame:
    """Table chunks (position, chunk_text, token_count) of rows with company, ticker, fiscal_year and section_name.

    A line that names them goes before each part; the parts' budget is what it leaves, 50 at least, and token_count
    does not count it."""
    head = F.concat(F.col("company"), F.lit(" ("), F.col("ticker"), F.lit(") FY"), F.col("fiscal_year").cast("string"), F.lit(" — "), F.col("section_name"), F.lit("\n"))
    room = F.greatest(F.lit(TABLE_FLOOR), most - X.token_count(head))
    rows = tables.withColumn("head", head).withColumn("room", room)
    rows = rows.select(*[c for c in rows.columns if c not in (text, "room")], F.posexplode(table_parts(F.col(text), F.col("room"))).alias("position", "part"))
    return rows.withColumn("token_count", X.token_count("part")).withColumn("chunk_text", F.concat("head", "part")).drop("head", "part")


def identified(chunks: DataFrame, order: list[str], doc: str = "doc_id", parent: str = "section_id") -> DataFrame:
    """Running positions within each document from 0, and ids that depend on nothing but where a chunk stands, so that
    chunking again replaces instead of adding."""
    place = F.row_number().over(W.partitionBy(doc).orderBy(*order)) - 1
    rows = chunks.withColumn("position", place)
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws("|", F.col(doc).cast("string"), F.col(parent).cast("string"), F.col("position").cast("string")), 256))
