"""Which texts hold which others, without comparing all with all: candidates by the rarest part, then an exact check."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.tables import saved, scratch

#: Characters of a gram.
GRAM = 4
#: Bytes of texts without an inner term that go to all tasks at once.
BLOCK_BYTES = 8 << 20


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct runs of n characters; none of a shorter text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def by_rarest(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): for each text of inner (inner, parts: array) the texts of outer (outer, parts) that have the one of its parts that the fewest have.

    A text one of whose parts none has is held by none and goes. Only parts that inner has are counted; the counts and the
    choice are written, so that Spark knows their sizes and sends small ones to all tasks."""
    asked = inner.select("inner", F.size("parts").alias("several"), F.explode("parts").alias("part"))
    there = outer.select("outer", F.explode("parts").alias("part"))
    wanted = saved(asked.select("part").distinct())
    many = saved(there.join(wanted, "part", "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    met = asked.join(many, "part").groupBy("inner").agg(F.max("several").alias("several"), F.count(F.lit(1)).alias("met"), F.min(F.struct("n", "part")).alias("least"))
    chosen = saved(met.where("met = several").select("inner", F.col("least.part").alias("part")))
    return there.join(chosen, "part").select("inner", "outer")


def candidates(inner: DataFrame, outer: DataFrame, n: int = GRAM) -> DataFrame:
    """(inner, outer) of texts (id, text): a superset of the pairs where inner's text stands in outer's, by the rarest run of n characters.

    A text of fewer characters is looked up whole among the shorter runs of outer: that path is exact by itself."""
    parted = lambda df, name: df.select(F.col("id").alias(name), grams(F.col("text"), n).alias("parts")).where(F.size("parts") > 0)
    found = by_rarest(parted(inner, "inner"), parted(outer, "outer"))
    short = saved(inner.where(F.length("text").between(1, n - 1)).select(F.col("id").alias("inner"), F.col("text").alias("part")))
    if short.isEmpty():
        return found
    runs = F.array_distinct(F.concat(*(grams(F.col("text"), k) for k in range(1, n))))
    small = outer.select(F.col("id").alias("outer"), F.explode(runs).alias("part")).join(short, "part")
    return found.unionByName(small.select("inner", "outer"))


def either_way(names: DataFrame, titles: DataFrame, tight: Callable[[str], Column], n: int = GRAM) -> DataFrame:
    """(name, title), each once: pairs of distinct names and titles of which one, made tight, stands in the other."""
    a, b = (df.select(F.col(c).alias("id"), tight(c).alias("text")) for df, c in ((names, "name"), (titles, "title")))
    one = candidates(a, b, n).select(F.col("inner").alias("name"), F.col("outer").alias("title"))
    other = candidates(b, a, n).select(F.col("outer").alias("name"), F.col("inner").alias("title"))
    pairs = one.unionByName(other).where(F.contains(tight("name"), tight("title")) | F.contains(tight("title"), tight("name")))
    return pairs.distinct()


def containing(items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """(item_id, doc_id): the documents whose text holds the item's, each pair once for each row that it has; a table.

    An item's terms but the first and last, which may be parts of longer ones in a document, are terms of each document that
    holds it: the rarest of them gives the candidates, which are checked on the whole texts. Items without such a term
    go to the documents in blocks of at most BLOCK_BYTES. Null texts hold nothing and stand in nothing; the empty text stands in every other."""
    with scratch(items.sparkSession) as kept:
        said = saved(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item")).where("item is not null"))
        own = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("doc"))
        named = said.select("item", X.terms("item").alias("t")).distinct()
        inner = named.select(F.col("item").alias("inner"), F.array_distinct(F.slice("t", 2, F.greatest(F.size("t") - 2, F.lit(0)))).alias("parts"))
        met = saved(by_rarest(inner.where(F.size("parts") > 0), own.select(F.col("doc_id").alias("outer"), F.array_distinct(X.terms("doc")).alias("parts"))).distinct())
        checked = own.join(met.withColumnRenamed("outer", "doc_id").withColumnRenamed("inner", "item"), "doc_id").where(F.contains("doc", "item"))
        found = [checked.select("doc_id", "item")]
        short = saved(inner.where(F.size("parts") == 0).select(F.col("inner").alias("item")))
        size = short.agg(F.coalesce(F.sum(F.octet_length("item") + 16), F.lit(0))).first()[0]
        for k in range(-(-size // BLOCK_BYTES)):
            block = short.where(F.pmod(F.xxhash64("item"), F.lit(-(-size // BLOCK_BYTES))) == k)
            found.append(own.join(F.broadcast(block), F.contains("doc", "item")).select("doc_id", "item"))
        pairs = reduce(DataFrame.unionByName, found)
        return kept(pairs.join(said, "item").select("item_id", "doc_id"))
