"""From questions to targets: classification rules, company resolution, decomposition and outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.operators import matching
from ledgerlark.tables import saved, scratch

# Companies covered from the start, years, types and topics of questions, and phrases for topics.
COMPANIES = [
    ("AAPL", "Apple Inc.", "Technology"), ("MSFT", "Microsoft Corporation", "Technology"), ("GOOGL", "Alphabet Inc.", "Technology"), ("AMZN", "Amazon.com Inc.", "Technology"),
    ("JPM", "JPMorgan Chase & Co.", "Banking"), ("WFC", "Wells Fargo & Company", "Banking"), ("BAC", "Bank of America Corporation", "Banking"), ("GS", "The Goldman Sachs Group Inc.", "Banking"),
    ("BLK", "BlackRock Inc.", "Asset Management"), ("STT", "State Street Corporation", "Asset Management"), ("TROW", "T. Rowe Price Group Inc.", "Asset Management"), ("IVZ", "Invesco Ltd.", "Asset Management"),
]
YEARS = (2023, 2024, 2025)
TYPES = ("single_doc", "multi_doc", "temporal", "out_of_scope")
METRICS = {
    "revenue": "total net sales or total revenue", "rd_expense": "research and development expenses", "net_income": "net income", "operating_income": "income from operations",
    "balance_sheet": "total assets, liabilities, and cash and cash equivalents", "segment_info": "business segment breakdown", "business_overview": "core business, products, and segments",
    "risk_factors": "key risk factors", "legal_proceedings": "legal proceedings", "cybersecurity": "cybersecurity risk management", "other": "financial performance",
}
FINANCIAL = ("revenue", "rd_expense", "net_income", "operating_income", "balance_sheet")
# Ours: words that tell a question's topic, tried in this order.
TOPIC_WORDS = [
    ("rd_expense", r"\br&d\b|research"), ("operating_income", r"operating income|income from operations"), ("net_income", r"net income|net loss|earnings|profit"), ("revenue", r"revenue|net sales|sales"),
    ("legal_proceedings", r"lawsuit|litigation|legal"), ("cybersecurity", r"cyber"), ("risk_factors", r"risk|threat|uncertaint"), ("balance_sheet", r"balance sheet|assets|liabilit|cash|debt"),
    ("segment_info", r"segment|geograph"), ("business_overview", r"business|product|sell|strategy|industry"),
]
# Ours: capitalised words that name no company.
NO_NAMES = (
    "a an and annual are but can compare describe did do does earlier fiscal form fy give has have how i if in is it list of on or our q report reports show summarize tell the their these they this those was we were what when where which who why you "
    "year january february march april may june july august september october november december"
).split()


def companies(spark) -> DataFrame:
    return spark.createDataFrame(COMPANIES, "ticker string, name string, sector string")


def classified(questions: DataFrame, known: DataFrame) -> DataFrame:
    """Default classifier: (query_id, question, tickers, years, focus, query_type). A company is meant by its ticker as a word or
    the first word of its name; several companies, then several years, decide the type; a question that names none is out of scope.

    Runs of capitalised words that name no known company, and are no words of questions, are unresolved names. A reply of a model is checked by
    validated() instead."""
    names = known.select("ticker", F.split(X.normal_name(F.regexp_replace("name", r"(?i)^the\s+", "")), " ").alias("words")).select("ticker", F.get("words", F.lit(0)).alias("word"))
    asked = questions.withColumn("words", F.array_distinct(F.split(X.normal_name("question"), " ")))
    pairs = names.select("ticker", F.explode(F.array_distinct(F.array(F.lower("ticker"), "word"))).alias("word")).where("word <> ''")
    met = asked.select("query_id", F.explode("words").alias("word")).join(pairs, "word").groupBy("query_id").agg(F.sort_array(F.collect_set("ticker")).alias("tickers"))
    years = F.sort_array(F.array_distinct(F.filter(F.transform(F.regexp_extract_all("question", F.lit(r"\b(20\d\d)\b"), F.lit(1)), lambda y: y.cast("int")), lambda y: y.isin(*YEARS))))
    low = F.lower(X.text_of("question"))
    years = F.when(low.rlike(r"last year|recent") & (F.size(years) == 0), F.array(*map(F.lit, YEARS))).otherwise(years)
    focus = reduce(lambda c, kv: c.when(low.rlike(kv[1]), kv[0]), TOPIC_WORDS, F.when(F.lit(False), "")).otherwise("other")
    rows = questions.join(met, "query_id", "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>"))).withColumn("years", years).withColumn("focus", focus)
    words = F.collect_set("word").alias("words")
    every = pairs.agg(words).withColumn("one", F.lit(1))  # a word or two for each of the companies covered from the start
    runs = F.regexp_extract_all(X.text_of("question"), F.lit(r"[A-Z][\w&.'-]*(?:\s+[A-Z][\w&.'-]*)*"), F.lit(0))
    strange = lambda w: (X.normal_name(w) != "") & ~F.array_contains("words", X.normal_name(w)) & ~X.normal_name(w).isin(*NO_NAMES) & ~X.normal_name(w).rlike(r"^(?:fy|q)?\d*$")
    known_run = lambda r: F.exists(F.split(X.normal_name(r), " "), lambda w: F.array_contains("words", w))
    named = F.transform(F.filter(runs, lambda r: ~known_run(r)), lambda r: F.regexp_replace(F.array_join(F.filter(F.split(r, r"\s+"), strange), " "), r"(?:'s?|\.)$", ""))
    rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(every), "one").withColumn("unresolved", F.array_distinct(F.filter(named, lambda m: m != ""))).drop("one", "words")
    kind = F.when(F.size("tickers") + F.size("unresolved") > 1, "multi_doc").when(F.size("tickers") + F.size("unresolved") == 0, "out_of_scope").when(F.size("years") > 1, "temporal").otherwise("single_doc")
    return rows.withColumn("query_type", kind)


def validated(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """A model's reply as columns: unknown types become single_doc and unknown topics other, years outside the covered ones go,
    and tickers outside the known companies are moved to unresolved. A reply that does not parse has no filters."""
    own = X.json_object(reply, "query_type string, tickers array<string>, other_companies array<string>, years array<int>, focus string, reasoning string")
    rows = replies.withColumn("r", own)
    known, none = F.array(*(F.lit(t) for t, _, _ in COMPANIES)), F.array().cast("array<string>")
    tickers = F.array_distinct(F.transform(F.coalesce("r.tickers", none), F.upper))
    return rows.select(
        *[c for c in rows.columns if c not in ("r", reply)], F.when(F.col("r.query_type").isin(*TYPES), F.col("r.query_type")).otherwise("single_doc").alias("query_type"),
        F.array_intersect(tickers, known).alias("tickers"), F.concat(F.coalesce("r.other_companies", none), F.array_except(tickers, known)).alias("unresolved"),
        F.filter(F.coalesce("r.years", F.array().cast("array<int>")), lambda y: y.isin(*YEARS)).alias("years"), F.when(F.col("r.focus").isin(*METRICS), F.col("r.focus")).otherwise("other").alias("focus"),
    )


def resolved(mentions: DataFrame, registry: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(mention_id, mention, ticker, title, tier) of each mention, as a table: a known company's ticker (0), a registry ticker (1), a title
    that holds the mention or is held by it (2), the same without spaces (3); of several the shortest title, then the first in order.

    Exact tiers are equi joins. What they leave is matched by distinct names and titles without spaces: the rarest run of four
    characters gives the candidates, shorter names are looked up whole, and all are checked exactly. Equal mentions are matched once, and of titles
    with one normal form the shortest and first stands for all. Mentions and titles without letters or digits, or null,
    match nothing; rows that repeat an id are answered each. registry: ticker, title, ord."""
    with scratch(mentions.sparkSession) as kept:
        asked = mentions.select("mention_id", "mention", X.normal_name("mention").alias("name"), F.upper(F.trim("mention")).alias("key"))
        exact = [(registry.select(F.upper("ticker").alias("key"), "ticker", "title", "ord"), 1)]
        if known is not None:
            exact.insert(0, (known.select(F.upper("ticker").alias("key"), "ticker", F.col("name").alias("title"), F.lit(0).alias("ord")), 0))
        best = lambda tier: F.min(F.struct(tier.alias("tier"), F.length("title").alias("long"), "ord", "ticker", F.col("title").alias("said"))).alias("best")
        keys = asked.select("key").distinct()
        hits = reduce(DataFrame.unionByName, (keys.join(x, "key").select("key", "ticker", "title", "ord", F.lit(t).alias("tier")) for x, t in exact))
        hits = saved(hits.groupBy("key").agg(best(F.col("tier"))))
        norms = registry.withColumn("norm", X.normal_name("title")).where("norm <> ''").groupBy("norm").agg(F.min(F.struct(F.length("title").alias("long"), "ord", "ticker", "title")).alias("of"))
        norms = saved(norms.select("norm", "of.ord", "of.ticker", "of.title"))
        names = saved(asked.join(hits, "key", "left_anti").where("name <> ''").select("name").distinct())
        pairs = matching.either_way(names, norms.select(F.col("norm").alias("title")), lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))).withColumnRenamed("title", "norm")
        tier = F.when(F.contains("name", "norm") | F.contains("norm", "name"), 2).otherwise(3)
        near = saved(pairs.withColumn("tier", tier).join(norms, "norm").groupBy("name").agg(best(F.col("tier"))))
        told = asked.join(hits, "key", "left").join(near.withColumnRenamed("best", "near"), "name", "left").withColumn("best", F.coalesce("best", "near"))
        return kept(told.select("mention_id", "mention", "best.ticker", F.col("best.said").alias("title"), "best.tier"))


def by_year(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, ord, question, ticker, year): a question for each distinct year, in order, in the words of the topic."""
    phrase = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in METRICS.items() for x in kv)), F.col("focus")), F.lit(METRICS["other"]))
    rows = questions.withColumn("ticker", F.coalesce(F.get("tickers", F.lit(0)), F.lit("AAPL"))).join(known.select("ticker", "name"), "ticker", "left")
    rows = rows.select("query_id", "ticker", F.coalesce("name", "ticker").alias("name"), phrase.alias("metric"), F.posexplode(F.sort_array(F.array_distinct("years"))).alias("ord", "year"))
    return rows.select("query_id", "ord", F.format_string("What was %s's %s in fiscal year %d?", "name", "metric", "year").alias("question"), "ticker", "year")


def by_company(questions: DataFrame) -> DataFrame:
    """(query_id, ord, question, ticker, year): the question itself for each company and year; AAPL and 2024 stand for none."""
    tickers = F.when(F.size("tickers") > 0, F.col("tickers")).otherwise(F.array(F.lit("AAPL")))
    years = F.when(F.size("years") > 0, F.col("years")).otherwise(F.array(F.lit(2024)))
    rows = questions.select("query_id", "question", F.posexplode(tickers).alias("t", "ticker"), years.alias("ys"))
    rows = rows.select("query_id", "question", "t", "ticker", F.posexplode("ys").alias("y", "year"), F.size("ys").alias("n"))
    return rows.select("query_id", (F.col("t") * F.col("n") + F.col("y")).alias("ord"), "question", "ticker", "year")


def decomposed(questions: DataFrame, known: DataFrame) -> DataFrame:
    """Default decomposition of questions (query_id, question, query_type, focus, targets): one company over several years by a question for each year in
    the words of the topic, all others by the question itself for each company and year."""
    one = F.size(F.array_distinct(F.transform("targets", lambda t: t["ticker"]))) == 1
    years = questions.where((F.col("query_type") == "temporal") & one).select("query_id", "focus", "tickers", F.transform("targets", lambda t: t["year"]).alias("years"))
    rest = questions.where(~((F.col("query_type") == "temporal") & one)).select("query_id", "question", F.posexplode("targets").alias("ord", "t"))
    return by_year(years, known).unionByName(rest.select("query_id", "ord", "question", "t.ticker", "t.year"))


def target_year() -> Column:
    """The year that must be covered: the first, of questions about figures that do not span years."""
    return F.when((F.col("query_type") != "temporal") & F.col("focus").isin(*FINANCIAL), F.get("years", F.lit(0)))


def outcomes(questions: DataFrame, indexed: DataFrame) -> DataFrame:
    """questions (query_id, query_type, tickers, years, focus, unresolved) with failed (unresolved mentions), missing_years
    (companies not indexed for the year that must be covered) and the route taken. indexed: ticker, fiscal_year."""
    rows = questions.withColumn("target", target_year())
    asked = rows.select("query_id", "target", F.explode("tickers").alias("ticker"))
    has = indexed.groupBy("ticker").agg(F.collect_set("fiscal_year").alias("have"))
    lack = asked.join(has, "ticker", "left").where(F.col("have").isNull() | (F.col("target").isNotNull() & ~F.array_contains("have", F.col("target"))))
    lack = lack.groupBy("query_id").agg(F.sort_array(F.collect_set("ticker")).alias("missing_years"))
    rows = rows.join(lack, "query_id", "left").withColumn("missing_years", F.coalesce("missing_years", F.array().cast("array<string>")))
    named = F.size("tickers") > 0
    route = F.when((F.col("query_type") == "out_of_scope") & ~named, "out_of_scope").when(~named & (F.size("unresolved") > 0), "unresolved_company").when(~named, "clarification_needed")
    route = route.when(F.col("query_type").isin("multi_doc", "temporal"), "synthesis").otherwise("single")
    return rows.withColumn("route", route)


def ensured(asked: DataFrame, registry: DataFrame, known: DataFrame, indexed: DataFrame, fetch=None) -> DataFrame:
    """asked (query_id, query_type, tickers, years, focus, unresolved and others) with the companies and collections that can be searched.

    Names in unresolved become tickers where the registry has them, else they are failed_lookups. Each company must be indexed (indexed: ticker,
    fiscal_year), for the year that must be covered if there is one; what is not goes to fetch, a function of (ticker, year)
    that returns (ticker, year, years), the years that are indexed now, null where it failed; without a fetch nothing is.
    tickers are those that are there; targets their collections: the years asked for that they have, and the one that must be covered, else the last;
    ingest_failed has tickers, year_not_available tickers with the years that there are. A question out of scope that names a company after all
    is one of one or several companies; route is what becomes of it."""
    rows = asked.withColumn("target", target_year())
    none = F.array().cast("array<string>")
    said = rows.select("query_id", F.posexplode("unresolved").alias("at", "mention"))
    found = resolved(said.select(F.col("mention").alias("mention_id"), "mention").distinct(), registry, known)
    said = saved(said.join(found.select("mention", "ticker"), "mention", "left"))
    in_order = lambda at, value: F.transform(F.sort_array(F.collect_list(F.struct(at, value.alias("v")))), lambda x: x["v"])
    lost = said.where("ticker is null").groupBy("query_id").agg(in_order("at", F.col("mention")).alias("failed_lookups"))
    wanted = rows.select("query_id", F.posexplode("tickers").alias("at", "ticker")).unionByName(said.where("ticker is not null").select("query_id", (F.col("at") + 1000).alias("at"), "ticker"))
    wanted = wanted.groupBy("query_id", "ticker").agg(F.min("at").alias("at")).join(rows.select("query_id", "target", "years"), "query_id")
    there = indexed.where("fiscal_year is not null").groupBy("ticker").agg(F.sort_array(F.collect_set(F.col("fiscal_year").cast("int"))).alias("have"))
    wanted = wanted.join(there, "ticker", "left").withColumn("have", F.coalesce("have", F.array().cast("array<int>"))).withColumn("failed", F.size("have") == 0)
    if fetch is not None:
        lacking = (F.size("have") == 0) | (F.col("target").isNotNull() & ~F.array_contains("have", F.col("target")))
        got = saved(fetch(saved(wanted.where(lacking).select("ticker", F.col("target").alias("year")).distinct())))
        got = got.select(F.col("ticker").alias("t"), F.col("year").alias("y"), F.col("years").alias("now"), F.lit(True).alias("asked"))
        wanted = saved(wanted).join(got, (F.col("ticker") == F.col("t")) & F.col("target").eqNullSafe(F.col("y")) & lacking, "left")
        wanted = wanted.withColumn("failed", F.when(F.col("asked"), F.col("now").isNull() | (F.size("now") == 0)).otherwise(F.col("failed"))).withColumn("have", F.array_sort(F.array_union("have", F.coalesce("now", F.array().cast("array<int>")))))
    sure = F.when(~F.col("failed"), F.when(F.col("target").isNull(), F.array_max("have")).when(F.array_contains("have", F.col("target")), F.col("target")))
    years = F.array_sort(F.array_union(F.array_intersect("years", "have"), F.array("sure")))
    none_such = F.concat("ticker", F.lit(" (asked for FY"), F.col("target").cast("string"), F.lit(", have FY"), F.array_join("have", "/FY"), F.lit(")"))
    wanted = wanted.withColumn("sure", sure).withColumn("own", F.transform(years, lambda y: F.struct(F.col("ticker").alias("ticker"), y.alias("year"))))
    ok = F.col("sure").isNotNull()
    picked = wanted.groupBy("query_id").agg(
        in_order("at", F.when(ok, F.col("ticker"))).alias("_t"), in_order("at", F.when(ok, F.col("own"))).alias("_c"), in_order("at", F.when(F.col("failed"), F.col("ticker"))).alias("_f"),
        in_order("at", F.when(~F.col("failed") & ~ok, none_such)).alias("_y"),
    )
    out = rows.drop("tickers").join(picked, "query_id", "left").join(lost, "query_id", "left")
    out = out.withColumns({n: F.coalesce(F.array_compact(c), none) for n, c in (("tickers", "_t"), ("ingest_failed", "_f"), ("year_not_available", "_y"))})
    out = out.withColumn("targets", F.coalesce(F.flatten(F.array_compact("_c")), F.array().cast("array<struct<ticker:string,year:int>>"))).withColumn("failed_lookups", F.coalesce("failed_lookups", none)).drop("_t", "_c", "_f", "_y")
    named, kind = F.size("tickers") > 0, F.col("query_type")
    out = out.withColumn("query_type", F.when((kind == "out_of_scope") & named, F.when(F.size("tickers") > 1, "multi_doc").otherwise("single_doc")).otherwise(kind))
    problem = F.size("failed_lookups") + F.size("ingest_failed") + F.size("year_not_available") > 0
    route = F.when(F.col("query_type") == "out_of_scope", "out_of_scope").when(~named & problem, "unresolved_company").when(~named, "clarification_needed")
    return out.withColumn("route", route.when(F.col("query_type").isin("multi_doc", "temporal"), "synthesis").otherwise("single")).drop("target")
