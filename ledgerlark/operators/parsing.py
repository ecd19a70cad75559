"""From filing HTML to sections and blocks. Lines, headings and slices are DataFrame operations; only tables need a parser."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.tables import saved, scratch

# Heading patterns, in the order in which they are tried, with ids and titles.
DASH = r"[\.\s:—–-]*"
HEADINGS = [
    (rf"item\s*1a{DASH}risk\s*factor", "item_1a_risk_factors", "Item 1A: Risk Factors"),
    (rf"item\s*1b{DASH}unresolved", "item_1b_staff", "Item 1B: Unresolved Staff Comments"),
    (rf"item\s*1c{DASH}cyber", "item_1c_cyber", "Item 1C: Cybersecurity"),
    (rf"item\s*1{DASH}business", "item_1_business", "Item 1: Business"),
    (rf"item\s*2{DASH}propert", "item_2_properties", "Item 2: Properties"),
    (rf"item\s*3{DASH}legal", "item_3_legal", "Item 3: Legal Proceedings"),
    (rf"item\s*4{DASH}mine", "item_4_mine", "Item 4: Mine Safety"),
    (rf"item\s*5{DASH}market", "item_5_market", "Item 5: Market for Equity"),
    (rf"item\s*6{DASH}selected", "item_6_selected", "Item 6: Selected Financial Data"),
    (rf"item\s*7a{DASH}quantitative", "item_7a_market_risk", "Item 7A: Quantitative Disclosures"),
    (rf"item\s*7{DASH}management", "item_7_mda", "Item 7: MD&A"),
    (rf"item\s*8{DASH}financial", "item_8_financials", "Item 8: Financial Statements"),
    (rf"item\s*9a{DASH}controls", "item_9a_controls", "Item 9A: Controls and Procedures"),
    (rf"item\s*9b{DASH}other", "item_9b_other", "Item 9B: Other Information"),
    (rf"item\s*9{DASH}change", "item_9_accountants", "Item 9: Disagreements with Accountants"),
    (r"item\s*1[0-4][\.\s:]", "item_governance", "Items 10-14: Corporate Governance"),
    (rf"item\s*15{DASH}exhibit", "item_15_exhibits", "Item 15: Exhibits"),
    (r"consolidated\s+statements?\s+of\s+operations", "fs_income_stmt", "Consolidated Statements of Operations"),
    (r"consolidated\s+statements?\s+of\s+(income|earnings)", "fs_income_stmt", "Consolidated Statements of Income"),
    (r"consolidated\s+(income|earnings)\s+statements?", "fs_income_stmt", "Consolidated Statements of Income"),
    (r"consolidated\s+balance\s+sheets?", "fs_balance_sheet", "Consolidated Balance Sheets"),
    (r"consolidated\s+statements?\s+of\s+financial\s+(condition|position)", "fs_balance_sheet", "Consolidated Statements of Financial Condition"),
    (r"consolidated\s+statements?\s+of\s+condition\b", "fs_balance_sheet", "Consolidated Statement of Condition"),
    (r"consolidated\s+statements?\s+of\s+cash\s+flows?", "fs_cash_flow", "Consolidated Statements of Cash Flows"),
    (r"consolidated\s+statements?\s+of\s+(stockholders|shareholders|changes\s+in\s+equity)", "fs_equity", "Consolidated Statements of Equity"),
    (r"notes?\s+to\s+(consolidated\s+)?financial\s+statements?", "fs_notes", "Notes to Financial Statements"),
    (r"^risk\s+factors$", "item_1a_risk_factors", "Item 1A: Risk Factors"),
    (r"management.s\s+discussion\s+and\s+analysis", "item_7_mda", "Item 7: MD&A"),
    (r"^financial\s+review$", "item_7_mda", "Item 7: MD&A"),
    (r"^quantitative\s+and\s+qualitative", "item_7a_market_risk", "Item 7A: Quantitative Disclosures"),
    (r"financial\s+statements\s+and\s+supplementary", "item_8_financials", "Item 8: Financial Statements"),
    (r"^controls\s+and\s+procedures$", "item_9a_controls", "Item 9A: Controls and Procedures"),
]
STATEMENTS = [
    (r"^consolidated\s+statements?\s+of\s+(income|earnings)\s*$", "fs_income_stmt", "Consolidated Statements of Income"),
    (r"^consolidated\s+statements?\s+of\s+operations\s*$", "fs_income_stmt", "Consolidated Statements of Operations"),
    (r"^consolidated\s+(income|earnings)\s+statements?\s*$", "fs_income_stmt", "Consolidated Statements of Income"),
    (r"^consolidated\s+balance\s+sheets?\s*$", "fs_balance_sheet", "Consolidated Balance Sheets"),
    (r"^consolidated\s+statements?\s+of\s+financial\s+(condition|position)\s*$", "fs_balance_sheet", "Consolidated Statements of Financial Condition"),
    (r"^consolidated\s+statements?\s+of\s+condition\s*$", "fs_balance_sheet", "Consolidated Statement of Condition"),
    (r"^consolidated\s+statements?\s+of\s+cash\s+flows?\s*$", "fs_cash_flow", "Consolidated Statements of Cash Flows"),
    (r"^notes?\s+to\s+(consolidated\s+)?financial\s+statements?\s*$", "fs_notes", "Notes to Financial Statements"),
    (r"^consolidated\s+statements?\s+of\s+(stockholders|shareholders|changes\s+in\s+equity)\s*$", "fs_equity", "Consolidated Statements of Equity"),
    (r"^financial\s+statements?\s*$", "fs_income_stmt", "Financial Statements"),
]
#: Words of which every pattern above needs one: other lines meet none of them.
WORDS = ("item", "consolidated", "note", "risk", "management", "financial", "quantitative", "controls")
ITEM_CELLS = [(r"^item\s*1\.?\s*business$", "item_1_business", "Item 1: Business")]
PRIORITY = {
    "item_1_business": 10, "item_1a_risk_factors": 15, "item_1b_staff": 16, "item_1c_cyber": 17, "item_2_properties": 20, "item_3_legal": 30, "item_4_mine": 40,
    "item_5_market": 50, "item_6_selected": 60, "item_7_mda": 70, "item_7a_market_risk": 75, "item_8_financials": 80, "fs_income_stmt": 81, "fs_balance_sheet": 82,
    "fs_cash_flow": 83, "fs_equity": 84, "fs_notes": 85, "item_9_accountants": 90, "item_9a_controls": 91, "item_9b_other": 92, "item_governance": 100, "item_15_exhibits": 150,
}
UNLISTED = 500
SENTINEL = "FS_SECTION_HEADER:"
SKIPPED = ("script", "style", "head", "noscript")


def without_tags_of_filings(html: str | Column) -> Column:
    """HTML without the XML prolog and inline-report tags; what stands in them stays."""
    return F.regexp_replace(F.regexp_replace(X.text_of(html), r"(?i)^\s*<\?xml[^?]*\?>", ""), r"(?i)</?(?:ix|xbrli|xbrldi):[^>]*>", "")


def documents_of(filings: DataFrame, html: str = "html") -> DataFrame:
    """A row (part, html) for each embedded document that is not blank; a filing without any is its own."""
    parts = F.filter(F.split(X.text_of(html), X.DOC_MARK), lambda x: F.trim(x) != "")
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(X.text_of(html)))
    return filings.select(*[c for c in filings.columns if c != html], F.posexplode(parts).alias("part", html))


def visible_text(html: str | Column) -> Column:
    """Text of the elements a reader sees, an element's end or begin as a line end, no more than two blank lines."""
    bare = F.regexp_replace(X.text_of(html), r"(?is)<!--.*?-->|<(script|style|head|noscript)\b[^>]*>.*?</\1\s*>|<(?:meta|link)\b[^>]*>", "")
    lines = F.regexp_replace(bare, r"(?s)<[^>]*>", "\n")
    plain = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")), lines)
    return F.regexp_replace(plain, r"\n{4,}", "\n\n\n")


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row (n_lines, i, line) for each line, trimmed, counted from 0."""
    rows = docs.withColumn("all_lines", F.split(X.text_of(text), "\n"))
    return rows.select(*[c for c in docs.columns if c != text], F.size("all_lines").alias("n_lines"), F.posexplode("all_lines").alias("i", "line")).withColumn("line", F.trim("line"))


def heading(line: Column, patterns: list[tuple[str, str, str]] = HEADINGS) -> Column:
    """struct(section_id, title) of the first pattern that is found in the line, else null."""
    low = F.lower(F.trim(line))
    found = F.when(F.lit(False), F.lit(None).cast("struct<section_id:string,title:string>"))
    for pattern, section, title in patterns:
        found = found.when(low.rlike(pattern), F.struct(F.lit(section).alias("section_id"), F.lit(title).alias("title")))
    return found


def may_head(line: Column) -> Column:
    """Whether a line has a word that headings need: the patterns, which take far longer, are tried on such lines alone."""
    low = F.lower(line)
    return reduce(lambda x, y: x | y, (F.contains(low, F.lit(w)) for w in WORDS))


def headed(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """lines with met (section_id, title; null where a line heads nothing) and sentinel.

    A short line that is only an item's number is read together with the next line that is not empty, of four at
    most: with a space, then without. Lines that the table parser put in name their section outright."""
    ahead = W.partitionBy(doc).orderBy("i")
    rows = lines.select(doc, "n_lines", "i", "line")
    following = F.coalesce(*(F.nullif(F.lead("line", k).over(ahead), F.lit("")) for k in range(1, 5)))
    rows = rows.withColumn("next", following)
    split = (F.length("line") < 35) & F.lower("line").rlike(r"^item\s*\d") & (F.length("next") < 100)
    none = F.lit(None).cast("struct<section_id:string,title:string>")
    named = reduce(lambda c, t: c.when(F.lower(F.substr("line", F.lit(len(SENTINEL) + 1))) == t[2].lower(), F.struct(F.lit(t[1]).alias("section_id"), F.lit(t[2]).alias("title"))), [*STATEMENTS, *ITEM_CELLS], F.when(F.lit(False), none))
    sentinel = F.startswith("line", F.lit(SENTINEL))
    # the chain of patterns over arrays of readings: three chains would be too long to compile; a line that heads something is read no further
    spaced, tight = F.concat_ws(" ", "line", "next"), F.concat("line", F.coalesce("next", F.lit("")))
    first = lambda *readings: F.get(F.filter(F.transform(F.array(*readings), lambda x: heading(x)), lambda h: h.isNotNull()), F.lit(0))
    found = F.coalesce(first("line"), F.when(split, first(spaced, tight)))
    # a generator of one row, so that a filter on what is met doesn't find it a second time
    met = F.explode_outer(F.array(F.when(sentinel, named).when(may_head(F.col("line")), found)))
    return rows.select("*", met.alias("met")).withColumn("sentinel", sentinel).drop("next")


def candidates(lines: DataFrame, doc: str = "doc_id", first: float = 0.15, last: float = 0.97, met: DataFrame | None = None) -> DataFrame:
    """(doc, n_lines, i, section_id, title, width, sentinel) of lines that head a section, between 15 and 97 % of the lines. met: headed(lines), if at hand."""
    window = F.col("i").between(F.floor(F.col("n_lines") * first), F.floor(F.col("n_lines") * last)) & (F.length("line").between(1, 250))
    return (headed(lines, doc) if met is None else met).where(window).where("met is not null").select(doc, "n_lines", "i", "met.*", F.length("line").alias("width"), "sentinel")


def selected(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One line for each section of a document: a sentinel, else the last of a statement's lines of at most 100
    characters (or the last), else the first of an item's."""
    statement = F.startswith("section_id", F.lit("fs_"))
    rank = F.struct(F.when(F.col("sentinel"), 0).otherwise(1), F.when(statement & (F.col("width") > 100), 1).otherwise(0), F.when(statement | F.col("sentinel"), -F.col("i")).otherwise(F.col("i")))
    best = F.min_by(F.struct("n_lines", "i", "title"), rank)
    return found.groupBy(doc, "section_id").agg(best.alias("best")).select(doc, "section_id", "best.*")


def priority(section: str = "section_id") -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col(section)), F.lit(UNLISTED))


def monotonic(chosen: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Items in the order of a filing: an item stays if its priority is above those of all before it (a rejected one never
    was above a kept one). Statements always stay."""
    own = F.when(F.startswith("section_id", F.lit("item_")), priority())
    so_far = F.max("priority").over(W.partitionBy(doc).orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    rows = chosen.withColumn("priority", own).withColumn("so_far", so_far)  # one pass: what is chosen is not made twice
    return rows.where(F.col("priority").isNull() | (F.col("priority") > F.coalesce("so_far", F.lit(-1)))).drop("priority", "so_far")


def recovered(lines: DataFrame, chosen: DataFrame, doc: str = "doc_id", least: int = 1000) -> DataFrame:
    """Statements that were not found, from the lines of sections of 1,000 lines or more: the first line of each that is nothing but
    its title. Joined on the document, with the line between two starts."""
    bounds = chosen.withColumn("end", F.coalesce(F.lead("i").over(W.partitionBy(doc).orderBy("i")), F.col("n_lines"))).where(F.col("end") - F.col("i") >= least)
    bounds = bounds.select(F.col(doc).alias("of"), F.col("i").alias("start"), "end")
    lines = lines.where(F.col("n_lines") >= least)  # shorter documents have no such section, and aren't taken apart
    titles = lines.where(F.length("line").between(1, 120) & may_head(F.col("line"))).withColumn("met", heading(F.col("line"), STATEMENTS)).where("met is not null")
    inside = titles.join(bounds, (F.col(doc) == F.col("of")) & (F.col("i") > F.col("start")) & (F.col("i") < F.col("end"))).select(doc, "n_lines", "i", "met.*")
    first = inside.groupBy(doc, "section_id").agg(F.min_by(F.struct("n_lines", "i", "title"), "i").alias("best")).select(doc, "section_id", "best.*")
    return first.join(chosen.select(doc, "section_id"), [doc, "section_id"], "left_anti")


def early_business(lines: DataFrame, chosen: DataFrame, doc: str = "doc_id", first: float = 0.15, met: DataFrame | None = None) -> DataFrame:
    """Item 1 where it stands before the window of candidates(): the last line there that heads it."""
    early = (headed(lines, doc) if met is None else met).where((F.col("i") < F.floor(F.col("n_lines") * first)) & (F.length("line") <= 250)).where("met.section_id = 'item_1_business'")
    last = early.groupBy(doc).agg(F.max_by(F.struct("n_lines", "i", "met.title"), "i").alias("best")).select(doc, F.lit("item_1_business").alias("section_id"), "best.*")
    return last.join(chosen.where("section_id = 'item_1_business'").select(doc), doc, "left_anti")


def numbered(sections: DataFrame, doc: str = "doc_id", order: str = "i") -> DataFrame:
    """section_base_id beside section_id, to which the second and later of a document get __2, __3 ..."""
    n = F.row_number().over(W.partitionBy(doc, "section_id").orderBy(order))
    rows = sections.withColumn("n", n).withColumn("section_base_id", F.col("section_id"))
    return rows.withColumn("section_id", F.when(F.col("n") > 1, F.concat("section_id", F.lit("__"), F.col("n").cast("string"))).otherwise(F.col("section_id"))).drop("n")


def slices(sections: DataFrame, texts: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, section_id, title, section_order, body): the lines after each heading up to the next; a document without headings is
    one section full_document; blank sections go. Lines are cut from the text's own array."""
    end = F.lead("i").over(W.partitionBy(doc).orderBy("i"))
    spans = sections.withColumn("end", end).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("i", "end", "section_id", "title"))).alias("spans"))
    rows = texts.select(doc, F.split(X.text_of(text), "\n").alias("all_lines")).join(spans, doc, "left")
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("int").alias("end"), F.lit("full_document").alias("section_id"), F.lit("Full Document").alias("title")))
    rows = rows.select(doc, "all_lines", F.posexplode(F.coalesce("spans", whole)).alias("section_order", "s"))
    stop = F.coalesce("s.end", F.size("all_lines"))
    body = F.array_join(F.slice("all_lines", F.col("s.i") + 2, F.greatest(F.lit(0), stop - F.col("s.i") - 1)), "\n")
    return rows.select(doc, "s.section_id", "s.title", "section_order", body.alias("body")).where(F.trim(F.regexp_replace("body", r"\s+", " ")) != "")


def blocks(sections: DataFrame, body: str = "body") -> DataFrame:
    """A row (position, block_type, text) for each paragraph of 30 characters or more and each table's placeholder."""
    pieces = F.split(F.regexp_replace(X.text_of(body), r"(<<<TABLE_\d+>>>)", "\n\n$1\n\n"), r"\n{2,}")
    tidy = F.filter(F.transform(pieces, lambda x: F.trim(F.replace(F.regexp_replace(x, r"[ \t]{2,}", " "), F.lit("\n"), F.lit(" ")))), lambda x: x.rlike(r"^<<<TABLE_\d+>>>$") | (F.length(x) >= 30))
    rows = sections.select(*[c for c in sections.columns if c != body], F.posexplode(tidy).alias("position", "text"))
    return rows.withColumn("block_type", F.when(F.col("text").rlike(r"^<<<TABLE_\d+>>>$"), "table").when((F.length("text") < 500) & F.col("text").rlike(X.FOOTNOTE), "footnote").otherwise("text"))


#: Tags that a head may hold: any other ends it, closed or not.
HEAD_TAGS = {"head", "title", "meta", "link", "base", "style", "script", "noscript", "template"}


class _Tables(HTMLParser):
    """Rows of cells of each table, and the document's text with a mark where a table stood.

    Tags that may stay open end where the next one begins: a head at the first tag that it can't hold, a cell at the next cell, row or end of
    its table. A cell around another table keeps its own words."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.out: list[str] = []
        self.open: list[tuple[int, list[str] | None]] = []  # tables that are open, each with the words of its open cell
        self.hidden, self.head = 0, False

    def _cell(self, words: list[str] | None = None) -> None:
        """End the innermost table's open cell, and begin one with these words."""
        at, own = self.open[-1]
        if own is not None:
            self.tables[at][-1][-1] = " ".join(" ".join(own).split())
        self.open[-1] = at, words

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "head":
            self.head = True
        elif self.head and tag not in HEAD_TAGS:
            self.head, self.hidden = False, 0
        if tag in SKIPPED:
            self.hidden += tag != "head"
        elif tag == "table":
            self.tables.append([])
            self.open.append((len(self.tables) - 1, None))
            self.out.append(f"\n\x00{len(self.tables) - 1}\x00\n")
        elif tag == "tr" and self.open:
            self._cell()
            self.tables[self.open[-1][0]].append([])
        elif tag in ("td", "th") and self.open:
            self._cell([])
            rows = self.tables[self.open[-1][0]]
            if not rows:
                rows.append([])
            rows[-1].append("")
        elif not self.open:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.head = False
        elif tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th", "tr") and self.open:
            self._cell()
        elif tag == "table" and self.open:
            self._cell()
            self.open.pop()
        elif not self.open:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if self.hidden or self.head:
            return
        if self.open and self.open[-1][1] is not None:
            self.open[-1][1].append(data)
        elif not self.open:
            self.out.append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self._cell()
            self.open.pop()


def is_data_table(rows: list[list[str]]) -> bool:
    return len(rows) >= 2 and len(rows[0]) >= 2 and len(" ".join(c for r in rows for c in r).strip()) > 60


def markdown(rows: list[list[str]]) -> str:
    """A table as pipe rows, the first as its head; a head of numbers alone is blank."""
    width = max(map(len, rows))
    full = [[*r, *[""] * (width - len(r))] for r in rows]
    head = full[0]
    if all(re.fullmatch(r"\d+", c) for c in head):
        head = [""] * width
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * width, *full[1:]])


def table_heading(rows: list[list[str]]) -> str | None:
    """The statement that one of the first five rows names in a cell, else the item named by a cell, or by a row's
    cells joined, of the first sixty."""
    cells = lambda r: [c.lower() for c in r if c and len(c) <= 120]
    for r in rows[:5]:
        for c in cells(r):
            for pattern, _, title in STATEMENTS:
                if re.search(pattern, c):
                    return title
    for r in rows[:60]:
        joined = "".join(c.lower() for c in r if c)
        for c in [*cells(r), *([joined] if len(joined) <= 120 else [])]:
            for pattern, _, title in ITEM_CELLS:
                if re.search(pattern, c):
                    return title
    return None


def parsed_tables(html: str | None, start: int = 0) -> tuple[str, list[tuple[int, str, list[list[str]]]]]:
    """Text with placeholders and headings for tables, and (index, markdown, rows) of the data tables."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    kept, index = [], start
    text = "".join(parser.out)

    def put(m: re.Match) -> str:
        nonlocal index
        rows = [r for r in parser.tables[int(m[1])] if r]
        title = table_heading(rows)
        lead = f"\n{SENTINEL}{title}\n" if title else ""
        if not is_data_table(rows):
            return lead
        kept.append((index, markdown(rows), rows))
        index += 1
        return f"{lead}\n<<<TABLE_{index - 1}>>>\n"

    text = re.sub("\x00(\\d+)\x00", put, text)
    return re.sub(r"\n{4,}", "\n\n\n", text), kept


def extract_tables(pages: DataFrame, doc: str = "doc_id", html: str = "html", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc, also, text, tables array<struct<idx, markdown, rows>>, error) of each page. Python, in Arrow batches: tables need a parser.

    A page that the parser fails on has an error and no text; the others of its batch are not touched by it."""
    kept = [doc, *also]
    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", text string, tables array<struct<idx:int,markdown:string,rows:array<array<string>>>>, error string"

    def work(batches) -> Iterator:
        import pandas as pd

        def one(page: str | None) -> tuple[str | None, list, str | None]:
            try:
                text, tables = parsed_tables(page)
                return text, [{"idx": i, "markdown": m, "rows": r} for i, m, r in tables], None
            except Exception as e:
                return None, [], f"{type(e).__name__}: {e}"[:500]

        for frame in batches:
            found = [one(h) for h in frame[html]]
            yield pd.DataFrame({c: frame[c] for c in kept} | {"text": [t for t, _, _ in found], "tables": [t for _, t, _ in found], "error": [e for _, _, e in found]})

    return pages.select(*kept, html).mapInPandas(work, schema)


def numbered_through(parts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """parts (doc, part, text, tables) with tables and their placeholders numbered on from those of the parts before."""
    first = F.coalesce(F.sum(F.size("tables")).over(W.partitionBy(doc).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    rows = parts.withColumn("first", first)
    bits = F.split(F.regexp_replace("text", r"<<<TABLE_(\d+)>>>", "\x01\x02$1\x01"), "\x01")
    shifted = F.transform(bits, lambda b: F.when(F.startswith(b, F.lit("\x02")), F.concat(F.lit("<<<TABLE_"), (F.substr(b, F.lit(2)).cast("int") + F.col("first")).cast("string"), F.lit(">>>"))).otherwise(b))
    moved = F.transform("tables", lambda t: F.struct((t["idx"] + F.col("first")).alias("idx"), t["markdown"].alias("markdown"), t["rows"].alias("rows")))
    return rows.withColumn("text", F.array_join(shifted, "")).withColumn("tables", moved).drop("first")


def headings_of(lines: DataFrame, doc: str = "doc_id", recover: Callable[[DataFrame, DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(doc, section_id, n_lines, i, title), as a table: candidates, selection and order, and what the recoveries add. recover gets the lines, what
    is found so far and the name of doc, and returns further rows; none by default. Lines meet the patterns once; what heads something is written."""
    with scratch(lines.sparkSession) as kept:
        met = saved(headed(lines, doc).where("met is not null"))
        chosen = saved(monotonic(selected(candidates(lines, doc, met=met), doc), doc))
        chosen = saved(chosen.unionByName(recovered(lines, chosen, doc)))
        if recover is not None:
            chosen = saved(chosen.unionByName(recover(lines, chosen, doc)))
        return kept(chosen.unionByName(early_business(lines, chosen, doc, met=met)))


def sections_of(docs: DataFrame, doc: str = "doc_id", text: str = "text", recover=None) -> DataFrame:
    """Sections of plain documents: headings, numbering and slices."""
    chosen = headings_of(lines_of(docs.select(doc, text), text), doc, recover)
    return slices(numbered(chosen, doc), docs, doc, text)


def sections_of_parts(parts: DataFrame, doc: str = "doc_id", recover=None) -> DataFrame:
    """Sections of filings whose embedded documents are rows (doc, part, text).

    Headings are looked for in each part by itself, within its own window of lines and its own order of items, so that a wrapper's late items do
    not bar the sections of an exhibit. Ids that recur in a filing are numbered, and a section ends where the filing's next one begins, in
    whatever part; a filing without any heading is one section. Null texts have no lines but one empty one."""
    piece = F.concat_ws("|", F.col(doc).cast("string"), F.col("part").cast("string"))
    rows = parts.select(doc, "part", piece.alias("piece"), X.text_of("text").alias("text"))
    chosen = headings_of(lines_of(rows.select("piece", "text")), "piece", recover)
    long = rows.select(doc, "part", "piece", F.size(F.split("text", "\n")).alias("long"))
    before = F.coalesce(F.sum("long").over(W.partitionBy(doc).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = chosen.join(long.withColumn("before", before).select(doc, "piece", "before"), "piece").select(doc, "section_id", "title", (F.col("i") + F.col("before")).cast("int").alias("i"))
    whole = rows.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return slices(numbered(found, doc), whole, doc)


#: Pages that a model is asked about, their lines, and the statement that it is not asked for.
PAGES, PAGE_LINES, NOT_ASKED = 15, 100, "fs_equity"


def by_model(ask: Callable[[list[str], list[list[str]]], list[dict[str, str]]]) -> Callable[[DataFrame, DataFrame, str], DataFrame]:
    """A recovery for headings_of(): a model is shown the pages of documents that lack statements.

    ask gets the texts of pages (of 100 lines, at most 15 of a document, from where candidates begin) and, for each, the ids looked for, and returns for each
    a heading by id, as it stands in the page. A reply counts where a line of that page holds it; of several the first
    line. Statements of equity are not asked for. Where a batch fails its pages are asked about one by one; a page that fails has no headings."""
    titles = {s: t for _, s, t in reversed(STATEMENTS) if s != NOT_ASKED}

    def recover(lines: DataFrame, chosen: DataFrame, doc: str) -> DataFrame:
        every = F.array(*(F.lit(s) for s in sorted(titles)))
        have = chosen.groupBy(doc).agg(F.collect_set("section_id").alias("have"))
        kind = lines.schema[doc].dataType.simpleString()
        first = F.floor(F.col("n_lines") * 0.15).cast("int")
        page = lines.withColumn("page", F.floor((F.col("i") - first) / PAGE_LINES).cast("int")).where(F.col("page").between(0, PAGES - 1))
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
        pages = page.groupBy(doc, "page").agg(text.alias("text"), F.max("n_lines").alias("n_lines")).join(have, doc, "left")
        pages = pages.withColumn("missing", F.array_except(every, F.coalesce("have", F.array().cast("array<string>")))).where(F.size("missing") > 0)

        def work(batches) -> Iterator:
            import pandas as pd

            def tried(pages: list[str], wanted: list[list[str]]) -> list[dict[str, str]] | None:
                try:
                    return ask(pages, wanted)
                except Exception:
                    return None

            for frame in batches:
                wanted = [list(m) for m in frame["missing"]]
                pages = frame["text"].tolist()
                told = tried(pages, wanted) or [(tried([p], [w]) or [{}])[0] for p, w in zip(pages, wanted, strict=True)]
                out = [(d, p, s, h) for d, p, w, own in zip(frame[doc], frame["page"], wanted, told, strict=True) for s, h in own.items() if s in w and h and h.strip()]
                yield pd.DataFrame(out, columns=[doc, "page", "section_id", "heading"])

        found = pages.select(doc, "page", "text", "missing").mapInPandas(work, f"`{doc}` {kind}, page int, section_id string, heading string")
        met = page.join(found, [doc, "page"]).where(F.contains(F.lower("line"), F.lower(F.trim("heading"))))
        title = F.element_at(F.create_map(*(F.lit(x) for kv in titles.items() for x in kv)), F.col("section_id"))
        first_line = met.groupBy(doc, "section_id").agg(F.min_by(F.struct("n_lines", "i"), "i").alias("best"))
        return first_line.select(doc, "section_id", "best.*", title.alias("title"))

    return recover
