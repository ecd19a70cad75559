"""Queries of sessions, lifecycle, routing and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.operators import context, lifecycle, ondemand, routing, sessions
from ledgerlark.plans import fixtures as fx
from ledgerlark.plans.registry import query
from ledgerlark.sources import filings

SESSIONS_SQL = """
turns AS (
  SELECT CAST(u.conv_id AS VARCHAR) || '-' || u.turn AS id, u.conv_id AS session_id, u.text AS question, a.text AS answer, u.turn AS created_at, l.quality AS is_correct
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' LEFT JOIN labels l ON l.doc_id = u.conv_id WHERE u.role = 'user'),
sessions AS (SELECT conv_id AS id, max(turn) AS updated_at, min(CASE WHEN role = 'user' THEN turn END) AS first FROM conversations GROUP BY conv_id),
titled AS (SELECT s.id, s.updated_at, CASE WHEN length(trim(c.text)) > 60 THEN left(trim(c.text), 60) || '…' ELSE trim(c.text) END AS title FROM sessions s LEFT JOIN conversations c ON c.conv_id = s.id AND c.turn = s.first)"""


def turns_of(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations")
    marks = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("session_id"), F.col("quality").alias("is_correct"))
    asked = c.where("role = 'user'").select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").alias("session_id"), F.col("text").alias("question"), F.col("turn").alias("created_at"))
    told = c.where("role = 'assistant'").select(F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("created_at"), F.col("text").alias("answer"))
    return asked.join(told, ["session_id", "created_at"], "left").join(marks, "session_id", "left")


def sessions_of(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations")
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return c.groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("updated_at"), sessions.title(first).alias("title"))


@query("session_list", f"WITH {SESSIONS_SQL.strip()} SELECT s.id, s.title, s.updated_at, count(t.id) AS turn_count FROM titled s LEFT JOIN turns t ON t.session_id = s.id GROUP BY ALL")
def session_list(spark, sf_dir):
    return sessions.session_list(sessions_of(spark, sf_dir), turns_of(spark, sf_dir)).select("id", "title", "updated_at", "turn_count")


@query("review_filter", f"WITH {SESSIONS_SQL.strip()} SELECT t.id, title, CASE WHEN is_correct = 1 THEN 'correct' WHEN is_correct = 0 THEN 'incorrect' ELSE 'unreviewed' END AS which FROM turns t JOIN titled s ON s.id = t.session_id")
def review_filter(spark, sf_dir):
    t, s = turns_of(spark, sf_dir), sessions_of(spark, sf_dir)
    parts = [sessions.review_list(t, s, w).select("id", "title", F.lit(w).alias("which")) for w in ("correct", "incorrect", "unreviewed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("last3_history", f"""WITH {SESSIONS_SQL.strip()},
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS back FROM turns)
SELECT session_id, md5(string_agg('Q: ' || coalesce(question, '') || chr(10) || 'A: ' || left(coalesce(answer, ''), 400), chr(10) || '---' || chr(10) ORDER BY back DESC)) AS history_md5 FROM r WHERE back <= 3 GROUP BY session_id""")
def last3_history(spark, sf_dir):
    return sessions.histories(turns_of(spark, sf_dir)).select("session_id", F.md5(F.col("history").cast("binary")).alias("history_md5"))


@query("session_delete", "SELECT count(DISTINCT conv_id) AS n_sessions, count(*) FILTER (WHERE role = 'user') AS n_turns FROM conversations WHERE conv_id % 7 <> 0")
def session_delete(spark, sf_dir):
    s = sessions_of(spark, sf_dir)
    kept, turns = sessions.deleted(s, turns_of(spark, sf_dir), s.where("id % 7 = 0").select("id"))
    return kept.agg(F.count(F.lit(1)).alias("n_sessions")).withColumn("n_turns", turns.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("citation_renumber", r"""WITH p AS (SELECT conv_id AS query_id, turn AS ord, 'a [1] b [2] c [' || (turn % 3 + 1) || ']' AS answer, turn % 3 + 1 AS n FROM conversations),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p)
SELECT query_id, ord, CAST(off AS BIGINT) AS "offset", 'a [' || CAST(1 + off AS BIGINT) || '] b [' || CAST(2 + off AS BIGINT) || '] c [' || CAST(ord % 3 + 1 + off AS BIGINT) || ']' AS answer FROM o""")
def citation_renumber(spark, sf_dir):
    n = F.col("turn") % 3 + 1
    rows = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ord"), F.concat(F.lit("a [1] b [2] c ["), n.cast("string"), F.lit("]")).alias("answer"), n.alias("n_citations"))
    return context.merged(rows)


@query("refusal_flag", r"SELECT conv_id, turn, regexp_matches(CASE WHEN turn % 4 = 1 THEN 'The filing does not explicitly mention it. ' ELSE '' END || text, '" + X.REFUSAL.replace("'", "''") + "') AS refused FROM conversations")
def refusal_flag(spark, sf_dir):
    said = F.concat(F.when(F.col("turn") % 4 == 1, "The filing does not explicitly mention it. ").otherwise(""), F.col("text"))
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.is_refusal(said).alias("refused"))


@query("json_extract", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events")
def json_extract(spark, sf_dir):
    reply = F.concat(F.lit("Here: "), F.col("props"), F.lit(" done."))
    found = X.json_object(reply, "map<string, string>")
    return fx.table(spark, sf_dir, "events").select("event_id", F.element_at(F.map_values(found), 1).alias("first_value"))


@query("manifest_upsert", """WITH old AS (SELECT o_custkey AS k, year(o_orderdate) AS y, max(o_orderkey) AS path FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL),
new AS (SELECT o_custkey AS k, year(o_orderdate) AS y, max(o_orderkey) AS path FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE (k, y) NOT IN (SELECT (k, y) FROM new)""")
def manifest_upsert(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderkey").alias("path"))
    old = rows.where("path % 3 <> 0").groupBy("k", "y").agg(F.max("path").alias("path"))
    return lifecycle.upserted(old, rows.where("path % 3 = 0"), ["k", "y"], "path")


@query("skip_existing", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def skip_existing(spark, sf_dir):
    return lifecycle.remaining(fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), fx.table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("id")), ["id"])


@query("evict_stale", """WITH a AS (SELECT user_id, max(ts) AS last_access FROM events WHERE ts < TIMESTAMP '2024-01-05' OR user_id % 2 = 0 GROUP BY user_id)
SELECT user_id, last_access, coalesce(c.collections, 0) AS collections, coalesce(c.points, 0) AS points FROM a
LEFT JOIN (SELECT doc_id AS user_id, count(DISTINCT lang) AS collections, CAST(sum(n_chars) AS BIGINT) AS points FROM documents GROUP BY doc_id) c USING (user_id)
WHERE last_access < TIMESTAMP '2024-02-05' - INTERVAL 30 DAY AND user_id % 10 <> 0""")
def evict_stale(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").where("ts < timestamp_ntz '2024-01-05' or user_id % 2 = 0")
    log = e.select("user_id", F.col("ts").cast("string").alias("last_access"))
    have = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), F.col("lang").alias("collection"), F.col("n_chars").alias("points"))
    bundled = e.where("user_id % 10 = 0").select("user_id").distinct()
    found = lifecycle.stale(have, log, bundled, F.expr("timestamp '2024-02-05'"), key="user_id")
    return found.withColumn("last_access", F.col("last_access").cast("timestamp_ntz"))


@query("negative_cache", """WITH f AS (SELECT user_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events))
SELECT event_id FROM events e WHERE event_type <> (SELECT min(event_type) FROM events) AND NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = e.user_id AND f.ts <= e.ts AND f.ts > e.ts - INTERVAL 300 SECOND)""")
def negative_cache(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    least = e.agg(F.min("event_type").alias("m")).scalar()
    return lifecycle.not_cached(e.where(F.col("event_type") != least), e.where(F.col("event_type") == least), ["user_id"]).select("event_id")


# Requests and ends of fetches by user; each step's state follows from the one before.
_MISS = "list_transform([1, 2, 3, 4], lambda i: {0})".format
_FRESH = "coalesce({0} > e.ts - INTERVAL 300 SECOND, false)".format
_STEP = f"""CASE WHEN NOT e.asks THEN NULL WHEN coalesce(list_contains(r.have, e.y), false) OR (e.y IS NULL AND len(r.have) > 0) THEN 'indexed' WHEN e.y IS NOT NULL AND {_FRESH('r.miss[e.y - 2021]')} THEN 'year_not_available'
  WHEN {_FRESH('r.failed')} THEN 'failed' WHEN {_FRESH('r.pending')} THEN 'waiting' ELSE 'fetch' END"""


@query("on_demand_requests", f"""WITH RECURSIVE ev AS (
  SELECT event_id, user_id, ts, event_type <> (SELECT min(event_type) FROM events) AS asks, CASE WHEN event_id % 3 > 0 THEN CAST(2022 + event_id % 4 AS INTEGER) END AS y, [NULL, [2023], [2023, 2024], [2025]][event_id // 5 % 4 + 1] AS years FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, asks, event_id) AS n FROM ev),
r AS (
  SELECT user_id, 0 AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS INTEGER) AS served, CAST([] AS INTEGER[]) AS have, CAST(NULL AS TIMESTAMP) AS pending, CAST(NULL AS TIMESTAMP) AS failed, CAST([NULL, NULL, NULL, NULL] AS TIMESTAMP[]) AS miss
  FROM (SELECT DISTINCT user_id FROM ev)
  UNION ALL
  SELECT e.user_id, e.n, e.event_id, {_STEP}, CASE WHEN e.asks AND e.y IS NULL THEN list_max(r.have) WHEN e.asks AND list_contains(r.have, e.y) THEN e.y END, CASE WHEN NOT e.asks AND e.years IS NOT NULL THEN list_distinct(list_concat(r.have, e.years)) ELSE r.have END,
         CASE WHEN NOT e.asks THEN NULL WHEN ({_STEP}) = 'fetch' THEN e.ts ELSE r.pending END, CASE WHEN e.asks THEN r.failed WHEN e.years IS NULL THEN e.ts END,
         CASE WHEN NOT e.asks AND e.years IS NOT NULL AND e.y IS NOT NULL AND NOT list_contains(e.years, e.y) THEN {_MISS("CASE WHEN i = e.y - 2021 THEN e.ts ELSE r.miss[i] END")} ELSE r.miss END
  FROM r JOIN o e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, outcome, served AS served_year FROM r WHERE outcome IS NOT NULL""")
def on_demand_requests(spark, sf_dir):
    return ondemand.decided(request_events(spark, sf_dir)).select("event_id", "outcome", "served_year")


def request_events(spark, sf_dir):
    """Events of the least type end a fetch, all others are requests."""
    e, k = fx.table(spark, sf_dir, "events"), F.col("event_id")
    least = e.agg(F.min("event_type").alias("m")).scalar()
    years = F.get(F.array(F.lit(None).cast("array<int>"), F.array(F.lit(2023)), F.array(F.lit(2023), F.lit(2024)), F.array(F.lit(2025))), F.floor(k / 5).cast("int") % 4)
    return e.select("event_id", F.col("user_id").cast("string").alias("ticker"), F.when(k % 3 > 0, (F.lit(2022) + k % 4).cast("int")).alias("year"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == least, "result").otherwise("request").alias("kind"), years.alias("years"))


@query("migrate_diff", """WITH a AS (SELECT source AS collection, count(*) AS local_points FROM documents WHERE lang <> 'es' GROUP BY source),
b AS (SELECT source AS collection, count(*) AS remote_points FROM documents WHERE doc_id % 40 < 20 AND lang = 'en' AND source <> 'src1' GROUP BY source)
SELECT collection, coalesce(local_points, 0) AS local_points, coalesce(remote_points, 0) AS remote_points,
       CASE WHEN coalesce(local_points, 0) = coalesce(remote_points, 0) THEN 'skip' WHEN local_points IS NULL THEN 'extra' WHEN remote_points IS NULL THEN 'copy' ELSE 'resume' END AS action
FROM a FULL JOIN b USING (collection)""")
def migrate_diff(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").withColumnRenamed("source", "collection")
    return lifecycle.copy_plan(d.where("lang <> 'es'"), d.where("doc_id % 40 < 20 and lang = 'en' and collection <> 'src1'"))


@query("priority_split", f"""WITH {fx.CHUNKS_SQL},
p AS (SELECT *, ({" OR ".join("contains(lower(section_name), '" + w.replace("'", "''") + "')" for w in lifecycle.PRIORITY_SECTIONS)}) AS pri FROM chunks)
SELECT chunk_id, CASE WHEN count(*) OVER w < 40 OR count(*) FILTER (WHERE pri) OVER w = 0 OR pri THEN 1 ELSE 2 END AS load FROM p WINDOW w AS (PARTITION BY source)""")
def priority_split(spark, sf_dir):
    return lifecycle.prioritised(fx.chunks(spark, sf_dir), ["source"]).select("chunk_id", "load")


NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))".format


@query("resolve_company", f"""WITH reg AS (SELECT 'P' || p_partkey AS ticker, p_name AS title, p_partkey AS ord, {NORM("p_name")} AS norm, replace({NORM("p_name")}, ' ', '') AS tight FROM part),
m AS (SELECT s_suppkey AS mention_id, CASE WHEN s_suppkey % 4 = 0 THEN 'p' || s_suppkey WHEN s_suppkey % 4 = 1 THEN split_part(p_name, ' ', 1) ELSE upper(replace(p_name, ' ', '-')) END AS mention FROM supplier JOIN part ON p_partkey = s_suppkey),
n AS (SELECT *, {NORM("mention")} AS name FROM m),
hit AS (SELECT mention_id, ticker, title, ord, 1 AS tier FROM n JOIN reg ON upper(ticker) = upper(trim(mention))),
near AS (
  SELECT mention_id, ticker, title, ord, CASE WHEN contains(norm, name) OR contains(name, norm) THEN 2 ELSE 3 END AS tier FROM n JOIN reg
    ON contains(norm, name) OR contains(name, norm) OR contains(tight, replace(name, ' ', '')) OR contains(replace(name, ' ', ''), tight)
  WHERE norm <> '' AND name <> '' AND mention_id NOT IN (SELECT mention_id FROM hit)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY tier, length(title), ord) AS n FROM (SELECT * FROM hit UNION ALL SELECT * FROM near)) WHERE n = 1)
SELECT m.mention_id, mention, ticker, title, CAST(tier AS INTEGER) AS tier FROM m LEFT JOIN best USING (mention_id)""")
def resolve_company(spark, sf_dir):
    part, sup = fx.table(spark, sf_dir, "part"), fx.table(spark, sf_dir, "supplier")
    reg = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ord"))
    k = F.col("s_suppkey")
    said = F.when(k % 4 == 0, F.concat(F.lit("p"), k.cast("string"))).when(k % 4 == 1, F.substring_index("p_name", " ", 1)).otherwise(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))))
    return routing.resolved(sup.join(part, sup.s_suppkey == part.p_partkey).select(k.alias("mention_id"), said.alias("mention")), reg)


@query("decompose_temporal", f"""WITH c AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{n}')" for t, n, _ in routing.COMPANIES)}) AS v(ticker, name)),
q AS (SELECT o_custkey AS query_id, {fx.sql_list([t for t, _, _ in routing.COMPANIES])}[o_custkey % 12 + 1] AS ticker, {fx.sql_list(list(routing.METRICS.values()))}[o_custkey % 11 + 1] AS metric, list_sort(list_distinct(list(year(o_orderdate)))) AS ys FROM orders GROUP BY o_custkey)
SELECT query_id, CAST(i - 1 AS INTEGER) AS ord, 'What was ' || name || '''s ' || metric || ' in fiscal year ' || ys[i] || '?' AS question, ticker, CAST(ys[i] AS INTEGER) AS year FROM (SELECT *, unnest(range(1, len(ys) + 1)) AS i FROM q) JOIN c USING (ticker)""")
def decompose_temporal(spark, sf_dir):
    return routing.by_year(_asked(spark, sf_dir), routing.companies(spark))


def _asked(spark, sf_dir):
    pick = lambda v, n: F.element_at(F.array(*map(F.lit, v)), (F.col("o_custkey") % n + 1).cast("int"))
    rows = fx.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.year("o_orderdate")).alias("years"), F.max("o_orderkey").alias("n"))
    return rows.select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("Question "), F.col("o_custkey").cast("string")).alias("question"), F.array(pick([t for t, _, _ in routing.COMPANIES], 12)).alias("tickers"), "years", pick(list(routing.METRICS), 11).alias("focus"))


@query("decompose_cross", f"""WITH q AS (SELECT o_custkey AS query_id, list_sort(list_distinct(list(year(o_orderdate)))) AS ys, [{", ".join(f"'{t}'" for t in ("AAPL", "MSFT", "JPM"))}][1 : o_custkey % 4] AS ts FROM orders GROUP BY o_custkey)
SELECT query_id, CAST((t - 1) * len(ys) + y - 1 AS INTEGER) AS ord, 'Question ' || query_id AS question, (CASE WHEN len(ts) = 0 THEN ['AAPL'] ELSE ts END)[t] AS ticker, CAST(ys[y] AS INTEGER) AS year
FROM (SELECT *, unnest(range(1, len(ys) + 1)) AS y FROM (SELECT *, unnest(range(1, greatest(1, len(ts)) + 1)) AS t FROM q))""")
def decompose_cross(spark, sf_dir):
    three = F.array(*map(F.lit, ("AAPL", "MSFT", "JPM")))
    rows = _asked(spark, sf_dir).withColumn("tickers", F.slice(three, F.lit(1), (F.col("query_id") % 4).cast("int").cast("int")).cast("array<string>")).withColumn("years", F.sort_array(F.array_distinct("years")))
    return routing.by_company(rows.withColumn("tickers", F.slice(three, F.lit(1), F.least(F.lit(3), (F.col("query_id") % 4).cast("int")))))


@query("classify_rules")
def classify_rules(spark, sf_dir):
    said = F.concat(F.lit("What was "), F.element_at(F.array(*(F.lit(n) for _, n, _ in routing.COMPANIES)), (F.col("item_id") % 12 + 1).cast("int")), F.lit(" revenue in "), (2022 + F.col("item_id") % 4).cast("string"), F.lit("?"))
    found = routing.classified(fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), said.alias("question")), routing.companies(spark))
    return found.select("query_id", "question", "tickers", "years", "focus", "query_type")


@query("fiscal_year", r"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN CAST(year(o_orderdate) AS INTEGER) WHEN o_orderkey % 4 = 1 THEN CAST(year(o_orderdate) - 1 AS INTEGER) WHEN o_orderkey % 4 = 2 THEN CAST(1999 + 10 + o_orderkey % 10 AS INTEGER) ELSE 2023 END AS fiscal_year FROM orders""")
def fiscal_year(spark, sf_dir):
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    rows = fx.table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 4 == 0, F.concat(F.lit("CONFORMED PERIOD OF REPORT:\t"), y.cast("string"), F.lit("1231"))).alias("h"), F.when(k % 4 == 1, F.concat(F.lit('{"reportDate": "'), (y - 1).cast("string"), F.lit('-12-31"}'))).alias("d"), F.when(k % 4 == 2, F.concat(F.lit("0000320193-"), (10 + k % 10).cast("string"), F.lit("-000123"))).alias("a"))
    return rows.select("id", filings.fiscal_year("h", "d", "a").alias("fiscal_year"))


@query("split_submission", """SELECT doc_id, count(*) AS n_kept, md5(string_agg('<!-- ===== embedded document: ' || t || ' ===== -->' || chr(10) || body, chr(10) ORDER BY seq)) AS html_md5
FROM (SELECT doc_id, seq, ['10-K/A', 'EX-99', 'EX-13'][seq + 1] AS t, trim(lang || ' part ' || seq) AS body FROM documents, (VALUES (0), (1), (2)) AS s(seq)) WHERE t <> 'EX-99' GROUP BY doc_id""")
def split_submission(spark, sf_dir):
    doc = lambda t, i: F.concat(F.lit(f"<DOCUMENT>\n<TYPE>{t}\n<TEXT>\n<XBRL>"), F.col("lang"), F.lit(f" part {i}</XBRL>\n</TEXT>\n</DOCUMENT>\n"))
    files = fx.table(spark, sf_dir, "documents").select("doc_id", F.concat(doc("10-K/A", 0), doc("EX-99", 1), doc("EX-13", 2)).alias("text"))
    parts = filings.documents_of(files, "doc_id")
    counts = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"))
    return filings.joined(parts, "doc_id").join(counts, "doc_id").select("doc_id", "n_kept", F.md5(F.col("html").cast("binary")).alias("html_md5"))
