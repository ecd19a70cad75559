"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import string
import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import bestfit, bpe, chats, clustering, embeddings, linededup, manifest, packing, quality, sharding, simhash, toxicity, warc
from ledgerlark.llm.common import deleted, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over links of at most 4 of 64 bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4)


@_query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines whose keys ten documents or more have."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.without_common_lines(docs, min_docs=10, least=1, stats=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLES["op9_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY doc_id
"""


@_query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.98 under equal labels."""
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


ORACLES["op10_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(node, other) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT e.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS BIGINT) AS n_links,
       least(e.vec_id, coalesce((SELECT min(other) FROM reach r WHERE r.node = e.vec_id), e.vec_id)) AS component_id,
       e.vec_id <= coalesce((SELECT min(other) FROM reach r WHERE r.node = e.vec_id), e.vec_id) AS kept
FROM embeddings e
"""


@_query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the text decoded from them."""
    found = bpe.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@_query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full sequences of at most 1024 ids."""
    pieces = packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    return quality.judged(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_STOPS = ", ".join(f"'{w}'" for w in quality._stop_forms())
ORACLES["op6_quality"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
t AS (
  SELECT doc_id, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t WHERE c IS NOT NULL) WHERE n >= 2),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         len(list_filter(words, lambda x: x IN ({_STOPS}))) AS n_stop, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.1
         AND n_stop / n_words >= 0.08 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM m
"""


@_query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    placed = sharding.sharded(_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@_query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives, read back and assembled."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    found = warc.captures(_table(spark, sf_dir, "pages"), path)
    deleted(spark, path)  # what was read from the archives is a table now
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that learned from two thirds of the labels."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.trained(docs, labels.where(~held))
    return toxicity.scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without quotes, in the order of replies."""
    found = chats.linked(_table(spark, sf_dir, "conversations"))
    digest = F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")
    return found.select("conv_id", "turn", "role", digest, "n_quotes", "max_level", "n_linked", "reply_to_conv", "reply_to_turn", "linked_by", "reply_position")


ORACLES["op3_quotation_linking"] = r"""
WITH RECURSIVE msgs AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
lines AS (
  SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM msgs),
marked AS (
  SELECT *, len(regexp_replace(regexp_extract(line, '^[ \t]*>[> \t]*'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*>[> \t]*', '') AS body FROM lines),
starts AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM marked),
runs AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY pos) AS run FROM starts),
pieces AS (
  SELECT id, conv_id, turn, run, level, string_agg(CASE WHEN level > 0 THEN body ELSE line END, chr(10) ORDER BY pos) AS body
  FROM runs GROUP BY id, conv_id, turn, run, level),
plain AS (SELECT id, coalesce(string_agg(body, chr(10) ORDER BY run) FILTER (WHERE level = 0), '') AS own,
                 count(*) FILTER (WHERE level > 0) AS n_quotes, max(level) AS max_level FROM pieces GROUP BY id),
texts AS (
  SELECT m.conv_id, m.turn, m.id, 0 AS asks, 0 AS q, 0 AS level, own AS body FROM msgs m JOIN plain USING (id)
  UNION ALL SELECT conv_id, turn, id, 1, row_number() OVER (PARTITION BY id ORDER BY run), level, body FROM pieces WHERE level > 0),
parts AS (
  SELECT *, 0 AS part, body AS bit FROM texts
  UNION ALL SELECT *, generate_subscripts(string_split(body, chr(10)), 1), unnest(string_split(body, chr(10))) FROM texts),
keys AS (
  SELECT conv_id, turn, id, asks, q, level, part, lower(trim(regexp_replace(bit, '[\x20\x09-\x0D]+', ' ', 'g'))) AS key FROM parts),
used AS (SELECT * FROM keys WHERE key <> '' AND (part = 0 OR length(key) >= 20)),
here AS (SELECT conv_id, key, min(turn) AS turn FROM used WHERE asks = 0 GROUP BY ALL),
anywhere AS (
  SELECT key, min({'c': conv_id, 't': turn}) FILTER (WHERE place = 1) AS one, min({'c': conv_id, 't': turn}) FILTER (WHERE place = 2) AS two
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY conv_id) AS place FROM here WHERE conv_id IS NOT NULL AND turn IS NOT NULL) GROUP BY key),
met AS (
  SELECT u.id, u.q, u.level, u.part, CASE WHEN h.turn < u.turn THEN {'c': u.conv_id, 't': h.turn} WHEN a.one.c <> u.conv_id THEN a.one ELSE a.two END AS to_
  FROM used u LEFT JOIN here h ON h.conv_id = u.conv_id AND h.key = u.key LEFT JOIN anywhere a ON a.key = u.key WHERE u.asks = 1),
best AS (SELECT id, count(DISTINCT q) AS n_linked, arg_min(to_, {'v': level, 'l': CASE WHEN part > 0 THEN 1 ELSE 0 END, 'q': q, 'p': part}) AS to_ FROM met WHERE to_ IS NOT NULL GROUP BY id),
prev AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT DISTINCT conv_id, turn FROM msgs)),
found AS (
SELECT m.conv_id, m.turn, m.role, sha256(p.own) AS text_sha256, p.n_quotes, p.max_level, coalesce(b.n_linked, 0) AS n_linked,
       coalesce(b.to_.c, CASE WHEN v.prev IS NOT NULL THEN m.conv_id END) AS reply_to_conv, coalesce(b.to_.t, v.prev) AS reply_to_turn,
       CASE WHEN b.to_ IS NOT NULL THEN 'quote' WHEN v.prev IS NOT NULL THEN 'order' END AS linked_by
FROM msgs m JOIN plain p USING (id) LEFT JOIN best b USING (id) LEFT JOIN prev v ON v.conv_id = m.conv_id AND v.turn = m.turn)
SELECT *, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN row_number() OVER (
  PARTITION BY conv_id, turn IS NULL ORDER BY CASE WHEN reply_to_conv = conv_id THEN reply_to_turn END NULLS FIRST, turn, role NULLS FIRST, text_sha256, n_quotes, max_level, n_linked, reply_to_conv NULLS FIRST, reply_to_turn NULLS FIRST) - 1 END AS reply_position
FROM found
"""


@_query
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and the roots that tampered texts would give."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(tampered, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))

    def told(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("folded_root", manifest.folded(F.coalesce("changed_leaf", "leaf"), F.col("path")))
        proof = F.sha2(manifest.proof(F.col("path")).cast("binary"), 256)
        return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

    return manifest.manifest(_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], told, changed={"text": text})


def _leaf_sql(text: str) -> str:
    parts = (f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


def _trie_sql(name: str, key: str, levels: int) -> str:
    """Levels of 16 children a node for each key, from name0 (key, i, h); a level of one node stays as it is. name{k}r holds the runs."""
    out = []
    for k in range(levels):
        out.append(f"{name}{k}c AS (SELECT {key} AS key, count(*) AS n FROM {name}{k} GROUP BY 1)")
        out.append(f"{name}{k}r AS (SELECT t.{key} AS key, i // 16 AS j, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {name}{k} t JOIN {name}{k}c c ON c.key IS NOT DISTINCT FROM t.{key} GROUP BY 1, 2)")
        out.append(f"{name}{k + 1} AS (SELECT key AS {key}, j AS i, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}{k}r)")
    return ",\n".join(out)


def _fold_sql(name: str, key: str, rank: str, levels: int, table: str) -> str:
    """table with what stands left and right of its row's way on each level, folded onto acc and gathered in proof."""
    last = table
    out = []
    for k in range(levels):
        at = f"(t.{rank} // {16**k})"
        left, right = (f"CASE WHEN r.n > 1 THEN array_to_string(r.hs[{x}], '') ELSE '' END" for x in (f"1:{at} % 16", f"{at} % 16 + 2:"))
        out.append(f"""{table}_{name}{k} AS (
  SELECT t.* EXCLUDE (acc, proof), CASE WHEN r.n > 1 THEN sha256({left} || acc || {right}) ELSE acc END AS acc, proof || {left} || {right} AS proof
  FROM {last} t JOIN {name}{k}r r ON r.key IS NOT DISTINCT FROM t.{key} AND r.j = {at} // 16)""")
        last = f"{table}_{name}{k}"
    return ",\n".join(out)


_CRC = "xor(4294967295, list_reduce([ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')], lambda c, b: list_reduce(range(8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295::BIGINT))"
ORACLES["op11_manifest"] = f"""
WITH d AS (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql('text')} END AS other
  FROM documents),
docs AS (SELECT *, other AS acc, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, 0 AS one FROM d),
s0 AS (SELECT source, i, leaf AS h FROM docs),
{_trie_sql('s', 'source', 5)},
g0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, source FROM s5),
{_trie_sql('g', 'one', 3)},
{_fold_sql('s', 'source', 'i', 5, 'docs')},
tops AS (SELECT t.*, g.i AS gi, g.h AS subroot FROM docs_s4 t JOIN g0 g ON g.source IS NOT DISTINCT FROM t.source),
{_fold_sql('g', 'one', 'gi', 3, 'tops')}
SELECT doc_id, leaf, subroot, g3.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = g3.h AS verified FROM tops_g2, g3
"""


@_query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 components after ten rounds."""
    return clustering.clustered(_table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, dim=64, scale=1024, seed=3)


def _rounds_sql(rounds: int) -> str:
    """Assignments a{t} (vec_id, q, k, d) and centroids c{t} (k, q) of each round; sums of whole numbers this small are exact in doubles."""
    dot = lambda x, y: f"list_dot_product({x}, {y})"
    out = []
    for t in range(rounds + 1):
        out.append(f"""a{t} AS (
  SELECT r, vec_id, q, k, d FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, k) AS place
    FROM (SELECT v.*, c.k, {dot('v.q', 'v.q')} - 2 * {dot('v.q', 'c.q')} + {dot('c.q', 'c.q')} AS d FROM v CROSS JOIN c{t} c))
  WHERE place = 1)""")
        if t < rounds:
            out.append(f"""c{t + 1} AS (
  SELECT c.k, coalesce(n.q, c.q) AS q FROM c{t} c LEFT JOIN (
    SELECT k, list(x ORDER BY i) AS q FROM (
      SELECT k, i, floor(sum(x) / count(*)) AS x FROM (SELECT k, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{t}) GROUP BY k, i)
    GROUP BY k) n ON n.k = c.k)""")
    return ",\n".join(out)


ORACLES["op12_centroids"] = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS k, q FROM v QUALIFY k < 8),
{_rounds_sql(10)}
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.q, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a10 a JOIN c10 c ON c.k = a.k
"""


@_query
def op13_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole where 1024 ids hold them, in few sequences."""
    columns = ["doc_id", "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "sequence_id", "offset"]
    return bestfit.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2, then=lambda pieces: pieces.select(*columns))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over documents; the ids stay behind, with their checksum."""
    pieces = corpus_pipeline.run(spark, sf_dir)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")
