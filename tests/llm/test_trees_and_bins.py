"""The manifest, the centroids and the best-fit packing against brute force, on tables with nulls, empty and long texts, ties, repeated
rows, no rows, and further columns whose names the operators use themselves."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlark.llm import bestfit, clustering, manifest

DOCS = "doc_id long, text string, source string, lang string, n_chars long, digest string, `rank` long, grp string, item long, id long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(digests):
    """Root of a list of digests, and for each of them the (left, right) texts on the way."""
    ways = [[] for _ in digests]
    at = list(range(len(digests)))
    while len(digests) > 1:
        for i, place in enumerate(at):
            first = place // 16 * 16
            ways[i].append(("".join(digests[first:place]), "".join(digests[place + 1 : first + 16])))
        digests = [H(*digests[k : k + 16]) for k in range(0, len(digests), 16)]
        at = [place // 16 for place in at]
    return digests[0], ways


def tree(rows, changed):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, H(*map(field, r)), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, ways, members = {}, {}, {}
    for s in order:
        members[s] = sorted(groups[s], key=lambda x: x[:3])
        subs[s], ways[s] = climb([m[2] for m in members[s]])
    root, above = climb([subs[s] for s in order])
    out = []
    for k, s in enumerate(order):
        for (_, _, leaf, r), way in zip(members[s], ways[s], strict=True):
            way = way + above[k]
            own = H(*map(field, changed(r)))
            for left, right in way:
                own = H(left, own, right)
            out.append((r[0], leaf, subs[s], root, H(*(x for w in way for x in w)), own))
    return out


def lower(r):
    text = r[4]
    tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
    return r if text is None or not tampered else (*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def manifested(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, s, lang, n, "d", 1, "g", 2, 3) for i, s, lang, n, t in rows], DOCS)
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))

    def told(found):
        path = F.col("path")
        return found.select("id", "leaf", "subroot", "root", F.sha2(manifest.proof(path).cast("binary"), 256), manifest.folded(F.coalesce("changed_leaf", "leaf"), path))

    got = manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], told, changed={"text": text}, **more)
    return sorted(map(tuple, got.collect()), key=repr)


def documents(seed, many, hot=0):
    rng = random.Random(seed)
    rows = [(rng.randrange(-(1 << 62), 1 << 62) if i % 3 else i, rng.choice(["web", "a", "é", "ab", None, "", f"s{i % 40}"]), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "Some TEXT", "É z", "W" * 9000])) for i in range(many)]
    rows += [rows[0]] * 3 + [(None, "web", None, None, None)] * 2 + [(7, "web", "en", 1, f"text {k}") for k in range(4)] + [(1 << 63) - 1 and ((1 << 63) - 1, "web", "", 0, "Last"), (-(1 << 63), "web", "", 0, "First")]
    rows += [(99, "web", "en", 1, f"T{k % 7}") for k in range(hot)] + [(k, "deep", "en", k, "TEXT") for k in range(300 if many else 0)]
    return rows


@pytest.mark.parametrize("seed, many, hot, most", [(1, 200, 0, 8192), (2, 40, 60, 5), (3, 5, 0, 1)])
def test_manifest(spark, seed, many, hot, most):
    rows = documents(seed, many, hot)
    assert manifested(spark, rows, most=most) == sorted(tree(rows, lower), key=repr)


def test_manifest_of_few(spark):
    assert manifested(spark, []) == []
    for rows in ([(1, None, None, None, None)], [(1, "a", "x", 0, "T"), (2, None, "x", 0, "T")], [(k, "a", "x", 0, "T") for k in range(17)]):
        assert manifested(spark, rows) == sorted(tree(rows, lower), key=repr)


def test_ranks_come_without_a_sort_of_all(spark):
    rows = spark.range(0, 200_000, 1, 8).select(F.xxhash64("id").alias("id"), F.lit(False).alias("nil"), F.lit("g").alias("grp"), F.lit("").alias("digest"))
    dense = spark.range(0, 100_000, 1, 8).select("id", F.lit(False).alias("nil"), F.lit("h").alias("grp"), F.lit("").alias("digest"))
    found = manifest.ranked(rows.union(dense))
    order = {g: [r["id"] for r in found.where(F.col("grp") == g).orderBy("rank").select("id").collect()] for g in "gh"}
    assert order["g"] == sorted(order["g"]) and order["h"] == list(range(100_000))
    assert found.groupBy("grp").agg(F.countDistinct("rank").alias("n"), F.max("rank").alias("m"), F.max("total").alias("t")).where("n <> t or m <> t - 1").count() == 0


VECTORS = "vec_id long, embedding array<double>, label int, q int, id string, own int"


def lloyd(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) < 65_536 for x in v)]
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    centers = [q for _, q in starts]
    if not centers:
        return []

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        own = [nearest(q)[1] for _, q in kept]
        centers = [[sum(x) // len(x) for x in zip(*part, strict=True)] if (part := [q for (_, q), o in zip(kept, own, strict=True) if o == n]) else c for n, c in enumerate(centers)]
    found = [(i, *nearest(q)) for i, q in kept]
    total = sum(d for _, d, _ in found)
    return [(i, n, d, sum(e for _, e, m in found if m == n), total, hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest()) for i, d, n in found]


def vectors(seed, many, spread):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((12, 64))
    rows = [(int(i), (middle[i % 12] + spread * rng.standard_normal(64)).tolist()) for i in range(many)]
    if many:
        rows += [rows[0]] * 5 + [(None, rows[1][1]), (3, rows[2][1])] + [(900 + k, rows[-1][1]) for k in range(20)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [0.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [65_536.0] + [0.0] * 63]
    return rows + [(700 + k, v) for k, v in enumerate(bad)] + [(800, [0.0] * 64), (801, [-0.0] * 64), (802, [65_535.9] * 64), (803, [-65_535.9] * 64)] * bool(many)


@pytest.mark.parametrize("seed, many, spread", [(1, 300, 0.1), (2, 400, 1.0), (3, 3, 0.5), (4, 0, 0.0)])
def test_centroids(spark, seed, many, spread):
    rows = vectors(seed, many, spread)
    table = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], VECTORS).repartition(5)
    assert sorted(map(tuple, clustering.clustered(table).collect()), key=repr) == sorted(lloyd(rows), key=repr)


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(9)
    middle = rng.standard_normal((8, 64))
    rows = [(i, (middle[i % 8] + 0.4 * rng.standard_normal(64)).tolist(), 1, 2, "x", 3) for i in range(2000)]
    trace = []
    clustering.clustered(spark.createDataFrame(rows, VECTORS), trace=trace)
    assert trace[0] == (2000, 2000) and len(trace) > 2 and trace[-1][1] < 400


def test_ties_of_centroids_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2 * 2)] + [0.0] * 63) for i in range(40)] + [(100 + i, [1.0] + [0.0] * 63) for i in range(3)]
    got = clustering.clustered(spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], VECTORS), clusters=2)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(lloyd(rows, k=2), key=repr)


def test_bounds_never_keep_a_vector_from_a_nearer_centroid():
    rng = np.random.default_rng(5)
    q = rng.integers(-50, 50, (500, 4))
    centers, drift = q[:6].copy(), np.zeros(6)
    own, upper, lower = np.full(500, -1), np.zeros(500), np.zeros(500)
    for _ in range(30):
        own, upper, lower, _ = clustering.bounded(q, own, upper, lower, centers, drift)
        assert (own == clustering.distances(q, centers).argmin(axis=1)).all()
        moved = centers + rng.integers(-3, 4, centers.shape)
        drift, centers = np.sqrt(((moved - centers) ** 2).sum(axis=1)), moved


PATH = public_tokenizers.path("byte_bpe_50k.json")


def packing_rows(spark, texts, parts, **more):
    rows = [(i, t, "s", "en", 1, "d", 1, "g", 2, 3) for i, t in texts]
    docs = spark.createDataFrame(rows, DOCS).repartition(parts) if rows else spark.createDataFrame([], DOCS)
    return bestfit.packed(docs, PATH, **more).collect()


def fits(texts, pieces, size):
    library = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) if len(ids) <= size else len(ids) % size
        starts = [0] * bool(head) + list(range(head, len(ids), size))
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[(i, n, a, b - a, struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    got, rows = defaultdict(int), defaultdict(list)
    for p in pieces:
        got[(p["doc_id"], p["piece"], p["start"], p["length"], bytes(p["ids"]))] += 1
        rows[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == want
    for own in rows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(rows)


def least(pieces, size):
    """No packing has fewer: what fills, and pieces of which no two fit together."""
    lengths = [p["length"] for p in pieces]
    return max(-(-sum(lengths) // size), sum(n > size // 2 for n in lengths))


@pytest.mark.parametrize("parts, more", [(3, {}), (7, {"held_tokens": 3000, "lane": 16, "size": 256}), (4, {"held_tokens": 500, "lane": 8, "size": 64, "nearly": 0})])
def test_best_fit(spark, parts, more):
    rng = random.Random(parts)
    texts = [(i, " ".join(rng.choice(["stone", "the", "Éau", "über", "x1"]) for _ in range(int(rng.expovariate(1 / 120))))) for i in range(400)]
    texts += [(1, None), (None, ""), (2, "again and again"), (2, "again and again"), (5, "long word " * 4000), (6, "日本語 " * 50), (7, "<|endoftext|> x")]
    pieces = packing_rows(spark, texts, parts, **more)
    size = more.get("size", 1024)
    many = fits(texts, pieces, size)
    assert many <= math.ceil(1.05 * least(pieces, size)) + 1


def test_best_fit_of_equal_documents_that_fill_nothing(spark):
    texts = [(i, "stone " * 640) for i in range(60)]
    pieces = packing_rows(spark, texts, 5, lane=8)
    assert fits(texts, pieces, 1024) == 60


def test_best_fit_of_nothing(spark):
    assert packing_rows(spark, [], 2) == []
    assert [(p["doc_id"], p["length"]) for p in packing_rows(spark, [(1, None)], 1)] == [(1, 1)]


def test_best_fit_takes_the_bin_with_least_room():
    bins, free = bestfit.best_fit([6, 5, 4, 3, 1, 1], 10)
    assert bins == [[0, 2], [1, 3, 4, 5]] and free == [0, 0]


def test_a_second_run_packs_alike(spark):
    texts = [(i, "stone " * (i * 37 % 900)) for i in range(150)]
    docs = spark.createDataFrame([(i, t, "s", "en", 1, "d", 1, "g", 2, 3) for i, t in texts], DOCS).repartition(4, "doc_id")
    one, two = (sorted((p["doc_id"], p["piece"], p["sequence_id"], p["offset"]) for p in bestfit.packed(docs, PATH).collect()) for _ in range(2))
    assert one == two
