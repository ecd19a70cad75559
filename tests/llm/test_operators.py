"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows,
empty tables and further columns whose names the operators use themselves."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from ledgerlark.llm import bpe, chats, components, embeddings, linededup, packing, quality, sharding, simhash, toxicity, warc
from ledgerlark.llm import queries as own_queries

DOCS = "doc_id long, text string, lang string, id long, line string, score double, w0 long, t string, `key` string"


def rows_of(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", 7, "x", 0.5, 1, "t", "k") for i, t in zip(ids, texts, strict=True)]


def some_texts(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("the", "of", "And", "stone", "Éau", "wh") for b in ("", "er", "ing", "s,", ".")]
    texts = []
    for _ in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 6))]
        texts.append("\n".join(lines))
    texts += [texts[0]] * 12 + [texts[1] + " end", None, "", " \n\t ", "a", "\n\n", "Common LINE  \n" + texts[2]]
    texts += [f"own {i} words\n  common line\nlast {i}" for i in range(12)] + ["x" * 50_000 + " " + "long word " * 2000]
    return texts


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame(rows_of(texts, ids), DOCS)


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(150)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")).collect()}
    expected = classes(edges, {x for e in edges for x in e})
    assert got == {n: expected[n] for n in nodes}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- op1


def test_toxicity_learns_and_swaps_do_not_matter(spark):
    rng = random.Random(5)
    calm, rude = ["the stone river", "a quiet morning", "women walk here", "people of the town"], ["you idiot", "what scum", "women are idiot people", "the black moron"]
    docs = [(i, " ".join(rng.choice(rude if i % 3 == 0 else calm) for _ in range(6)), int(i % 3 == 0)) for i in range(300)]
    table = docs_of(spark, [t for _, t, _ in docs] + [None, ""])
    labels = spark.createDataFrame([(i, y, 5) for i, _, y in docs] + [(0, 2, 5), (1, 0, 5), (1, 1, 5)], "doc_id long, toxic int, score int")
    model = toxicity.trained(table, labels)
    out = {r["doc_id"]: r for r in toxicity.scored(table, model, name="s").collect()}
    assert all((out[i]["s"] >= 0.7) == bool(y) for i, _, y in docs)
    assert out[300]["s"] == out[301]["s"] == pytest.approx(1 / (1 + math.exp(-model.bias)))
    assert set(out[0].asDict()) == {*table.columns, "s"}
    free = toxicity.trained(table, labels, penalty=0.0)
    gap = lambda m: abs(m.score("women walk here") - m.score("men walk here"))
    assert gap(model) <= gap(free) + 1e-9
    assert toxicity.trained(table, labels.limit(0)).score("idiot") == pytest.approx(0.5)
    assert toxicity.scored(table.limit(0), model).count() == 0


def test_swap_counts():
    assert toxicity.swaps("Gay people. A gay idiot!", (("gay", "straight"),)) == {("gay", "straight"): 2}
    assert toxicity.swaps(None) == {}


def test_penalty_reduces_the_effect_of_identity_terms():
    rows = [np.array([0, 1]), np.array([2]), np.array([0, 1]), np.array([2])]
    values = [np.ones(len(r)) for r in rows]
    names, labels = ["w:idiot", "w:gay", "w:calm"], np.array([1.0, 0, 1, 0])
    plain, fair = (toxicity.fit(rows, values, labels, names, {("gay", "straight"): 4}, penalty=p) for p in (0.0, 5.0))
    assert abs(fair.weight.get("w:gay", 0)) < 0.2 * abs(plain.weight["w:gay"])
    assert fair.score("idiot") > 0.7


# ---- op2


def test_sharding(spark):
    texts = some_texts(2, 400)
    ids = [*range(len(texts) - 2), None, 0]
    out = sharding.sharded(docs_of(spark, texts, ids), 8, ranges=64).collect()
    assert len(out) == len(texts)
    size = Counter()
    slots = defaultdict(list)
    for r in out:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    largest = max(r["size"] for r in out)
    assert max(size.values()) - min(size.values()) <= max(largest, sum(size.values()) / 8 / 32)
    expected = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == expected
    assert sharding.sharded(docs_of(spark, []), 8).count() == 0


def test_sharding_hot_text(spark):
    texts = ["same text " * 5] * 3000 + [f"text {i} " * (1 + i % 9) for i in range(3000)]
    out = sharding.sharded(docs_of(spark, texts), 5, ranges=64).collect()
    size = Counter()
    for r in out:
        size[r["shard"]] += r["size"]
    assert max(size.values()) < 1.02 * min(size.values())
    assert {(r["shard"], r["slot"]) for r in out}.__len__() == 6000


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and {r["shard"] for r in back.collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        sharding.write_shards(docs.union(docs), str(tmp_path / "u"), 4)


# ---- op3


def test_quotation_linking(spark):
    base = "The first message says something worth quoting.\nIt has a second line that is long enough."
    rows = [
        (1, 0, "user", base, "a"), (1, 1, "assistant", "> The first message says   something worth quoting.\n> It has a second line that is long enough.\nAgreed with all of this.", "b"),
        (1, 2, "user", ">> It has a second line that is long enough.\n> Agreed with ALL of this.\nFine then, thanks.", "c"), (1, 3, "user", None, "d"),
        (2, 0, "user", "> Fine then, thanks.\nElsewhere", "e"), (2, 5, "user", "> unknown passage of some length here\nown", "f"), (2, 5, "user", "> unknown passage of some length here\nown", "f"),
        (None, 0, "user", "> own", "g"), (3, None, "user", "", "h"), (3, 4000, "user", "x", "i"), (3, 1, "user", "y", "j"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h string")
    out = chats.ordered(chats.linked(table)).collect()
    got = {(r["conv_id"], r["turn"]): r for r in out}
    assert len(out) == len(rows)
    assert got[1, 1]["text"] == "Agreed with all of this." and (got[1, 1]["reply_to_turn"], got[1, 1]["linked_by"]) == (0, "quote")
    assert got[1, 2]["n_quotes"] == 2 and got[1, 2]["max_level"] == 2 and got[1, 2]["n_linked"] == 2
    assert got[1, 2]["reply_to_turn"] == 1  # the least quote level is what it answers
    assert (got[2, 0]["reply_to_conv"], got[2, 0]["reply_to_turn"], got[2, 0]["linked_by"]) == (1, 2, "quote")
    assert (got[2, 5]["reply_to_turn"], got[2, 5]["linked_by"]) == (0, "order")
    assert got[3, 4000]["reply_to_turn"] == 1 and got[3, 1]["linked_by"] is None and got[3, None]["linked_by"] is None
    assert got[1, 3]["text"] == ""
    assert chats.linked(table.limit(0)).count() == 0


def test_quotation_linking_equals_sql(spark, tmp_path):
    rng = random.Random(17)
    lines = [f"line number {i} with quite some words" for i in range(12)] + ["ok", "", "  "]
    rows = []
    for c in range(25):
        for t in sorted(rng.sample(range(3000), rng.randint(1, 7))):
            body = "\n".join("> " * rng.choice([0, 0, 1, 1, 2]) + rng.choice(lines) for _ in range(rng.randint(0, 5)))
            rows += [(c, t, rng.choice(["user", "assistant"]), body)] * rng.choice([1, 1, 1, 2])
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    name = "op3_quotation_linking"
    own = own_queries.QUERIES[name](spark, str(tmp_path)).collect()
    names = own[0].asDict().keys()
    other = con.execute(own_queries.ORACLES[name]).fetchall()
    at = [d[0] for d in con.description]
    plain = lambda v: None if v is None else str(v)
    assert Counter(tuple(plain(r[k]) for k in names) for r in own) == Counter(tuple(plain(r[at.index(k)]) for k in names) for r in other)
    assert {r["linked_by"] for r in own} == {"quote", "order", None} and {r["reply_to_conv"] == r["conv_id"] for r in own if r["linked_by"] == "quote"} == {True, False}


# ---- op4


def brute_prints(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def test_simhash(spark):
    texts = [t for t in some_texts(4, 150) if t is None or len(t) < 10_000]
    docs = docs_of(spark, texts)
    prints = brute_prints(texts, 4)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    expected = classes(pairs, range(len(texts)))
    for table in (docs, docs.union(docs.limit(5))):
        out = simhash.near_duplicates(table).collect()
        assert all(int(r["fingerprint"], 16) == prints[r["doc_id"]] and r["component_id"] == expected[r["doc_id"]] for r in out)
        assert len(out) == table.count()
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    alone = simhash.near_duplicates(docs_of(spark, ["only here now so", "quite another thing"], [None, 4])).collect()
    assert {r["doc_id"]: r["component_id"] for r in alone} == {None: None, 4: 4}


@pytest.mark.parametrize("most", [20, 1024])
def test_links_are_complete_in_dense_groups(spark, most):
    rng = np.random.default_rng(6)
    centre = int(rng.integers(1 << 63))
    own = {centre}
    while len(own) < 500:
        x = centre
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            x ^= 1 << int(b)
        own.add(x)
    words = sorted(own | {int(x) for x in rng.integers(0, 1 << 63, 300)})
    table = spark.createDataFrame([(i, w - (1 << 64) if w >> 63 else w) for i, w in enumerate(words)], "id long, w0 long")
    links = simhash.near_links(table, simhash.block_masks(len(words), 4), 4, most=most)
    got = classes([(r["a"], r["b"]) for r in links.collect()], range(len(words)))
    expected = classes([(i, j) for i in range(len(words)) for j in range(i) if (words[i] ^ words[j]).bit_count() <= 4], range(len(words)))
    assert got == expected


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(7)
    for rows in (10, 10**7, 10**10):
        masks = simhash.block_masks(rows, 4)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & m == 0 for _, m in masks)


def test_descent_finds_what_all_pairs_find():
    rng = np.random.default_rng(8)
    words = rng.integers(0, 1 << 14, (1500, 1)).astype(np.uint64)
    found = {tuple(sorted(p)) for x, y in simhash.near_pairs(words, 2) for p in zip(x.tolist(), y.tolist(), strict=True)}
    d = np.bitwise_count(words[:, 0][:, None] ^ words[:, 0][None, :])
    i, j = np.nonzero(np.triu(d <= 2, 1))
    assert found == set(zip(i.tolist(), j.tolist(), strict=True))


def test_one_of_each_stays(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(200)) for _ in range(20)]
    near = [" ".join([*t.split()[:100], "changed", *t.split()[101:]]) for t in base]
    docs = docs_of(spark, [*base, *near, *base, "", None])
    kept = simhash.kept_one_of_each(docs.union(docs.where("doc_id = 3")))
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(20), 60]
    assert kept.columns == docs.columns


@pytest.mark.parametrize(("asked", "most"), [(1, 16), (4, 1024)])
def test_similarity_is_exact_near_the_threshold(spark, asked, most):
    rng = random.Random(18)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4, 6, 9])):
            own[at] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(own))
    texts += [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 40, 150]))) for _ in range(60)] + [texts[0], "", None]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    expected = classes(pairs, range(len(texts)))
    out = {r["id"]: r["component_id"] for r in simhash.similar_components(docs_of(spark, texts), asked=asked, most=most).collect()}
    assert out == expected


def test_a_pair_behind_refuted_nearer_ones_is_found(spark):
    texts = []
    for seed in (4, 37, 91, 108, 120, 131, 141, 152, 168, 182, 188, 250, 267, 271, 281, 298, 304, 322, 323, 332, 352, 357, 367, 371, 394, 397):
        own = [f"q{seed}w{i}" for i in range(200)]
        other = [f"c{seed}x{w[w.index('w') + 1 :]}" if k in (40, 80, 120, 160, 199) else w for k, w in enumerate(own)]
        texts += [" ".join(t) for t in (own, [f"r{seed}x0", *own[1:]], other, [other[0], f"d{seed}x1", *other[2:]])]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert all(alike(k, k + 2) and not alike(k, k + 3) and not alike(k + 1, k + 2) for k in range(0, len(texts), 4))
    out = {r["id"]: r["component_id"] for r in simhash.similar_components(docs_of(spark, texts)).collect()}
    assert out == {i: i // 4 * 4 for i in range(len(texts))}


def test_a_repeated_sentence_makes_no_near_copies(spark):
    rng = random.Random(20)
    sentence = " ".join(f"same{i}" for i in range(10))
    texts = [" ".join([*[sentence] * 20, *(f"w{rng.randrange(10**6)}" for _ in range(200))]) for _ in range(6)]
    texts += [f"{texts[0]} {sentence}", " ".join([sentence, *texts[1].split()])]
    assert {r["doc_id"] for r in simhash.kept_one_of_each(docs_of(spark, texts)).collect()} == set(range(6))


# ---- op5


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = some_texts(10, 300) + ["x<|endoftext|> y", "日本語 text", " " * 3000]
    docs = docs_of(spark, texts).repartition(3, "doc_id")
    pieces = packing.packed(docs, path).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = np.frombuffer(p["ids"], "<u4").tolist()
        assert own == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]] and p["doc_tokens"] == len(ids[p["doc_id"]])
        by_doc[p["doc_id"]].append((p["start"], p["length"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"], p["sequence_length"]))
    for i, own in ids.items():
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(own)
    for own in by_sequence.values():
        at = 0
        for offset, length, total in sorted(own):
            assert offset == at
            at += length
        assert at == total <= 1024 and total & (total - 1) == 0
    groups = Counter()
    for s in {(p["sequence_id"], p["sequence_length"], p["step_group"]) for p in pieces}:
        groups[s[2]] += s[1]
    assert max(groups.values()) <= packing.STEP_TOKENS
    assert packing.packed(docs.limit(0), path).count() == 0


# ---- op6


def brute_quality(t):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    twice = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(twice)


def test_quality(spark):
    texts = some_texts(11, 80) + ["a b c a b c a b", "# $ % a|b <x> &", "line\nline\n line\nline", "und der die das " * 40, "é à " * 60, "WORD " * 80]
    out = {r["id"]: r for r in quality.judged(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = brute_quality(t)
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and not (r["base_failed"] and r["kept"])
    docs = docs_of(spark, texts)
    assert sorted(r["doc_id"] for r in quality.passing(docs).collect()) == sorted(i for i, r in out.items() if r["kept"])
    assert quality.passing(docs).columns == docs.columns
    assert quality.judged(docs.limit(0)).count() == 0


# ---- op7


def test_bpe(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(12)
    texts = some_texts(12, 60) + ["<|endoftext|>a<|startoftext|> b", "İΣΑΣ ß ﬁ é 한국어 १२ don't", "ab" * 300, "".join(rng.choice("thein' r<|>0é ") for _ in range(3000))]
    out = {r["id"]: r for r in bpe.encoded(docs_of(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(out[i]["ids"], "<u4").tolist() == ids and out[i]["n_tokens"] == len(ids)
        assert out[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encoded(docs_of(spark, []), path).count() == 0


# ---- op8


def test_warc(spark, tmp_path):
    big = "<p>WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" + "é" * 100
    rows = [(5, "http://a.b/c d\r\nX: y", big, "k"), (2, None, big, "k"), (9, "http://q", big, "k"), (3, "u", "short", "k"), (4, "u", "short", "k"), (6, "u", None, "k"), (7, "u", "", "k"), (8, "u", "x" * 2_000_000, "k"), (8, "u", "x" * 2_000_000, "k"), (None, "n", big, "k"), (9, "http://q", big, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `key` string")
    out = warc.captures(pages, str(tmp_path / "w"), payload=True).collect()
    first = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    expected = Counter()
    for i, _, h, _ in rows:
        to = first.get(h) if h in first and first[h] != i else None
        expected[i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == expected
    assert all(r["request"]["key"] != r["response"]["key"] != r["metadata"]["key"] for r in out)
    assert {bytes(r["response"]["payload"]) for r in out if r["record_type"] == "response"} == {(h or "").encode() for _, _, h, _ in rows}
    assert warc.captures(pages.limit(0), str(tmp_path / "e")).count() == 0


# ---- op9


def brute_lines(texts, most):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.encode().strip(strip.encode()).lower()
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    kept = [[x for x in (t or "").split("\n") if n[key(x)] < most or not key(x)] for t in texts]
    return [("\n".join(k), len((t or "").split("\n")), len((t or "").split("\n")) - len(k)) for t, k in zip(texts, kept, strict=True)]


@pytest.mark.parametrize(("shard_keys", "room"), [(32_768, 64 << 20), (4, 1500)])
def test_line_dedup(spark, monkeypatch, shard_keys, room):
    monkeypatch.setattr(linededup, "SHARD_KEYS", shard_keys)
    texts = some_texts(13, 80) + [" common line", "COMMON line\r"]
    docs = docs_of(spark, texts)
    out = linededup.without_common_lines(docs, min_docs=5, broadcast_bytes=room, stats=("n_lines", "n_dropped"))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, 5)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert linededup.without_common_lines(docs.limit(0)).count() == 0


def test_copies_of_a_text_count_once_on_request(spark):
    docs = docs_of(spark, ["one line\nshared"] * 20 + [f"{i}\nshared" for i in range(9)])
    out = linededup.without_common_lines(docs, copies=False).select("text").distinct().collect()
    assert {r["text"] for r in out} == {"one line", *map(str, range(9))}


def test_perfect_hash():
    h = np.unique(np.random.default_rng(14).integers(0, 1 << 63, 30_000).astype(np.uint64))
    parts = [h[h % np.uint64(3) == k] for k in range(3)]
    index = linededup.LineIndex(0, 3, [linededup.build_shard(p, p % np.uint64(1000) + np.uint64(1)) for p in parts])
    assert len(index.n) == len(h) and np.array_equal(index.count(h), (h % np.uint64(1000)).astype(np.int64) + 1)
    assert not index.count(np.random.default_rng(15).integers(1 << 63, 1 << 64, 50_000, dtype=np.uint64)).any()


# ---- op10


@pytest.mark.parametrize("most", [8, 1024])
def test_embeddings(spark, most):
    rng = np.random.default_rng(16)
    base = rng.standard_normal((40, 16))
    near = np.concatenate([base + rng.standard_normal(base.shape) * s for s in (0.02, 0.05, 0.1, 0.15)])
    ball = rng.standard_normal(16) + rng.standard_normal((60, 16)) * 0.05
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate([base, near, ball])]
    label = [int(i % 40 % 3) for i in range(200)] + [9] * 60
    vectors += [vectors[0], [0.0] * 16, None, [*vectors[1][:15], float("nan")], [*vectors[1][:15], None], vectors[2][:8], vectors[3]]
    label += [label[0], 0, 0, 1, 1, 2, None]
    rows = [(i, v, y, 1) for i, (v, y) in enumerate(zip(vectors, label, strict=True))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long")
    links = defaultdict(set)
    ok = [i for i, v, y, _ in rows if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for a in ok:
        for b in ok:
            if a < b and label[a] == label[b] and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], np.float64), np.array(vectors[b], np.float64)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a].add(b)
                    links[b].add(a)
    expected = classes([(a, b) for a, own in links.items() for b in own], range(len(rows)))
    out = {r["vec_id"]: r for r in embeddings.near_vectors(table, most=most).collect()}
    assert len(out) == len(rows)
    for i in range(len(rows)):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (len(links[i]), expected[i], expected[i] == i)
    assert embeddings.near_vectors(table.limit(0)).count() == 0
