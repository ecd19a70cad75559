"""Clashing names, ids of other types, skew, and decisions that the larger tests don't show."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlark.llm import chats, common, embeddings, linededup, packing, quality, sharding, simhash, toxicity, warc


def words(rng, n, kinds=500):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


# ---- what the operators share


class Unset:
    """A session of a cluster without a checkpoint folder."""

    class sparkContext:  # noqa: N801
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Unset)


def test_tables_of_a_scratch_are_deleted(spark):
    with common.scratch(spark) as kept:
        inner = common.saved(spark.range(5))
        paths = inner.inputFiles()
        outer = kept(inner)
    assert outer.count() == 5 and paths
    left = spark._jvm.org.apache.hadoop.fs.Path(paths[0])
    assert not left.getFileSystem(spark._jsc.hadoopConfiguration()).exists(left)


def test_free_names():
    assert common.free_name(["A", "_a"], "a") == "__a" and common.free_name(["b"], "a") == "a"


@pytest.mark.parametrize("run", [
    lambda d: simhash.near_duplicates(d), lambda d: simhash.similar_components(d), lambda d: chats.linked(d, conv_col="doc_id", turn_col="doc_id", role_col="text"),
    lambda d: warc.write_archives(d, "nowhere", "doc_id", "text", "text"), lambda d: embeddings.near_vectors(d, "doc_id", "v", "text"),
])
def test_operators_of_classes_and_links_refuse_ids_that_are_no_integers(spark, run):
    docs = spark.createDataFrame([("a", "some text", [1.0])], "doc_id string, text string, v array<float>")
    with pytest.raises(TypeError, match="integer ids"):
        run(docs)


def test_ids_of_other_types_elsewhere(spark):
    docs = spark.createDataFrame([("a", "some text"), ("b", "some text\nand more"), (None, None)], "doc_id string, text string")
    assert {r["doc_id"] for r in packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()} == {"a", "b", None}
    assert {r["id"] for r in quality.judged(docs).collect()} == {"a", "b", None}
    assert {r["doc_id"] for r in sharding.sharded(docs, 2).collect()} == {"a", "b", None}
    assert linededup.without_common_lines(docs).count() == 3


# ---- op1


def test_scores_beside_a_column_of_that_name(spark):
    docs = spark.createDataFrame([(1, "you idiot", "own", 3), (2, None, "x", 4)], "doc_id long, text string, score string, _Score int")
    model = toxicity.Model({"w:idiot": 2.0, "w:you": 0.5}, -1.0)
    out = toxicity.scored(docs, model)
    assert out.columns == [*docs.columns, "__score"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert (rows[1]["score"], rows[1]["_Score"]) == ("own", 3)
    assert rows[1]["__score"] == pytest.approx(1 / (1 + math.exp(-1.5))) and rows[2]["__score"] == pytest.approx(1 / (1 + math.exp(1)))


def brute_score(model, text):
    many = Counter()
    for w in toxicity.WORD.findall((text or "").lower()):
        many.update({f"w:{w}": 1} | {f"p{k}:{w[:k]}": 1 for k in (5, 7) if len(w) > k})
    z = model.bias + sum(model.weight.get(f, 0.0) * math.log2(1 + n) for f, n in many.items())
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_equal_a_plain_sum(spark):
    rng = random.Random(21)
    model = toxicity.Model({f"w:w{i}": rng.uniform(-1, 1) for i in range(40)} | {"p5:hello": 0.4, "p7:hellowo": -0.3}, 0.2)
    texts = [words(rng, rng.randrange(200), 60) for _ in range(50)] + ["Helloworld hellos HELLO", "", None, "w1 " * 50_000]
    out = toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert all(r["score"] == pytest.approx(brute_score(model, texts[r["doc_id"]]), abs=1e-12) for r in out)


def test_swaps_follow_the_counts_of_the_sentence():
    groups = (("women", "men"),)
    assert toxicity.swaps("Women and men and women.", groups) == {("women", "men", 2, 1): 1, ("men", "women", 1, 2): 1}
    change = toxicity.swap_change("women", "men", 2, 1)
    assert change == {"w:women": pytest.approx(math.log2(3)), "w:men": pytest.approx(math.log2(2) - math.log2(4))}
    assert "p5:musli" not in toxicity.swap_change("muslim", "muslims") and toxicity.swaps("Frauen und Kinder")[("frauen", "männer")] == 1


def test_the_penalty_reduces_false_positives_on_neutral_mentions(spark):
    rng = random.Random(22)
    rude, calm = ["idiot", "scum", "moron", "vermin"], ["garden", "river", "market", "window", "morning", "letter"]
    train, y = [], []
    for i in range(900):  # toxic sentences mention one group far more often than clean ones do
        toxic = i % 2
        own = [rng.choice(calm) for _ in range(6)] + ([rng.choice(rude)] if toxic and i % 6 != 1 else [])
        if rng.random() < (0.9 if toxic else 0.1):
            own.append("muslims")
        elif rng.random() < 0.3:
            own.append(rng.choice(["christians", "jews"]))
        rng.shuffle(own)
        train.append(" ".join(own) + ".")
        y.append(toxic)
    docs = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    neutral = [" ".join([rng.choice(calm) for _ in range(6)] + ["muslims"]) for _ in range(200)]
    insults = [" ".join([rng.choice(calm) for _ in range(6)] + [rng.choice(rude), "christians"]) for _ in range(200)]
    plain, fair = (toxicity.trained(docs, labels, penalty=p) for p in (0.0, 5.0))
    wrong = {m: sum(model.score(t) >= 0.7 for t in neutral) for m, model in (("plain", plain), ("fair", fair))}
    assert wrong["plain"] >= 100 and wrong["fair"] <= 0.1 * wrong["plain"]
    assert sum(fair.score(t) >= 0.7 for t in insults) >= 180


# ---- op2


def test_sharding_keeps_even_where_rows_repeat_an_id(spark):
    docs = spark.range(6000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 2000, "a text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    out = sharding.sharded(docs, 5, ranges=64).collect()
    size = Counter()
    for r in out:
        size[r["shard"]] += r["size"]
    assert max(size.values()) < 1.02 * min(size.values()) and len({(r["shard"], r["slot"]) for r in out}) == 6000


# ---- op3


def test_links_to_the_first_of_another_conversation_where_the_own_one_says_it_later(spark):
    said = "a passage that is long enough to link by itself"
    rows = [(5, 0, "user", f"> {said}\n{said}"), (5, 1, "user", said), (7, 3, "user", said), (9, 0, "user", said), (1, 0, "user", f"> {said}\nwell")]
    out = {(r["conv_id"], r["turn"]): r for r in chats.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (out[5, 0]["reply_to_conv"], out[5, 0]["reply_to_turn"], out[5, 0]["linked_by"]) == (7, 3, "quote")
    assert (out[1, 0]["reply_to_conv"], out[1, 0]["reply_to_turn"]) == (5, 0)


@pytest.mark.parametrize("block", [4, 1024])
def test_reply_positions(spark, monkeypatch, block):
    monkeypatch.setattr(chats, "BLOCK", block)
    rng = random.Random(23)
    rows = []
    for c in range(4):
        own = [f"message number {i} of conversation {c} in words" for i in range(40)]
        for i, text in enumerate(own):
            quoted = f"> {own[rng.randrange(i)] if rng.random() < 0.6 else own[0]}\n" if i and rng.random() < 0.7 else ""
            rows += [(c, 3 * i, rng.choice(["user", None]), quoted + text)] * (2 if i == 7 else 1)
    rows += [(None, 1, "user", "x"), (0, None, "user", "y")]
    out = chats.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(rows)
    for c in range(4):
        own = sorted((r for r in out if r["conv_id"] == c and r["turn"] is not None), key=lambda r: r["reply_position"])
        assert [r["reply_position"] for r in own] == list(range(41))
        key = [(-1 if r["reply_to_turn"] is None or r["reply_to_conv"] != c else r["reply_to_turn"], r["turn"]) for r in own]
        assert key == sorted(key)
        place = {r["turn"]: r["reply_position"] for r in own}
        assert all(place[r["reply_to_turn"]] < r["reply_position"] for r in own if r["reply_to_conv"] == c)
    assert all(r["reply_position"] is None for r in out if r["conv_id"] is None or r["turn"] is None)
    assert chats.ordered(spark.createDataFrame(out)).count() == len(rows)


# ---- op4 and the near-dedup of the pipeline


def test_one_of_rows_with_maps_that_repeat_an_id_stays(spark):
    rows = [(1, "one two three four five six", {"b": 2, "a": 1}, 5), (1, "one two three four five six", {"a": 0}, 5), (2, None, None, 6), (2, "", {}, 6), (None, "x", {}, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, id long")
    out = simhash.kept_one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["m"]) for r in out.collect()), key=repr) == [(1, "one two three four five six", {"a": 0}), (2, None, None), (None, "x", {})]


# ---- op5


def test_step_groups_are_balanced(spark):
    rng = random.Random(24)
    docs = spark.createDataFrame([(i, words(rng, rng.choice([5, 20, 60, 200, 900]))) for i in range(3000)], "doc_id long, text string").repartition(2, "doc_id")
    pieces = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    many, groups, in_sequence = Counter(), defaultdict(set), Counter()
    for p in pieces:
        many[p["step_group"]] += 1
        in_sequence[p["sequence_id"]] += 1
        groups[p["step_group"]].add((p["sequence_id"], p["sequence_length"]))
    full = {g: own for g, own in groups.items() if sum(s for _, s in own) == packing.STEP_TOKENS}
    assert len(full) >= 20 and all(len({s for _, s in own}) == 1 for own in groups.values())
    for part in (0, 1):
        own = [many[g] for g in full if g.startswith(f"{part}-1024-")]
        most = max(in_sequence[s] for g in full if g.startswith(f"{part}-1024-") for s, _ in full[g])
        assert max(own) - min(own) <= most
    ragged = [g for g in groups if g not in full]
    assert all(sum(g.rsplit("-", 1)[0] == r.rsplit("-", 1)[0] for g in ragged) == 1 for r in ragged)  # one for each partition and length


# ---- op8


def test_no_task_gathers_the_captures_of_a_hot_payload(spark, tmp_path):
    hot = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("http://a/b").alias("url"), F.when(F.col("id") % 3 == 0, "hot payload " * 20).otherwise(F.concat(F.lit("own " * 40), "id")).alias("html"))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(saved, ("false", "-1", "16"), strict=True):
            spark.conf.set(k, v)
        warc.write_archives(hot, str(tmp_path / "w"))
        files = [p.stat().st_size for p in (tmp_path / "w").glob("*.gz")]
        assert len(files) == 16 and max(files) < 2 * sum(files) / 16
        met = common.saved(warc.transactions(warc.read_records(spark, str(tmp_path / "w"), payload=False)))
        joined = warc.with_references(met)
        assert "SortMergeJoin" in joined._jdf.queryExecution().toString()
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count("first_page").alias("again"), F.sum("first_bytes").alias("b")).collect()
        assert sum(r["n"] for r in sizes) == 4000 and max(r["n"] for r in sizes) < 2 * 4000 / 16
        assert sum(r["again"] for r in sizes) == 1333 and max(r["again"] for r in sizes) < 2 * 1333 / 16
        out = warc.captures(hot, str(tmp_path / "v"))
        assert out.where("record_type = 'revisit' and refers_to = 0 and payload_bytes = 240").count() == 1333
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


# ---- op1


def test_the_fit_takes_one_text_of_each_id(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 3, f"text {i} vile" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, *a, **b: seen.append(len(rows)) or fit(rows, *a, **b))
    toxicity.trained(docs, labels, most=2)
    toxicity.trained(docs, labels)
    assert seen == [2, 3]


# ---- op9


def test_line_dedup_beside_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(i, f"common\n{i}", 9, "d", b"z") for i in range(12)], "doc_id long, text string, n_lines long, dropped_lines string, _dropped_lines binary")
    out = linededup.without_common_lines(docs, stats=("n_lines", "n_dropped"))
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped"]
    assert {(r["text"], r["n_lines"], r["dropped_lines"], r["_dropped_lines"], r["_n_lines"], r["n_dropped"]) for r in out.collect()} == {(str(i), 9, "d", b"z", 2, 1) for i in range(12)}


# ---- op10


def test_signatures_do_not_depend_on_the_batch():
    x = embeddings.unit(np.random.default_rng(25).standard_normal((500, 64)).ravel(), 64)
    whole = embeddings.signatures(x, 12, 20)
    assert all(np.array_equal(embeddings.signatures(x[a : a + n], 12, 20), whole[a : a + n]) for a, n in ((0, 1), (3, 7), (100, 333)))


# ---- the pipeline


def corpus(spark, folder):
    rng = random.Random(26)
    common_words = ["the", "and", "of", "to", "that", "with", "have", "be"]
    text = lambda n: " ".join(rng.choice(common_words) if rng.random() < 0.3 else f"word{rng.randrange(4000)}" for _ in range(n))
    clean = [text(rng.randrange(80, 160)) for _ in range(60)]
    toxic = [f"{text(70)} idiot scum moron {text(20)}" for _ in range(40)]
    shared = [f"{text(60)}\nThis line stands in many documents\n{text(30)}" for _ in range(14)]
    near = [" ".join([*t.split()[:40], "changed", *t.split()[41:]]) for t in clean[:10]]
    texts = [*clean, *toxic, *shared, *near, clean[0], clean[0], "too short", "", None, "# $ % & " * 60, "same words again " * 60, text(20_000)]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "k") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, _score string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(60 <= i < 100)) for i in range(110)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict(enumerate(texts))


def test_the_chain_equals_a_brute_force_version(spark, tmp_path):
    texts = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    results = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.saved(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns
        results.append({r["doc_id"]: r for r in docs.collect()})
        assert all((r["score"], r["_score"], r["source"]) == (0.5, "k", "s") for r in results[-1].values())
    quality_kept, calm, lined, single = results
    verdict = {r["id"]: r["kept"] for r in quality.judged(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert set(quality_kept) == {i for i, ok in verdict.items() if ok} and not {i for i in texts if i >= 126 and i != 131} & set(quality_kept)
    assert {i for i in range(60)} <= set(quality_kept) and 131 in quality_kept
    assert set(calm) == {i for i in quality_kept if not 60 <= i < 100}
    found = Counter(k for t in {r["text"] for r in calm.values()} for k in {x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")} if k)
    for i, r in lined.items():
        assert r["text"] == "\n".join(x for x in calm[i]["text"].split("\n") if found[x.strip(" \t\n\x0b\x0c\r").lower()] < 10) and r["n_chars"] == len(r["text"])
    assert set(lined) == set(calm) and "stands in many" not in lined[105]["text"]
    sets = {}
    for i, r in lined.items():
        w = r["text"].lower().split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert set(single) == {i for i in sets if find(i) == i} and len(single) < len(sets)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rest = defaultdict(dict)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        rest[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
    assert set(rest) == set(single)
    for i, pieces in rest.items():
        assert [x for k in sorted(pieces) for x in pieces[k]] == [*library.encode(single[i]["text"], add_special_tokens=False).ids, 0]
