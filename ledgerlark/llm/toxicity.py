"""Toxicity: a logistic classifier of words and word beginnings, regularised by counterfactual identity terms.

In labelled sentences each identity term is swapped for the others of its group; the fit adds a penalty on the square
of the score's (log odds) change. The score is a sum over a text's features, so that a swap changes it by what the two terms'
features change: sentences only need to be counted by the two terms and how often each stands there. Other words of the sentence that
begin like one of the two are left out of that change.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import free_name, saved, text_batches

#: Bounds of the fit: labelled rows of the sample, and features of the model.
TRAIN_ROWS = 12_000
MODEL_FEATURES = 20_000
LEAST_DOCS = 4
LEAST_Z = 2.5
PREFIXES = (5, 7)
CACHED = 200_000

#: Groups of identity terms of English, German, French and Spanish that may stand for one another.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "indigenous"), ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("immigrant", "refugee", "foreigner", "native"), ("immigrants", "refugees", "foreigners", "natives"),
    ("african", "american", "european", "mexican", "chinese", "indian", "turkish", "russian"),
    ("disabled", "blind", "deaf", "autistic"), ("old", "young", "elderly", "teenage"),
    ("frauen", "männer", "mädchen", "jungen"), ("frau", "mann", "mädchen", "junge"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber"), ("schwule", "lesben", "bisexuelle", "queere"), ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("türken", "russen", "polen", "franzosen", "afrikaner", "amerikaner"), ("behinderte", "blinde", "gehörlose", "autisten"),
    ("femmes", "hommes", "filles", "garçons"), ("femme", "homme", "fille", "garçon"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes"), ("gays", "lesbiennes", "bisexuels", "hétéros"), ("immigrés", "réfugiés", "étrangers", "migrants"),
    ("africains", "américains", "européens", "mexicains", "chinois", "indiens", "turcs", "russes"), ("handicapés", "aveugles", "sourds", "autistes"),
    ("mujeres", "hombres", "niñas", "niños"), ("mujer", "hombre", "niña", "niño"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes"), ("gais", "lesbianas", "bisexuales", "heteros"), ("inmigrantes", "refugiados", "extranjeros", "migrantes"),
    ("africanos", "americanos", "europeos", "mexicanos", "chinos", "indios", "turcos", "rusos"), ("discapacitados", "ciegos", "sordos", "autistas"),
)

WORD = regex.compile(r"\w+")
SENTENCE = regex.compile(r"[^.!?\n]+")


def word_features(word: str) -> tuple[str, ...]:
    """A word itself and, of longer ones, how it begins."""
    return (f"w:{word}", *(f"p{k}:{word[:k]}" for k in PREFIXES if len(word) > k))


def counted(text: str | None) -> dict[str, int]:
    """Occurrences of each lower-cased word of a whole text."""
    out: dict[str, int] = {}
    for w in WORD.findall((text or "").lower()):
        out[w] = out.get(w, 0) + 1
    return out


@dataclass
class Model:
    """Weights of features; a feature counts log2(1 + occurrences)."""

    weight: dict[str, float]
    bias: float
    words: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        """The probability of label 1; a text without known features has that of the bias."""
        many: dict[str, int] = {}
        for w, n in counted(text).items():
            known = self.words.get(w)
            if known is None:
                if len(self.words) > CACHED:
                    self.words.clear()
                known = self.words[w] = tuple(f for f in word_features(w) if f in self.weight)
            for f in known:
                many[f] = many.get(f, 0) + n
        z = self.bias + sum(self.weight[f] * np.log2(1 + n) for f, n in sorted(many.items()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def swaps(text: str | None, groups: tuple[tuple[str, ...], ...] = IDENTITY) -> dict[tuple, int]:
    """In how many sentences a term of a group stands and may be swapped for another, by what the swap changes.

    (a, b): one of the two stands there once and becomes the other. (a, b, m, n): a stands there m times, b n times, and a becomes b.
    """
    of: dict[str, list[str]] = {}
    for g in groups:
        for t in g:
            of.setdefault(t, []).extend(o for o in g if o != t)
    out: dict[tuple, int] = {}
    low = (text or "").lower()
    if not any(t in low for t in of):
        return out
    for sentence in SENTENCE.findall(low):
        words = WORD.findall(sentence)
        for w in sorted(set(words) & of.keys()):
            for other in dict.fromkeys(of[w]):
                m, n = words.count(w), words.count(other)
                change = (min(w, other), max(w, other)) if (m, n) == (1, 0) else (w, other, m, n)
                out[change] = out.get(change, 0) + 1
    return out


def swap_change(a: str, b: str, m: int = 1, n: int = 0) -> dict[str, float]:
    """How much each feature of the two terms is less after a, standing m times, becomes b, standing n times before."""
    own, other = set(word_features(a)), set(word_features(b))
    out = {}
    for f in sorted(own | other):
        before, after = m * (f in own) + n * (f in other), (m + n) * (f in other)
        if before != after:
            out[f] = float(np.log2(1 + before) - np.log2(1 + after))
    return out


def fit(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, names: list[str], pairs: dict[tuple, int], penalty: float = 1.0, ridge: float = 1e-4, steps: int = 400) -> Model:
    """Minimise log loss + ridge * |w|^2 + penalty * mean over swapped sentences of the squared change, by Adam."""
    n, k = len(rows), len(names)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if n else np.empty(0, np.int64)
    x = np.concatenate(values) if n else np.empty(0)
    place = {f: i for i, f in enumerate(names)}
    swap_rows, swap_weight = [], []
    for swap, many in sorted(pairs.items()):
        change = np.zeros(k)
        for f, by in swap_change(*swap).items():
            if f in place:
                change[place[f]] = by
        if change.any():
            swap_rows.append(change)
            swap_weight.append(many)
    change = np.array(swap_rows).reshape(len(swap_rows), k)
    share = np.array(swap_weight, float) / max(1, sum(swap_weight))
    w, bias = np.zeros(k), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    mean, square = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        z = np.bincount(at, w[col] * x, n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / max(1, n)
        grad = np.bincount(col, error[at] * x, k) + 2 * ridge * w
        if len(change):
            grad += 2 * penalty * (change.T @ (share * (change @ w)))
        g = np.append(grad, error.sum())
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:k], bias - move[k]
    keep = np.abs(w) > 1e-4
    return Model({f: float(v) for f, v, ok in zip(names, w, keep, strict=True) if ok}, float(bias))


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS, penalty: float = 1.0, groups: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    """A model fitted on at most `most` labelled texts, drawn by the hash of their ids.

    Of rows that repeat an id one text is taken, so that the bound holds whatever docs repeat; rows without an id and texts without a
    label are not learned from, and a null text counts as an empty one. Labels other than 0 and 1 and ids that have both are left out. Which features the model has is decided by the
    sample's document counts of each label, taken on the executors: those in enough documents, whose share differs
    most between the labels. Without rows of both labels every score is that of their smoothed share.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("z"))
    drawn = known.where("y = z").select("id", "y").orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull())
    met = texts.join(F.broadcast(drawn), "id")
    sample = saved(met.groupBy("id").agg(F.min("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text")).select("y", "text"))

    def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in text_batches(batches, "text"):
            count: dict[str, list[int]] = {}
            for text, y in zip(rows, part.column("y").to_pylist(), strict=True):
                for f in {f for w in counted(text) for f in word_features(w)}:
                    count.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), *(pa.array([c[y] for c in count.values()], pa.int64()) for y in (0, 1))], ["f", "n0", "n1"])

    by_label = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = [by_label.get(0, 0), by_label.get(1, 0)]
    found = sample.mapInArrow(seen, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (total[1] - F.col("n1") + 0.5)) - F.log((F.col("n0") + 0.5) / (total[0] - F.col("n0") + 0.5))
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    names = [r["f"] for r in found.where(F.col("n0") + F.col("n1") >= LEAST_DOCS).withColumn("z", F.abs(odds / error)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(MODEL_FEATURES).select("f").collect()]
    place = {f: i for i, f in enumerate(names)}

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in text_batches(batches, "text"):
            col, val, swapped = [], [], []
            for text in rows:
                own: dict[int, int] = {}
                for w, n in counted(text).items():
                    for f in word_features(w):
                        if f in place:
                            own[place[f]] = own.get(place[f], 0) + n
                col.append(list(own))
                val.append(list(own.values()))
                found = [{"a": s[0], "b": s[1], "m": s[2] if s[2:] else 1, "n": s[3] if s[2:] else 0, "many": c} for s, c in swaps(text, groups).items()]
                swapped.append(found)
            int_list = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(col, int_list), pa.array(val, int_list), pa.array(swapped, swap_list)], ["y", "col", "val", "swaps"])

    swap_list = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string()), ("m", pa.int32()), ("n", pa.int32()), ("many", pa.int32())]))
    rows = sample.mapInArrow(rows_of, "y int, col array<int>, val array<int>, swaps array<struct<a string, b string, m int, n int, many int>>").toArrow()
    pairs: dict[tuple, int] = {}
    for own in rows.column("swaps").to_pylist():
        for s in own:
            key = (s["a"], s["b"], s["m"], s["n"])
            pairs[key] = pairs.get(key, 0) + s["many"]
    col = [np.array(c, np.int64) for c in rows.column("col").to_pylist()]
    val = [np.log2(1 + np.array(v, float)) for v in rows.column("val").to_pylist()]
    return fit(col, val, rows.column("y").to_numpy().astype(float), names, pairs, penalty)


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a last column of scores of their whole texts; columns stay as they are.

    Where docs has a column of that name, the new one's gets an underscore before it. A null, empty or wordless text has the bias's score; texts of
    any length are read whole; repeated rows get equal scores; an empty table gives no rows. Nothing but the text is read for a score.
    """
    weight, bias = model.weight, model.bias
    out = docs.select("*", F.lit(0.0).alias(free_name(docs.columns, name)))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weight, bias)
        for part, texts in text_batches(batches, text_col):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([own.score(t) for t in texts], pa.float64())], part.schema.names)

    return out.mapInArrow(work, out.schema)
