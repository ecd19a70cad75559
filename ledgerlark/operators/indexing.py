"""Encoders and the index table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ledgerlark.functions import text as X
from ledgerlark.operators.lifecycle import remaining, store_partitions

DIM = 64


def hashed(df: DataFrame, text: str = "text", dim: int = DIM) -> DataFrame:
    """df with dense: terms hashed to signed places of a vector of unit length. The default where no model is given."""
    at = lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int")
    sign = lambda t: F.when(F.xxhash64(t, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0)
    places = F.transform("_terms", lambda t: F.struct(at(t).alias("i"), sign(t).alias("v")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate("_places", F.lit(0.0), lambda s, p: s + F.when(p["i"] == i, p["v"]).otherwise(0.0)))
    length = F.sqrt(F.aggregate("_sums", F.lit(0.0), lambda s, x: s + x * x))
    rows = df.withColumn("_terms", X.terms(text)).withColumn("_places", places).withColumn("_sums", sums).withColumn("_length", length)
    return rows.withColumn("dense", F.transform("_sums", lambda x: F.coalesce(F.try_divide(x, F.col("_length")), F.lit(0.0)).cast("float"))).drop("_terms", "_places", "_sums", "_length")


#: Models by name that this process has loaded.
_held: dict[str, Callable] = {}


def held(name: str, load: Callable[[], Callable]) -> Callable:
    """The model of that name in this process, loaded when it is first asked for and kept for later tasks."""
    if name not in _held:
        _held[name] = load()
    return _held[name]


def encoded(df: DataFrame, load: Callable[[], Callable[[list[str], str], list]], name: str, text: str = "text", mode: str = "passage", batch: int = 64) -> DataFrame:
    """df with dense by a model, called with at most `batch` texts and the mode, "passage" or "query".

    load() runs once in each worker process for a name, which must tell model and settings apart; tasks that follow in the process use the
    same model. A null text is an empty one. Vectors are of 32-bit floats; a model that returns more or fewer vectors than texts is an error."""
    if mode not in ("passage", "query"):
        raise ValueError(f"mode is passage or query, not {mode}")

    def work(batches: Iterator) -> Iterator:
        model = held(name, load)
        for frame in batches:
            texts, found = frame[text].fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                vectors = list(model(part, mode))
                if len(vectors) != len(part):
                    raise ValueError(f"{name} returned {len(vectors)} vectors for {len(part)} texts")
                found += [[float(x) for x in v] for v in vectors]
            yield frame.assign(dense=found)

    kept = df.drop("dense")
    return kept.mapInPandas(work, StructType([*kept.schema.fields, StructField("dense", ArrayType(FloatType()))]))


def build(chunks: DataFrame, path: str, keys: list[str], force: bool = False, encoder: Callable[[DataFrame], DataFrame] = hashed) -> DataFrame:
    """Index the collections that path lacks (all of them if forced), as partitions of a table; returns those written.

    Collections are complete or absent: a write that fails leaves none that later calls would take for indexed."""
    try:
        done = chunks.sparkSession.read.parquet(path).select(*keys).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    new = chunks if force or done is None else remaining(chunks, done, keys)
    store_partitions(encoder(new), path, keys)
    return new.select(*keys).distinct()


def dropped(spark, path: str, collection: dict) -> bool:
    """Delete one collection's partition; False if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *(f"{k}={v}" for k, v in collection.items())]))
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))
