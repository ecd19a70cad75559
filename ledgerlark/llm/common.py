"""What the operators share: the checkpoint folder, written tables and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.tables import deleted, dropped, saved, scratch, shared_dir  # noqa: F401  the operators take them from here

WORD_SPACE = " \t\n\x0b\x0c\r"


def integer_id(df: DataFrame, column: str) -> Column:
    """The column as a long. Classes, links and references are named by the least id, so that ids of other types are an error."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"{column} is {kind.simpleString()}: this operator takes integer ids")
    return F.col(f"`{column}`").cast("long")


def free_name(columns: Iterable[str], wish: str) -> str:
    """wish, with as many underscores before it as make it differ from all columns, in whatever case."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def text_batches(batches: Iterable[pa.RecordBatch], column: str, step: int = 512) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The batches in slices of a few hundred rows, so that long texts never pile up in Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(column).to_pylist()


def per_key(batches: Iterable[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """Apply work to slices of sorted rows that hold whole keys: the last key of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        if held and all(held[-1].column(k)[held[-1].num_rows - 1] == x for k, x in zip(keys, last, strict=True)):
            held.append(batch)
            continue
        at = batch.num_rows - 1
        while at > 0 and all(batch.column(k)[at - 1] == x for k, x in zip(keys, last, strict=True)):
            at -= 1
        if done := [*held, batch.slice(0, at)]:
            table = pa.Table.from_batches(done)
            if table.num_rows:
                yield from work(table).to_batches()
        held = [batch.slice(at)]
    if held:
        yield from work(pa.Table.from_batches(held)).to_batches()
