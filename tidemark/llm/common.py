"""Helpers shared by the training-data operators.

Working tables live in the folder that the cluster names in ``spark.checkpoint.dir``; executors
reach it through Spark's own readers and writers only, so any store Spark supports will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import discard, folder, shared_dir, stored

__all__ = ["append", "discard", "folder", "fresh", "map_texts", "shared_dir", "steps", "stored", "texts_only"]

#: Bytes of text that one step of a Python worker holds, apart from a single longer row.
STEP_BYTES = 2 << 20


def texts_only(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text, nulls as empty texts; whatever else the input holds is pruned at the scan."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def steps(batches: Iterator[pa.RecordBatch], column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that ``column`` holds about ``size`` bytes in each; a longer row comes alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            n = 0 if n != n else int(n)
            if i > start and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def map_texts(
    docs: DataFrame, make: Callable[[], Callable[[list, list[str]], dict]], schema: str, column: str = "text", size: int = STEP_BYTES
) -> DataFrame:
    """Run ``make()(keys, texts)`` over Arrow batches of a (key, text) table.

    ``make`` runs once a task and returns the function for the batches, which gives a dict of columns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = docs.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(out)
    key = docs.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in steps(batches, column, size):
            made = work(batch.column(key).to_pylist(), batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return docs.mapInArrow(run, out)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def append(docs: DataFrame, make: Callable[[], Callable[[list, list[str]], dict]], fields: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with more columns: ``make()(keys, texts)`` gives the values of ``fields`` (name: type) by row.

    Every column of a row stays with it, so repeated rows and null keys need no join and no shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    whole = docs.selectExpr("*", *(f"cast(null as {kind}) as `{name}`" for name, kind in fields.items())).schema
    arrow, n = to_arrow_schema(whole), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in steps(batches, text):
            made = work(batch.column(key).to_pylist(), [x or "" for x in batch.column(text).to_pylist()])
            new = [pa.array(v, f.type) for v, f in zip(made.values(), list(arrow)[n:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), *new], schema=arrow)

    return docs.mapInArrow(run, whole)
