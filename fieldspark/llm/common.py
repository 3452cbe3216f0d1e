"""Helpers shared by the training-data operators: words, let-bound expressions, shared-folder tables, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import materialise, materialise_by, scratch_path  # noqa: F401

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of at most so many narrow rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bytes (of its rows as JSON) that such a side may have.
BROADCAST_BYTES = 1 << 26


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Rows that are written within go to Python so many at a time: rows with whole texts or sets in them are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def words(text: Column) -> Column:
    """All words of a text in order; an empty array for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where body uses it in nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as remainder 1, so as a training row."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(1))


def is_small(df: DataFrame) -> bool:
    """Whether a table may be broadcast, by its counted rows and, where a row's size isn't fixed, by its counted bytes."""
    if df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return False
    if all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)) for f in df.schema):
        return True
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def with_small(df: DataFrame, small: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """Join with a table that is usually small: broadcast if is_small(), else by shuffle.

    `small` should be cheap to evaluate (materialised or aggregated from a materialised table). In the shuffle join
    adaptive execution splits the partitions of hot keys.
    """
    return df.join(F.broadcast(small) if is_small(small) else small, on, how)
