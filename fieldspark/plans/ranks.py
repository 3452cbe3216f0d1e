"""Global ranks and running sums without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _runs(df: DataFrame, by: str, parts: int) -> tuple[DataFrame, Column]:
    """`df` with __run: which quantile range of the numeric column a row is in (nulls first)."""
    q = df.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    cuts = F.array(*[F.lit(c) for c in sorted(set(q or []))]) if q else None
    run = F.when(F.col(by).isNull(), F.lit(-1)).otherwise(F.size(F.filter(cuts, lambda c: c < F.col(by)))) if cuts is not None else F.lit(0)
    return df.withColumn("__run", run), F.col("__run")


def global_rank(df: DataFrame, by: str, tie: list[str], out: str = "rank", weight: str | None = None, running: str | None = None, parts: int | None = None) -> DataFrame:
    """`df` with the 0-based rank by (`by` ascending, nulls first, then `tie`), and the running sum of `weight` up to and with the row.

    Rows are dealt into quantile ranges of `by`; each range is ranked alone, and the totals of the ranges before it (a table
    of at most `parts` rows) are added. Many equal values of `by` share a range; ties should then include a hash.
    """
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df, _ = _runs(df, by, parts)
    w = F.col(weight) if weight else F.lit(0.0)
    totals = df.groupBy("__run").agg(F.count(F.lit(1)).alias("__n"), F.sum(w).alias("__w"))
    all_runs = Window.orderBy("__run")
    totals = totals.select("__run", (F.sum("__n").over(all_runs) - F.col("__n")).alias("__n0"), (F.coalesce(F.sum("__w").over(all_runs), F.lit(0.0)) - F.coalesce("__w", F.lit(0.0))).alias("__w0"))
    own = Window.partitionBy("__run").orderBy(F.col(by).asc_nulls_first(), *tie)
    df = df.withColumn("__r", F.row_number().over(own) - 1)
    if running:
        df = df.withColumn("__s", F.sum(w).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.join(F.broadcast(totals), "__run")  # one row per range
    df = df.withColumn(out, (F.col("__r") + F.col("__n0")).cast("long"))
    if running:
        df = df.withColumn(running, F.col("__s") + F.col("__w0"))
    return df.drop("__run", "__r", "__s", "__n0", "__w0")
