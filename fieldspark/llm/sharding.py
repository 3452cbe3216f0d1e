"""Sharding along a Hilbert curve: near-equal bytes, equal texts together, neighbouring metadata in the same shard.

Language, source and size are quantised, each to 2^BITS steps, and interleaved to a position on a Hilbert curve. Texts
sorted by that position are cut into runs of near-equal bytes, so a file or shard holds a small box of metadata and a
filter on any of the dimensions skips most of the others. Law: `bytes`.

Equal texts are one group and stay in one shard. A group larger than a whole shard's share can't; its rows are dealt by
the hash of their id over as few shards as it needs. Groups of several rows that hold over a 64th of a share of the rows,
and groups over a 64th of a share of the bytes (twice 64 times the shards at most, by that definition) are placed first,
the largest into the emptiest shard; the small groups then fill the room that is left, in curve order.
Totals are taken in two levels (curve cell, then hash cell), so no task sees more than a cell.

Edge cases: a null text has size 1 and the crc of an empty text; null languages and sources have a step of their own,
the first; repeated rows are rows of the same group; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranks import global_rank
from .common import materialise, with_small

BITS, SUB = 5, 64


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points given as an (n dimensions, rows) integer array, after Skilling (2004)."""
    x = axes.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def hilbert(*axes: Column, bits: int = BITS) -> Column:
    """The Hilbert position of integer columns in [0, 2^bits)."""

    @F.pandas_udf("long")
    def position(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cols]), bits))

    return position(*axes)


def _steps(df: DataFrame, column: str, bits: int) -> DataFrame:
    """`df` with step_<column>: the rank of its value among the distinct values, scaled to 2^bits steps; null: 0.

    Values are ranked by ranges of their first seven bytes, then by all of them.
    """
    v = F.col(f"v_{column}")
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias(f"v_{column}")).distinct()
    head = F.conv(F.rpad(F.hex(F.substring(F.encode(v, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    values = materialise(values.withColumn("head", head), "values")
    rank = F.col("rank") / F.lit(max(1, values.count()))
    values = global_rank(values, "head", [f"v_{column}"]).select(v, (F.floor(rank * (2**bits - 1)).cast("int") + 1).alias(f"step_{column}"))
    values = materialise(values, "steps")
    df = with_small(df, values, df[column] == values[f"v_{column}"])
    return df.withColumn(f"step_{column}", F.coalesce(f"step_{column}", F.lit(0))).drop(f"v_{column}")


def _place(sizes: list[int], total: int, shards: int) -> tuple[list[int], list[float]]:
    """Shards for a few large pieces, given in descending size, and the room left in each shard for the rest."""
    load, at = [0] * shards, []
    for size in sizes:
        s = min(range(shards), key=lambda i: (load[i], i))
        load[s] += size
        at.append(s)
    rest, order = total - sum(sizes), sorted(load)
    level, below = 0.0, 0
    for i, x in enumerate(order):
        below += x
        level = (rest + below) / (i + 1)
        if i + 1 == shards or level <= order[i + 1]:
            break
    return at, [max(0.0, level - x) for x in load]


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", dimensions: tuple = ("lang", "source"), bits: int = BITS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in curve order), grown_shard (null), curve."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("h"), *[F.col(d).cast("string").alias(f"d{i}") for i, d in enumerate(dimensions)])
    rows = materialise(rows, "sized")
    group = ["h", "text_crc32", "size"]
    groups = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.min(f"d{i}").alias(f"d{i}") for i in range(len(dimensions))])
    groups = materialise(groups.withColumn("bytes", F.col("n") * F.col("size")), "groups")
    cuts = groups.agg(F.percentile_approx("size", [i / 2**bits for i in range(1, 2**bits)], 10_000).alias("q"), F.sum("bytes").alias("total"), F.sum("n").alias("rows")).first()
    total, q = cuts["total"] or 0, sorted(set(cuts["q"] or []))
    for i in range(len(dimensions)):
        groups = _steps(groups, f"d{i}", bits)
    size_step = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in q]), lambda c: c < F.col("size"))) if q else F.lit(0)
    groups = groups.withColumn("curve", hilbert(*[F.col(f"step_d{i}") for i in range(len(dimensions))], size_step, bits=bits))
    groups = groups.withColumn("sub", F.pmod(F.shiftrightunsigned("h", 32), F.lit(SUB)).cast("int"))
    share = max(1.0, total / shards)
    # By rows, too: a short text may have most of the rows in few of the bytes.
    hot = (F.col("bytes") > F.lit(share / 64)) | ((F.col("n") > 1) & (F.col("n") > F.lit((cuts["rows"] or 0) / (64 * shards))))
    groups = materialise(groups.select(*group, "bytes", "curve", "sub", hot.alias("hot")), "curve")
    large = groups.filter("hot").orderBy(F.col("bytes").desc(), *group).collect()
    pieces = []
    for g in large:
        m = int(-(-g["bytes"] // share))
        pieces += [(g["bytes"] // m, g["h"], g["text_crc32"], g["size"], m, i) for i in range(m)]
    pieces.sort(key=lambda p: (-p[0], *p[1:]))
    at, room = _place([p[0] for p in pieces], total, shards)
    ends = list(np.cumsum(room)[:-1])
    # The large pieces are a fixed few rows; they are matched by broadcast, so copies of a hot text are never shuffled by it.
    schema = "lh long, lcrc long, lsize long, pieces int, piece int, lshard int"
    big = spark.createDataFrame([(p[1], p[2], p[3], p[4], p[5], s) for p, s in zip(pieces, at)], schema)
    small = groups.filter("NOT hot")
    cell, fine, inner = Window.orderBy("curve"), Window.partitionBy("curve").orderBy("sub"), Window.partitionBy("curve", "sub").orderBy(*group)
    fines = small.groupBy("curve", "sub").agg(F.sum("bytes").alias("w"))
    fines = materialise(fines, "cells")
    cells = fines.groupBy("curve").agg(F.sum("w").alias("cw")).withColumn("before_cell", F.sum("cw").over(cell) - F.col("cw")).drop("cw")
    fines = fines.withColumn("before_sub", F.sum("w").over(fine) - F.col("w")).drop("w")
    fines = fines.join(F.broadcast(cells), "curve")  # at most 2^(3 * BITS) cells
    small = small.withColumn("before", F.sum("bytes").over(inner) - F.col("bytes")).join(fines, ["curve", "sub"])
    middle = F.col("before_cell") + F.col("before_sub") + F.col("before") + F.col("bytes") / 2
    shard = F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]), lambda e: e <= middle)) if shards > 1 else F.lit(0)
    small = small.select(*group, "curve", "sub", shard.cast("int").alias("shard"))
    once = big.select("lh", "lcrc", "lsize", "pieces").distinct()
    same = (F.col("h") == F.col("lh")) & (F.col("text_crc32") == F.col("lcrc")) & (F.col("size") == F.col("lsize"))
    marked = rows.join(F.broadcast(once), same, "left").drop("lh", "lcrc", "lsize")
    salt = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.coalesce("pieces", F.lit(1))).cast("int")
    out = ["doc_id", "size", "text_crc32", "h", "curve", "sub", "shard"]
    few = marked.filter(F.col("pieces").isNull()).join(small, group).select(*out)
    where = groups.filter("hot").select(*group, "curve")
    where = big.join(F.broadcast(where), same).select("lh", "lcrc", "lsize", "piece", "lshard", "curve")
    many = marked.filter(F.col("pieces").isNotNull()).withColumn("of", salt).join(F.broadcast(where), same & (F.col("of") == F.col("piece")))
    many = many.withColumn("sub", F.lit(SUB) + F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(SUB)).cast("int")).withColumn("shard", F.col("lshard")).select(*out)
    placed = materialise(few.unionByName(many), "placed")
    # Slots: rows before this shard's curve cell, before the hash cell in it, and before the row in that.
    subs = materialise(placed.groupBy("shard", "curve", "sub").agg(F.count(F.lit(1)).alias("n")), "slots")
    over_cells, over_subs = Window.partitionBy("shard").orderBy("curve"), Window.partitionBy("shard", "curve").orderBy("sub")
    per_cell = subs.groupBy("shard", "curve").agg(F.sum("n").alias("cn")).withColumn("c0", F.sum("cn").over(over_cells) - F.col("cn")).drop("cn")
    subs = subs.withColumn("s0", F.sum("n").over(over_subs) - F.col("n")).drop("n").join(F.broadcast(per_cell), ["shard", "curve"])
    in_sub = Window.partitionBy("shard", "curve", "sub").orderBy("h", "doc_id")
    placed = placed.withColumn("r", F.row_number().over(in_sub)).join(subs, ["shard", "curve", "sub"])
    slot = (F.col("c0") + F.col("s0") + F.col("r") - 1).cast("long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
