"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source gets a target number of words. Whole copies of all its documents are certain; the fraction that is left
is a Pareto order sample: documents are ranked by the odds of a uniform number divided by the odds of their inclusion
(in proportion to their size), and the lowest ranks that fill the remaining words are taken. Documents whose odds in
proportion would reach one are certain, and the proportion is set anew for the others. The sample's size is fixed in
words: it ends within half a document of the target.

No source is ranked in one task: a histogram of the ranks finds the one bin in which each source's sample ends, and
only that bin is ordered. Edge cases: a null text has size 0 and nothing is taken of it; a null source is a source of
its own, last; repeated rows share their uniform number and differ in nothing, so which of them is taken is the same
result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns_of, materialise, with_small

BINS, SPAN = 4096, 40.0


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in (0, 1) decided by the keys: 52 bits of an md5."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13))


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row per source: source_size, weight, target, whole (certain copies), remain (words still to sample), least_sure and share (see _sure()).

    Sources in code-point order, null last, take the weights in turn. Targets share all words by weight and stop at
    `cap` times the source's size; the excess is shared again by weight until no target is above. That fixed point is
    a water level: sources are filled in order of cap * size / weight. The windows run over one row per source.
    """
    by_size = sizes.groupBy(F.col(source).alias("mix_source"), F.col(size).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    by_size = by_size.withColumn("words_of", F.col("n") * F.col("w")).withColumn("squares_of", F.col("words_of").cast("decimal(20,0)") * F.col("w").cast("decimal(18,0)"))
    by_size = materialise(by_size, "by_size")
    s = by_size.groupBy("mix_source").agg(F.coalesce(F.sum("words_of"), F.lit(0)).alias("source_size"))
    s = materialise(s, "sources")
    every, turn = Window.partitionBy(), Window.orderBy(F.col("mix_source").asc_nulls_last())
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumns({"most": F.col("source_size") * F.lit(float(cap)), "words": F.sum("source_size").over(every)})
    level = Window.orderBy(F.col("most") / F.col("weight"), F.col("mix_source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"filled": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    full = (F.col("words") - F.col("filled")) / F.col("open") > F.col("most") / F.col("weight")
    s = s.withColumn("full", full)
    kept = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)
    shared = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    s = s.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise((F.col("words") - kept) / shared * F.col("weight")))
    s = s.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    s = s.withColumn("remain", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).select("mix_source", "source_size", "weight", "target", "whole", "remain")
    s = materialise(s, "remains")
    return s.join(_sure(by_size, s), F.col("mix_source").eqNullSafe(F.col("sure_source")), "left").drop("sure_source")


def _sure(by_size: DataFrame, s: DataFrame) -> DataFrame:
    """One row per source: least_sure, the size from which a document's inclusion is certain (null: none), and share, the inclusion of a word's size below.

    From the largest size down, a size is certain while its share of what remains for it and all smaller ones reaches one.
    The window runs over the distinct sizes of a source, which are at most as many as the longest text has words.
    """
    larger = Window.partitionBy("mix_source").orderBy(F.col("w").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("mix_source")
    nothing = F.lit(0).cast("decimal(38,0)")
    b = with_small(by_size, s.select(F.col("mix_source").alias("sure_source"), "remain"), F.col("mix_source").eqNullSafe(F.col("sure_source")), "inner")
    b = b.withColumns({"left": F.col("remain") - F.coalesce(F.sum("words_of").over(larger), F.lit(0)), "squares": (F.sum("squares_of").over(whole) - F.coalesce(F.sum("squares_of").over(larger), nothing)).cast("double")})
    sure = (F.col("w") > 0) & (F.col("w") * F.col("left") >= F.col("squares"))
    # The first size that isn't certain has what is left for it and all smaller ones.
    first = F.max_by(F.struct("left", "squares"), F.when(~sure, F.col("w")))
    b = b.groupBy("sure_source").agg(F.min(F.when(sure, F.col("w"))).alias("least_sure"), first.alias("f"))
    return b.select("sure_source", "least_sure", F.when(F.col("f.squares") > 0, F.col("f.left") / F.col("f.squares")).otherwise(F.lit(0.0)).alias("share"))


def _ranked(df: DataFrame, plan: DataFrame, source: str, size: str, keys: tuple, seed: int) -> DataFrame:
    """`df` joined with its source's plan, with mix_rank and its bin; nothing but the small plan is moved."""
    df = with_small(df, plan, df[source].eqNullSafe(plan["mix_source"]))
    odds = lambda p: p / (1 - p)
    share = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), F.col("share") * F.col(size)))
    sure = F.coalesce(F.col(size) >= F.col("least_sure"), F.lit(False))
    df = df.withColumn("mix_rank", F.when(sure, F.lit(0.0)).otherwise(odds(uniform(*[F.col(k) for k in keys], seed=seed)) / odds(share)))
    place = F.floor((F.log("mix_rank") + F.lit(SPAN)) * F.lit(BINS / (2 * SPAN)))
    return df.withColumn("mix_bin", F.least(F.lit(BINS - 1), F.greatest(F.lit(0), place)).cast("int"))  # rank 0: no logarithm, bin 0


def mix_plan(sizes: DataFrame, source: str = "source", size: str = "size", keys: tuple = ("doc_id",), seed: int = 0, **options) -> DataFrame:
    """source_targets() with the rank at which each source's sample ends: bin `cut`, and within it the rank `last`.

    `sizes` should be narrow and cheap to read again. Rows of equal rank (repeated rows) are taken together.
    """
    targets = materialise(source_targets(sizes, source, size, **options), "targets")
    df = materialise(_ranked(sizes.select(source, size, *[k for k in keys if k not in (source, size)]), targets, source, size, keys, seed).select("mix_source", "mix_rank", "mix_bin", "remain", F.col(size).alias("w")), "ranked")
    run = Window.partitionBy("mix_source").orderBy("mix_bin")
    bins = df.groupBy("mix_source", "mix_bin", "remain").agg(F.sum("w").alias("w")).withColumn("upto", F.sum("w").over(run))
    ends = bins.filter((F.col("upto") >= F.col("remain")) & (F.col("upto") - F.col("w") < F.col("remain")))
    ends = ends.select(F.col("mix_source").alias("end_source"), F.col("mix_bin").alias("cut"), (F.col("upto") - F.col("w")).alias("below"))
    ends = materialise(ends, "ends")
    near = with_small(df, ends, df["mix_source"].eqNullSafe(ends["end_source"]) & (df["mix_bin"] == ends["cut"]), "inner")
    order = Window.partitionBy("mix_source").orderBy("mix_rank", "w").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("mid", F.col("below") + F.sum("w").over(order) - F.col("w") / 2)
    last = near.groupBy("mix_source", "cut").agg(F.max(F.when(F.col("mid") < F.col("remain"), F.col("mix_rank"))).alias("last"))
    last = last.select(F.col("mix_source").alias("end_source"), "cut", F.coalesce("last", F.lit(-1.0)).alias("last"))
    plan = targets.join(last, targets["mix_source"].eqNullSafe(last["end_source"]), "left")
    # A source without such a bin samples nothing (nothing remains) or, up to rounding, everything.
    return materialise(plan.withColumn("cut", F.coalesce("cut", F.when(F.col("remain") > 0, F.lit(BINS)).otherwise(F.lit(-1)))).drop("end_source"), "plan")


def mix(df: DataFrame, plan: DataFrame, source: str = "source", size: str = "size", keys: tuple = ("doc_id",), seed: int = 0) -> DataFrame:
    """`df` with source_size, target, copies (long) and taken (copies * size), by the plan of mix_plan(); columns of these names are replaced."""
    own = [f"__fs_key{i}" for i in range(len(keys))]
    rows = df.select(F.struct(*columns_of(df)).alias("__fs_row"), F.col(source).alias("__fs_source"), F.col(size).alias("__fs_size"), *[F.col(k).alias(a) for k, a in zip(keys, own)])
    ranked = _ranked(rows, plan, "__fs_source", "__fs_size", tuple(own), seed)
    extra = (F.col("mix_bin") < F.col("cut")) | ((F.col("mix_bin") == F.col("cut")) & (F.col("mix_rank") <= F.coalesce("last", F.lit(-1.0))))
    copies = F.when(F.col("__fs_size") > 0, F.col("whole") + extra.cast("long")).otherwise(F.lit(0)).cast("long")
    made = {"source_size": F.col("source_size"), "target": F.col("target"), "copies": copies, "taken": copies * F.col("__fs_size")}
    return ranked.select(*[F.col("__fs_row")[c].alias(c) for c in df.columns if c not in made], *[v.alias(k) for k, v in made.items()])


def word_count(text: Column) -> Column:
    """The number of words of a text (long; null text: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken; texts are read twice and never shuffled."""
    rows = docs.select(F.struct(*columns_of(docs)).alias("__fs_doc"), F.col(key).alias("__fs_id"), F.col(source).alias("__fs_from"), word_count(F.col(text)).alias("__fs_words"))
    sizes = materialise(rows.drop("__fs_doc"), "sizes")
    plan = mix_plan(sizes, "__fs_from", "__fs_words", keys=("__fs_id",), **options)
    df = mix(rows, plan, "__fs_from", "__fs_words", keys=("__fs_id",))
    return df.withColumn("__fs_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("__fs_doc.*")
