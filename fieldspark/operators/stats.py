"""Summaries, percentiles, ranks, tables by key, mesh quality, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranks import global_rank
from ..plans.scratch import if_small, materialise

#: Bins of a count that finds where a sample ends.
BINS = 4096


def summary_stats(df: DataFrame, column: str, key: str) -> DataFrame:
    """Minimum, maximum, their keys (the smallest), mean and sample variance; NULLs for an empty table."""
    v = F.col(column)
    return df.agg(F.min(v).alias("low"), F.max(v).alias("high"), F.min_by(key, F.struct(v, key)).alias("at_low"), F.max_by(key, F.struct(v, -F.col(key))).alias("at_high"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"))


def summary_stats_population(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column)
    return df.agg(F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"))


def profile_percents(step: float) -> list[float]:
    """0, 0.1, 0.5, 1, then every `step` percent, 99, 99.9, 100."""
    out = [0.0, 0.1, 0.5, 1.0]
    p = step
    while p < 99:
        out += [p] * (p > 1)
        p += step
    return [*out, 99.0, 99.9, 100.0]


def values_at_ranks(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """Values at 0-based sorted positions, found by histograms: exact, and without sorting the table.

    Each round is one aggregation: it counts the values of 2 ** 12 equal bins of every wanted rank's interval, and narrows
    each interval to the bin that holds the rank, until it holds one distinct value. Only counts of bins come to the driver.
    """
    v = F.col(column).cast("double")
    base = df.filter(F.col(column).isNotNull()).select(v.alias("v"))
    lo, hi = base.agg(F.min("v"), F.max("v")).first()
    out: dict[int, float] = {}
    todo = {(lo, hi, 0): sorted(set(ranks))} if lo is not None else {}
    for _ in range(60):
        for (a, b, _), wanted in todo.items():
            if a == b:
                out.update(dict.fromkeys(wanted, a))
        todo = {k: w for k, w in sorted(todo.items()) if k[0] < k[1]}
        if not todo:
            return out
        # Intervals are apart from each other, so a value is in the last one that starts at or below it, or in none.
        lows, highs = (F.array(*[F.lit(k[e]) for k in todo]) for e in (0, 1))
        at = base.select("v", (F.size(F.filter(lows, lambda a: a <= F.col("v"))) - 1).alias("i")).filter("i >= 0")
        at = at.select("v", "i", F.get(lows, F.col("i")).alias("a"), F.get(highs, F.col("i")).alias("b")).filter("v <= b")
        bin_ = F.least(F.lit(4095), F.floor((F.col("v") - F.col("a")) / ((F.col("b") - F.col("a")) / F.lit(4096)))).cast("int")
        rows = at.groupBy("i", bin_.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("i", "k").collect()
        new: dict = {}
        for i, ((_, _, below), wanted) in enumerate(todo.items()):
            for r in (r for r in rows if r["i"] == i):
                here = [w for w in wanted if below <= w < below + r["n"]]
                if here:
                    new[r["a"], r["b"], below] = here
                below += r["n"]
        todo = new
    raise RuntimeError("ranks didn't settle")


def percentile_profile(df: DataFrame, column: str, step: float = 5.0) -> DataFrame:
    """(percent, value): the value at sorted index floor(p * (n - 1)), exact."""
    percents = profile_percents(step)
    n = df.filter(F.col(column).isNotNull()).count()
    at = {p: int(p / 100 * (n - 1) + 1e-9) for p in percents} if n else {}
    found = values_at_ranks(df, column, list(at.values()))
    return df.sparkSession.createDataFrame([(p, found[at[p]]) for p in percents if p in at], "percent double, value double")


def percentile_profile_fast(df: DataFrame, column: str, percents: list[float], accuracy: int = 10_000) -> DataFrame:
    """percentile_profile() by a mergeable sketch."""
    got = df.agg(F.percentile_approx(column, [p / 100 for p in percents], accuracy).alias("q"))
    return got.select(F.posexplode("q").alias("i", "value")).select(F.element_at(F.array(*[F.lit(p) for p in percents]), F.col("i") + 1).alias("percent"), "value")


def argmin_in_range(df: DataFrame, index: str, value: str, low: int, high: int, group: str) -> DataFrame:
    """Per group, the index in [low, high] of the least value (the smallest index on ties)."""
    return df.filter(F.col(index).between(low, high)).groupBy(group).agg(F.min_by(index, F.struct(value, index)).alias("argmin"), F.min(value).alias("least"))


def best_scale(df: DataFrame, pixel: list[str], scale: str, strength: str, value: str) -> DataFrame:
    """Per pixel, the value at the scale of greatest strength; the lowest scale wins ties."""
    order = F.struct(F.col(strength), -F.col(scale))
    return df.groupBy(*pixel).agg(F.max_by(value, order).alias("best_value"), F.max_by(scale, order).alias("best_scale"))


def bounding_box_per_step(df: DataFrame, step: str, axes: tuple = ("x", "y")) -> DataFrame:
    return df.groupBy(step).agg(*[f(a).alias(f"{k}_{a}") for a in axes for k, f in (("min", F.min), ("max", F.max))])


def counter(df: DataFrame, key: str) -> DataFrame:
    """Counts by key, and a row of key NULL with the total."""
    return df.rollup(key).agg(F.count(F.lit(1)).alias("n"))


def cell_period_stats(df: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Per cell: points, distinct values, their min, max and mean, span, and span relative to the mean."""
    each = df.groupBy(*cell, value).agg(F.count(F.lit(1)).alias("__n"))
    out = each.groupBy(*cell).agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    return out.withColumns({"span": F.col("high") - F.col("low"), "rel_span": F.when(F.col("mean") != 0, (F.col("high") - F.col("low")) / F.col("mean"))})


def key_profile(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key: rows, and each column's distinct values, min and max."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("distinct", F.count_distinct), ("min", F.min), ("max", F.max))])


def section_consistency(df: DataFrame, section: str, attributes: list[str]) -> DataFrame:
    """Per section: rows and whether every attribute has exactly one value."""
    one = reduce(lambda a, b: a & b, [F.count_distinct(c) == 1 for c in attributes])
    return df.groupBy(section).agg(F.count(F.lit(1)).alias("rows"), one.alias("consistent"))


#: Rationals that may be sent to all cells.
MOST_RATIONALS = 10_000


def candidate_periods(cells: DataFrame, corners: list[str], best: list[str], rationals: DataFrame, most: int) -> DataFrame:
    """Per cell (column `cell`): the periods that could occur in it.

    They are the corners' own best periods, and the numerators of all listed rationals between those nearest to the smallest
    and largest corner value; none if a corner value is 0 or NULL. `rationals` (num, den) travels as one array to all cells;
    over MOST_RATIONALS raise.
    """
    if rationals.limit(MOST_RATIONALS + 1).count() > MOST_RATIONALS:
        raise ValueError(f"at most {MOST_RATIONALS} rationals")
    low, high = F.least(*corners), F.greatest(*corners)
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) != 0, F.lit(False)) for c in corners])
    listed = rationals.agg(F.sort_array(F.collect_list(F.struct((F.col("num") / F.col("den")).alias("q"), F.col("num").cast("long").alias("num")))).alias("qs"))
    base = cells.filter(ok).select("cell", low.alias("lo"), high.alias("hi"), F.array(*best).alias("own")).crossJoin(F.broadcast(listed))
    near = lambda v: F.array_min(F.transform("qs", lambda x: F.struct(F.abs(x["q"] - v).alias("e"), x["q"].alias("x"))))["x"]
    base = base.withColumns({"lo": near(F.col("lo")), "hi": near(F.col("hi"))})
    ranged = base.select("cell", F.explode(F.filter("qs", lambda x: x["q"].between(F.col("lo"), F.col("hi")))).alias("x")).select("cell", F.col("x.num").alias("period"))
    own = base.select("cell", F.explode("own").alias("period")).filter(F.col("period").isNotNull())
    return ranged.unionByName(own.select("cell", F.col("period").cast("long"))).filter(F.col("period") <= most).distinct()


def mesh_quality(tris: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per triangle: area, edge lengths, aspect ratio (longest edge squared over twice the area), least and greatest corner value."""
    v = lambda n: vertices.select(F.col("id").alias(f"v{n}"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"), F.col("value").alias(f"f{n}"))
    df = tris.join(v(0), "v0").join(v(1), "v1").join(v(2), "v2")
    edge = lambda a, b: F.hypot(F.col(f"x{a}") - F.col(f"x{b}"), F.col(f"y{a}") - F.col(f"y{b}"))
    area = F.abs((F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / 2
    df = df.withColumns({"area": area, "e0": edge(0, 1), "e1": edge(1, 2), "e2": edge(2, 0), "low": F.least("f0", "f1", "f2"), "high": F.greatest("f0", "f1", "f2")})
    longest = F.greatest("e0", "e1", "e2")
    return df.withColumns({"longest": longest, "aspect": F.when(F.col("area") > 0, longest * longest / (2 * F.col("area")))})


def value_span_contains(df: DataFrame, value: float, low: str = "low", high: str = "high") -> DataFrame:
    return df.filter((F.col(low) <= F.lit(float(value))) & (F.col(high) >= F.lit(float(value))))


def value_span_meets(df: DataFrame, lo: float, hi: float, low: str = "low", high: str = "high") -> DataFrame:
    return df.filter((F.col(low) <= F.lit(float(hi))) & (F.col(high) >= F.lit(float(lo))))


def refinement_priority(quality: DataFrame, most_area: float, most_aspect: float, n: int) -> DataFrame:
    """Triangles over a limit, highest priority (the larger excess ratio of area and aspect) first; ties by id."""
    p = F.greatest(F.col("area") / F.lit(float(most_area)), F.coalesce(F.col("aspect"), F.lit(0.0)) / F.lit(float(most_aspect))) - 1
    return quality.withColumn("priority", p).filter("priority > 0").orderBy(F.col("priority").desc(), "tri").limit(n)


def argsort(df: DataFrame, by: str, key: str, parts: int | None = None) -> DataFrame:
    """`df` with its 0-based rank by (by, key)."""
    return global_rank(df, by, [key], "rank", parts=parts)


def top_fraction(df: DataFrame, forward: str, backward: str, ratio: float) -> DataFrame:
    """Rows whose larger value exceeds ratio * (pooled values at index floor(ratio * 2N)), with the signed extreme."""
    from ..functions.expr import signed_extreme

    pooled = df.select(F.col(forward).alias("v")).unionAll(df.select(F.col(backward).alias("v")))
    n = pooled.count()
    if n == 0:
        return df.withColumn("signed", F.col(forward))
    rank = min(n - 1, int(ratio * n))
    limit = ratio * values_at_ranks(pooled, "v", [rank])[rank]
    return df.filter(F.greatest(forward, backward) > F.lit(limit)).withColumn("signed", signed_extreme(forward, backward))


def hash_uniform(key: str, seed: int = 0) -> Column:
    """A number in [0, 1) decided by the key: 52 bits of an md5, portable across engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def _smallest(df: DataFrame, by: str, tie: str, n: int, place: Column) -> DataFrame:
    """The n rows of `df` with the smallest (by, tie). `place` is a bin, 0 to BINS - 1, that doesn't fall as `by` grows.

    Bins are counted, those below the n-th row are taken whole, and only that row's bin is ranked.
    """
    df = df.withColumn("__bin", F.least(F.lit(BINS - 1), F.greatest(F.lit(0), place)).cast("int"))
    cut, left = BINS, n
    for b, m in sorted((r["__bin"], r["count"]) for r in df.groupBy("__bin").count().collect()):
        if m >= left:
            cut = b
            break
        left -= m
    rest = global_rank(df.filter(F.col("__bin") == cut), by, [tie], "__place").filter(F.col("__place") < left).drop("__place")
    return df.filter(F.col("__bin") < cut).unionByName(rest).drop("__bin", by)


def random_subset(df: DataFrame, size: int | str, key: str, seed: int = 0) -> DataFrame:
    """A fixed random subset without replacement: a count, a share 'x0.1' or a percentage '10%'."""
    if isinstance(size, str):
        share = float(size[1:]) if size.startswith("x") else float(size.rstrip("%")) / 100
        size = int(df.count() * share)
    return _smallest(df.withColumn("__u", hash_uniform(key, seed)), "__u", key, size, F.floor(F.col("__u") * BINS))


def weighted_sample(df: DataFrame, n: int, weight: str, key: str, seed: int = 0) -> DataFrame:
    """n distinct rows drawn in proportion to |weight| (Efraimidis and Spirakis' exponential keys); weight 0 is never drawn."""
    w = F.abs(F.col(weight))
    u = hash_uniform(key, seed) + F.lit(0.5 / 16**13)
    return _smallest(df.filter(w > 0).withColumn("__k", -F.log(u) / w), "__k", key, n, F.floor((F.log("__k") + 41.0) * F.lit(BINS / 82)))


def weight_cdf(df: DataFrame, weight: str, key: str, parts: int | None = None) -> DataFrame:
    """`df` with the running share of |weight| in ascending order of |weight|."""
    total = df.agg(F.sum(F.abs(F.col(weight)))).first()[0] or 1.0
    df = df.withColumn("__w", F.abs(F.col(weight)))
    return global_rank(df, "__w", [key], "rank", "__w", "__sum", parts).withColumn("cdf", F.col("__sum") / F.lit(float(total))).drop("__w", "__sum")


def seeds_above_mean(df: DataFrame, value: str, key: str, strongest_first: bool = False) -> DataFrame:
    mean = df.agg(F.avg(value)).first()[0]
    keep = df.filter(F.col(value) >= F.lit(mean))
    return keep.orderBy(F.col(value).desc() if strongest_first else F.col(value), key)


def adaptive_cells(points: DataFrame, bounds: tuple, value: str, least: int, tolerance: float, max_depth: int, reference: float | None = None, eps: float = 0.0) -> DataFrame:
    """Leaves of a quadtree over (x, y): depth, cx, cy and the cell's statistics.

    A cell is split while it has over `least` points and its distinct values' relative span exceeds the tolerance or the
    reference value lies within eps of its range. Points carry their cell of the finest level, of which a coarser one is the
    prefix. Each round is written, and only the points of split cells go on to the next one.
    """
    x0, x1, y0, y1 = map(float, bounds)
    n = 2**max_depth
    at = lambda c, a, b: F.least(F.lit(n - 1), F.floor((F.col(c) - F.lit(a)) / F.lit((b - a) / n))).cast("long")
    rest = points.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).select(at("x", x0, x1).alias("__x"), at("y", y0, y1).alias("__y"), F.col(value).alias("v"))
    out = None
    for depth in range(max_depth + 1):
        cells = rest.withColumns({c: F.shiftright(f"__{c[1]}", max_depth - depth) for c in ("cx", "cy")})
        split = (F.col("n") > least) & ((F.col("rel_span") > tolerance) | (F.lit(reference is not None) & F.lit(reference or 0.0).between(F.col("low") - eps, F.col("high") + eps)))
        split = F.coalesce(split, F.lit(False)) if depth < max_depth else F.lit(False)
        s = materialise(cell_period_stats(cells, ["cx", "cy"], "v").withColumn("__split", split), "cells")
        leaves = s.filter("NOT __split").drop("__split").withColumn("depth", F.lit(depth).cast("long"))
        out = leaves if out is None else out.unionByName(leaves)
        open_ = s.filter("__split").select("cx", "cy")
        if open_.isEmpty():
            return out
        rest = materialise(cells.join(if_small(open_), ["cx", "cy"], "left_semi").select("__x", "__y", "v"), "points")
    return out


def stratified_sample(df: DataFrame, group: str, key: str, max_per_group: int, total: int, seed: int = 0) -> DataFrame:
    """At most max_per_group rows of each group; if that could exceed the total, of total / max_per_group random groups only."""
    groups = df.select(group).distinct()
    if groups.count() * max_per_group > total:
        groups = random_subset(groups, total // max_per_group, group, seed)
        df = df.join(groups, group, "left_semi")
    w = Window.partitionBy(group).orderBy("__u", key)
    return df.withColumn("__u", hash_uniform(key, seed)).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= max_per_group).drop("__u", "__r")


def equal_count_thresholds(df: DataFrame, column: str, n: int) -> list[float]:
    """n values: every (size div (n - 1))-th sorted one, the last the maximum plus 1."""
    size = df.filter(F.col(column).isNotNull()).count()
    if size == 0 or n < 2:
        return []
    ranks = [min(size - 1, i * (size // (n - 1))) for i in range(n - 1)]
    found = values_at_ranks(df, column, [*ranks, size - 1])
    return [*[found[r] for r in ranks], found[size - 1] + 1]


def threshold_bins(df: DataFrame, column: str, cuts: list[float]) -> DataFrame:
    """`df` with bin: the number of thresholds at or below the value, less 1."""
    return df.withColumn("bin", (F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(column))) - 1).cast("long"))


def rescale(df: DataFrame, column: str, low: float, high: float, out: str = "rescaled") -> DataFrame:
    """The column mapped linearly so that its range becomes [low, high]; a constant column becomes `low`."""
    a, b = df.agg(F.min(column), F.max(column)).first()
    scale = (high - low) / (b - a) if a is not None and b != a else 0.0
    return df.withColumn(out, F.lit(float(low)) + (F.col(column) - F.lit(a)) * F.lit(float(scale)))


def layers(df: DataFrame, axis: str, n: int, thickness: float) -> DataFrame:
    """Rows within one of n equally spaced layers of the thickness along the axis, with their layer."""
    lo, hi = df.agg(F.min(axis), F.max(axis)).first()
    if lo is None or n < 2:
        return df.withColumn("layer", F.lit(0).cast("long"))
    pitch = thickness + (hi - lo - n * thickness) / (n - 1)
    offset = F.col(axis) - F.lit(lo)
    layer = F.floor(offset / F.lit(pitch)).cast("long")
    return df.withColumn("layer", layer).filter(offset - F.col("layer") * F.lit(pitch) < F.lit(float(thickness)))


def dedupe_exact(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """The smallest key of each distinct combination of the columns, with the number of rows."""
    return df.groupBy(*columns).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
