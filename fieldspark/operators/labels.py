"""Statistics of labelled voxels, and joins of labels, tags and spans back to points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tensor import sym_eig3, tensor_invariants, westin_anisotropy
from ..plans.ranks import global_rank


def label_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """Voxels per label; NULL and negative labels are void."""
    return df.filter(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("size"))


def label_span(df: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    return df.groupBy(label).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def label_mean(df: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    return df.groupBy(label).agg(F.avg(value).alias("mean"))


def label_first(df: DataFrame, order: list[str], label: str = "label", value: str = "value") -> DataFrame:
    """The value of each label's first voxel in the order of `order`."""
    return df.groupBy(label).agg(F.min_by(value, F.struct(*order)).alias("first"))


def label_ids(df: DataFrame, order: list[str], label: str = "label") -> DataFrame:
    """Dense ids of labels in the order of their first voxel; the first column of `order` is numeric."""
    at = [f"__at{i}" for i in range(len(order))]
    first = df.groupBy(label).agg(F.min(F.struct(*[F.col(c).alias(a) for c, a in zip(order, at)])).alias("__first")).select(label, "__first.*")
    return global_rank(first, at[0], [*at[1:], label], "dense_id").select(label, "dense_id")


def label_shape(df: DataFrame, label: str = "label", axes: tuple = ("x", "y", "z"), centred: bool = False) -> DataFrame:
    """Centroid, scatter matrix about it, anisotropy measures and sorted eigenvalues per label.

    One pass of moments; `centred` joins the centroids back first, which keeps digits where coordinates are far from 0.
    """
    if centred:
        mid = df.groupBy(label).agg(*[F.avg(a).alias(f"__{a}") for a in axes])
        df = df.join(mid, label).withColumns({a: F.col(a) - F.col(f"__{a}") for a in axes})
    x, y, z = axes
    pairs = {"xx": (x, x), "xy": (x, y), "xz": (x, z), "yy": (y, y), "yz": (y, z), "zz": (z, z)}
    sums = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"s{a}") for a in axes], *[F.sum(F.col(a) * F.col(b)).alias(k) for k, (a, b) in pairs.items()], *([F.first(f"__{a}").alias(f"__{a}") for a in axes] if centred else []))
    at = [(F.col(f"__{a}") if centred else F.lit(0.0)) + F.col(f"s{a}") / F.col("n") for a in axes]
    out = sums.select(label, "n", *[c.alias(f"c{a}") for c, a in zip(at, axes)], *[(F.col(k) - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n")).alias(k) for k, (a, b) in pairs.items()])
    six = [F.col(k) for k in pairs]
    eig = sym_eig3(*six)
    out = out.withColumns({**{k: v for k, v in tensor_invariants(*six).items() if k == "fa"}, "l1": eig[0], "l2": eig[1], "l3": eig[2]})
    return out.withColumns(westin_anisotropy(F.col("l1"), F.col("l2"), F.col("l3")))


def label_statistics(df: DataFrame, label: str = "label", value: str = "value", axes: tuple = ("x", "y", "z")) -> DataFrame:
    """Size, span, mean, centroid and anisotropy of every label in a single aggregation."""
    x, y, z = axes
    pairs = {"xx": (x, x), "xy": (x, y), "xz": (x, z), "yy": (y, y), "yz": (y, z), "zz": (z, z)}
    sums = df.groupBy(label).agg(F.count(F.lit(1)).alias("size"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), *[F.sum(a).alias(f"s{a}") for a in axes], *[F.sum(F.col(a) * F.col(b)).alias(k) for k, (a, b) in pairs.items()])
    six = [F.col(k) - F.col(f"s{a}") * F.col(f"s{b}") / F.col("size") for k, (a, b) in pairs.items()]
    return sums.select(label, "size", "low", "high", "mean", *[(F.col(f"s{a}") / F.col("size")).alias(f"c{a}") for a in axes], tensor_invariants(*six)["fa"].alias("fa"))


def value_range_slices(df: DataFrame, column: str, fraction: float) -> DataFrame:
    """Bins [s, s + d] over the column's range, d = fraction * (max - min), both edges closed: count, percent, min, max, avg.

    A value on an edge counts in both bins. Each row meets only its own one or two bins, not all.
    """
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n == 0:
        return df.select(F.lit(0).cast("long").alias("bin"), F.col(column).cast("double").alias("v")).limit(0).groupBy("bin").agg(F.count("v").alias("n"), F.avg("v").alias("percent"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))
    d, bins = (hi - lo) * fraction, int(-(-1 // fraction))
    v = F.col(column).cast("double")
    k = F.least(F.lit(bins - 1), F.floor((v - F.lit(float(lo))) / F.lit(float(d)))) if d > 0 else F.lit(0)
    near = F.array(k - 1, k, k + 1).cast("array<bigint>")
    inside = lambda b: (b >= 0) & (b < bins) & (v >= F.lit(float(lo)) + b * F.lit(float(d))) & (v <= F.lit(float(lo)) + (b + 1) * F.lit(float(d)))
    rows = df.filter(F.col(column).isNotNull()).select(F.explode(F.filter(near, inside)).alias("bin"), v.alias("v"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * F.lit(100.0 / n)).alias("percent"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))


def thresholded_integral(df: DataFrame, box: dict[str, tuple[float, float]], threshold: float, voxel_volume: float = 1.0, value: str = "value") -> DataFrame:
    """The sum of value * volume over voxels in the box with a value of at least the threshold (0 if there is none)."""
    from ..functions.expr import in_box

    hit = df.filter(in_box(box) & (F.col(value) >= F.lit(float(threshold))))
    return hit.agg(F.coalesce(F.sum(F.col(value) * F.lit(float(voxel_volume))), F.lit(0.0)).alias("integral"), F.count(F.lit(1)).alias("voxels"))


def broadcast_back(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Group values on every member; the join is by broadcast if the groups' statistics allow, else adaptive with skew handling."""
    return df.join(groups, key, "left")


def select_labels(stats: DataFrame, ranges: dict[str, tuple[float, float]], label: str = "label") -> DataFrame:
    """Labels >= 0 whose attributes all lie in closed ranges."""
    ok = reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()], F.col(label) >= 0)
    return stats.filter(ok).select(label)


def points_with_tags(tags: DataFrame, chosen: DataFrame, label: str = "label", vertex: str = "vertex", column: str = "tags") -> DataFrame:
    """Vertices that carry a chosen label."""
    return tags.select(vertex, F.explode(column).alias("__tag")).join(chosen.select(F.col(label).alias("__tag")), "__tag", "left_semi").select(vertex).distinct()


def grain_values_on_points(tags: DataFrame, values: DataFrame, label: str = "label", value: str = "value", vertex: str = "vertex", column: str = "tags") -> DataFrame:
    """For each vertex whose tag set meets the chosen labels: how many, and their mean value."""
    rows = tags.select(vertex, F.explode(column).alias(label)).join(values.select(label, value), label)
    return rows.groupBy(vertex).agg(F.count(F.lit(1)).alias("n_labels"), F.avg(value).alias("mean_value"))


def faces_within(faces: DataFrame, chosen: DataFrame, face: str, corners: list[str], vertex: str = "vertex") -> DataFrame:
    """Faces all of whose vertices are chosen."""
    own = faces.select(face, F.explode(F.array(*corners)).alias(vertex))
    hit = own.join(chosen.select(vertex).withColumn("__in", F.lit(True)), vertex, "left")
    return hit.groupBy(face).agg(F.bool_and(F.coalesce("__in", F.lit(False))).alias("all_in")).filter("all_in").select(face)


def shared_tags(a: Column, b: Column, c: Column) -> Column:
    """The tags that all three corners of a face have; NULL unless exactly two labels share it and the larger is above 0."""
    both = F.array_sort(F.array_intersect(F.array_intersect(a, b), c))
    return F.when((F.size(both) == 2) & (F.array_max(both) > 0), both)


def spans_containing(spans: DataFrame, sweep: DataFrame, width: float, low: str = "low", high: str = "high", value: str = "value") -> DataFrame:
    """Rows of `spans` with every value of `sweep` that their closed range contains: an equi-join on buckets of `width`."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("long")
    s = spans.withColumn("__b", F.explode(F.sequence(bucket(low), bucket(high))))
    v = sweep.withColumn("__b", bucket(value))
    return s.join(v, "__b").filter(F.col(value).between(F.col(low), F.col(high))).drop("__b")


def value_pairs(sets: DataFrame, column: str = "tags", key: str = "vertex") -> DataFrame:
    """All unordered pairs of values of a set, with the number of sets that hold both."""
    t = F.col(column)
    pairs = F.flatten(F.transform(t, lambda a: F.transform(F.filter(t, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(key, F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("sets"))


def tag_bounding_boxes(tags: DataFrame, points: DataFrame, axes: tuple = ("x", "y"), vertex: str = "vertex", column: str = "tags") -> DataFrame:
    """The box of all vertices that carry each tag; `points` has the vertices' coordinates."""
    rows = tags.select(vertex, F.explode(column).alias("tag")).join(points, vertex)
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{k}_{a}") for a in axes for k, f in (("min", F.min), ("max", F.max))])


def label_interfaces(grid: DataFrame, axes: tuple = ("i", "j", "k"), tag: str = "tag") -> DataFrame:
    """Per pair of labels, the voxel edges (unit steps along an axis) with one at either end."""
    parts = []
    for a in axes:
        there = grid.select(*[(F.col(x) - 1 if x == a else F.col(x)).alias(x) for x in axes], F.col(tag).alias("__other"))
        parts.append(grid.join(there, list(axes)).filter(F.col(tag) != F.col("__other")).select(F.least(tag, "__other").alias("tag_a"), F.greatest(tag, "__other").alias("tag_b")))
    return reduce(DataFrame.unionByName, parts).groupBy("tag_a", "tag_b").agg(F.count(F.lit(1)).alias("edges"))
