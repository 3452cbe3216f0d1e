"""Trajectories: recurrence, periods, flow maps, accumulated deviation, runs. Order is the step column; windows are by trajectory."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.expr import periodic_distance, turn_angle
from ..functions.tensor import sym_eig2
from ..plans.scratch import if_small, materialise
from .components import connected_components
from .neighbors import knn_join, radius_join

#: Points of an orbit, or links of its points, that may be one row's array.
ORBIT = 1_000


def _w(pid: str, step: str) -> Window:
    return Window.partitionBy(pid).orderBy(step)


def lag_distances(df: DataFrame, p: int, cols: list[str] = ("x", "y"), periods: list | None = None, pid: str = "pid", step: str = "step") -> DataFrame:
    """(pid, step, d): the distance between step i and i + p of a trajectory; steps without such a partner are left out."""
    w = _w(pid, step)
    d = periodic_distance([F.col(c) for c in cols], [F.lead(c, p).over(w) for c in cols], periods or [None] * len(cols))
    return df.select(pid, step, d.alias("d")).filter("d IS NOT NULL")


def average_distance(df: DataFrame, p: int, **options) -> DataFrame:
    """Mean lag-p distance per trajectory; NULL where it has p steps or fewer."""
    pid = options.get("pid", "pid")
    means = lag_distances(df, p, **options).groupBy(pid).agg(F.avg("d").alias("mean_distance"))
    return df.select(pid).distinct().join(means, pid, "left")


def distance_profile(df: DataFrame, p: int, **options) -> DataFrame:
    """Mean and upper median (element n div 2 of the sorted distances) of lag-p distances."""
    pid = options.get("pid", "pid")
    d = lag_distances(df, p, **options)
    w = Window.partitionBy(pid)
    d = d.withColumns({"r": F.row_number().over(w.orderBy("d")) - 1, "n": F.count(F.lit(1)).over(w)})
    return d.groupBy(pid).agg(F.avg("d").alias("mean_distance"), F.max(F.when(F.col("r") == F.floor(F.col("n") / 2), F.col("d"))).alias("median_distance"))


def compare_profiles(df: DataFrame, p0: int, p1: int, **options) -> DataFrame:
    """Which lag is nearer: the one smaller at more of the common steps; on a tie the one of smaller upper median, then p0."""
    pid, step = options.get("pid", "pid"), options.get("step", "step")
    a, b = (lag_distances(df, p, **options).withColumnRenamed("d", n) for p, n in ((p0, "d0"), (p1, "d1")))
    votes = a.join(b, [pid, step]).groupBy(pid).agg(F.sum((F.col("d0") < F.col("d1")).cast("long")).alias("wins0"), F.sum((F.col("d1") < F.col("d0")).cast("long")).alias("wins1"))
    m0, m1 = (distance_profile(df, p, **options).select(pid, F.col("median_distance").alias(n)) for p, n in ((p0, "m0"), (p1, "m1")))
    out = votes.join(m0, pid).join(m1, pid)
    second = (F.col("wins1") > F.col("wins0")) | ((F.col("wins1") == F.col("wins0")) & (F.col("m1") < F.col("m0")))
    return out.withColumn("better", F.when(second, F.lit(p1)).otherwise(F.lit(p0)).cast("long"))


def best_period(df: DataFrame, max_p: int, cols: list[str] = ("x", "y"), periods: list | None = None, pid: str = "pid", step: str = "step") -> DataFrame:
    """The lag p in 1..max_p of least mean distance (the smallest p on ties), and that mean.

    All lags come from one window: leads 1..max_p are columns, and their means one aggregation.
    """
    w, periods = _w(pid, step), periods or [None] * len(cols)
    ds = [periodic_distance([F.col(c) for c in cols], [F.lead(c, p).over(w) for c in cols], periods).alias(f"d{p}") for p in range(1, max_p + 1)]
    means = df.select(pid, *ds).groupBy(pid).agg(*[F.avg(f"d{p}").alias(f"d{p}") for p in range(1, max_p + 1)])
    best = F.array_min(F.filter(F.array(*[F.struct(F.col(f"d{p}").alias("d"), F.lit(p).cast("long").alias("p")) for p in range(1, max_p + 1)]), lambda s: s["d"].isNotNull()))
    return means.select(pid, best.alias("b")).select(pid, F.col("b.p").alias("best_period"), F.col("b.d").alias("mean_distance"))


def period_from_closest_pair(df: DataFrame, width: float, cols: list[str] = ("x", "y"), periods: list | None = None, pid: str = "pid", step: str = "step") -> DataFrame:
    """Per trajectory, its closest pair of steps i < j and q = (j - i) * width / (x_j - x_i); distances by the periodic metric.

    Of equally close pairs the one of the smallest i, then j, counts. Each step's nearest step of its trajectory is found by
    bins (knn_join()), so the work follows the steps, not their pairs. A periodic axis has an image of each step on either side.
    """
    periods = list(periods or [None] * len(cols))
    points = df.select(pid, step, *[F.col(c) if p is None else F.pmod(F.col(c), F.lit(float(p))).alias(c) for c, p in zip(cols, periods)])
    images, copies = points, 1
    for c, p in zip(cols, periods):
        if p is not None:
            images = images.withColumn(c, F.explode(F.array(F.col(c) - F.lit(float(p)), F.col(c), F.col(c) + F.lit(float(p)))))
            copies *= 3
    near = knn_join(points, images, 1, list(cols), step, same=copies, keys=(pid,))
    pair = near.groupBy(pid).agg(F.min(F.struct("distance", F.least("a_id", "b_id").alias("i"), F.greatest("a_id", "b_id").alias("j"))).alias("p")).select(pid, "p.*")
    x = lambda k: df.select(pid, F.col(step).alias(k), F.col(cols[0]).alias(f"x_{k}"))
    best = pair.join(x("i"), [pid, "i"]).join(x("j"), [pid, "j"])
    best = best.select(pid, F.struct(F.col("distance").alias("d"), "i", "j", (F.col("x_j") - F.col("x_i")).alias("dx")).alias("m"))
    return best.select(pid, F.col("m.i").alias("i"), F.col("m.j").alias("j"), F.col("m.d").alias("distance"), F.when(F.col("m.dx") != 0, (F.col("m.j") - F.col("m.i")) * F.lit(float(width)) / F.col("m.dx")).alias("q"))


def safety_factor(df: DataFrame, width: float, cols: list[str] = ("x", "y"), periods: list | None = None, pid: str = "pid", step: str = "step") -> DataFrame:
    """The weighted mean of q_i = i * width / (x_i - x_0), weights min|d| / |d_i| by the distance to the first point.

    Negative means become 0; NULL for trajectories of one step.
    """
    w = _w(pid, step).rowsBetween(Window.unboundedPreceding, 0)
    first = [F.first(c).over(w) for c in cols]
    d = periodic_distance(first, [F.col(c) for c in cols], periods or [None] * len(cols))
    rows = df.select(pid, (F.row_number().over(_w(pid, step)) - 1).alias("i"), (F.col(cols[0]) - first[0]).alias("dx"), d.alias("d"))
    rows = rows.filter("i > 0 AND dx <> 0 AND d > 0")
    rows = rows.withColumn("wt", F.min("d").over(Window.partitionBy(pid)) / F.col("d"))
    q = rows.groupBy(pid).agg((F.sum(F.col("wt") * F.col("i") * F.lit(float(width)) / F.col("dx")) / F.sum("wt")).alias("q"))
    return df.select(pid).distinct().join(q, pid, "left").withColumn("q", F.when(F.col("q").isNotNull(), F.greatest("q", F.lit(0.0))))


def period_at_min_recurrence(df: DataFrame, p: int, cols: list[str] = ("x", "y"), pid: str = "pid", step: str = "step") -> DataFrame:
    """p / |x_{i+p} - x_i| at the point that recurs best: least mean of its forward and backward lag-p distances."""
    w, none = _w(pid, step), [None] * len(cols)
    ahead = periodic_distance([F.col(c) for c in cols], [F.lead(c, p).over(w) for c in cols], none)
    back = periodic_distance([F.lag(c, p).over(w) for c in cols], [F.col(c) for c in cols], none)
    dx = F.abs(F.coalesce(F.lead(cols[0], p).over(w) - F.col(cols[0]), F.col(cols[0]) - F.lag(cols[0], p).over(w)))
    rows = df.select(pid, F.col(step).alias("i"), ((F.coalesce(ahead, back) + F.coalesce(back, ahead)) / 2).alias("d"), dx.alias("dx")).filter("d IS NOT NULL AND dx > 0")
    best = rows.groupBy(pid).agg(F.min(F.struct("d", "i", "dx")).alias("m"))
    return best.select(pid, F.col("m.i").alias("i"), F.col("m.d").alias("recurrence"), (F.lit(float(p)) / F.col("m.dx")).alias("q"))


def p_map_vector(df: DataFrame, p: int, cols: list[str] = ("x", "y"), err: str | None = None, pid: str = "pid", step: str = "step") -> DataFrame:
    """The p-map's displacement at every step: half of x_{i+p} - x_{i-p}, one-sided at the ends, else NULL; and the summed error bars."""
    w = _w(pid, step)
    out = {}
    for c in [*cols]:
        a, b = F.lead(c, p).over(w), F.lag(c, p).over(w)
        out[f"v_{c}"] = F.when(a.isNotNull() & b.isNotNull(), (a - b) / 2).otherwise(F.coalesce(a - F.col(c), F.col(c) - b))
    if err:
        out["v_err"] = F.col(err) + F.coalesce(F.lead(err, p).over(w), F.lag(err, p).over(w))
    return df.withColumns(out)


def flow_map(df: DataFrame, t0: float, dt: float, cols: list[str] = ("x", "y"), pid: str = "pid", t: str = "t") -> DataFrame:
    """One row per particle seen at t0: its position at t0, t0 + dt and t0 - dt (NULL where it wasn't seen)."""
    at = {"": t0, "_after": t0 + dt, "_before": t0 - dt}
    rows = df.filter(F.col(t).isin([float(v) for v in at.values()]))
    out = rows.groupBy(pid).agg(*[F.max(F.when(F.col(t) == float(v), F.col(c))).alias(f"{c}{k}") for k, v in at.items() for c in cols])
    return out.filter(F.col(cols[0]).isNotNull())


def region_time_average(df: DataFrame, value: str, t: str, region: Column | None = None) -> DataFrame:
    """Per time step, the mean of the value over the region's samples and their number."""
    rows = df if region is None else df.filter(region)
    return rows.groupBy(t).agg(F.avg(value).alias("mean_value"), F.count(value).alias("samples"))


def multi_region_time_average(df: DataFrame, regions: DataFrame, value: str, t: str, axis: str, width: float) -> DataFrame:
    """region_time_average() of many (region, low, high) ranges of an axis that may overlap: an equi-join on buckets of `width`."""
    b = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("long")
    r = regions.withColumn("__b", F.explode(F.sequence(b("low"), b("high"))))
    rows = df.withColumn("__b", b(axis)).join(r, "__b").filter(F.col(axis).between(F.col("low"), F.col("high")))
    return rows.groupBy("region", t).agg(F.avg(value).alias("mean_value"), F.count(value).alias("samples"))


def accumulated_deviation(df: DataFrame, value: str, t: str = "t", step: str = "step", pid: str = "pid", means: DataFrame | None = None, rule: str = "trapezoid", key: str | None = None) -> DataFrame:
    """`df` with deviation (|value - mean of its step|) and accumulated (its running time integral by trajectory).

    `means` has (key, mean_value), by default of every step; `rule` is trapezoid or rectangle (right ends).
    """
    key = key or step
    means = region_time_average(df, value, key) if means is None else means
    rows = df.join(means.select(key, "mean_value"), key).withColumn("deviation", F.abs(F.col(value) - F.col("mean_value")))
    w = _w(pid, step)
    dt, before = F.col(t) - F.lag(t).over(w), F.lag("deviation").over(w)
    area = dt * ((F.col("deviation") + before) / 2 if rule == "trapezoid" else F.col("deviation"))
    return rows.withColumn("__area", F.coalesce(area, F.lit(0.0))).withColumn("accumulated", F.sum("__area").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__area")


def multi_window_deviation(df: DataFrame, regions: DataFrame, value: str, axis: str, width: float, t: str = "t", step: str = "step", pid: str = "pid") -> DataFrame:
    """Total accumulated deviation by (region, pid): a particle belongs to the regions it starts in, each with its own mean."""
    b = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("long")
    start = df.groupBy(pid).agg(F.min_by(axis, step).alias("__a"))
    r = regions.withColumn("__b", F.explode(F.sequence(b("low"), b("high"))))
    member = start.withColumn("__b", b("__a")).join(r, "__b").filter(F.col("__a").between(F.col("low"), F.col("high"))).select(pid, "region")
    rows = df.join(member, pid)
    means = rows.groupBy("region", step).agg(F.avg(value).alias("mean_value"))
    rows = rows.join(means, ["region", step]).withColumn("deviation", F.abs(F.col(value) - F.col("mean_value")))
    w = Window.partitionBy("region", pid).orderBy(step)
    area = (F.col(t) - F.lag(t).over(w)) * (F.col("deviation") + F.lag("deviation").over(w)) / 2
    return rows.withColumn("__area", area).groupBy("region", pid).agg(F.coalesce(F.sum("__area"), F.lit(0.0)).alias("accumulated"))


def collapse_repeats(df: DataFrame, state: str, pid: str = "pid", step: str = "step") -> DataFrame:
    """Rows whose state differs from the one before in the trajectory."""
    before = F.lag(state).over(_w(pid, step))
    first = F.row_number().over(_w(pid, step)) == 1
    return df.withColumn("__new", first | ~F.col(state).eqNullSafe(before)).filter("__new").drop("__new")


def visit_frequency(df: DataFrame, cell: str, label: DataFrame, pid: str = "pid", step: str = "step") -> DataFrame:
    """Per label: visits (consecutive repeats of a cell count once) over its size and the number of paths. `label` has (cell, label, size)."""
    paths = df.select(pid).distinct().count()
    visits = collapse_repeats(df, cell, pid, step).join(label, cell).groupBy("label").agg(F.count(F.lit(1)).alias("visits"), F.first("size").alias("size"))
    return visits.withColumn("frequency", F.col("visits") / F.col("size") / F.lit(float(max(1, paths))))


def _orbit_radius(df: DataFrame, k: int, cols: list[str], pid: str) -> float:
    """A first radius for the neighbours within an orbit: about 2k points of an orbit that fills the box of all."""
    box = df.agg(F.count(F.lit(1)) / F.approx_count_distinct(pid), *[F.max(c) - F.min(c) for c in cols]).first()
    sides = [float(s) for s in box[1:] if s]
    return (2.0 * k * math.prod(sides) / box[0]) ** (1 / len(sides)) / 2 if sides else 1.0


def _short_and_long(df: DataFrame, pid: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of orbits of at most ORBIT points, and those of the others, None if there are none."""
    long = materialise(df.groupBy(pid).count().filter(F.col("count") > ORBIT).select(pid), "long-orbits")
    if long.isEmpty():
        return df, None
    long = if_small(long)
    return df.join(long, pid, "left_anti"), df.join(long, pid, "left_semi")


def _orbits(df: DataFrame, pid: str, step: str, x: str, y: str, out: str) -> DataFrame:
    """(pid, out): each orbit's points with coordinates as an array of (s, x, y)."""
    known = df.filter(F.col(pid).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    point = F.struct(F.col(step).alias("s"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return known.groupBy(pid).agg(F.collect_list(point).alias(out))


def _nearest_within(p: Column, pts: Column, k: int, ok: Callable[[Column, Column, Column], Column]) -> Column:
    """The k nearest of `pts` to p, ties by step, as (d, s, dx, dy), of those for which ok(d, dx, dy) and that aren't p itself."""
    to = lambda q: F.struct(F.sqrt((q["x"] - p["x"]) ** 2 + (q["y"] - p["y"]) ** 2).alias("d"), q["s"].alias("s"), (q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy"))
    near = F.filter(F.transform(pts, to), lambda n: (n["s"] != p["s"]) & ok(n["d"], n["dx"], n["dy"]))
    return F.array_compact(F.array(F.array_min(near))) if k == 1 else F.slice(F.array_sort(near), 1, k)


def _tangents_within(df: DataFrame, k: int, cols: list[str], pid: str, step: str) -> DataFrame:
    """orbit_tangent()'s sums (pid, i, xx, xy, yy) of orbits of at most ORBIT points, each in one row."""
    near = lambda p: F.struct(p["s"].alias("i"), _nearest_within(p, F.col("__pts"), k, lambda d, dx, dy: d > 0).alias("near"))
    rows = _orbits(df, pid, step, *cols, "__pts").select(pid, F.explode(F.transform("__pts", near)).alias("__n")).select(pid, "__n.i", "__n.near").filter(F.size("near") > 0)
    total = lambda u, v: F.aggregate("near", F.lit(0.0), lambda acc, n: acc + n[u] * n[v] / (n["d"] * n["d"]))
    return rows.select(pid, "i", total("dx", "dx").alias("xx"), total("dx", "dy").alias("xy"), total("dy", "dy").alias("yy"))


def _nearest_sides_within(df: DataFrame, tangents: DataFrame, cols: list[str], max_dist: float, pid: str, step: str) -> DataFrame:
    """(pid, i, j): the nearest point j on either side of i's tangent, of orbits of at most ORBIT points, each in one row."""
    own = tangents.groupBy(pid).agg(F.map_from_entries(F.collect_list(F.struct(F.col(step), F.struct("tx", "ty")))).alias("__t"))
    rows = _orbits(df, pid, step, *cols, "__pts").join(own, pid)

    def links(p: Column) -> Column:
        along = lambda dx, dy: dx * p["t"]["tx"] + dy * p["t"]["ty"]
        sides = [_nearest_within(p, F.col("__pts"), 1, lambda d, dx, dy, side=side: side(along(dx, dy)) & (d <= F.lit(float(max_dist)))) for side in (lambda a: a > 0, lambda a: a <= 0)]
        return F.transform(F.concat(*sides), lambda n: F.struct(p["s"].alias("i"), n["s"].alias("j")))

    turned = F.transform("__pts", lambda p: F.struct(p["s"].alias("s"), p["x"].alias("x"), p["y"].alias("y"), F.col("__t")[p["s"]].alias("t")))
    return rows.select(pid, F.explode(F.flatten(F.transform(turned, links))).alias("__l")).select(pid, "__l.i", "__l.j")


def _tangents_by_bins(df: DataFrame, k: int, cols: list[str], pid: str, step: str) -> DataFrame:
    """_tangents_within() of orbits of any length, by a neighbour join."""
    x, y = cols
    p = materialise(df, "long-orbits")
    near = knn_join(p, p, k, list(cols), step, radius=_orbit_radius(p, k, cols, pid), keys=(pid,), where=F.col("distance") > 0)
    at = lambda i, s: p.select(pid, F.col(step).alias(i), F.col(x).alias(f"{s}x"), F.col(y).alias(f"{s}y"))
    near = near.select(pid, F.col("a_id").alias("i"), F.col("b_id").alias("j"), F.col("distance").alias("d")).join(at("i", "a"), [pid, "i"]).join(at("j", "b"), [pid, "j"])
    near = near.withColumns({"dx": F.col("bx") - F.col("ax"), "dy": F.col("by") - F.col("ay")})
    return near.groupBy(pid, "i").agg(F.sum(F.col("dx") * F.col("dx") / (F.col("d") * F.col("d"))).alias("xx"), F.sum(F.col("dx") * F.col("dy") / (F.col("d") * F.col("d"))).alias("xy"), F.sum(F.col("dy") * F.col("dy") / (F.col("d") * F.col("d"))).alias("yy"))


def orbit_tangent(df: DataFrame, k: int, cols: list[str] = ("x", "y"), pid: str = "pid", step: str = "step") -> DataFrame:
    """Per step, the principal direction of the unit displacements to its k nearest points of the same orbit; points at its own place don't count."""
    short, long = _short_and_long(df.select(pid, step, *cols), pid)
    m = _tangents_within(short, k, cols, pid, step)
    if long is not None:
        m = m.unionByName(_tangents_by_bins(long, k, cols, pid, step))
    e = sym_eig2("xx", "xy", "yy")
    return m.select(pid, F.col("i").alias(step), e[2].alias("tx"), e[3].alias("ty"), e[0].alias("strength"))


def _nearest_sides_by_bins(df: DataFrame, tangents: DataFrame, cols: list[str], max_dist: float, pid: str, step: str) -> DataFrame:
    """_nearest_sides_within() of orbits of any length, by neighbour joins."""
    x, y = cols
    p = materialise(df.join(tangents.select(pid, step, "tx", "ty"), [pid, step]).select(pid, step, x, y, "tx", "ty"), "tangents")
    others = materialise(df, "long-orbits")
    along = (F.col(f"b_{x}") - F.col(f"a_{x}")) * F.col("a_tx") + (F.col(f"b_{y}") - F.col(f"a_{y}")) * F.col("a_ty")
    best = None
    for side in (along > 0, along <= 0):
        where = side & (F.col("distance") <= F.lit(float(max_dist)))
        if math.isinf(max_dist):
            near = knn_join(p, others, 1, list(cols), step, same=True, radius=_orbit_radius(others, 1, cols, pid), keys=(pid,), where=where, carry=("tx", "ty"))
        else:
            near = radius_join(p, others, max_dist, list(cols), step, keys=(pid,), where=where & (F.col("a_id") != F.col("b_id")), carry=("tx", "ty"))
        near = near.groupBy(pid, F.col("a_id").alias("i")).agg(F.min(F.struct("distance", "b_id"))["b_id"].alias("j"))
        best = near if best is None else best.unionByName(near)
    return best


def curve_links(df: DataFrame, tangents: DataFrame, cols: list[str] = ("x", "y"), max_dist: float = float("inf"), pid: str = "pid", step: str = "step") -> DataFrame:
    """Mutual links (pid, i, j), i < j, of points that are each other's nearest on one side along the tangent: at most two per point."""
    short, long = _short_and_long(df.select(pid, step, *cols), pid)
    best = _nearest_sides_within(short, tangents, cols, max_dist, pid, step)
    if long is not None:
        best = best.unionByName(_nearest_sides_by_bins(long, tangents, cols, max_dist, pid, step))
    # A link is mutual if it was found from both of its ends; an orbit's rows are in one partition already.
    ends = best.groupBy(pid, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max(F.col("i") < F.col("j")).alias("up"), F.max(F.col("i") > F.col("j")).alias("down"))
    return ends.filter("up AND down").select(pid, "i", "j")


def _chains_of_orbits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each orbit's links (arrays i and j) the linked points s and the smallest point c that each is linked with."""

    def chains(i: list, j: list) -> tuple[list, list]:
        low: dict = {}

        def root(p):
            while low.setdefault(p, p) != p:
                low[p] = p = low[low[p]]
            return p

        for a, b in zip(i, j):
            a, b = root(a), root(b)
            low[max(a, b)] = min(a, b)
        return list(low), [root(p) for p in low]

    for b in batches:
        pid = next(c for c in b.columns if c not in ("i", "j"))
        found = [chains(i.tolist(), j.tolist()) for i, j in zip(b["i"], b["j"])]
        yield pd.DataFrame({pid: b[pid], "s": [s for s, _ in found], "c": [c for _, c in found]})


def link_chains(df: DataFrame, links: DataFrame, pid: str = "pid", step: str = "step") -> DataFrame:
    """(pid, step, chain) of all points: `chain` is the smallest step of those that curve_links()' links connect; a point without links is its own."""
    short, long = _short_and_long(links.select(pid, "i", "j"), pid)
    edges = short.groupBy(pid).agg(F.collect_list("i").alias("i"), F.collect_list("j").alias("j"))
    schema = StructType([edges.schema[pid], StructField("s", edges.schema["i"].dataType), StructField("c", edges.schema["i"].dataType)])
    cc = edges.mapInPandas(_chains_of_orbits, schema).select(F.explode(F.arrays_zip("s", "c")).alias("__c"), pid).select(pid, F.col("__c.s").alias(step), F.col("__c.c").alias("chain"))
    if long is not None:
        end = lambda c: F.struct(F.col(pid).alias("p"), F.col(c).alias("s"))
        far = connected_components(long.select(end("i").alias("src"), end("j").alias("dst")))
        cc = cc.unionByName(far.select(F.col("id.p").alias(pid), F.col("id.s").alias(step), F.col("component.s").alias("chain")))
    return df.select(pid, step).join(cc, [pid, step], "left").withColumn("chain", F.coalesce("chain", F.col(step)))


def stop_at_exit(df: DataFrame, inside: Column, pid: str = "pid", step: str = "step", most: int | None = None) -> DataFrame:
    """Each trajectory up to the step before it first leaves the domain, and of at most `most` steps."""
    out = F.max((~F.coalesce(inside, F.lit(False))).cast("int")).over(_w(pid, step).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumns({"__out": out, "__n": F.row_number().over(_w(pid, step))}).filter("__out = 0")
    return (rows.filter(F.col("__n") <= most) if most else rows).drop("__out", "__n")


def thin_polyline(df: DataFrame, spacing: float, min_size: int, cols: list[str] = ("x", "y"), curve: str = "pid", seq: str = "step", keep: Column | None = None) -> DataFrame:
    """Points farther than `spacing` from the last kept one; a curve's first and last stay; curves of fewer than min_size points go.

    A curve is folded in order as one array; curves are of bounded length. `keep` drops points beforehand.
    """
    rows = df if keep is None else df.filter(keep)
    pts = rows.groupBy(curve).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), *[F.col(c).cast("double").alias(c) for c in cols]))).alias("pts"))
    far = lambda p, q: F.sqrt(sum((p[c] - q[c]) ** 2 for c in cols)) > F.lit(float(spacing))
    last = lambda a: F.element_at(a, -1)
    fold = F.aggregate(F.slice("pts", F.lit(2), F.size("pts")), F.slice("pts", F.lit(1), F.lit(1)), lambda acc, p: F.when(far(last(acc), p), F.concat(acc, F.array(p))).otherwise(acc))
    pts = pts.withColumn("kept", fold)
    kept = F.when(last(F.col("kept"))["s"] == last(F.col("pts"))["s"], F.col("kept")).otherwise(F.concat("kept", F.slice("pts", F.size("pts"), F.lit(1))))
    pts = pts.select(curve, kept.alias("kept")).filter(F.size("kept") >= min_size)
    return pts.select(curve, F.explode("kept").alias("p")).select(curve, F.col("p.s").alias(seq), *[F.col(f"p.{c}").alias(c) for c in cols])


def split_runs(df: DataFrame, passes: Column, min_size: int, curve: str = "pid", seq: str = "step") -> DataFrame:
    """(curve, run, first, last, n): maximal runs of consecutive passing points within a curve, of at least min_size points."""
    ok = F.coalesce(passes, F.lit(False))
    rows = df.select(curve, seq, ok.alias("ok")).withColumn("__cut", F.sum((~F.col("ok")).cast("long")).over(_w(curve, seq).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("ok").groupBy(curve, F.col("__cut").alias("run")).agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)


def turn_angles(df: DataFrame, cols: list[str] = ("x", "y"), pid: str = "pid", step: str = "step") -> DataFrame:
    """`df` with angle: the signed turn at each step, from the two steps before it; NULL for the first two."""
    w = _w(pid, step)
    x, y = cols
    return df.withColumn("angle", turn_angle(F.lag(x, 2).over(w), F.lag(y, 2).over(w), F.lag(x, 1).over(w), F.lag(y, 1).over(w), F.col(x), F.col(y)))


def orbit_order(df: DataFrame, pid: str = "pid", step: str = "step") -> DataFrame:
    """`df` with order: the place along the trajectory, from 0 to 1; 0 for a single point."""
    n = F.count(F.lit(1)).over(Window.partitionBy(pid))
    return df.withColumn("order", F.when(n > 1, (F.row_number().over(_w(pid, step)) - 1) / (n - 1)).otherwise(F.lit(0.0)))
