"""Queries on trajectories and gridded fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grid as R
from ..operators import orbits as O
from . import adapters as A
from .adapters import rd, sq, with_views
from .registry import query


def _lags(p: int) -> str:
    return f"l{p} AS (SELECT pid, step, sqrt((lead(x, {p}) OVER w - x)^2 + (lead(y, {p}) OVER w - y)^2) AS d FROM trajectories WINDOW w AS (PARTITION BY pid ORDER BY step))"


@query(with_views(f"+{_lags(5)} SELECT pid, {sq('avg(d)')} AS mean_distance FROM l5 GROUP BY pid", "trajectories"))
def average_distance(spark, sf):
    return O.average_distance(A.trajectories(spark, sf), 5).withColumn("mean_distance", rd("mean_distance"))


@query(with_views(f"+{_lags(3)}, r AS (SELECT pid, d, row_number() OVER (PARTITION BY pid ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY pid) AS n FROM l3 WHERE d IS NOT NULL) SELECT pid, {sq('avg(d)')} AS mean_distance, {sq('max(CASE WHEN k = n // 2 THEN d END)')} AS median_distance FROM r GROUP BY pid", "trajectories"))
def distance_profile(spark, sf):
    return O.distance_profile(A.trajectories(spark, sf), 3).select("pid", rd("mean_distance").alias("mean_distance"), rd("median_distance").alias("median_distance"))


@query(with_views(f"+{_lags(2)}, {_lags(3)}, v AS (SELECT a.pid, sum(CASE WHEN a.d < b.d THEN 1 ELSE 0 END)::BIGINT AS wins0, sum(CASE WHEN b.d < a.d THEN 1 ELSE 0 END)::BIGINT AS wins1 FROM l2 a JOIN l3 b ON a.pid = b.pid AND a.step = b.step AND a.d IS NOT NULL AND b.d IS NOT NULL GROUP BY 1), m AS (SELECT pid, max(CASE WHEN k = n // 2 THEN d END) AS m0 FROM (SELECT pid, d, row_number() OVER (PARTITION BY pid ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY pid) AS n FROM l2 WHERE d IS NOT NULL) GROUP BY 1), o AS (SELECT pid, max(CASE WHEN k = n // 2 THEN d END) AS m1 FROM (SELECT pid, d, row_number() OVER (PARTITION BY pid ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY pid) AS n FROM l3 WHERE d IS NOT NULL) GROUP BY 1) SELECT v.pid, wins0, wins1, CASE WHEN wins1 > wins0 OR (wins1 = wins0 AND m1 < m0) THEN 3::BIGINT ELSE 2::BIGINT END AS better FROM v JOIN m ON v.pid = m.pid JOIN o ON v.pid = o.pid", "trajectories"))
def compare_profiles(spark, sf):
    return O.compare_profiles(A.trajectories(spark, sf), 2, 3).select("pid", "wins0", "wins1", "better")


@query(with_views("+a AS (SELECT s.pid, p, avg(sqrt((t.x-s.x)^2 + (t.y-s.y)^2)) AS d FROM trajectories s, (SELECT unnest(range(1, 9)) AS p) JOIN trajectories t ON t.pid = s.pid AND t.step = s.step + p GROUP BY 1, 2) SELECT pid, arg_min(p, row(d, p)) AS best_period, " + sq("min(d)") + " AS mean_distance FROM a GROUP BY 1", "trajectories"))
def best_period(spark, sf):
    return O.best_period(A.trajectories(spark, sf), 8).withColumn("mean_distance", rd("mean_distance"))


@query(with_views("+a AS (SELECT s.pid, s.step AS i, t.step AS j, sqrt((t.x-s.x)^2 + (t.y-s.y)^2) AS d, t.x - s.x AS dx FROM trajectories s JOIN trajectories t ON t.pid = s.pid AND s.step < t.step), b AS (SELECT pid, arg_min(row(i, j, d, dx), row(d, i, j)) AS m FROM a GROUP BY 1) SELECT pid, m[1] AS i, m[2] AS j, " + sq("m[3]") + " AS distance, " + sq("CASE WHEN m[4] <> 0 THEN (m[2]-m[1])*100/m[4] END") + " AS q FROM b", "trajectories"))
def period_from_closest_pair(spark, sf):
    return O.period_from_closest_pair(A.trajectories(spark, sf), 100.0).select("pid", "i", "j", rd("distance").alias("distance"), rd("q").alias("q"))


@query(with_views("+f AS (SELECT pid, step AS i, x - first_value(x) OVER w AS dx, sqrt((x - first_value(x) OVER w)^2 + (y - first_value(y) OVER w)^2) AS d FROM trajectories WINDOW w AS (PARTITION BY pid ORDER BY step)), g AS (SELECT *, min(d) OVER (PARTITION BY pid) / d AS wt FROM f WHERE i > 0 AND dx <> 0 AND d > 0) SELECT pid, " + sq("greatest(0.0, sum(wt*i*100/dx)/sum(wt))", 5) + " AS q FROM g GROUP BY 1", "trajectories"))
def safety_factor(spark, sf):
    return O.safety_factor(A.trajectories(spark, sf), 100.0).withColumn("q", rd("q", 5))


@query(with_views("+f AS (SELECT pid, step AS i, sqrt((lead(x, 4) OVER w - x)^2 + (lead(y, 4) OVER w - y)^2) AS a, sqrt((x - lag(x, 4) OVER w)^2 + (y - lag(y, 4) OVER w)^2) AS b, abs(coalesce(lead(x, 4) OVER w - x, x - lag(x, 4) OVER w)) AS dx FROM trajectories WINDOW w AS (PARTITION BY pid ORDER BY step)), g AS (SELECT pid, i, (coalesce(a, b) + coalesce(b, a))/2 AS d, dx FROM f), h AS (SELECT pid, arg_min(row(i, d, dx), row(d, i)) AS m FROM g WHERE d IS NOT NULL AND dx > 0 GROUP BY 1) SELECT pid, m[1] AS i, " + sq("m[2]") + " AS recurrence, " + sq("4.0::DOUBLE / m[3]", 6) + " AS q FROM h", "trajectories"))
def period_at_min_recurrence(spark, sf):
    return O.period_at_min_recurrence(A.trajectories(spark, sf), 4).select("pid", "i", rd("recurrence").alias("recurrence"), rd("q", 6).alias("q"))


@query(with_views("SELECT pid, step, " + sq("coalesce((lead(x, 3) OVER w - lag(x, 3) OVER w)/2, lead(x, 3) OVER w - x, x - lag(x, 3) OVER w)") + " AS v_x, " + sq("coalesce((lead(y, 3) OVER w - lag(y, 3) OVER w)/2, lead(y, 3) OVER w - y, y - lag(y, 3) OVER w)") + " AS v_y, " + sq("y*0.01 + coalesce(lead(y*0.01, 3) OVER w, lag(y*0.01, 3) OVER w)", 6) + " AS v_err FROM trajectories WINDOW w AS (PARTITION BY pid ORDER BY step)", "trajectories"))
def p_map_vector(spark, sf):
    df = O.p_map_vector(A.trajectories(spark, sf).withColumn("err", F.col("y") * 0.01), 3, err="err")
    return df.select("pid", "step", rd("v_x").alias("v_x"), rd("v_y").alias("v_y"), rd("v_err", 6).alias("v_err"))


@query(with_views("SELECT a.pid, a.x, a.y, b.x AS x_after, b.y AS y_after, c.x AS x_before, c.y AS y_before FROM trajectories a LEFT JOIN trajectories b ON a.pid = b.pid AND b.step = 14 LEFT JOIN trajectories c ON a.pid = c.pid AND c.step = 6 WHERE a.step = 10", "trajectories"))
def flow_map(spark, sf):
    return O.flow_map(A.trajectories(spark, sf).withColumn("s", F.col("step").cast("double")), 10, 4, t="s")


@query(with_views("SELECT step, " + sq("avg(y)") + " AS mean_value, count(y) AS samples FROM trajectories WHERE x BETWEEN 100 AND 2500 GROUP BY 1", "trajectories"))
def region_time_average(spark, sf):
    return O.region_time_average(A.trajectories(spark, sf), "y", "step", F.col("x").between(100, 2500)).withColumn("mean_value", rd("mean_value"))


def _regions(spark):
    return spark.range(8).select(F.col("id").alias("region"), (F.col("id") * 150.0).alias("low"), (F.col("id") * 150.0 + 400).alias("high"))


_REG = "r AS (SELECT unnest(range(0, 8)) AS region)"


@query(with_views(f"+{_REG} SELECT region, step, {sq('avg(y)')} AS mean_value, count(y) AS samples FROM r JOIN trajectories ON x BETWEEN region*150.0 AND region*150.0+400 GROUP BY 1, 2", "trajectories"))
def multi_region_time_average(spark, sf):
    df = O.multi_region_time_average(A.trajectories(spark, sf), _regions(spark), "y", "step", "x", 100.0)
    return df.withColumn("mean_value", rd("mean_value"))


@query(with_views("+m AS (SELECT step, avg(y) AS m FROM trajectories GROUP BY 1), d AS (SELECT pid, t.step, t, abs(y - m) AS dev FROM trajectories t JOIN m ON t.step = m.step), a AS (SELECT *, coalesce((t - lag(t) OVER w) * (dev + lag(dev) OVER w)/2, 0) AS area FROM d WINDOW w AS (PARTITION BY pid ORDER BY step)) SELECT pid, step, " + sq("dev") + " AS deviation, " + sq("sum(area) OVER (PARTITION BY pid ORDER BY step ROWS UNBOUNDED PRECEDING)", 1) + " AS accumulated FROM a", "trajectories"))
def accumulated_deviation(spark, sf):
    df = O.accumulated_deviation(A.trajectories(spark, sf), "y")
    return df.select("pid", "step", rd("deviation").alias("deviation"), rd("accumulated", 1).alias("accumulated"))


@query(with_views(f"+{_REG}, s AS (SELECT pid, region FROM trajectories JOIN r ON step = 0 AND y BETWEEN region*20.0 AND region*20.0+60), j AS (SELECT s.region, t.* FROM trajectories t JOIN s ON t.pid = s.pid), m AS (SELECT region, step, avg(y) AS m FROM j GROUP BY 1, 2), d AS (SELECT j.region, pid, j.step, t, abs(y - m) AS dev FROM j JOIN m ON j.region = m.region AND j.step = m.step), a AS (SELECT *, (t - lag(t) OVER w) * (dev + lag(dev) OVER w)/2 AS area FROM d WINDOW w AS (PARTITION BY region, pid ORDER BY step)) SELECT region, pid, {sq('coalesce(sum(area), 0)', 1)} AS accumulated FROM a GROUP BY 1, 2", "trajectories"))
def multi_window_deviation(spark, sf):
    regions = spark.range(8).select(F.col("id").alias("region"), (F.col("id") * 20.0).alias("low"), (F.col("id") * 20.0 + 60).alias("high"))
    return O.multi_window_deviation(A.trajectories(spark, sf), regions, "y", "y", 20.0).withColumn("accumulated", rd("accumulated", 1))


@query(with_views("SELECT pid, step, tag FROM (SELECT *, lag(tag) OVER (PARTITION BY pid ORDER BY step) AS before FROM trajectories) WHERE before IS DISTINCT FROM tag", "trajectories"))
def collapse_repeats(spark, sf):
    return O.collapse_repeats(A.trajectories(spark, sf), "tag").select("pid", "step", "tag")


@query(with_views("+c AS (SELECT tag AS label, count(*) AS size FROM trajectories GROUP BY 1), k AS (SELECT tag AS label, count(*) AS visits FROM (SELECT *, lag(tag) OVER (PARTITION BY pid ORDER BY step) AS before FROM trajectories) WHERE before IS DISTINCT FROM tag GROUP BY 1) SELECT label, visits, size, " + sq("visits / size::DOUBLE / (SELECT count(DISTINCT pid) FROM trajectories)", 8) + " AS frequency FROM k JOIN c USING (label)", "trajectories"))
def visit_frequency(spark, sf):
    t = A.trajectories(spark, sf)
    labels = t.groupBy("tag").agg(F.count(F.lit(1)).alias("size")).withColumn("label", F.col("tag"))
    return O.visit_frequency(t, "tag", labels).withColumn("frequency", rd("frequency", 8))


#: Tangents t by the four nearest points of the orbit that aren't at the same place.
_TANGENT = """t0 AS (
    SELECT a.pid, a.step AS i, b.step AS j, sqrt((b.x-a.x)^2 + (b.y-a.y)^2) AS d, b.x-a.x AS dx, b.y-a.y AS dy
    FROM trajectories a JOIN trajectories b ON a.pid = b.pid AND (a.x <> b.x OR a.y <> b.y)),
  t1 AS (SELECT * FROM t0 QUALIFY row_number() OVER (PARTITION BY pid, i ORDER BY d, j) <= 4),
  t2 AS (SELECT pid, i, sum(dx*dx/(d*d)) AS xx, sum(dx*dy/(d*d)) AS xy, sum(dy*dy/(d*d)) AS yy FROM t1 GROUP BY 1, 2),
  t AS (
    SELECT pid, i AS step, cos(atan2(xy, (xx-yy)/2)/2) AS tx, sin(atan2(xy, (xx-yy)/2)/2) AS ty, (xx+yy)/2 + sqrt(((xx-yy)/2)^2 + xy*xy) AS strength FROM t2)"""
#: Mutual links l of nearest points on a side of the tangent.
_LINKS = _TANGENT + """,
  l0 AS (
    SELECT a.pid, a.step AS i, b.step AS j, sqrt((b.x-a.x)^2 + (b.y-a.y)^2) AS d, (b.x-a.x)*tx + (b.y-a.y)*ty > 0 AS side
    FROM trajectories a JOIN t ON t.pid = a.pid AND t.step = a.step JOIN trajectories b ON a.pid = b.pid AND a.step <> b.step),
  l1 AS (SELECT DISTINCT pid, i, j FROM (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY pid, i, side ORDER BY d, j) = 1)),
  l AS (SELECT a.pid, a.i, a.j FROM l1 a JOIN l1 b ON a.pid = b.pid AND a.i = b.j AND a.j = b.i WHERE a.i < a.j)"""


@query(with_views(f"+{_TANGENT} SELECT pid, step, {sq('abs(tx)', 5)} AS tx, {sq('strength', 5)} AS strength FROM t", "trajectories"))
def orbit_tangent(spark, sf):
    df = O.orbit_tangent(A.trajectories(spark, sf), 4)
    return df.select("pid", "step", rd(F.abs("tx"), 5).alias("tx"), rd("strength", 5).alias("strength"))


@query(with_views(f"+{_LINKS} SELECT pid, i, j FROM l", "trajectories"))
def curve_links(spark, sf):
    t = A.trajectories(spark, sf)
    return O.curve_links(t, O.orbit_tangent(t, 4))


_CONNECTED = f"""+{_LINKS},
  e AS (SELECT pid, i AS a, j AS b FROM l UNION ALL SELECT pid, j, i FROM l),
  r AS (SELECT pid, step, step AS c FROM trajectories UNION SELECT r.pid, e.b, r.c FROM r JOIN e ON e.pid = r.pid AND e.a = r.step AND r.c < e.b)
SELECT pid, step, min(c) AS chain FROM r GROUP BY 1, 2
"""


@query(with_views(_CONNECTED, "trajectories", recursive=True))
def link_chains(spark, sf):
    t = A.trajectories(spark, sf)
    return O.link_chains(t, O.curve_links(t, O.orbit_tangent(t, 4)))


@query(with_views("SELECT pid, step FROM (SELECT pid, step, max(CASE WHEN x <= 1500 THEN 0 ELSE 1 END) OVER (PARTITION BY pid ORDER BY step) AS o, row_number() OVER (PARTITION BY pid ORDER BY step) AS n FROM trajectories) WHERE o = 0 AND n <= 40", "trajectories"))
def stop_at_exit(spark, sf):
    return O.stop_at_exit(A.trajectories(spark, sf), F.col("x") <= 1500, most=40).select("pid", "step")


@query(with_views("+f AS (SELECT pid, min(step) AS step FROM trajectories GROUP BY 1), walk AS (SELECT t.pid, t.step, t.x, t.y FROM trajectories t JOIN f ON t.pid = f.pid AND t.step = f.step UNION ALL SELECT pid, m.step, m.x, m.y FROM (SELECT w.pid, min(row(t.step, t.x, t.y)) AS z FROM walk w JOIN trajectories t ON t.pid = w.pid AND t.step > w.step AND sqrt((t.x-w.x)^2 + (t.y-w.y)^2) > 120 GROUP BY w.pid) q, LATERAL (SELECT z[1] AS step, z[2] AS x, z[3] AS y) m), l AS (SELECT pid, arg_max(row(step, x, y), step) AS z FROM trajectories GROUP BY 1), a AS (SELECT * FROM walk UNION SELECT pid, z[1], z[2], z[3] FROM l) SELECT pid, step, x, y FROM a WHERE pid IN (SELECT pid FROM a GROUP BY 1 HAVING count(*) >= 8)", "trajectories", recursive=True))
def thin_polyline(spark, sf):
    return O.thin_polyline(A.trajectories(spark, sf), 120.0, 8)


@query(with_views("+c AS (SELECT pid, step, y > 30 AS ok, sum(CASE WHEN y > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY pid ORDER BY step ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM trajectories) SELECT pid, run, min(step) AS first, max(step) AS last, count(*) AS n FROM c WHERE ok GROUP BY 1, 2 HAVING count(*) >= 3", "trajectories"))
def split_runs(spark, sf):
    return O.split_runs(A.trajectories(spark, sf), F.col("y") > 30, 3)


@query(with_views("SELECT pid, step, " + sq("CASE WHEN count(*) OVER (PARTITION BY pid) > 1 THEN step / (count(*) OVER (PARTITION BY pid) - 1)::DOUBLE ELSE 0 END", 8) + " AS place FROM trajectories", "trajectories"))
def orbit_order(spark, sf):
    return O.orbit_order(A.trajectories(spark, sf)).select("pid", "step", rd("order", 8).alias("place"))


# Gridded fields.

_DIFF = "CASE WHEN p IS NOT NULL AND m IS NOT NULL THEN (p-m)/2 WHEN p IS NOT NULL THEN p-v WHEN m IS NOT NULL THEN v-m END"


def _grad(v: str = "v", src: str = "grid2d", name: str = "g", extra: str = "") -> str:
    d = lambda a: f"CASE WHEN p{a} IS NOT NULL AND m{a} IS NOT NULL THEN (p{a}-m{a})/2 WHEN p{a} IS NOT NULL THEN p{a}-v WHEN m{a} IS NOT NULL THEN v-m{a} END"
    return f"{name}0 AS (SELECT a.i, a.j{extra}, a.{v} AS v, b.{v} AS pi, c.{v} AS mi, d.{v} AS pj, e.{v} AS mj FROM {src} a LEFT JOIN {src} b ON b.i=a.i+1 AND b.j=a.j LEFT JOIN {src} c ON c.i=a.i-1 AND c.j=a.j LEFT JOIN {src} d ON d.i=a.i AND d.j=a.j+1 LEFT JOIN {src} e ON e.i=a.i AND e.j=a.j-1), {name} AS (SELECT i, j, v, {d('i')} AS gi, {d('j')} AS gj FROM {name}0)"


@query(with_views("+" + _grad() + f" SELECT i, j, {sq('gi', 2)} AS d_v_i, {sq('gj', 2)} AS d_v_j FROM g", "grid2d"))
def grid_gradient(spark, sf):
    g = R.grid_gradient(A.grid2d(spark, sf))
    return g.select("i", "j", rd("d_v_i", 2).alias("d_v_i"), rd("d_v_j", 2).alias("d_v_j"))


_FLOW = "f AS (SELECT i, j, i + v/1000 AS fx, j + (v % 7000)/500 AS fy FROM grid2d)"


def _flow(spark, sf):
    return A.grid2d(spark, sf).select("i", "j", (F.col("i") + F.col("v") / 1000).alias("fx"), (F.col("j") + (F.col("v") % 7000) / 500).alias("fy"))


_C = "c AS (SELECT a.i, a.j, a.gi*a.gi + b.gi*b.gi AS xx, a.gi*a.gj + b.gi*b.gj AS xy, a.gj*a.gj + b.gj*b.gj AS yy FROM a JOIN b ON a.i=b.i AND a.j=b.j)"
_HIGH = "(xx+yy)/2 + sqrt(((xx-yy)/2)^2 + xy*xy)"


@query(with_views(f"+{_FLOW}, {_grad('fx', 'f', 'a')}, {_grad('fy', 'f', 'b')}, {_C} SELECT i, j, {sq(f'CASE WHEN {_HIGH} > 0 THEN ln({_HIGH})/2/3.0 ELSE 0 END', 5)} AS ftle FROM c", "grid2d"))
def ftle_grid(spark, sf):
    return R.ftle_grid(_flow(spark, sf), ["i", "j"], ["fx", "fy"], 3.0).select("i", "j", rd("ftle", 5).alias("ftle"))


_STRETCH = f"CASE WHEN {_HIGH} > 0 THEN ln({_HIGH})/2/3.0 ELSE 0 END"
_BRANCHES = f"""+{_FLOW}, {_grad('fx', 'f', 'a')}, {_grad('fy', 'f', 'b')}, {_C},
  h AS (SELECT i, j, {_STRETCH} AS f, abs(sin(atan2(xy, (xx-yy)/2)/2)) > abs(cos(atan2(xy, (xx-yy)/2)/2)) AS swap FROM c),
  w AS (SELECT i, j, 2*i - fx AS fx, 2*j - fy AS fy FROM f), {_grad('fx', 'w', 'u')}, {_grad('fy', 'w', 'v')},
  d AS (SELECT u.i, u.j, u.gi*u.gi + v.gi*v.gi AS xx, u.gi*u.gj + v.gi*v.gj AS xy, u.gj*u.gj + v.gj*v.gj AS yy FROM u JOIN v ON u.i = v.i AND u.j = v.j),
  k AS (SELECT i, j, {_STRETCH} AS b FROM d)
SELECT h.i, h.j, {sq('CASE WHEN swap THEN b ELSE f END', 5)} AS high, {sq('CASE WHEN swap THEN f ELSE b END', 5)} AS low FROM h JOIN k ON h.i = k.i AND h.j = k.j
"""


@query(with_views(_BRANCHES, "grid2d"))
def eigen_ftle(spark, sf):
    f = _flow(spark, sf)
    back = f.withColumns({"fx": 2 * F.col("i") - F.col("fx"), "fy": 2 * F.col("j") - F.col("fy")})
    df = R.eigen_ftle(f, back, ["i", "j"], ["fx", "fy"], 3.0)
    return df.select("i", "j", rd("high", 5).alias("high"), rd("low", 5).alias("low"))


_HESS = _grad() + ", " + "gx AS (SELECT i, j, gi AS v FROM g), gy AS (SELECT i, j, gj AS v FROM g), " + _grad("v", "gx", "hx") + ", " + _grad("v", "gy", "hy") + ", h AS (SELECT g.i, g.j, g.gi AS gx, g.gj AS gy, hx.gi AS hxx, (hx.gj + hy.gi)/2 AS hxy, hy.gj AS hyy FROM g JOIN hx ON g.i=hx.i AND g.j=hx.j JOIN hy ON g.i=hy.i AND g.j=hy.j)"


@query(with_views(f"+{_HESS} SELECT i, j, {sq('hxx', 2)} AS hxx, {sq('hxy', 2)} AS hxy, {sq('hyy', 2)} AS hyy FROM h", "grid2d"))
def hessian2d(spark, sf):
    h = R.hessian2d(A.grid2d(spark, sf))
    return h.select("i", "j", rd("hxx", 2).alias("hxx"), rd("hxy", 2).alias("hxy"), rd("hyy", 2).alias("hyy"))


@query(with_views(f"+{_HESS}, e AS (SELECT *, (hxx+hyy)/2 - sqrt(((hxx-hyy)/2)^2 + hxy*hxy) AS low, atan2(hxy, (hxx-hyy)/2)/2 AS ang FROM h), s AS (SELECT *, -sin(ang) AS ex, cos(ang) AS ey FROM e) SELECT a.i, a.j, {sq('any_value(a.low)', 2)} AS strength, count(*) AS crossings FROM s a JOIN s b ON abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j) WHERE a.low < -200 AND b.low > a.low AND (a.gx*a.ex + a.gy*a.ey) * (CASE WHEN a.ex*b.ex + a.ey*b.ey < 0 THEN -1 ELSE 1 END) * (b.gx*b.ex + b.gy*b.ey) < 0 GROUP BY 1, 2", "grid2d"))
def ridge_points(spark, sf):
    return R.ridge_points(A.grid2d(spark, sf), -200.0).withColumn("strength", rd("strength", 2))


_VEC = "u AS (SELECT i, j, v - 38000 AS u, (v * 7) % 9000 - 4500 AS w FROM grid2d)"


def _vectors(spark, sf):
    return A.grid2d(spark, sf).select("i", "j", (F.col("v") - 38000).alias("u"), ((F.col("v") * 7) % 9000 - 4500).alias("w"))


_CELL = "c AS (SELECT a.i, a.j, a.u AS u00, a.w AS w00, b.u AS u10, b.w AS w10, d.u AS u01, d.w AS w01, e.u AS u11, e.w AS w11 FROM u a JOIN u b ON b.i=a.i+1 AND b.j=a.j JOIN u d ON d.i=a.i AND d.j=a.j+1 JOIN u e ON e.i=a.i+1 AND e.j=a.j+1)"


def _turn(p: str, q: str) -> str:
    return f"atan2(u{p}*w{q} - w{p}*u{q}, u{p}*u{q} + w{p}*w{q})"


@query(with_views(f"+{_VEC}, {_CELL} SELECT i, j, CAST(round(({_turn('00', '10')} + {_turn('10', '11')} + {_turn('11', '01')} + {_turn('01', '00')}) / (2*pi())) AS BIGINT) AS index FROM c", "grid2d"))
def cell_index(spark, sf):
    return R.cell_index(_vectors(spark, sf))


@query(with_views(f"+{_VEC}, {_CELL}, t AS (SELECT i, j, 0 AS half, u00 AS u0, w00 AS w0, u10-u00 AS a, u01-u00 AS b, w10-w00 AS c, w01-w00 AS d FROM c UNION ALL SELECT i, j, 1, u11, w11, u01-u11, u10-u11, w01-w11, w10-w11 FROM c), z AS (SELECT *, a*d-b*c AS det, (-u0*d + w0*b)/(a*d-b*c) AS s, (-a*w0 + c*u0)/(a*d-b*c) AS r FROM t WHERE a*d-b*c <> 0) SELECT i, j, half::BIGINT AS half, {sq('CASE WHEN half = 0 THEN i + s ELSE i + 1 - s END')} AS x, {sq('CASE WHEN half = 0 THEN j + r ELSE j + 1 - r END')} AS y, CASE WHEN det < 0 THEN 'saddle' ELSE 'other' END AS kind FROM z WHERE s >= 0 AND r >= 0 AND s + r <= 1", "grid2d"))
def critical_points(spark, sf):
    df = R.critical_points(_vectors(spark, sf))
    return df.select("i", "j", "half", rd("x").alias("x"), rd("y").alias("y"), F.when(F.col("kind") == "saddle", "saddle").otherwise("other").alias("kind"))


#: A field that turns from node to node on tables of any size; odd integers, so no node is a zero.
_TURNING = """u AS (
    SELECT CAST(l_quantity AS BIGINT) - 1 AS i, CAST(round(l_discount*100) AS BIGINT) AS j,
      CAST(2*sum(CAST(round(l_tax*100) AS BIGINT) - 4) + 1 AS DOUBLE) AS u, CAST(2*sum(l_partkey % 101 - 50) + 1 AS DOUBLE) AS w
    FROM lineitem GROUP BY 1, 2)"""

_JACOBIAN = """t AS (
    SELECT i, j, 0 AS half, u00 AS u0, w00 AS w0, u10-u00 AS a, u01-u00 AS b, w10-w00 AS c, w01-w00 AS d, 1 AS s FROM c
    UNION ALL SELECT i, j, 1, u11, w11, u01-u11, u10-u11, w01-w11, w10-w11, -1 FROM c),
  h AS (SELECT *, (-u0*d + w0*b)/(a*d-b*c) AS p, (-a*w0 + c*u0)/(a*d-b*c) AS q FROM t WHERE a*d-b*c <> 0),
  z AS (
    SELECT (i*11 + j)*2 + half AS id, CASE WHEN half = 0 THEN i + p ELSE i + 1 - p END AS x, CASE WHEN half = 0 THEN j + q ELSE j + 1 - q END AS y,
      s*a AS xx, s*b AS xy, s*c AS yx, s*d AS yy, s*(a+d) AS tr, a*d-b*c AS det
    FROM h WHERE p >= 0 AND q >= 0 AND p + q <= 1),
  k AS (
    SELECT *, CASE WHEN det < 0 THEN 'saddle' WHEN abs(tr) < 1e-12 THEN 'centre' WHEN tr*tr < 4*det THEN CASE WHEN tr > 0 THEN 'spiral source' ELSE 'spiral sink' END
      WHEN tr > 0 THEN 'source' ELSE 'sink' END AS kind, tr/2 + sqrt(greatest(0, tr*tr/4 - det)) AS l0, tr/2 - sqrt(greatest(0, tr*tr/4 - det)) AS l1 FROM z)"""


def _direction(value: str) -> str:
    """The eigenvector of one eigenvalue, from the row of the matrix that gives the longer one."""
    n0, n1 = f"sqrt(xy*xy + ({value}-xx)*({value}-xx))", f"sqrt(({value}-yy)*({value}-yy) + yx*yx)"
    return f"CASE WHEN {n0} >= {n1} THEN [xy/{n0}, ({value}-xx)/{n0}] ELSE [({value}-yy)/{n1}, yx/{n1}] END"


_SIMILAR = f"""+{_TURNING}, {_CELL}, {_JACOBIAN},
  e AS (SELECT *, CASE WHEN det < 0 THEN {_direction('l0')} END AS e0, CASE WHEN det < 0 THEN {_direction('l1')} END AS e1 FROM k),
  n AS (
    SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id <> b.id AND (a.det < 0) = (b.det < 0) AND sqrt((a.x-b.x)^2 + (a.y-b.y)^2) <= 1.5
    WHERE a.det >= 0 OR (abs(a.e0[1]*b.e0[1] + a.e0[2]*b.e0[2]) >= 0.95 AND abs(a.e1[1]*b.e1[1] + a.e1[2]*b.e1[2]) >= 0.95)),
  r AS (SELECT id, id AS c FROM e UNION SELECT n.b, r.c FROM r JOIN n ON n.a = r.id AND r.c < n.b)
SELECT e.id::BIGINT AS id, kind, min(c)::BIGINT AS kept FROM e JOIN r ON r.id = e.id GROUP BY 1, 2
"""


@query(with_views(_SIMILAR, "grid2d", recursive=True))
def similar_critical_points(spark, sf):
    """Critical points no farther apart than 1.5 cells that are alike: no saddles, or saddles along the same axes."""
    hundred = lambda c: F.round(F.col(c) * 100).cast("long")
    cell = [(F.col("l_quantity") - 1).cast("long").alias("i"), hundred("l_discount").alias("j")]
    odd = lambda c: (2 * F.sum(c) + 1).cast("double")
    v = A.table(spark, sf, "lineitem").groupBy(*cell).agg(odd(hundred("l_tax") - 4).alias("u"), odd(F.col("l_partkey") % 101 - 50).alias("w"))
    z = R.critical_points(v).withColumn("id", (F.col("i") * 11 + F.col("j")) * 2 + F.col("half"))
    return R.similar_critical_points(z, 1.5)


@query(with_views("SELECT a.i, a.j, least(a.v, b.v, c.v, d.v) AS low, greatest(a.v, b.v, c.v, d.v) AS high FROM grid2d a JOIN grid2d b ON b.i=a.i+1 AND b.j=a.j JOIN grid2d c ON c.i=a.i AND c.j=a.j+1 JOIN grid2d d ON d.i=a.i+1 AND d.j=a.j+1 WHERE least(a.v, b.v, c.v, d.v) <= 40000 AND greatest(a.v, b.v, c.v, d.v) >= 40000", "grid2d"))
def value_span_cells(spark, sf):
    return R.value_span_cells(A.grid2d(spark, sf), 40000.0)


@query(with_views(f"+{_HESS} SELECT i, j, CASE WHEN gx = 0 AND gy = 0 THEN CASE WHEN hxx*hyy - hxy*hxy > 0 THEN 'extremum' ELSE 'saddle' END WHEN gy*gy*hxx - 2*gx*gy*hxy + gx*gx*hyy < 0 THEN 'ridge' WHEN gy*gy*hxx - 2*gx*gy*hxy + gx*gx*hyy IS NOT NULL THEN 'valley' END AS kind FROM h", "grid2d"))
def ridge_curvature_test(spark, sf):
    h = R.hessian2d(A.grid2d(spark, sf))
    return h.select("i", "j", R.ridge_curvature_test("gx", "gy", "hxx", "hxy", "hyy").alias("kind"))


def _smooth(n: int, src: str) -> str:
    return f"s{n} AS (SELECT a.i, a.j, 0.4*(coalesce(b.s,0)+coalesce(c.s,0)+coalesce(d.s,0)+coalesce(e.s,0))/((b.s IS NOT NULL)::INT+(c.s IS NOT NULL)::INT+(d.s IS NOT NULL)::INT+(e.s IS NOT NULL)::INT) + 0.6*a.s AS s FROM {src} a LEFT JOIN {src} b ON b.i=a.i+1 AND b.j=a.j LEFT JOIN {src} c ON c.i=a.i-1 AND c.j=a.j LEFT JOIN {src} d ON d.i=a.i AND d.j=a.j+1 LEFT JOIN {src} e ON e.i=a.i AND e.j=a.j-1)"


@query(with_views(f"+s0 AS (SELECT i, j, v AS s FROM grid2d), {_smooth(1, 's0')}, {_smooth(2, 's1')}, {_smooth(3, 's2')} SELECT s3.i, s3.j, {sq('s3.s + (SELECT greatest(0, max(g.v - z.s)) FROM grid2d g JOIN s3 z ON g.i=z.i AND g.j=z.j)', 3)} AS smooth FROM s3", "grid2d"))
def low_pass(spark, sf):
    return R.low_pass(A.grid2d(spark, sf), 3, 0.4).withColumn("smooth", rd("smooth", 3))


@query("SELECT p_partkey AS index, 0.5::DOUBLE * (p_partkey % 10) AS x, 2.0::DOUBLE * ((p_partkey // 10) % 40) AS y, (p_partkey // 400) * 1.0::DOUBLE AS z, p_retailprice AS value FROM part")
def rectilinear_grid(spark, sf):
    part = A.table(spark, sf, "part")
    n = part.agg(F.max("p_partkey")).first()[0] // 400 + 1
    data = part.select(F.col("p_partkey").alias("index"), F.col("p_retailprice").alias("value"))
    return R.rectilinear_grid(spark, [[0.5 * i for i in range(10)], [2.0 * i for i in range(40)], [1.0 * i for i in range(n)]], data)


@query("SELECT CAST(l_quantity AS BIGINT) AS i, round(l_tax*100) AS t, count(*) AS n FROM lineitem GROUP BY 1, 2")
def stack_time(spark, sf):
    """Counts of each of lineitem's tax steps as a slice of its own, stacked."""
    l = A.table(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").alias("i"), F.round(F.col("l_tax") * 100).alias("k"))
    steps = sorted(r["k"] for r in l.select("k").distinct().collect())
    return R.stack_time([(t, l.filter(F.col("k") == t).groupBy("i").agg(F.count(F.lit(1)).alias("n"))) for t in steps])


_UPSAMPLE = f"""+a AS (
    SELECT 2*g.i + k AS i, g.j, CASE WHEN k = 0 THEN g.v ELSE g.v + (h.v - g.v)*k/2.0::DOUBLE END AS v
    FROM grid2d g LEFT JOIN grid2d h ON h.i = g.i + 1 AND h.j = g.j, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR h.v IS NOT NULL),
  b AS (
    SELECT g.i, 3*g.j + k AS j, CASE WHEN k = 0 THEN g.v ELSE g.v + (h.v - g.v)*k/3.0::DOUBLE END AS v
    FROM a g LEFT JOIN a h ON h.j = g.j + 1 AND h.i = g.i, (SELECT unnest([0, 1, 2]) AS k) WHERE k = 0 OR h.v IS NOT NULL)
SELECT i, j, {sq('v', 3)} AS v FROM b
"""


@query(with_views(_UPSAMPLE, "grid2d"))
def upsample(spark, sf):
    return R.upsample(A.grid2d(spark, sf), {"i": 2, "j": 3}).withColumn("v", rd("v", 3))


_AROUND = """+d AS (SELECT x.a AS di, y.a AS dj, z.a AS dk FROM (SELECT unnest([-1, 0, 1]) AS a) x, (SELECT unnest([-1, 0, 1]) AS a) y, (SELECT unnest([-1, 0, 1]) AS a) z WHERE x.a <> 0 OR y.a <> 0 OR z.a <> 0),
  e AS (SELECT g.i, g.j, g.k, abs(di) + abs(dj) + abs(dk) AS far FROM grid3d g, d JOIN grid3d h ON h.i = g.i + di AND h.j = g.j + dj AND h.k = g.k + dk)
SELECT i, j, k, sum(CASE WHEN far = 1 THEN 1 ELSE 0 END)::BIGINT AS faces, count(*) AS around FROM e GROUP BY 1, 2, 3
"""


@query(with_views(_AROUND, "grid3d"))
def grid_connectivity(spark, sf):
    """The numbers of a node's neighbours along the axes and all around it, of those that exist."""
    g, axes = A.grid3d(spark, sf).select("i", "j", "k"), ["i", "j", "k"]
    faces = R.grid_edges(g, axes).groupBy(*axes).agg(F.count(F.lit(1)).alias("faces"))
    around = R.grid_edges(g, axes, corners=True).groupBy(*axes).agg(F.count(F.lit(1)).alias("around"))
    return around.join(faces, axes, "left").select(*axes, F.coalesce("faces", F.lit(0)).alias("faces"), "around")


_EDGES = "e AS (SELECT least(v0,v1) AS a, greatest(v0,v1) AS b FROM triangles UNION ALL SELECT least(v1,v2), greatest(v1,v2) FROM triangles UNION ALL SELECT least(v2,v0), greatest(v2,v0) FROM triangles)"


@query(with_views(f"+{_EDGES} SELECT a, b, count(*) AS triangles, (p.x+q.x)/2 AS mx, (p.y+q.y)/2 AS my FROM e JOIN vertices p ON p.id=a JOIN vertices q ON q.id=b GROUP BY a, b, p.x, q.x, p.y, q.y", "triangles", "vertices"))
def split_edges(spark, sf):
    return R.split_edges(A.triangles(spark, sf), A.vertices(spark, sf))


_TURN3 = "atan2({p}.u*{q}.w - {p}.w*{q}.u, {p}.u*{q}.u + {p}.w*{q}.w)"


@query(with_views(f"+{_VEC}, n AS (SELECT i*11+j AS id, u, w FROM u), t AS (SELECT tri, {_TURN3.format(p='a', q='b')} AS t0, {_TURN3.format(p='b', q='c')} AS t1, {_TURN3.format(p='c', q='a')} AS t2 FROM triangles JOIN n a ON a.id=v0 JOIN n b ON b.id=v1 JOIN n c ON c.id=v2) SELECT tri, CAST(round((t0+t1+t2)/(2*pi())) AS BIGINT) AS index, {sq('abs(t0)+abs(t1)+abs(t2)', 5)} AS total_turn, {sq('greatest(abs(t0),abs(t1),abs(t2))', 5)} AS greatest_turn FROM t", "triangles"))
def triangle_index(spark, sf):
    v = _vectors(spark, sf).select((F.col("i") * 11 + F.col("j")).alias("id"), F.col("u").alias("vx"), F.col("w").alias("vy"))
    df = R.triangle_index(A.triangles(spark, sf), v)
    return df.select("tri", "index", rd("total_turn", 5).alias("total_turn"), rd("greatest_turn", 5).alias("greatest_turn"))


@query(with_views("+q AS (SELECT tri, least(a.value,b.value,c.value)/10000 AS low, greatest(a.value,b.value,c.value)/10000 AS high FROM triangles JOIN vertices a ON a.id=v0 JOIN vertices b ON b.id=v1 JOIN vertices c ON c.id=v2), f AS (SELECT 7.0::DOUBLE/i AS q FROM (SELECT unnest(range(1, 7)) AS i)) SELECT DISTINCT tri FROM q JOIN f ON low - 0.01::DOUBLE <= f.q AND high + 0.01::DOUBLE >= f.q", "triangles", "vertices"))
def period_compatible_triangles(spark, sf):
    from ..operators.stats import mesh_quality

    q = mesh_quality(A.triangles(spark, sf), A.vertices(spark, sf)).select("tri", (F.col("low") / 10000).alias("low"), (F.col("high") / 10000).alias("high"))
    return R.period_compatible_triangles(q, 7, 0.01).select("tri")


_FIT_ERROR = f"""+{_VEC}, n AS (SELECT i*11 + j AS id, u AS vx, w AS vy FROM u),
  r AS (
    SELECT tri, x.x AS x0, x.y AS y0, y.x AS x1, y.y AS y1, z.x AS x2, z.y AS y2, a.vx AS u0, b.vx AS u1, c.vx AS u2, a.vy AS w0, b.vy AS w1, c.vy AS w2, CASE WHEN tri % 2 = 0 THEN 0.25 ELSE -0.25 END::DOUBLE AS o
    FROM triangles JOIN vertices x ON x.id = v0 JOIN vertices y ON y.id = v1 JOIN vertices z ON z.id = v2 JOIN n a ON a.id = v0 JOIN n b ON b.id = v1 JOIN n c ON c.id = v2),
  q AS (SELECT *, (o*(y2-y0) - (x2-x0)*o) / ((x1-x0)*(y2-y0) - (x2-x0)*(y1-y0)) AS p1, ((x1-x0)*o - o*(y1-y0)) / ((x1-x0)*(y2-y0) - (x2-x0)*(y1-y0)) AS p2, sqrt(u0*u0 + w0*w0) AS size FROM r)
SELECT tri, {sq('CASE WHEN size > 0 THEN sqrt((u0*(1-p1-p2) + u1*p1 + u2*p2 - u0)^2 + (w0*(1-p1-p2) + w1*p1 + w2*p2 - w0)^2)/size END', 5)} AS error,
  size < least(sqrt(u0*u0 + w0*w0), sqrt(u1*u1 + w1*w1), sqrt(u2*u2 + w2*w2)) AS smaller FROM q
"""


@query(with_views(_FIT_ERROR, "triangles", "vertices"))
def linear_fit_error(spark, sf):
    v = A.vertices(spark, sf).join(_vectors(spark, sf).select((F.col("i") * 11 + F.col("j")).alias("id"), F.col("u").alias("vx"), F.col("w").alias("vy")), "id")
    t = A.triangles(spark, sf)
    mid = t.join(v.select(F.col("id").alias("v0"), "x", "y", "vx", "vy"), "v0").select("tri", (F.col("x") + F.when(F.col("tri") % 2 == 0, 0.25).otherwise(-0.25)).alias("x"), (F.col("y") + F.when(F.col("tri") % 2 == 0, 0.25).otherwise(-0.25)).alias("y"), F.col("vx").alias("px"), F.col("vy").alias("py"))
    return R.linear_fit_error(t, v, mid).select("tri", rd("error", 5).alias("error"), "smaller")


@query(with_views("SELECT " + ", ".join(sq(f"covar_pop({a}, {b})", d) + f" AS {a}{b}" for a, b, d in (("x", "x", 1), ("x", "y", 2), ("x", "z", 2), ("y", "y", 2), ("y", "z", 2), ("z", "z", 3))) + " FROM points3d", "points3d"))
def pca_covariance(spark, sf):
    p = A.points3d(spark, sf)
    _, cov, _ = R.pca_project(p, ["x", "y", "z"], (2, 1), "id")
    names = {"xx": (0, 0, 1), "xy": (0, 1, 2), "xz": (0, 2, 2), "yy": (1, 1, 2), "yz": (1, 2, 2), "zz": (2, 2, 3)}
    one = p.agg(F.count(F.lit(1)).alias("n"))
    return one.select(*[rd(F.lit(float(cov[i, j])), d).alias(k) for k, (i, j, d) in names.items()])


@query()
def pca_project(spark, sf):
    df, _, _ = R.pca_project(A.points3d(spark, sf), ["x", "y", "z"], (2, 1), "id")
    return df.select("id", rd(F.abs("p0"), 3).alias("p0"), rd(F.abs("p1"), 3).alias("p1"))


@query(with_views("+d AS (SELECT id % 12 AS label, x - 200 AS x, y - 100 AS y, z - 50 AS z FROM points3d), s AS (SELECT label, sum(x*x) AS xx, sum(y*y) AS yy, sum(z*z) AS zz FROM d GROUP BY 1) SELECT label, TRUE AS unit, " + sq("xx+yy+zz", 0) + " AS trace FROM s", "points3d"))
def unoriented_mean_direction(spark, sf):
    d = A.points3d(spark, sf).select((F.col("id") % 12).alias("label"), (F.col("x") - 200).alias("x"), (F.col("y") - 100).alias("y"), (F.col("z") - 50).alias("z"))
    m = R.unoriented_mean_direction(d, "label")
    a = R.align_to_mean(d, m, "label").groupBy("label").agg(F.sum(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("trace"))
    unit = F.abs(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2 - 1) < 1e-9
    return m.select("label", unit.alias("unit")).join(a, "label").select("label", "unit", rd("trace", 0).alias("trace"))


def _blocks(spark, sf):
    """Hexahedra between eight corners of the 3-D grid, as a mesh over the table's nodes."""
    g = A.grid3d(spark, sf).select("i", "j", "k", "v", (F.col("i") * 10000 + F.col("j") * 100 + F.col("k")).alias("id"))
    at = F.col("id")
    corner = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    verts = F.array(*[(at + a * 10000 + b * 100 + c) for a, b, c in corner])
    cells = g.filter("i < 49 AND j < 10 AND k < 8").select(at.alias("cell"), F.lit("hexahedron").alias("type"), verts.alias("verts"))
    ids = g.select(F.col("id").alias("n"))
    whole = cells.select("cell", F.explode("verts").alias("n")).join(ids, "n").groupBy("cell").agg(F.count(F.lit(1)).alias("m")).filter("m = 8").select("cell")
    return g, cells.join(whole, "cell", "left_semi")


@query(with_views("+n AS (SELECT i, j, k, i*10000+j*100+k AS id FROM grid3d), c AS (SELECT a.id, a.i, a.j, a.k FROM n a WHERE (SELECT count(*) FROM n b WHERE b.id IN (a.id, a.id+10000, a.id+10100, a.id+100, a.id+1, a.id+10001, a.id+10101, a.id+101)) = 8), f AS (SELECT id AS cell, unnest([[id, id+10000, id+10100, id+100], [id+1, id+10001, id+10101, id+101], [id, id+10000, id+1, id+10001], [id+10000, id+10100, id+10001, id+10101], [id+10100, id+100, id+10101, id+101], [id+100, id, id+101, id+1]]) AS v FROM c), s AS (SELECT cell, list_sort(v) AS key FROM f) SELECT any_value(cell) AS cell, key[1] AS k0, key[4] AS k3 FROM s GROUP BY key HAVING count(*) = 1", "grid3d"))
def boundary_faces(spark, sf):
    _, cells = _blocks(spark, sf)
    b = R.boundary_faces(cells)
    return b.select("cell", F.get("key", F.lit(0)).alias("k0"), F.get("key", F.lit(3)).alias("k3"))


#: The boundary of _blocks() in SQL: faces of one cell with their vertices, the vertices across the cell, and normals.
_HULL = """
n AS (SELECT i, j, k, v, i*10000+j*100+k AS id FROM grid3d),
c AS (SELECT a.id FROM n a WHERE (SELECT count(*) FROM n b WHERE b.id IN
  (a.id, a.id+10000, a.id+10100, a.id+100, a.id+1, a.id+10001, a.id+10101, a.id+101)) = 8),
f AS (SELECT id AS cell, unnest([
  {'face': 0, 'v': [id, id+100, id+10100, id+10000], 'o': [id+1, id+101, id+10101, id+10001], 'x': 0, 'y': 0, 'z': -1},
  {'face': 1, 'v': [id+1, id+10001, id+10101, id+101], 'o': [id, id+10000, id+10100, id+100], 'x': 0, 'y': 0, 'z': 1},
  {'face': 2, 'v': [id, id+10000, id+10001, id+1], 'o': [id+100, id+10100, id+10101, id+101], 'x': 0, 'y': -1, 'z': 0},
  {'face': 3, 'v': [id+10000, id+10100, id+10101, id+10001], 'o': [id, id+100, id+101, id+1], 'x': 1, 'y': 0, 'z': 0},
  {'face': 4, 'v': [id+10100, id+100, id+101, id+10101], 'o': [id+10000, id, id+1, id+10001], 'x': 0, 'y': 1, 'z': 0},
  {'face': 5, 'v': [id+100, id, id+1, id+101], 'o': [id+10100, id+10000, id+10001, id+10101], 'x': -1, 'y': 0, 'z': 0}]) AS s FROM c),
b AS (SELECT any_value(cell) AS cell, any_value(s) AS s FROM f GROUP BY list_sort(s.v) HAVING count(*) = 1),
e AS (SELECT cell, s.face AS face, unnest(s.v) AS id, unnest(s.o) AS o, s.x AS x, s.y AS y, s.z AS z FROM b),
r AS (SELECT id, arg_min({'x': x, 'y': y, 'z': z, 'o': o}, row(cell, face)) AS r FROM e GROUP BY id),
m AS (SELECT e.id, any_value(r.o) AS o, sum(t*x)::DOUBLE AS x, sum(t*y)::DOUBLE AS y, sum(t*z)::DOUBLE AS z
  FROM (SELECT e.*, r.r AS r, CASE WHEN e.x*r.r.x + e.y*r.r.y + e.z*r.r.z < 0 THEN -1 ELSE 1 END AS t FROM e JOIN r USING (id)) e GROUP BY e.id),
h AS (SELECT id, o, CASE WHEN x*x+y*y+z*z > 0 THEN x / sqrt(x*x+y*y+z*z) END AS nx, CASE WHEN x*x+y*y+z*z > 0 THEN y / sqrt(x*x+y*y+z*z) END AS ny,
  CASE WHEN x*x+y*y+z*z > 0 THEN z / sqrt(x*x+y*y+z*z) END AS nz FROM m)
"""


@query(with_views(f"+{_HULL} SELECT id, {sq('nx')} AS nx, {sq('ny')} AS ny, {sq('nz')} AS nz FROM h", "grid3d"))
def vertex_normals(spark, sf):
    g, cells = _blocks(spark, sf)
    v = g.select("id", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), F.col("k").cast("double").alias("z"))
    n = R.vertex_normals(R.boundary_faces(cells), v)
    return n.select("id", rd("nx").alias("nx"), rd("ny").alias("ny"), rd("nz").alias("nz"))


_ALONG = "(u*nx + w*ny + q*nz)"


@query(with_views(
    f"+{_HULL}, t AS (SELECT h.*, n.v / 1000 AS u, n.i::DOUBLE AS w, n.k::DOUBLE AS q FROM h JOIN n ON n.id = h.o) "
    f"SELECT id, {sq(f'u - {_ALONG}*nx')} AS tu, {sq(f'w - {_ALONG}*ny')} AS tv, {sq(f'q - {_ALONG}*nz')} AS tw FROM t", "grid3d"))  # fmt: skip
def tangential_at_boundary(spark, sf):
    g, cells = _blocks(spark, sf)
    v = g.select("id", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), F.col("k").cast("double").alias("z"))
    u = g.select("id", (F.col("v") / 1000).alias("u"), F.col("i").cast("double").alias("v"), F.col("k").cast("double").alias("w"))
    t = R.tangential_at_boundary(cells, v, u)
    return t.select("id", rd("tu").alias("tu"), rd("tv").alias("tv"), rd("tw").alias("tw"))


@query(with_views("+p AS (SELECT id, CAST(floor(x/20) AS BIGINT) AS u, CAST(floor(y/20) AS BIGINT) AS v, x, y, z FROM points3d), r AS (SELECT a.id AS a, arg_min(b.id, row(abs(a.z-b.z), b.id)) AS b FROM p a JOIN p b ON b.u=a.u+1 AND b.v=a.v GROUP BY 1), d AS (SELECT a.id AS a, arg_min(b.id, row(abs(a.z-b.z), b.id)) AS c FROM p a JOIN p b ON b.u=a.u AND b.v=a.v+1 GROUP BY 1), t AS (SELECT r.a, r.b, d.c, greatest(sqrt((p.x-q.x)^2+(p.y-q.y)^2+(p.z-q.z)^2), sqrt((q.x-s.x)^2+(q.y-s.y)^2+(q.z-s.z)^2), sqrt((s.x-p.x)^2+(s.y-p.y)^2+(s.z-p.z)^2)) AS m FROM r JOIN d ON r.a=d.a JOIN p ON p.id=r.a JOIN p q ON q.id=r.b JOIN p s ON s.id=d.c) SELECT a, b, c, " + sq("m") + " AS diameter FROM t WHERE m < 30", "points3d"))
def pixel_triangles(spark, sf):
    p = A.points3d(spark, sf).withColumns({"u": F.floor(F.col("x") / 20), "v": F.floor(F.col("y") / 20)})
    return R.pixel_triangles(p, 30.0).withColumn("diameter", rd("diameter"))
