"""Queries on labelled voxels, expressions and statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import tensor as M
from ..operators import labels as L
from ..operators import stats as S
from . import adapters as A
from .adapters import rd, sq, with_views
from .registry import query

_SUMS = "SELECT label, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x*x) AS xx, sum(x*y) AS xy, sum(x*z) AS xz, sum(y*y) AS yy, sum(y*z) AS yz, sum(z*z) AS zz, min(value) AS low, max(value) AS high, avg(value) AS mean FROM voxels GROUP BY label"
_COV = "SELECT label, n, sx/n AS cx, sy/n AS cy, sz/n AS cz, low, high, mean, xx-sx*sx/n AS xx, xy-sx*sy/n AS xy, xz-sx*sz/n AS xz, yy-sy*sy/n AS yy, yz-sy*sz/n AS yz, zz-sz*sz/n AS zz FROM sums"
_FA = "sqrt(1.5 * ((xx-(xx+yy+zz)/3)^2 + (yy-(xx+yy+zz)/3)^2 + (zz-(xx+yy+zz)/3)^2 + 2*(xy*xy+xz*xz+yz*yz)) / (xx*xx+yy*yy+zz*zz+2*(xy*xy+xz*xz+yz*yz)))"
_INV = f"SELECT *, (xx+yy+zz)/3 AS q, xy*xy+xz*xz+yz*yz AS o, CASE WHEN xx*xx+yy*yy+zz*zz+2*(xy*xy+xz*xz+yz*yz) > 0 THEN {_FA} ELSE 0 END AS fa FROM cov"
_EIG = "SELECT *, q + 2*p*cos(ang) AS l1, q + 2*p*cos(ang + 2*pi()/3) AS l3 FROM (SELECT *, acos(greatest(-1.0, least(1.0, CASE WHEN p > 0 THEN ((xx-q)*((yy-q)*(zz-q)-yz*yz) - xy*(xy*(zz-q)-yz*xz) + xz*(xy*yz-(yy-q)*xz)) / (2*p*p*p) ELSE 0 END)))/3 AS ang FROM (SELECT *, sqrt(((xx-q)^2+(yy-q)^2+(zz-q)^2+2*o)/6) AS p FROM inv))"


def _cov_sql(select: str) -> str:
    return with_views(f"+sums AS ({_SUMS}), cov AS ({_COV}), inv AS ({_INV}), eig AS ({_EIG}) {select}", "voxels")


@query(_cov_sql(f"SELECT label, n AS size, low, high, {sq('mean')} AS mean, {sq('cx')} AS cx, {sq('cy')} AS cy, {sq('cz')} AS cz, {sq('fa', 5)} AS fa FROM inv"))
def label_statistics(spark, sf):
    df = L.label_statistics(A.voxels(spark, sf))
    return df.select("label", "size", "low", "high", rd("mean").alias("mean"), rd("cx").alias("cx"), rd("cy").alias("cy"), rd("cz").alias("cz"), rd("fa", 5).alias("fa"))


@query(with_views("SELECT label, count(*) AS size FROM voxels GROUP BY label", "voxels"))
def label_sizes(spark, sf):
    return L.label_sizes(A.voxels(spark, sf))


@query(with_views("SELECT label, min(value) AS low, max(value) AS high FROM voxels GROUP BY label", "voxels"))
def label_span(spark, sf):
    return L.label_span(A.voxels(spark, sf))


@query(with_views(f"SELECT label, {sq('avg(value)')} AS mean FROM voxels GROUP BY label", "voxels"))
def label_mean(spark, sf):
    return L.label_mean(A.voxels(spark, sf)).select("label", rd("mean").alias("mean"))


@query(with_views("SELECT label, arg_min(value, (x, y, z, value)) AS first FROM voxels GROUP BY label", "voxels"))
def label_first(spark, sf):
    return L.label_first(A.voxels(spark, sf), ["x", "y", "z", "value"])


@query(with_views("SELECT label, row_number() OVER (ORDER BY first_at, label) - 1 AS dense_id FROM (SELECT label, min(row(x, y, z, value)) AS first_at FROM voxels GROUP BY label)", "voxels"))
def label_ids(spark, sf):
    return L.label_ids(A.voxels(spark, sf), ["x", "y", "z", "value"])


@query(_cov_sql(f"SELECT label, n, {sq('cx')} AS cx, {sq('cy')} AS cy, {sq('cz')} AS cz, {sq('xx', 2)} AS xx, {sq('xy', 2)} AS xy, {sq('zz', 2)} AS zz, {sq('fa', 5)} AS fa, {sq('l1', 2)} AS l1, {sq('3*q-l1-l3', 2)} AS l2, {sq('l3', 2)} AS l3, {sq('(l1-(3*q-l1-l3))/(3*q)', 5)} AS cl, {sq('2*((3*q-l1-l3)-l3)/(3*q)', 5)} AS cp, {sq('3*l3/(3*q)', 5)} AS cs FROM eig"))
def label_shape(spark, sf):
    df = L.label_shape(A.voxels(spark, sf), centred=True)
    return df.select("label", "n", *[rd(c).alias(c) for c in ("cx", "cy", "cz")], *[rd(c, 2).alias(c) for c in ("xx", "xy", "zz", "l1", "l2", "l3")], *[rd(c, 5).alias(c) for c in ("fa", "cl", "cp", "cs")])


@query(_cov_sql(f"SELECT label, {sq('3*q', 2)} AS trace, {sq('sqrt(xx*xx+yy*yy+zz*zz+2*o)', 2)} AS frobenius, {sq('fa', 5)} AS fa FROM inv"))
def tensor_invariants(spark, sf):
    df = L.label_shape(A.voxels(spark, sf)).drop("fa")
    t = M.tensor_invariants("xx", "xy", "xz", "yy", "yz", "zz")
    return df.select("label", rd(t["trace"], 2).alias("trace"), rd(t["frobenius"], 2).alias("frobenius"), rd(t["fa"], 5).alias("fa"))


@query(_cov_sql(f"SELECT label, {sq('l1', 2)} AS l1, {sq('3*q-l1-l3', 2)} AS l2, {sq('l3', 2)} AS l3, TRUE AS is_eigenvector FROM eig"))
def sym_eig3(spark, sf):
    df = L.label_shape(A.voxels(spark, sf)).drop("l1", "l2", "l3")
    six = ["xx", "xy", "xz", "yy", "yz", "zz"]
    l1, l2, l3 = M.sym_eig3(*six)
    df = df.withColumns({"l1": l1, "l2": l2, "l3": l3})
    x, y, z = M.principal_vector3(*six, "l1")
    off = F.abs(F.col("xx") * x + F.col("xy") * y + F.col("xz") * z - F.col("l1") * x)
    return df.select("label", rd("l1", 2).alias("l1"), rd("l2", 2).alias("l2"), rd("l3", 2).alias("l3"), (off <= 1e-6 * F.col("l1")).alias("is_eigenvector"))


@query(_cov_sql(f"SELECT label, {sq('(xx+yy)/2 + sqrt(((xx-yy)/2)^2 + xy*xy)', 2)} AS l1, {sq('(xx+yy)/2 - sqrt(((xx-yy)/2)^2 + xy*xy)', 2)} AS l2 FROM cov"))
def sym_eig2(spark, sf):
    l1, l2, _, _ = M.sym_eig2("xx", "xy", "yy")
    return L.label_shape(A.voxels(spark, sf)).select("label", rd(l1, 2).alias("l1"), rd(l2, 2).alias("l2"))


@query(_cov_sql(f"SELECT label, {sq('((l1-q)-(3*q-l1-l3-q))/(abs(l1-q)+abs(3*q-l1-l3-q)+abs(l3-q))', 5)} AS cl_dev, {sq('(l1-(3*q-l1-l3))/(3*q)', 5)} AS cl FROM eig"))
def westin_anisotropy(spark, sf):
    df = L.label_shape(A.voxels(spark, sf))
    q = (F.col("l1") + F.col("l2") + F.col("l3")) / 3
    dev = [F.col(c) - q for c in ("l1", "l2", "l3")]
    cl = (dev[0] - dev[1]) / (F.abs(dev[0]) + F.abs(dev[1]) + F.abs(dev[2]))
    return df.select("label", rd(cl, 5).alias("cl_dev"), rd(M.westin_anisotropy("l1", "l2", "l3")["cl"], 5).alias("cl"))


@query("WITH r AS (SELECT min(p_size)::DOUBLE AS lo, (max(p_size)-min(p_size))*0.1::DOUBLE AS d, count(*) AS n FROM part), b AS (SELECT unnest(range(0, 10)) AS bin) SELECT bin, count(*) AS n, " + sq("count(*)*100.0/any_value(r.n)") + " AS percent, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high, " + sq("avg(p_size)") + " AS mean FROM part, r, b WHERE p_size >= lo + bin*d AND p_size <= lo + (bin+1)*d GROUP BY bin")
def value_range_slices(spark, sf):
    df = L.value_range_slices(A.table(spark, sf, "part"), "p_size", 0.1)
    return df.select("bin", "n", rd("percent").alias("percent"), "low", "high", rd("mean").alias("mean"))


@query(with_views(f"SELECT {sq('sum(value*0.5)', 1)} AS integral, count(*) AS voxels FROM voxels WHERE x BETWEEN 10 AND 30 AND y BETWEEN 2 AND 8 AND value >= 20000", "voxels"))
def thresholded_integral(spark, sf):
    df = L.thresholded_integral(A.voxels(spark, sf), {"x": (10, 30), "y": (2, 8)}, 20000, 0.5)
    return df.select(rd("integral", 1).alias("integral"), "voxels")


@query(with_views(f"SELECT v.label, x, y, z, {sq('value - mean')} AS centred FROM voxels v JOIN (SELECT label, avg(value) AS mean FROM voxels GROUP BY label) m ON v.label = m.label", "voxels"))
def broadcast_back(spark, sf):
    v = A.voxels(spark, sf)
    df = L.broadcast_back(v, L.label_mean(v), "label")
    return df.select("label", "x", "y", "z", rd(F.col("value") - F.col("mean")).alias("centred"))


@query(_cov_sql("SELECT DISTINCT vertex FROM (SELECT doc_id AS vertex, unnest(list_distinct([length(w) % 12 for w in string_split(text, ' ')])) AS tag FROM documents WHERE text IS NOT NULL) JOIN (SELECT label FROM inv WHERE fa BETWEEN 0.9 AND 1.3 AND n BETWEEN 10 AND 1000000 AND label % 3 = 0) ON tag = label"))
def select_labels(spark, sf):
    stats = L.label_statistics(A.voxels(spark, sf)).filter("label % 3 = 0")
    chosen = L.select_labels(stats, {"fa": (0.9, 1.3), "size": (10, 1000000)})
    return L.points_with_tags(A.tag_sets(spark, sf), chosen)


_TAGS = "SELECT vertex, unnest(tags) AS label FROM tag_sets"


@query(with_views(f"+t AS ({_TAGS}), m AS (SELECT l_suppkey % 12 AS label, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1) SELECT vertex, count(*) AS n_labels, {sq('avg(value)', 3)} AS mean_value FROM t JOIN m USING (label) GROUP BY vertex", "tag_sets"))
def grain_values_on_points(spark, sf):
    values = A.voxels(spark, sf).groupBy((F.col("label") % 12).alias("label")).agg(F.avg("value").alias("value"))
    df = L.grain_values_on_points(A.tag_sets(spark, sf), values)
    return df.select("vertex", "n_labels", rd("mean_value", 3).alias("mean_value"))


@query(with_views("+t AS (SELECT doc_id AS v0, doc_id + 1 AS v1, doc_id + 2 AS v2, doc_id AS face FROM documents), c AS (SELECT vertex FROM tag_sets WHERE list_contains(tags, 11)) SELECT face FROM t WHERE v0 IN (SELECT vertex FROM c) AND v1 IN (SELECT vertex FROM c) AND v2 IN (SELECT vertex FROM c)", "tag_sets"))
def faces_within(spark, sf):
    tags = A.tag_sets(spark, sf)
    faces = A.table(spark, sf, "documents").select(F.col("doc_id").alias("face"), F.col("doc_id").alias("v0"), (F.col("doc_id") + 1).alias("v1"), (F.col("doc_id") + 2).alias("v2"))
    return L.faces_within(faces, tags.filter(F.array_contains("tags", 11)), "face", ["v0", "v1", "v2"])


_MOD = "list_sort(list_distinct([CAST(o_orderkey % 3 AS INT), CAST(o_custkey % 4 AS INT), CAST(o_orderkey % 5 AS INT)]))"


@query(f"WITH t AS (SELECT o_orderkey AS id, {_MOD} AS tags FROM orders), f AS (SELECT a.id AS face, list_sort([e for e in a.tags if list_contains(b.tags, e) AND list_contains(c.tags, e)]) AS s FROM t a JOIN t b ON b.id = a.id + 1 JOIN t c ON c.id = a.id + 2) SELECT face, s[1]::BIGINT AS tag_a, s[2]::BIGINT AS tag_b FROM f WHERE len(s) = 2 AND s[2] > 0")
def shared_tags(spark, sf):
    o = A.table(spark, sf, "orders")
    tags = F.array_distinct(F.array(F.col("o_orderkey") % 3, F.col("o_custkey") % 4, F.col("o_orderkey") % 5).cast("array<int>"))
    t = lambda n: o.select((F.col("o_orderkey") - n).alias("face"), tags.alias(f"t{n}"))
    s = L.shared_tags(F.col("t0"), F.col("t1"), F.col("t2"))
    df = t(0).join(t(1), "face").join(t(2), "face").select("face", s.alias("s")).filter("s IS NOT NULL")
    return df.select("face", F.get("s", F.lit(0)).cast("long").alias("tag_a"), F.get("s", F.lit(1)).cast("long").alias("tag_b"))


@query("WITH s AS (SELECT l_suppkey AS label, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1), v AS (SELECT unnest(range(0, 101)) * 1000.0::DOUBLE AS value) SELECT label, value FROM s JOIN v ON value BETWEEN low AND high")
def spans_containing(spark, sf):
    sweep = spark.range(101).select((F.col("id") * 1000.0).alias("value"))
    return L.spans_containing(L.label_span(A.voxels(spark, sf)), sweep, 5000.0).select("label", "value")


@query(with_views("+t AS (SELECT vertex, unnest(tags) AS v FROM tag_sets) SELECT x.v::BIGINT AS a, y.v::BIGINT AS b, count(*) AS sets FROM t x JOIN t y ON x.vertex = y.vertex AND x.v < y.v GROUP BY 1, 2", "tag_sets"))
def value_pairs(spark, sf):
    return L.value_pairs(A.tag_sets(spark, sf)).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "sets")


@query(with_views(f"+t AS ({_TAGS}) SELECT label::BIGINT AS tag, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM t JOIN points2d ON vertex = id GROUP BY 1", "tag_sets", "points2d"))
def tag_bounding_boxes(spark, sf):
    df = L.tag_bounding_boxes(A.tag_sets(spark, sf), A.points2d(spark, sf).withColumnRenamed("id", "vertex"))
    return df.withColumn("tag", F.col("tag").cast("long"))


@query(with_views("+e AS (SELECT a.tag AS p, b.tag AS q FROM grid3d a JOIN grid3d b ON b.i = a.i + 1 AND b.j = a.j AND b.k = a.k UNION ALL SELECT a.tag, b.tag FROM grid3d a JOIN grid3d b ON b.i = a.i AND b.j = a.j + 1 AND b.k = a.k UNION ALL SELECT a.tag, b.tag FROM grid3d a JOIN grid3d b ON b.i = a.i AND b.j = a.j AND b.k = a.k + 1) SELECT least(p, q) AS tag_a, greatest(p, q) AS tag_b, count(*) AS edges FROM e WHERE p <> q GROUP BY 1, 2", "grid3d"))
def label_interfaces(spark, sf):
    return L.label_interfaces(A.grid3d(spark, sf))


# Expressions.


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_orderkey % 7 AS i, (l_orderkey // 7) % 11 AS j, l_orderkey // 77 AS k, l_orderkey AS back, -3 + (l_orderkey % 7) * 0.5::DOUBLE AS wx, CASE WHEN floor((l_quantity - 1) / 2.5 + 0.5) BETWEEN 0 AND 15 THEN CAST(floor((l_quantity - 1) / 2.5 + 0.5) AS BIGINT) END AS voxel FROM lineitem")
def grid_indices(spark, sf):
    i, j, k = X.index_to_coord("l_orderkey", [7, 11, 10**9])
    df = A.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), i.alias("i"), j.alias("j"), k.alias("k"), "l_quantity")
    return df.withColumns({"back": X.coord_to_index(["i", "j", "k"], [7, 11, 10**9]), "wx": X.world_position("i", -3, 0.5), "voxel": X.nearest_voxel("l_quantity", 1, 2.5, 16)}).drop("l_quantity")


@query("SELECT l_suppkey AS label, sum(CASE WHEN l_quantity BETWEEN 5 AND 20 AND l_extendedprice BETWEEN 1000 AND 30000 THEN 1 ELSE 0 END)::BIGINT AS in_box, sum(CASE WHEN l_quantity*l_quantity + round(l_discount*100)*round(l_discount*100) <= 400 THEN 1 ELSE 0 END)::BIGINT AS in_cylinder, sum(CASE WHEN abs(round(l_tax*100)) < 3 THEN 1 ELSE 0 END)::BIGINT AS in_slab FROM lineitem GROUP BY 1")
def point_filters(spark, sf):
    n = lambda c, a: F.sum(c.cast("long")).alias(a)
    return A.voxels(spark, sf).groupBy("label").agg(n(X.in_box({"x": (5, 20), "value": (1000, 30000)}), "in_box"), n(X.in_cylinder("x", "y", 20), "in_cylinder"), n(X.in_slab("z", 3), "in_slab"))


@query("SELECT l_orderkey AS id, l_linenumber::BIGINT AS line, " + sq("1 + 2 * l_quantity / 49", 6) + " AS wx, " + sq("2 - round(l_discount*100) * 3 / 10", 6) + " AS wy FROM lineitem WHERE l_returnflag = 'R'")
def mask_to_points(spark, sf):
    from ..operators.grid import mask_to_points as op

    df = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("i"), F.round(F.col("l_discount") * 100).alias("j"), (F.col("l_returnflag") == "R").cast("int").alias("mask"))
    df = op(df, "mask", (1.0, 2.0), (2.0, 0.0), (0.0, -3.0), (50, 11))
    return df.select("id", "line", rd("px", 6).alias("wx"), rd("py", 6).alias("wy"))


@query(with_views(f"SELECT src, rcv, {sq('km', 3)} AS km FROM geo_pairs", "geo_pairs"))
def great_circle_km(spark, sf):
    return A.each_receiver(A.geo_places(spark, sf).select("src", "rcvs", rd("km", 3).alias("km")))


@query("SELECT c_custkey, " + sq("6371.0 * acos(greatest(-1.0, least(1.0, sin(radians(lat))*sin(radians(lat)) + cos(radians(lat))*cos(radians(lat))*cos(radians((lon+0.5)-(lon-0.5)))))) / 1.0", 3) + " AS east FROM (SELECT c_custkey, c_custkey*91 % 360 - 179.5::DOUBLE AS lon, c_custkey*29 % 170 - 84.75::DOUBLE AS lat FROM customer)")
def km_per_degree(spark, sf):
    df = A.table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 91 % 360 - 179.5).alias("lon"), (F.col("c_custkey") * 29 % 170 - 84.75).alias("lat"))
    return df.select("c_custkey", rd(X.km_per_degree("lon", "lat", 1.0, 0.0, 0.5), 3).alias("east"))


@query(with_views("+d AS (SELECT pid, step, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM trajectories WINDOW w AS (PARTITION BY pid ORDER BY step)), e AS (SELECT *, (x-px) - 360*floor((x-px)/360) AS m FROM d) SELECT pid, step, " + sq("x - 360*floor(x/360)", 3) + " AS wrapped, " + sq("CASE WHEN m > 180 THEN m-360 ELSE m END", 3) + " AS dx, " + sq("sqrt((CASE WHEN m > 180 THEN m-360 ELSE m END)^2 + (y-py)^2)", 3) + " AS dist FROM e", "trajectories"))
def periodic_metric(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("pid").orderBy("step")
    df = A.trajectories(spark, sf).withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    return df.select("pid", "step", rd(X.periodic_modulo("x", 360), 3).alias("wrapped"), rd(X.periodic_displacement("px", "x", 360), 3).alias("dx"), rd(X.periodic_distance(["px", "py"], ["x", "y"], [360, None]), 3).alias("dist"))


@query(with_views("+d AS (SELECT pid, step, lag(x, 2) OVER w AS x0, lag(y, 2) OVER w AS y0, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x, y FROM trajectories WINDOW w AS (PARTITION BY pid ORDER BY step)) SELECT pid, step, " + sq("atan2((x1-x0)*(y-y1) - (y1-y0)*(x-x1), (x1-x0)*(x-x1) + (y1-y0)*(y-y1))", 5) + " AS angle FROM d", "trajectories"))
def turn_angle(spark, sf):
    from ..operators.orbits import turn_angles

    return turn_angles(A.trajectories(spark, sf)).select("pid", "step", rd("angle", 5).alias("angle"))


@query(with_views("SELECT label, " + sq("avg(atan2(x*3 - y*2, x*2 + y*3))", 5) + " AS signed, " + sq("avg(abs(atan2(x*3 - y*2, x*2 + y*3)))", 5) + " AS unsigned FROM voxels GROUP BY label", "voxels"))
def vector_angles(spark, sf):
    two, three = F.lit(2.0), F.lit(3.0)
    return A.voxels(spark, sf).groupBy("label").agg(rd(F.avg(X.signed_angle("x", "y", two, three)), 5).alias("signed"), rd(F.avg(X.unsigned_angle("x", "y", two, three)), 5).alias("unsigned"))


@query("SELECT p_partkey, " + sq("degrees(acos(greatest(-1.0, least(1.0, sin(a)*sin(b)*0.0 + (-cos(a)*sin(b))*0.6 + cos(b)*0.8))))", 4) + " AS deg FROM (SELECT p_partkey, p_partkey % 7 * 0.4::DOUBLE AS a, p_size * 0.05::DOUBLE AS b FROM part)")
def misorientation_deg(spark, sf):
    df = A.table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 7 * 0.4).alias("a"), (F.col("p_size") * 0.05).alias("b"))
    return df.select("p_partkey", rd(X.misorientation_deg(X.euler_to_direction("a", "b"), (F.lit(0.0), F.lit(0.6), F.lit(0.8)))).alias("deg"))



def _matrices(spark, sf):
    """Each vector's runs of nine elements as 3 x 3 matrices: (id, block, m)."""
    blocks = F.explode(F.sequence(F.lit(0), F.floor(F.size("v") / 9).cast("int") - 1)).alias("block")
    return A.vectors(spark, sf).select("id", "v", blocks).select("id", "block", F.slice("v", F.col("block") * 9 + 1, F.lit(9)).alias("m"))


_MATRICES = """WITH b AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, unnest(range(len(embedding) // 9))::INTEGER AS block FROM embeddings),
  m AS (SELECT id, block, v[9*block + 1:9*block + 9] AS v FROM b)
"""


@query(
    _MATRICES + f"""SELECT id, block, {sq("v[2]", 6)} AS t3, {sq("v[1] + v[1]", 6)} AS sum0, {sq("v[2] - v[4]", 6)} AS diff1, {sq("v[1]*v[1] + v[2]*v[4] + v[3]*v[7]", 6)} AS p0,
  {sq("v[1]*v[1] + v[4]*v[4] + v[7]*v[7]", 6)} AS c0, {sq("v[1]*v[2] + v[4]*v[5] + v[7]*v[8]", 6)} AS c1 FROM m"""
)
def matrix_map(spark, sf):
    df = _matrices(spark, sf).withColumn("t", M.matrix_transpose("m", 3))
    at = lambda m, i: F.get(m, F.lit(i))
    made = {
        "t3": at("t", 3), "sum0": at(M.matrix_sum("m", "m"), 0), "diff1": at(M.matrix_difference("m", "t"), 1), "p0": at(M.matrix_product("m", "m", 3), 0),
        "c0": at(M.matrix_tproduct("m", "m", 3), 0), "c1": at(M.matrix_tproduct("m", "m", 3), 1),
    }
    return df.select("id", "block", *[rd(x, 6).alias(c) for c, x in made.items()])


@query()
def matrix_decompositions(spark, sf):
    df = _matrices(spark, sf)
    for op in ("inverse", "svd", "eigen"):
        df = M.matrix_map(df, "m", op, 3)
    return df.select("id", "block", *[rd(F.get(F.col(op), F.lit(i)), 5).alias(f"{op}{i}") for op in ("inverse", "svd", "eigen") for i in range(3)])


@query(with_views("+p AS (SELECT pid, step, CASE WHEN t >= 1704067200 THEN (t-1704067200) - 500.05*floor((t-1704067200)/500.05) END AS phase FROM trajectories) SELECT pid, step, " + sq("phase", 3) + " AS phase, " + sq(f"CASE WHEN phase IS NULL THEN NULL WHEN phase < 0.05 THEN {2.5 * 9.81 / (2 * math.pi * 10) ** 2!r} * sin({2 * math.pi * 10!r} * phase) ELSE 0 END", 6) + " AS height FROM p", "trajectories"))
def tap_phase(spark, sf):
    phase, height = X.tap_phase("t", 1704067200, 500.0, 10.0, 2.5)
    return A.trajectories(spark, sf).select("pid", "step", rd(phase, 3).alias("phase"), rd(height, 6).alias("height"))


@query("SELECT p_partkey, txt, " + sq("CASE p_partkey % 7 WHEN 0 THEN p_size WHEN 1 THEN p_size*60 WHEN 2 THEN p_size*3600 WHEN 3 THEN p_size*86400 WHEN 4 THEN p_size*604800 WHEN 5 THEN p_size*2592000 END", 2) + " AS seconds FROM (SELECT p_partkey, p_size, concat(p_size, CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'm' WHEN 2 THEN ' h' WHEN 3 THEN 'd' WHEN 4 THEN 'w' WHEN 5 THEN 'mo' ELSE 'y' END) AS txt FROM part)")
def parse_duration(spark, sf):
    unit = F.get(F.array(*[F.lit(u) for u in ("", "m", " h", "d", "w", "mo", "y")]), (F.col("p_partkey") % 7).cast("int"))
    df = A.table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("txt"))
    return df.select("p_partkey", "txt", rd(X.parse_duration("txt"), 2).alias("seconds"))


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS parsed FROM events")
def parse_timestamp_multi(spark, sf):
    ts = F.col("ts")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "dd/MM/yyyy HH:mm:ss")).otherwise(F.lit("soon"))
    df = A.table(spark, sf, "events").select("event_id", text.alias("txt"))
    return df.select("event_id", F.date_format(X.parse_timestamp_multi("txt", ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss"]), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("WITH v AS (SELECT DISTINCT l_discount AS v FROM lineitem), c AS (SELECT n.n AS num, d.d AS den FROM (SELECT unnest(range(0, 6)) AS n) n, (SELECT unnest(range(1, 8)) AS d) d), r AS (SELECT v, num, den, row_number() OVER (PARTITION BY v ORDER BY abs(v - num/den::DOUBLE), num, den) AS k FROM v, c) SELECT l_discount, num, den, count(*) AS n FROM lineitem JOIN r ON l_discount = v AND k = 1 GROUP BY 1, 2, 3")
def rational_approx(spark, sf):
    df = A.table(spark, sf, "lineitem").groupBy("l_discount").agg(F.count(F.lit(1)).alias("n"))
    df = df.withColumn("r", X.rational_approx("l_discount", 5, 7))
    return df.select("l_discount", F.col("r.num").alias("num"), F.col("r.den").alias("den"), "n")


@query("SELECT l_suppkey AS label, " + sq("sum(CASE WHEN l_quantity > l_discount*300 THEN l_quantity ELSE -l_discount*300 END)", 3) + " AS total FROM lineitem GROUP BY 1")
def signed_extreme(spark, sf):
    return A.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("label")).agg(rd(F.sum(X.signed_extreme("l_quantity", F.col("l_discount") * 300)), 3).alias("total"))


@query("SELECT p_partkey, " + sq("CASE WHEN p_retailprice <= 900 THEN 0 WHEN p_retailprice <= 950 THEN (p_retailprice-900)*(1.0::DOUBLE/50) WHEN p_retailprice <= 1100 THEN 1 + (p_retailprice-950)*(-0.5::DOUBLE/150) ELSE 0.5 END", 6) + " AS ramp FROM part")
def piecewise_linear(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", rd(X.piecewise_linear("p_retailprice", [(900, 0), (950, 1), (1100, 0.5)]), 6).alias("ramp"))


@query("SELECT p_partkey, " + sq("10 + (p_retailprice - lo) * (90.0 / (hi - lo))", 6) + " AS scaled FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def rescale(spark, sf):
    return S.rescale(A.table(spark, sf, "part"), "p_retailprice", 10, 100).select("p_partkey", rd("rescaled", 6).alias("scaled"))


@query("SELECT l_suppkey AS label, sum(CASE WHEN round(l_discount*100) = 0 AND round(l_tax*100) = 0 THEN l_quantity ELSE round(l_discount*100) END) AS a, sum(CASE WHEN round(l_discount*100) = 0 AND round(l_tax*100) = 0 THEN 1 ELSE round(l_tax*100) END) AS b FROM lineitem GROUP BY 1")
def coalesce_vector(spark, sf):
    a, b = X.coalesce_vector(["y", "z"], ["x", F.lit(1.0)])
    return A.voxels(spark, sf).select("label", a.alias("a"), b.alias("b")).groupBy("label").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]+)', 1), '') AS ref FROM pages")
def parse_key_values(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", *X.parse_key_values("url", ["page", "ref"]))


@query(with_views("SELECT id, " + sq("CASE WHEN 50 <> z THEN x / (50 - z) END", 5) + " AS px, " + sq("CASE WHEN 50 <> z THEN y / (50 - z) END", 5) + " AS py FROM points3d", "points3d"))
def stereographic_projection(spark, sf):
    px, py = X.stereographic_projection(["x", "y"], "z", 50)
    return A.points3d(spark, sf).select("id", rd(px, 5).alias("px"), rd(py, 5).alias("py"))


@query("SELECT p_partkey, least(levenshtein(lower(p_type), 'economyplated'), levenshtein(lower(p_type), 'economy_plated'), levenshtein(lower(p_type), 'economy-plated'), levenshtein(lower(p_type), 'economy plated'), levenshtein(lower(p_type), 'ep')) AS edits FROM part")
def multi_word_match(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", X.multi_word_match("p_type", ["economy", "plated"]).cast("long").alias("edits"))


# Statistics.


@query("SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high, " + sq("avg(l_extendedprice)") + " AS mean, " + sq("var_samp(l_extendedprice)", 0) + " AS variance, " + sq("var_pop(l_extendedprice)", 0) + " AS population FROM lineitem")
def summary_stats(spark, sf):
    df = A.table(spark, sf, "lineitem")
    a = S.summary_stats(df, "l_extendedprice", "l_orderkey").select("low", "high", rd("mean").alias("mean"), rd("variance", 0).alias("variance"))
    b = S.summary_stats_population(df, "l_extendedprice").select(rd("variance", 0).alias("population"))
    return a.join(F.broadcast(b))  # two one-row summaries


@query("WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem), p AS (SELECT unnest([0, 0.1, 0.5, 1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 95, 99, 99.9, 100]::DOUBLE[]) AS percent) SELECT percent, v AS value FROM p JOIN s ON r = CAST(floor(percent/100*(n-1) + 1e-9) AS BIGINT)")
def percentile_profile(spark, sf):
    return S.percentile_profile(A.table(spark, sf, "lineitem"), "l_extendedprice", 5.0)


@query("WITH b AS (SELECT event_type, hour(ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, arg_min(h, (round(v, 9), h)) AS argmin, " + sq("min(v)", 5) + " AS least FROM b WHERE h BETWEEN 3 AND 20 GROUP BY 1")
def argmin_in_range(spark, sf):
    b = A.table(spark, sf, "events").groupBy("event_type", F.hour("ts").cast("long").alias("h")).agg(F.round(F.avg("value"), 9).alias("v"))
    df = S.argmin_in_range(b, "h", "v", 3, 20, "event_type")
    return df.select("event_type", "argmin", rd("least", 5).alias("least"))


@query("WITH s AS (SELECT CAST(l_quantity AS BIGINT) AS i, CAST(round(l_discount*100) AS BIGINT) AS j, CAST(round(l_tax*100) AS BIGINT) AS scale, max(l_extendedprice) AS strength, min(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY strength DESC, scale) AS k FROM s) SELECT i, j, value AS best_value, scale AS best_scale FROM r WHERE k = 1")
def best_scale(spark, sf):
    df = A.table(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("i"), F.round(F.col("l_discount") * 100).cast("long").alias("j"), F.round(F.col("l_tax") * 100).cast("long").alias("scale")).agg(F.max("l_extendedprice").alias("strength"), F.min("l_extendedprice").alias("value"))
    return S.best_scale(df, ["i", "j"], "scale", "strength", "value")


@query(with_views("SELECT step, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM trajectories GROUP BY step", "trajectories"))
def bounding_box_per_step(spark, sf):
    return S.bounding_box_per_step(A.trajectories(spark, sf), "step")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def counter(spark, sf):
    return S.counter(A.table(spark, sf, "events"), "event_type")


@query("WITH e AS (SELECT l_suppkey % 50 AS ci, CAST(round(l_discount*100) AS BIGINT) AS cj, l_quantity AS v, count(*) AS k FROM lineitem GROUP BY 1, 2, 3) SELECT ci, cj, sum(k)::BIGINT AS n, count(*) AS n_distinct, min(v) AS low, max(v) AS high, " + sq("avg(v)") + " AS mean, max(v)-min(v) AS span, " + sq("(max(v)-min(v))/avg(v)") + " AS rel_span FROM e GROUP BY 1, 2")
def cell_period_stats(spark, sf):
    df = A.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("ci"), F.round(F.col("l_discount") * 100).cast("long").alias("cj"), "l_quantity")
    df = S.cell_period_stats(df, ["ci", "cj"], "l_quantity")
    return df.withColumns({"mean": rd("mean"), "rel_span": rd("rel_span")})


@query("SELECT c_nationkey::BIGINT AS nation, count(*) AS rows, count(DISTINCT c_mktsegment) AS distinct_c_mktsegment, min(c_mktsegment) AS min_c_mktsegment, max(c_mktsegment) AS max_c_mktsegment, count(DISTINCT c_acctbal) AS distinct_c_acctbal, min(c_acctbal) AS min_c_acctbal, max(c_acctbal) AS max_c_acctbal FROM customer GROUP BY 1")
def key_profile(spark, sf):
    return S.key_profile(A.table(spark, sf, "customer").withColumn("nation", F.col("c_nationkey").cast("long")), "nation", ["c_mktsegment", "c_acctbal"])


@query("SELECT concat(c_nationkey, c_mktsegment) AS section, count(*) AS rows, count(DISTINCT c_nationkey) = 1 AND count(DISTINCT c_custkey % 2) = 1 AS consistent FROM customer GROUP BY 1")
def section_consistency(spark, sf):
    df = A.table(spark, sf, "customer").select(F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment").alias("section"), "c_nationkey", (F.col("c_custkey") % 2).alias("half"))
    return S.section_consistency(df, "section", ["c_nationkey", "half"])


_CELLS = "+c AS (SELECT a.i*11+a.j AS cell, a.v/10000 AS c0, b.v/10000 AS c1, c.v/10000 AS c2, d.v/10000 AS c3, a.i % 5 + 1 AS p0, b.j % 4 + 1 AS p1 FROM grid2d a JOIN grid2d b ON b.i=a.i+1 AND b.j=a.j JOIN grid2d c ON c.i=a.i AND c.j=a.j+1 JOIN grid2d d ON d.i=a.i+1 AND d.j=a.j+1)"


@query(with_views(_CELLS + ", q AS (SELECT num, den, num/den::DOUBLE AS q FROM (SELECT unnest(range(1, 12)) AS num), (SELECT unnest(range(1, 12)) AS den) WHERE den <= num AND gcd(num, den) = 1), n AS (SELECT cell, p0, p1, arg_min(q.q, (abs(q.q-least(c0,c1,c2,c3)), q.q)) AS lo, arg_min(q.q, (abs(q.q-greatest(c0,c1,c2,c3)), q.q)) AS hi FROM c, q WHERE c0<>0 AND c1<>0 AND c2<>0 AND c3<>0 GROUP BY 1,2,3) SELECT DISTINCT cell, period FROM (SELECT cell, num AS period FROM n JOIN q ON q.q BETWEEN lo AND hi UNION SELECT cell, p0 FROM n UNION SELECT cell, p1 FROM n)", "grid2d"))
def candidate_periods(spark, sf):
    from ..operators.grid import cell_corners

    cells = cell_corners(A.grid2d(spark, sf), "v").select((F.col("i") * 11 + F.col("j")).alias("cell"), (F.col("v00") / 10000).alias("c0"), (F.col("v10") / 10000).alias("c1"), (F.col("v01") / 10000).alias("c2"), (F.col("v11") / 10000).alias("c3"), (F.col("i") % 5 + 1).alias("p0"), (F.col("j") % 4 + 1).alias("p1"))
    rationals = spark.createDataFrame(X.rational_table(12), "num long, den long")
    return S.candidate_periods(cells, ["c0", "c1", "c2", "c3"], ["p0", "p1"], rationals, 1000)


_TRI = "+q AS (SELECT tri, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2, a.value AS f0, b.value AS f1, c.value AS f2, abs((b.x-a.x)*(c.value-a.value)-(c.x-a.x)*(b.value-a.value))/2 AS area, greatest(sqrt((a.x-b.x)^2+(a.value-b.value)^2), sqrt((b.x-c.x)^2+(b.value-c.value)^2), sqrt((c.x-a.x)^2+(c.value-a.value)^2)) AS longest FROM triangles JOIN vertices a ON v0=a.id JOIN vertices b ON v1=b.id JOIN vertices c ON v2=c.id)"


def _quality(spark, sf):
    v = A.vertices(spark, sf)
    return S.mesh_quality(A.triangles(spark, sf), v.withColumn("y", F.col("value")))


@query(with_views(_TRI + f" SELECT tri, {sq('area', 2)} AS area, {sq('longest', 2)} AS longest, {sq('CASE WHEN area > 0 THEN longest*longest/(2*area) END', 3)} AS aspect, least(f0,f1,f2) <= 35000 AND greatest(f0,f1,f2) >= 35000 AS has_value FROM q", "triangles", "vertices"))
def mesh_quality(spark, sf):
    df = _quality(spark, sf)
    return df.select("tri", rd("area", 2).alias("area"), rd("longest", 2).alias("longest"), rd("aspect", 3).alias("aspect"), ((F.col("low") <= 35000) & (F.col("high") >= 35000)).alias("has_value"))


@query(with_views(_TRI + f" SELECT tri, {sq('p', 4)} AS priority FROM (SELECT tri, greatest(area/2000, coalesce(CASE WHEN area > 0 THEN longest*longest/(2*area) END, 0)/5000) - 1 AS p FROM q) WHERE p > 0 ORDER BY p DESC, tri LIMIT 100", "triangles", "vertices"))
def refinement_priority(spark, sf):
    return S.refinement_priority(_quality(spark, sf), 2000, 5000, 100).select("tri", rd("priority").alias("priority"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS rank FROM part")
def argsort(spark, sf):
    return S.argsort(A.table(spark, sf, "part"), "p_retailprice", "p_partkey").select("p_partkey", "rank")


@query("WITH r AS (SELECT o_orderkey AS id, o_totalprice AS f, o_totalprice * (o_custkey % 7) / 3 AS b FROM orders), p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM (SELECT f AS v FROM r UNION ALL SELECT b FROM r)), c AS (SELECT 0.8::DOUBLE * v AS cut FROM p WHERE k = CAST(floor(0.8::DOUBLE * n) AS BIGINT)) SELECT id, " + sq("CASE WHEN f > b THEN f ELSE -b END") + " AS signed FROM r, c WHERE greatest(f, b) > cut")
def top_fraction(spark, sf):
    df = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("f"), (F.col("o_totalprice") * (F.col("o_custkey") % 7) / 3).alias("b"))
    return S.top_fraction(df, "f", "b", 0.8).select("id", rd("signed").alias("signed"))


_U = "('0x' || substr(md5(concat({}, ':7')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query("SELECT o_orderkey FROM (SELECT o_orderkey, " + _U.format("o_orderkey") + " AS u FROM orders) ORDER BY u, o_orderkey LIMIT (SELECT CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) FROM orders)")
def random_subset(spark, sf):
    return S.random_subset(A.table(spark, sf, "orders"), "10%", "o_orderkey", 7).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, -ln(" + _U.format("o_orderkey") + " + 0.5/4503599627370496.0::DOUBLE) / o_totalprice AS k FROM orders WHERE o_totalprice > 0) ORDER BY k, o_orderkey LIMIT 500")
def weighted_sample(spark, sf):
    return S.weighted_sample(A.table(spark, sf, "orders"), 500, "o_totalprice", "o_orderkey", 7).select("o_orderkey")


@query("SELECT o_orderkey, " + sq("sum(o_totalprice) OVER (ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING) / sum(o_totalprice) OVER ()", 7) + " AS cdf FROM orders")
def weight_cdf(spark, sf):
    return S.weight_cdf(A.table(spark, sf, "orders"), "o_totalprice", "o_orderkey").select("o_orderkey", rd("cdf", 7).alias("cdf"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT avg(o_totalprice) FROM orders)")
def seeds_above_mean(spark, sf):
    return S.seeds_above_mean(A.table(spark, sf, "orders"), "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


def _quad_sql() -> str:
    """Leaves of three levels, each from the points of the split cells of the level before."""
    parts, src = [], "p0"
    ctes = ["p0 AS (SELECT x, y, CAST(o.o_custkey % 13 AS DOUBLE) AS v FROM points2d JOIN orders o ON o_orderkey = id WHERE x BETWEEN 0 AND 600 AND y BETWEEN 0 AND 300)"]
    for d in range(3):
        n = 2**d
        ctes.append(f"c{d} AS (SELECT *, least({n - 1}, CAST(floor(x / (600.0/{n})) AS BIGINT)) AS cx, least({n - 1}, CAST(floor(y / (300.0/{n})) AS BIGINT)) AS cy FROM {src})")
        ctes.append(f"s{d} AS (SELECT cx, cy, count(*) AS n, count(DISTINCT v) AS n_distinct, min(v) AS low, max(v) AS high, (max(v)-min(v)) / (sum(DISTINCT v)/count(DISTINCT v)) AS r FROM c{d} GROUP BY 1, 2)")
        split = "n > 50 AND r > 0.5" if d < 2 else "FALSE"
        ctes.append(f"n{d} AS (SELECT * FROM s{d} WHERE {split})")
        ctes.append(f"p{d + 1} AS (SELECT x, y, v FROM c{d} SEMI JOIN n{d} USING (cx, cy))")
        parts.append(f"SELECT {d}::BIGINT AS depth, cx, cy, n, n_distinct, low, high FROM s{d} WHERE NOT coalesce({split}, FALSE)")
        src = f"p{d + 1}"
    return with_views("+" + ", ".join(ctes) + " " + " UNION ALL ".join(parts), "points2d")


@query(_quad_sql())
def adaptive_cells(spark, sf):
    p = A.points2d(spark, sf).join(A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 13).cast("double").alias("v")), "id")
    return S.adaptive_cells(p, (0, 600, 0, 300), "v", 50, 0.5, 2).select("depth", "cx", "cy", "n", "n_distinct", "low", "high")


@query("WITH g AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY " + _U.format("user_id") + ", user_id LIMIT 40), r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY " + _U.format("event_id") + ", event_id) AS k FROM events SEMI JOIN g USING (user_id)) SELECT event_id, user_id FROM r WHERE k <= 5")
def stratified_sample(spark, sf):
    return S.stratified_sample(A.table(spark, sf, "events"), "user_id", "event_id", 5, 200, 7).select("event_id", "user_id")


@query("WITH s AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS r, count(*) OVER () AS n FROM part), c AS (SELECT v FROM s WHERE r % (n // 9) = 0 AND r // (n // 9) < 9 UNION ALL SELECT max(p_retailprice) + 1 FROM part) SELECT p_partkey, (SELECT count(*) FROM c WHERE c.v <= p_retailprice) - 1 AS bin FROM part")
def equal_count_thresholds(spark, sf):
    part = A.table(spark, sf, "part")
    return S.threshold_bins(part, "p_retailprice", S.equal_count_thresholds(part, "p_retailprice", 10)).select("p_partkey", "bin")


@query("SELECT p_partkey, CAST(floor(o / pitch) AS BIGINT) AS layer FROM (SELECT p_partkey, p_retailprice - lo AS o, 10 + (hi - lo - 5*10) / 4 AS pitch FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)) WHERE o - floor(o / pitch) * pitch < 10")
def layers(spark, sf):
    return S.layers(A.table(spark, sf, "part"), "p_retailprice", 5, 10.0).select("p_partkey", "layer")


@query("SELECT l_quantity, l_discount, min(l_orderkey) AS l_orderkey, count(*) AS copies FROM lineitem GROUP BY 1, 2")
def dedupe_exact(spark, sf):
    return S.dedupe_exact(A.table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_orderkey")
