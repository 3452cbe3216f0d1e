"""Analytic fields, brute force, invariants and edge cases of the operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import expr, tensor
from fieldspark.operators import fit, graph, grid, labels, neighbors, orbits, particles, stats
from fieldspark.operators.components import connected_components
from fieldspark.sources import files


def grid_of(spark, n, **f):
    return spark.createDataFrame([(i, j, *[float(g(i, j)) for g in f.values()]) for i in range(n) for j in range(n)], "i long, j long, " + ", ".join(f"{k} double" for k in f))


def test_gradient_of_linear_field(spark):
    g = grid.grid_gradient(grid_of(spark, 5, v=lambda i, j: 2 * i - 3 * j + 1)).collect()
    assert all(r["d_v_i"] == pytest.approx(2) and r["d_v_j"] == pytest.approx(-3) for r in g)


def test_ftle_of_doubling_map(spark):
    df = grid.ftle_grid(grid_of(spark, 5, fx=lambda i, j: 2 * i, fy=lambda i, j: 2 * j), ["i", "j"], ["fx", "fy"], 3.0)
    assert all(r["ftle"] == pytest.approx(math.log(2) / 3) for r in df.collect())


@pytest.mark.parametrize("field,index,kind", [((1, -1), -1, "saddle"), ((1, 1), 1, "source"), ((-1, -1), 1, "sink")])
def test_index_and_kind(spark, field, index, kind):
    a, b = field
    g = grid_of(spark, 6, u=lambda i, j: a * (i - 2.4), w=lambda i, j: b * (j - 2.3))
    assert [r["index"] for r in grid.cell_index(g).collect() if r["index"]] == [index]
    z = grid.critical_points(g).collect()
    assert len(z) == 1 and z[0]["kind"] == kind and z[0]["x"] == pytest.approx(2.4) and z[0]["y"] == pytest.approx(2.3)


def points(spark, n, seed=1, box=10.0):
    rng = random.Random(seed)
    rows = [(i, rng.random() * box, rng.random() * box) for i in range(n)]
    rows += [(n, 3.0, 3.0), (n + 1, 3.0, 3.0), (n + 2, 4.0, 3.0), (n + 3, 0.0, 5.0), (n + 4, box - 1e-9, 5.0)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double")


@pytest.mark.parametrize("period", [None, 10.0])
def test_radius_join_is_brute_force(spark, period):
    rows, df = points(spark, 120)
    delta = lambda a, b: abs(a - b) if period is None else min(abs(a - b) % period, period - abs(a - b) % period)
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if math.hypot(delta(a[1], b[1]), delta(a[2], b[2])) <= 1.0}
    for crowd in (neighbors.CROWD, 3):
        got = neighbors.radius_join(df, df, 1.0, ["x", "y"], periods=[period, period], self_join=True, crowd=crowd).collect()
        assert {(r["a_id"], r["b_id"]) for r in got} == want and len(got) == len(want)


def test_knn_join_is_brute_force(spark):
    rows, df = points(spark, 60)
    got = {}
    for r in neighbors.knn_join(df, df, 3, ["x", "y"], same=True).collect():
        got.setdefault(r["a_id"], []).append((r["rank"], r["b_id"]))
    for a in rows:
        want = sorted((math.hypot(a[1] - b[1], a[2] - b[2]), b[0]) for b in rows if b[0] != a[0])[:3]
        assert [i for _, i in sorted(got[a[0]])] == [i for _, i in want]


def test_crowded_bins_are_split(spark):
    """Half of the points in one bin: no piece of a side has over twice the bound, and pairs are those of brute force."""
    rng = random.Random(11)
    rows = [(i, 5.05 + rng.random() / 2, 5.05 + rng.random() / 2) for i in range(600)] + [(1000 + i, rng.random() * 40, rng.random() * 40) for i in range(600)]
    a = spark.createDataFrame(rows, "id long, x double, y double")
    b = spark.createDataFrame(rows[::3], "id long, x double, y double")
    got = {(r["a_id"], r["b_id"]) for r in neighbors.radius_join(a, b, 0.2, ["x", "y"], crowd=50).collect()}
    assert got == {(p[0], q[0]) for p in rows for q in rows[::3] if math.hypot(p[1] - q[1], p[2] - q[2]) <= 0.2}
    bins = [F.floor(F.col(c) / 1.0).alias(n) for c, n in (("x", "i"), ("y", "j"))]
    left, right, on = neighbors._split_crowds(a.select(F.col("id").alias("a_id"), *bins), b.select(F.col("id").alias("b_id"), *bins), ["i", "j"], 50)
    sizes = [sorted(r["count"] for r in side.groupBy(*on).count().collect()) for side in (left, right)]
    assert all(s[-1] <= 100 for s in sizes) and left.filter("__pa > 0").count() > 400


def test_knn_of_outliers_and_clusters(spark):
    """Tight clusters, copies, lone points far away, points of b that a lacks, keys, four axes, fewer points than k."""
    rng = random.Random(12)
    rows = [(i, 7.0 + rng.gauss(0, 1e-3), -3.0 + rng.gauss(0, 1e-3), rng.random(), rng.random()) for i in range(150)]
    rows += [(200 + i, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.random(), rng.random()) for i in range(60)]
    rows += [(300 + i, 1.0, 1.0, 0.5, 0.5) for i in range(9)] + [(400, 1e5, -4e4, 0.0, 9.0), (401, -2e4, 3.0, 0.0, 0.0)]
    schema = "id long, x double, y double, z double, u double"
    df, some = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::2], schema)

    def brute(a, b, k, n, same, key=lambda r: 0):
        return {(p[0], rank, q) for p in a for rank, (_, q) in enumerate(sorted((math.dist(p[1 : n + 1], q[1 : n + 1]), q[0]) for q in b if key(p) == key(q) and not (same and p[0] == q[0]))[:k], 1)}

    for left, right, k, n, same in ((rows, rows, 5, 2, True), (rows, rows[::2], 3, 3, False), (rows[::2], rows, 4, 4, True), (rows, rows[:4], 6, 2, False)):
        frames = [df if x is rows else some if x == rows[::2] else spark.createDataFrame(x, schema) for x in (left, right)]
        got = {(r["a_id"], r["rank"], r["b_id"]) for r in neighbors.knn_join(*frames, k, ["x", "y", "z", "u"][:n], same=same).collect()}
        assert got == brute(left, right, k, n, same)
    keyed = df.withColumn("g", F.col("id") % 3)
    got = neighbors.knn_join(keyed, keyed, 4, ["x", "y"], same=True, keys=("g",)).collect()
    assert {(r["a_id"], r["rank"], r["b_id"]) for r in got} == brute(rows, rows, 4, 2, True, lambda r: r[0] % 3)


def test_an_outlier_opens_few_cells(spark):
    """A point far from 40,000 others meets the few cells on the near side of them, not all of their points."""
    b = spark.range(40_000).select("id", (F.rand(3) * 100).alias("x"), (F.rand(4) * 100).alias("y"))
    far = spark.createDataFrame([(-1, 5000.0, 4000.0), (-2, float("nan"), 0.0)], "id long, x double, y double")
    width = neighbors._cell_width(b, ["x", "y"], 3)
    cells, names = neighbors._near_cells(neighbors._known(far, ["x", "y"]), b, 3, width, ["x", "y"], "id", ())
    assert 0 < cells.count() < 30
    got = [r["b_id"] for r in neighbors.knn_join(far, b, 3, ["x", "y"]).orderBy("rank").collect()]
    assert got == [r["id"] for r in b.orderBy(F.hypot(F.col("x") - 5000.0, F.col("y") - 4000.0)).limit(3).collect()]


def test_joins_of_nothing_and_nulls(spark):
    _, df = points(spark, 5)
    empty = df.limit(0)
    assert neighbors.radius_join(df, empty, 1.0, ["x", "y"]).count() == 0
    odd = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, 1.0, 1.0), (4, 1.0, 1.0)], "id long, x double, y double")
    assert [(r["a_id"], r["b_id"]) for r in neighbors.radius_join(odd, odd, 1.0, ["x", "y"], self_join=True).collect()] == [(3, 4)]


def test_components_are_a_partition(spark):
    rng = random.Random(3)
    e = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (1, 2), (2, 1)] + [(100 + i, 101 + i) for i in range(30)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    touched = {x for a, b in e if a != b for x in (a, b)}
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in touched}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_spanning_tree_weight(spark):
    rng = random.Random(5)
    e = sorted((rng.random(), a, b) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.5)
    parent, total, n = list(range(14)), 0.0, 0

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for w, a, b in e:
        a, b = find(a), find(b)
        if a != b:
            parent[a], total, n = b, total + w, n + 1
    t = graph.minimum_spanning_tree(spark.createDataFrame([(a, b, w) for w, a, b in e], "src long, dst long, weight double")).collect()
    assert len(t) == n and sum(r["weight"] for r in t) == pytest.approx(total)


def test_chains_of_curves(spark):
    # 1-2-3 in a row; 4, 5, 6 meet at one point and stay apart; 7-8 close.
    ends = [(1, "a", "b"), (2, "b", "c"), (3, "d", "c"), (4, "x", "p"), (5, "x", "q"), (6, "x", "r"), (7, "m", "n"), (8, "n", "m")]
    got = {r["curve"]: r for r in graph.chain_curves(spark.createDataFrame(ends, "curve long, first string, last string")).collect()}
    assert [got[k]["chain"] for k in (1, 2, 3)] == [1, 1, 1] and [got[k]["place"] for k in (1, 2, 3)] == [0, 1, 2]
    assert [got[k]["chain"] for k in (4, 5, 6)] == [4, 5, 6]
    assert got[7]["chain"] == got[8]["chain"]


def test_slabs_conserve_volume(spark):
    df = spark.createDataFrame([(i, 0.37 * i) for i in range(20)], "id long, y double")
    total = particles.slab_fraction(df, "y", 0.8, 1.3, 1.0).agg(F.sum("fraction")).first()[0]
    assert total == pytest.approx(20 * 4 / 3 * math.pi * 1.3**3)


def test_least_squares_reproduce_polynomials(spark):
    rng = random.Random(2)
    s = spark.createDataFrame([(i, x := rng.random() * 4, y := rng.random() * 4, 1 + 2 * x - y, 1 + x * y - y * y) for i in range(150)], "id long, x double, y double, lin double, quad double")
    q = spark.createDataFrame([(0, 1.0, 1.5), (1, 2.5, 2.0), (2, 90.0, 90.0)], "id long, x double, y double")
    a = {r["id"]: r for r in fit.moving_least_squares(q, s, 1.5, ["x", "y"], "lin", 1).collect()}
    assert a[0]["value"] == pytest.approx(1.5) and a[0]["d_x"] == pytest.approx(2) and a[1]["d_y"] == pytest.approx(-1) and a[2]["value"] is None and a[2]["n"] == 0
    b = {r["id"]: r for r in fit.moving_least_squares(q, s, 1.5, ["x", "y"], "quad", 2).collect()}
    assert b[0]["value"] == pytest.approx(1 + 1.5 - 2.25) and b[1]["d_x"] == pytest.approx(2.0)


def test_rbf_gives_values_back(spark):
    rng = random.Random(4)
    p = spark.createDataFrame([(i, i % 2, rng.random() * 5, rng.random() * 5, rng.random()) for i in range(40)], "id long, g long, x double, y double, v double")
    w = fit.rbf_fit(p, "g", ["x", "y"], "v", 3.0)
    for g in (0, 1):
        own = p.filter(F.col("g") == g)
        back = fit.kernel_interpolate(own, own.join(w.drop("g"), "id"), ["x", "y"], "weight", "wendland", 3.0)
        for r in back.join(own.select("id", "v"), "id").collect():
            assert r["value"] == pytest.approx(r["v"], abs=1e-5)


def test_cos2theta(spark):
    rows = [(1, t / 10, 5 + 0.7 * math.cos(2 * t / 10 + 0.4)) for t in range(50)] + [(2, 0.5, 1.0)]
    got = {r["g"]: r for r in fit.fit_cos2theta(spark.createDataFrame(rows, "g long, t double, v double"), "g", "t", "v").collect()}
    assert got[1]["iso"] == pytest.approx(5) and got[1]["dA"] == pytest.approx(0.7) and got[1]["phi"] == pytest.approx(0.4) and got[1]["chi2"] == pytest.approx(0, abs=1e-6)
    assert got[2]["n"] == 1 and got[2]["chi2"] is None


def test_eigenvalues_are_numpys(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(30, 3, 3))
    m = m + m.transpose(0, 2, 1)
    six = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    df = spark.createDataFrame([(i, *[float(a[p]) for p in six]) for i, a in enumerate(m)] + [(99, 2.0, 0.0, 0.0, 2.0, 0.0, 2.0)], "id long, xx double, xy double, xz double, yy double, yz double, zz double")
    names = ["xx", "xy", "xz", "yy", "yz", "zz"]
    l = tensor.sym_eig3(*names)
    df = df.select("id", *[c.alias(f"l{i}") for i, c in enumerate(l)], *names)
    df = df.select("*", *[c.alias(f"e{i}") for i, c in enumerate(tensor.principal_vector3(*names, "l0"))], tensor.tensor_invariants(*names)["fa"].alias("fa"))
    for r in df.collect():
        assert 0 <= r["fa"] <= 1.2248
        if r["id"] < 99:
            assert [r["l0"], r["l1"], r["l2"]] == pytest.approx(sorted(np.linalg.eigvalsh(m[r["id"]]), reverse=True))
            e = np.array([r["e0"], r["e1"], r["e2"]])
            assert m[r["id"]] @ e == pytest.approx(r["l0"] * e, abs=1e-8)
        else:
            assert r["e0"] is None


def test_label_edge_cases(spark):
    v = spark.createDataFrame([(1, 0.0, 0.0, 0.0, -5.0), (1, 1.0, 0.0, 0.0, -7.0), (2, 1.0, 1.0, 1.0, None), (None, 0.0, 0.0, 0.0, 1.0), (-1, 0.0, 0.0, 0.0, 1.0)], "label long, x double, y double, z double, value double")
    assert {r["label"]: r["size"] for r in labels.label_sizes(v).collect()} == {1: 2, 2: 1}
    span = {r["label"]: (r["low"], r["high"]) for r in labels.label_span(v).collect()}
    assert span[1] == (-7.0, -5.0) and span[2] == (None, None)
    assert labels.label_shape(v.limit(0)).count() == 0


def test_values_at_ranks_are_exact(spark):
    rng = random.Random(9)
    vals = [rng.choice([1.0, 2.5, 2.5, rng.random() * 1e6]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    ranks = [0, 1, 100, 250, 498, 499]
    assert stats.values_at_ranks(df, "v", ranks) == {r: sorted(vals)[r] for r in ranks}
    assert stats.values_at_ranks(df.limit(0), "v", [0]) == {}


def test_orbits_of_one_step(spark):
    t = spark.createDataFrame([(1, 0, 1.0, 2.0), (2, 0, 0.0, 0.0), (2, 1, 3.0, 4.0)], "pid long, step long, x double, y double")
    got = {r["pid"]: r["mean_distance"] for r in orbits.average_distance(t, 1).collect()}
    assert got == {1: None, 2: 5.0}
    assert {r["pid"]: r["best_period"] for r in orbits.best_period(t, 3).collect()} == {1: None, 2: 1}


def test_expressions(spark):
    r = spark.range(1).select(expr.parse_duration(F.lit("2h")).alias("a"), expr.parse_duration(F.lit("soon")).alias("b"), expr.periodic_displacement(F.lit(0.5), F.lit(9.5), 10.0).alias("c"), expr.signed_angle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"), expr.seconds_text(F.lit(3725)).alias("e")).first()
    assert r["a"] == 7200 and r["b"] is None and r["c"] == -1 and r["d"] == pytest.approx(math.pi / 2) and r["e"] == "1:02:05"


def test_raster_and_netcdf(spark, tmp_path):
    import struct

    data = np.arange(12, dtype=float)
    (tmp_path / "a.nrrd").write_bytes(files.raster_bytes(data, [4, 3], [1.0, float("nan")]))
    got = {(r["i"], r["j"]): r["value"] for r in files.read_raster(spark, str(tmp_path / "a.nrrd")).collect()}
    assert got[3, 2] == 11 and len(got) == 12
    assert files.parse_raster((tmp_path / "a.nrrd").read_bytes())[0]["spacings"] == [1.0, 1.0]
    word = lambda *x: struct.pack(f">{len(x)}i", *x)
    name = lambda s: word(len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    dims = word(10, 3) + name("time") + word(0) + name("lat") + word(2) + name("lon") + word(2)
    var = lambda s, ids, size, at: name(s) + word(len(ids), *ids) + word(0, 0) + word(6, size, at)
    shape = lambda a: b"CDF\x01" + word(2) + dims + word(0, 0) + word(11, 4) + var("time", [0], 8, a[0]) + var("lat", [1], 16, a[1]) + var("lon", [2], 16, a[2]) + var("water_u", [0, 1, 2], 32, a[3])
    n = len(shape([0] * 4))
    body = struct.pack(">2d", 1, 2) + struct.pack(">2d", 5, 6) + b"".join(struct.pack(">5d", 10 + t, *[100 * t + k for k in range(4)]) for t in range(2))
    (tmp_path / "b.nc").write_bytes(shape([n + 32, n, n + 16, n + 40]) + body)
    rows = files.read_gridded_variables(spark, str(tmp_path / "b.nc"), ["water_u"]).collect()
    assert {(r["t"], r["lat"], r["lon"]): r["water_u"] for r in rows}[11.0, 2.0, 5.0] == 102.0 and len(rows) == 8


def test_isomap_recovers_a_line(spark):
    import numpy as np

    t = np.linspace(0, 3, 40)
    v = spark.createDataFrame([(i, [float(math.cos(x)), float(math.sin(x))]) for i, x in enumerate(t)], "id long, v array<double>")
    got = sorted((r["id"], r["coords"][0]) for r in graph.isomap(v, 2, 40, 1).collect())
    line = np.array([c for _, c in got])
    assert abs(np.corrcoef(line, t)[0, 1]) > 0.9999


def test_orbits_are_compared_whole(spark):
    """Two orbits that come back to the circle's places after 100 steps: neighbours, links and chains against brute force."""
    rng = random.Random(9)
    turn = lambda i: 2 * math.pi * (i % 100 + 0.3 * (i // 100) + rng.random() * 0.1) / 100
    rows = [(p, i, (p + 1) * math.cos(a), (p + 1) * math.sin(a)) for p in range(2) for i in range(200) for a in [turn(i)]]
    df = spark.createDataFrame(rows, "pid long, step long, x double, y double")
    t = {(r["pid"], r["step"]): r for r in orbits.orbit_tangent(df, 3).collect()}
    near, best = {}, {}
    for p in range(2):
        own = [r for r in rows if r[0] == p]
        for _, i, x, y in own:
            d = sorted((math.hypot(u - x, v - y), j, u - x, v - y) for _, j, u, v in own if j != i)
            near[p, i] = d
            m = sum(np.outer(q[2:], q[2:]) / q[0] ** 2 for q in d[:3])
            w, v = np.linalg.eigh(m)
            assert t[p, i]["strength"] == pytest.approx(w[1]) and abs(t[p, i]["tx"] * v[0, 1] + t[p, i]["ty"] * v[1, 1]) == pytest.approx(1)
            for side in (True, False):
                hit = [q[1] for q in d if (q[2] * t[p, i]["tx"] + q[3] * t[p, i]["ty"] > 0) == side]
                best.setdefault((p, i), set()).update(hit[:1])
    want = {(p, i, j) for (p, i), js in best.items() for j in js if i < j and i in best[p, j]}
    links = orbits.curve_links(df, orbits.orbit_tangent(df, 3))
    assert {tuple(r) for r in links.select("pid", "i", "j").collect()} == want and any(j - i > 64 for _, i, j in want)
    short = orbits.curve_links(df, orbits.orbit_tangent(df, 3), max_dist=0.03)
    far = {(p, i): dict((q[1], q[0]) for q in near[p, i]) for p, i in near}
    assert {tuple(r) for r in short.select("pid", "i", "j").collect()} == {k for k in want if far[k[0], k[1]][k[2]] <= 0.03}
    chains = {(r["pid"], r["step"]): r["chain"] for r in orbits.link_chains(df, links).collect()}
    parent = {(p, i): i for p, i, *_ in rows}
    for _ in rows:
        for p, i, j in want:
            parent[p, i] = parent[p, j] = min(parent[p, i], parent[p, j])
    assert chains == parent


def test_long_chains_have_places(spark):
    """An open chain of 450 curves whose ids are shuffled, a ring of 300, and two curves that meet at both ends."""
    ids = list(range(450))
    random.Random(4).shuffle(ids)
    ends = [(ids[i], f"a{i}", f"a{i + 1}") for i in range(450)] + [(1000 + i, f"r{i}", f"r{(i + 1) % 300}") for i in range(300)] + [(2000, "m", "n"), (2001, "n", "m")]
    got = {r["curve"]: r for r in graph.chain_curves(spark.createDataFrame(ends, "curve long, first string, last string")).collect()}
    line = ids if ids[0] < ids[-1] else ids[::-1]
    assert all((got[c]["chain"], got[c]["place"], got[c]["closed"]) == (0, k, False) for k, c in enumerate(line))
    assert all((got[1000 + i]["chain"], got[1000 + i]["place"], got[1000 + i]["closed"]) == (1000, None, True) for i in range(300))
    assert all(got[c]["chain"] == 2000 and got[c]["closed"] and got[c]["place"] is None for c in (2000, 2001)) and len(got) == 752


def test_paths_settle(spark):
    """A light path of 12 edges beats a heavy one of one edge; a limit holds only if given, and a safety limit raises."""
    e = [(i, i + 1, 1.0) for i in range(12)] + [(0, 12, 20.0), (12, 13, 1.0)]
    edges = graph.both_ways(spark.createDataFrame(e, "src long, dst long, weight double"))
    src = spark.range(1).select(F.col("id").alias("source"))
    assert {r["id"]: r["dist"] for r in graph.shortest_paths(edges, src).collect()} == {i: float(i) for i in range(14)}
    assert {r["id"]: r["dist"] for r in graph.shortest_paths(edges, src, 2).collect()} == {0: 0.0, 1: 1.0, 2: 2.0, 11: 21.0, 12: 20.0, 13: 21.0}
    with pytest.raises(RuntimeError):
        graph.shortest_paths(edges, src, max_rounds=3)


def test_dump_steps_are_bounded(spark):
    from fieldspark.plans import queries_fit

    e = spark.range(25_000).select(F.col("id").alias("event_id"), F.lit(0.5).alias("value"), F.lit(7).cast("long").alias("step"))
    n = [r["value"].split("ITEM: ATOMS id value\n")[1].count("\n") + 1 for r in queries_fit._dump_steps(e).collect()]
    assert sorted(n) == [5_000, 10_000, 10_000]


def test_eigenvectors_of_2x2(spark):
    rng = random.Random(4)
    rows = [tuple(rng.uniform(-3, 3) for _ in range(4)) for _ in range(50)] + [(1.0, 0.0, 0.0, 2.0), (2.0, 0.0, 0.0, 1.0), (1.0, 5.0, 0.0, -1.0), (0.0, 1.0, -1.0, 0.0), (2.0, 0.0, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").coalesce(1)
    for m, got in zip(rows, df.select(*tensor.eigenvectors2("a", "b", "c", "d")).collect()):
        m, (x0, y0, x1, y1) = np.array(m).reshape(2, 2), got
        values, vectors = np.linalg.eig(m)
        if np.iscomplex(values).any() or np.allclose(m, m[0, 0] * np.eye(2)):
            assert x0 is None and y1 is None
            continue
        order = np.argsort(-values.real)
        for v, k in zip(((x0, y0), (x1, y1)), order):
            assert abs(v @ vectors[:, k]) == pytest.approx(1.0)


def test_similar_saddles_share_their_axes(spark):
    """Two near saddles of equal axes are one, a third is turned; a source meets a sink, but no saddle."""
    z = [(1, 0.0, 0.0, "saddle", 1.0, 0.0, 0.0, -1.0), (2, 0.5, 0.0, "saddle", 2.0, 0.1, 0.0, -3.0), (3, 0.5, 0.5, "saddle", 0.0, 1.0, 1.0, 0.0), (4, 0.2, 0.2, "source", 1.0, 0.0, 0.0, 1.0), (5, 0.2, 0.4, "spiral sink", -1.0, 2.0, -2.0, -1.0), (6, 9.0, 0.0, "saddle", 1.0, 0.0, 0.0, -1.0)]
    got = grid.similar_critical_points(spark.createDataFrame(z, "id long, x double, y double, kind string, jxx double, jxy double, jyx double, jyy double"), 1.0)
    assert {r["id"]: r["kept"] for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


def test_stretching_of_linear_flows(spark):
    """The map x -> A x + b has the stretching ln of A's largest squared singular value, in two and three dimensions; particles in a plane have none."""
    rng = random.Random(6)
    for axes, a in ((["x", "y"], [[2.0, 0.3], [-0.1, 0.5]]), (["x", "y", "z"], [[1.5, 0.2, 0.0], [0.0, 0.7, -0.4], [0.3, 0.0, 2.5]])):
        d, back = len(axes), np.linalg.inv(np.array(a)) * 0.5
        places = [[rng.uniform(0, 3) for _ in axes] for _ in range(80)]
        rows = [(i, *p, *map(float, np.array(a) @ p + 1.0), *map(float, back @ p - 2.0)) for i, p in enumerate(places)]
        schema = "pid long, " + ", ".join(f"{c}{k} double" for k in ("", "_after", "_before") for c in axes)
        flow = spark.createDataFrame(rows, schema)
        want = [max(0.0, 2 * math.log(np.linalg.svd(np.array(m), compute_uv=False)[0])) for m in (a, back)]
        for r in fit.ftle_particles(flow, 4.0, axes).collect():
            assert [r["ftle_after"], r["ftle_before"]] == pytest.approx(want, abs=1e-6)
        v = fit.ftle_volume(flow, [(1.0, 2.0)] * d, [3] * d, 4.0, (1.5, 1.5), 0.6, axes).collect()
        assert len(v) == 5 * 3 ** (d - 2) and all(r["signed"] == pytest.approx(want[0] if want[0] > want[1] else -want[1], abs=1e-6) for r in v)
        flat = flow.filter("pid < 9").withColumn(axes[-1], F.lit(1.0))
        assert all(r["ftle_after"] is None for r in fit.ftle_particles(flat, 4.0, axes).collect())
        assert all(r["ftle_after"] is None for r in fit.ftle_particles(flow.filter("pid < 3"), 9.0, axes).collect())


def test_chains_are_turned_and_filtered(spark):
    rng = random.Random(7)
    chains = {i: [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(rng.randint(3, 7))] for i in range(12)}
    for i in range(12, 30):  # turned and shaken copies, chained
        base = chains[rng.randrange(i)]
        k = rng.randrange(len(base))
        chains[i] = [(x + rng.uniform(-0.4, 0.4), y + rng.uniform(-0.4, 0.4)) for x, y in base[k:] + base[:k]]

    def apart(a, b):
        s = min(range(len(b)), key=lambda k: (math.dist(a[0], b[k]), k))
        return sum(math.dist(p, b[(i + s) % len(b)]) for i, p in enumerate(a)) / len(a)

    df = spark.createDataFrame([(c, i, *p) for c, ps in chains.items() for i, p in enumerate(ps)], "chain long, pos long, x double, y double")
    want = {j for j in chains if not any(apart(chains[i], chains[j]) < 0.5 for i in range(j))}
    assert 12 <= len(want) < 25 and {r["chain"] for r in neighbors.unique_chains(df, 0.5, ["x", "y"]).collect()} == want
    pairs = spark.createDataFrame([(0, 1), (3, 20)], "chain_a long, chain_b long")
    assert {(r["chain_a"], round(r["distance"], 9)) for r in neighbors.chain_distance(df, pairs, ["x", "y"]).collect()} == {(a, round(apart(chains[a], chains[b]), 9)) for a, b in ((0, 1), (3, 20))}


def test_upsampling_is_linear(spark):
    """A field that is linear in each axis comes back at all new nodes; a missing node leaves a hole."""
    f = lambda i, j, k: 1 + 2 * i - j + 0.5 * k + i * j * k
    nodes = [(i, j, k, float(f(i, j, k))) for i in range(3) for j in range(4) for k in range(2)]
    got = {(r["i"], r["j"], r["k"]): r["v"] for r in grid.upsample(spark.createDataFrame(nodes, "i long, j long, k long, v double"), {"i": 2, "j": 3, "k": 4}).collect()}
    assert set(got) == {(i, j, k) for i in range(5) for j in range(10) for k in range(5)}
    assert all(v == pytest.approx(f(i / 2, j / 3, k / 4)) for (i, j, k), v in got.items())
    line = spark.createDataFrame([(0, 1.0), (1, 3.0), (3, 5.0)], "i long, v double")
    assert sorted(tuple(r) for r in grid.upsample(line, {"i": 2}).collect()) == [(0, 1.0), (1, 2.0), (2, 3.0), (6, 5.0)]


@pytest.mark.parametrize("periods", [None, [2 * math.pi, None], [4.0, 3.0]])
def test_closest_pair_is_brute_force(spark, periods):
    rng = random.Random(8)
    rows = [(p, i, rng.uniform(-6, 6), rng.uniform(0, 3) if p else 1.0) for p in range(4) for i in range(rng.randint(2, 40))] + [(9, 0, 1.0, 1.0)]
    rows += [(5, i, float(i % 3), 0.5) for i in range(8)]

    def d(a, b):
        out = 0.0
        for u, v, p in zip(a, b, periods or [None, None]):
            x = abs(u - v) if p is None else min(abs(u - v) % p, p - abs(u - v) % p)
            out += x * x
        return math.sqrt(out)

    want = {}
    for pid in {r[0] for r in rows} - {9}:
        own = [r for r in rows if r[0] == pid]
        want[pid] = min((round(d(a[2:], b[2:]), 9), a[1], b[1]) for a, b in itertools.combinations(own, 2))
    got = orbits.period_from_closest_pair(spark.createDataFrame(rows, "pid long, step long, x double, y double"), 1.0, periods=periods).collect()
    assert {r["pid"]: (round(r["distance"], 9), r["i"], r["j"]) for r in got} == want


def test_closest_pair_of_a_long_orbit(spark):
    """100,000 steps: a pair that was put in is found; there are 5,000,000,000 pairs of steps."""
    n = 100_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("pid"), F.col("id").alias("step"), ((F.col("id") % 1000) + 0.3 * F.rand(1)).alias("x"), (F.floor(F.col("id") / 1000) + 0.3 * F.rand(2)).alias("y"))
    df = df.filter("step <> 77777").unionByName(df.filter("step = 1234").select("pid", F.lit(77_777).cast("long").alias("step"), (F.col("x") + 1e-7).alias("x"), "y"))
    got = orbits.period_from_closest_pair(df, 1.0).collect()
    assert [(r["i"], r["j"]) for r in got] == [(1234, 77777)]


def test_dump_steps_larger_than_a_split(spark, tmp_path):
    """Steps of many splits, headers at any place of a split, a truncated step, two files: the rows of a plain parse."""
    rng = random.Random(9)
    want, paths = set(), []
    for f in range(2):
        lines = []
        for step in (5, 90 + f, 7, 1000):
            n, short = rng.choice([0, 3, 150, 400]), step == 7
            lines += ["ITEM: TIMESTEP", str(step), "ITEM: NUMBER OF ATOMS", str(n + short), "ITEM: BOX BOUNDS pp pp pp", f"0 {step}", "0 2", f"0 {f}", "ITEM: ATOMS id x f"]
            for i in range(n):
                x = round(rng.random(), 6)
                lines.append(f" {i}  {x} {step + f}.5")
                if not short:
                    want.add((step, f"0 {step}\n0 2\n0 {f}", float(i), x, step + f + 0.5))
        paths.append(tmp_path / f"dump{f}.txt")
        paths[-1].write_text("\n".join(lines) + "\n")
    assert len(want) > 300
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (64, 257, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            df = files.read_particle_dump(spark, [str(p) for p in paths])
            got = [tuple(r) for r in df.collect()]
            assert len(got) == len(want) and set(got) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_percentiles_take_a_job_a_round(spark):
    rng = random.Random(10)
    values = [rng.choice([1.5, 2.5]) if rng.random() < 0.4 else rng.gauss(0, 1) ** 9 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values)
    ranks = list(range(0, 3000, 37)) + [2999]
    assert stats.values_at_ranks(df, "v", ranks) == {k: ordered[k] for k in ranks}
    assert stats.values_at_ranks(df.filter("v > 1e300"), "v", [0]) == {}


def test_sparse_weights_give_the_values_back(spark):
    """A group above the dense solver's bound: conjugate gradients reproduce the values, and agree with the dense weights."""
    rng = random.Random(13)
    rows = [(g, i, (i % 12) + rng.uniform(-0.2, 0.2), i // 12 + rng.uniform(-0.2, 0.2), rng.uniform(-5, 5)) for g, n in ((1, 140), (2, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, id long, x double, y double, v double")
    dense = {(r["g"], r["id"]): r["weight"] for r in fit.rbf_fit(df, "g", ["x", "y"], "v", 1.8).collect()}
    got = {(r["g"], r["id"]): r["weight"] for r in fit.rbf_fit(df, "g", ["x", "y"], "v", 1.8, most=50).collect()}
    assert set(got) == set(dense) and all(got[k] == pytest.approx(dense[k], abs=1e-4) for k in dense)
    for g, i, x, y, v in rows[::17]:
        r = [(math.hypot(x - b[2], y - b[3]) / 1.8, got[g, b[1]]) for b in rows if b[0] == g]
        assert sum(w * (1 - d) ** 4 * (4 * d + 1) for d, w in r if d < 1) == pytest.approx(v, abs=1e-4)


def test_scaling_of_all_rows_keeps_distances(spark):
    """Points of a plane in 20 dimensions: two coordinates keep all distances; numpy's classical scaling gives the same."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 20)) + 1000.0
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>").repartition(3)
    got = {r["id"]: np.array(r["coords"]) for r in graph.classical_mds(df, 2).collect()}
    y = np.array([got[i] for i in range(60)])
    far = lambda z: np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    assert np.allclose(far(x), far(y), atol=1e-6)
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred @ centred.T)
    for k in range(2):
        want = vectors[:, -1 - k] * math.sqrt(values[-1 - k])
        assert np.allclose(np.abs(y[:, k]), np.abs(want), atol=1e-6)
    assert graph.classical_mds(df.limit(0), 2).count() == 0


def test_adaptive_cells_are_written(spark):
    """A deep tree's plan is no deeper than a shallow one's: each level is a written table."""
    df = spark.range(400).select((F.rand(1) ** 8).alias("x"), (F.rand(2) ** 8).alias("y"), F.rand(3).alias("v"))
    deep = stats.adaptive_cells(df, (0.0, 1.0, 0.0, 1.0), "v", 3, 0.1, 12)
    assert deep.agg(F.sum("n")).first()[0] == 400 and deep.agg(F.max("depth")).first()[0] > 8
    plan = deep._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_matrix_decompositions_are_numpys(spark, sf):
    from fieldspark.plans.catalogue import QUERIES

    v = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(20).collect()}
    got = QUERIES["matrix_decompositions"](spark, sf).filter(F.col("id").isin(list(v))).collect()
    assert len(got) == 7 * len(v)
    for r in got:
        m = v[r["id"]][9 * r["block"] : 9 * r["block"] + 9].reshape(3, 3)
        assert [r[f"svd{i}"] for i in range(3)] == pytest.approx(np.linalg.svd(m, compute_uv=False), abs=1e-4)
        assert [r[f"inverse{i}"] for i in range(3)] == pytest.approx(np.linalg.inv(m)[0], rel=1e-3, abs=1e-3)


def test_projections_are_on_principal_axes(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(200, 3)) @ np.diag([5.0, 1.0, 0.2]) + [10.0, -3.0, 100.0]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(x.tolist())], "id long, x double, y double, z double")
    got, cov, mean = grid.pca_project(df, ["x", "y", "z"], (2, 1), "id")
    assert np.allclose(cov, np.cov(x.T, bias=True), atol=1e-6) and np.allclose(mean, x.mean(0))
    p = np.array([[r["p0"], r["p1"]] for r in got.orderBy("id").collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(np.abs(p), np.abs((x - x.mean(0)) @ vectors[:, [2, 1]]), atol=1e-6) and np.allclose(p.var(0), values[[2, 1]])


def test_landmarks_of_all_rows_are_classical_scaling(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "id long, v array<double>")
    a, b = ({r["id"]: np.array(r["coords"]) for r in d.collect()} for d in (graph.landmark_mds(df, 50, 2), graph.classical_mds(df, 2)))
    assert all(np.allclose(np.abs(a[i]), np.abs(b[i]), atol=1e-6) for i in range(50))


def test_travel_times_of_one_velocity(spark):
    """Times of a constant velocity leave no residual: at every node the time is the distance over it."""
    rng = random.Random(17)
    places = [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(40)]
    rows = [(1, 0.0, 0.0, i, x, y, math.hypot(x, y), math.hypot(x, y) / 5) for i, (x, y) in enumerate(places)]
    schema = "src long, sx double, sy double, rcv long, x double, y double, dist double, tt double"
    nodes = spark.createDataFrame([(i, float(i % 7 - 3) * 2, float(i // 7 - 3) * 2) for i in range(49)], "id long, x double, y double")
    got = fit.travel_time_field(spark.createDataFrame(rows, schema), nodes, 4.0, 0.5).collect()
    assert len(got) > 30
    for r in got:
        x, y = (r["id"] % 7 - 3) * 2, (r["id"] // 7 - 3) * 2
        assert r["time"] == pytest.approx(math.hypot(x, y) / 5, abs=1e-6) and r["slowness"] == pytest.approx(0.2, abs=1e-6)
        assert r["azimuth"] == pytest.approx(math.atan2(y, x) % (2 * math.pi), abs=1e-9)
