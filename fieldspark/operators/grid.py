"""Gridded fields as tables (i, j, ..., v): derivatives, stretching, ridges, critical points, meshes."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import signed_angle
from ..functions.tensor import eigenvectors2, sym_eig2, sym_eig3
from ..plans.scratch import materialise
from .components import connected_components
from .neighbors import radius_join


def _neighbours(grid: DataFrame, axes: list[str], axis: str, columns: list[str]) -> DataFrame:
    """`grid` with <c>_p and <c>_m: the values one step up and down the axis, NULL where that node is missing."""
    w = Window.partitionBy(*[a for a in axes if a != axis]).orderBy(axis)
    out = {}
    for c in columns:
        out[f"{c}_p"] = F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(c).over(w))
        out[f"{c}_m"] = F.when(F.lag(axis).over(w) == F.col(axis) - 1, F.lag(c).over(w))
    return grid.withColumns(out)


def grid_gradient(grid: DataFrame, axes: list[str] = ("i", "j"), values: list[str] = ("v",), spacing: list[float] | None = None) -> DataFrame:
    """`grid` with d_<value>_<axis>: central differences inside, one-sided at borders, NULL for a lone node."""
    spacing = spacing or [1.0] * len(axes)
    for a, h in zip(axes, spacing):
        grid = _neighbours(grid, list(axes), a, list(values))
        for c in values:
            p, m, v = F.col(f"{c}_p"), F.col(f"{c}_m"), F.col(c)
            d = F.when(p.isNotNull() & m.isNotNull(), (p - m) / F.lit(2.0 * h)).when(p.isNotNull(), (p - v) / F.lit(float(h))).when(m.isNotNull(), (v - m) / F.lit(float(h)))
            grid = grid.withColumn(f"d_{c}_{a}", d).drop(f"{c}_p", f"{c}_m")
    return grid


def ftle_grid(flow: DataFrame, axes: list[str], values: list[str], T: float, spacing: list[float] | None = None, base: float | None = None, root: bool = True) -> DataFrame:
    """`flow` (end positions `values` at nodes) with ftle: ln of the largest stretching over |T|; 0 where nothing stretches.

    `root` takes the square root of the Cauchy-Green eigenvalue, `base` another base of the logarithm.
    """
    g = grid_gradient(flow, axes, values, spacing)
    J = [[F.col(f"d_{v}_{a}") for a in axes] for v in values]
    C = lambda p, q: reduce(lambda a, b: a + b, [row[p] * row[q] for row in J])
    high = sym_eig2(C(0, 0), C(0, 1), C(1, 1))[0] if len(axes) == 2 else sym_eig3(C(0, 0), C(0, 1), C(0, 2), C(1, 1), C(1, 2), C(2, 2))[0]
    scale = (0.5 if root else 1.0) / abs(T) / (float(np.log(base)) if base else 1.0)
    g = g.withColumn("stretch", high)
    return g.withColumn("ftle", F.when(F.col("stretch") > 0, F.lit(scale) * F.log("stretch")).when(F.col("stretch").isNotNull(), F.lit(0.0)))


def eigen_ftle(forward: DataFrame, backward: DataFrame, axes: list[str], values: list[str], T: float, spacing: list[float] | None = None) -> DataFrame:
    """Per node (high, low): forward and backward stretching, the branch chosen by the forward direction.

    Where the forward map's principal direction points more along the second axis, the two are swapped.
    """
    f = ftle_grid(forward, axes, values, T, spacing)
    J = [[F.col(f"d_{v}_{a}") for a in axes] for v in values]
    C = lambda p, q: reduce(lambda a, b: a + b, [row[p] * row[q] for row in J])
    _, _, cx, cy = sym_eig2(C(0, 0), C(0, 1), C(1, 1))
    f = f.select(*axes, F.col("ftle").alias("f"), (F.abs(cy) > F.abs(cx)).alias("swap"))
    b = ftle_grid(backward, axes, values, T, spacing).select(*axes, F.col("ftle").alias("b"))
    out = f.join(b, list(axes))
    return out.select(*axes, F.when(F.col("swap"), F.col("b")).otherwise(F.col("f")).alias("high"), F.when(F.col("swap"), F.col("f")).otherwise(F.col("b")).alias("low"))


def hessian2d(grid: DataFrame, value: str = "v") -> DataFrame:
    """`grid` with gradient gx, gy and Hessian hxx, hxy, hyy by two rounds of differences."""
    g = grid_gradient(grid, ["i", "j"], [value]).withColumnsRenamed({f"d_{value}_i": "gx", f"d_{value}_j": "gy"})
    h = grid_gradient(g, ["i", "j"], ["gx", "gy"])
    return h.select(*grid.columns, "gx", "gy", F.col("d_gx_i").alias("hxx"), ((F.col("d_gx_j") + F.col("d_gy_i")) / 2).alias("hxy"), F.col("d_gy_j").alias("hyy"))


def ridge_points(grid: DataFrame, threshold: float, value: str = "v") -> DataFrame:
    """Nodes with a Hessian eigenvalue below the threshold whose slope along its direction changes sign towards one of the 8 neighbours.

    The neighbour's eigenvalue must be the larger, so of two nodes beside a ridge the sharper one is kept.
    """
    h = hessian2d(grid, value)
    high, low, ex, ey = sym_eig2("hxx", "hxy", "hyy")
    h = materialise(h.select("i", "j", value, "gx", "gy", low.alias("low"), (-ey).alias("ex"), ex.alias("ey")), "hessian")
    around = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    own = h.filter(F.col("low") < F.lit(float(threshold))).withColumn("d", F.explode(around)).withColumns({"ni": F.col("i") + F.col("d.di"), "nj": F.col("j") + F.col("d.dj")})
    other = h.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("gx").alias("ngx"), F.col("gy").alias("ngy"), F.col("low").alias("nlow"), F.col("ex").alias("nex"), F.col("ey").alias("ney"))
    both = own.join(other, ["ni", "nj"])
    turn = F.when(F.col("ex") * F.col("nex") + F.col("ey") * F.col("ney") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    slope, nslope = F.col("gx") * F.col("ex") + F.col("gy") * F.col("ey"), turn * (F.col("ngx") * F.col("nex") + F.col("ngy") * F.col("ney"))
    return both.filter((slope * nslope < 0) & (F.col("nlow") > F.col("low"))).groupBy("i", "j").agg(F.first("low").alias("strength"), F.count(F.lit(1)).alias("crossings"))


def cell_corners(grid: DataFrame, *values: str) -> DataFrame:
    """One row per cell with all four corners: i, j and <value>00, 10, 01, 11 (first axis, second axis)."""
    at = lambda a, b: grid.select((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), *[F.col(v).alias(f"{v}{a}{b}") for v in values])
    return at(0, 0).join(at(1, 0), ["i", "j"]).join(at(0, 1), ["i", "j"]).join(at(1, 1), ["i", "j"])


def cell_index(grid: DataFrame, u: str = "u", v: str = "w") -> DataFrame:
    """The Poincare index of each cell: the turning of the corner vectors around it, in whole turns."""
    c = cell_corners(grid, u, v)
    ring = ["00", "10", "11", "01"]
    total = reduce(lambda a, b: a + b, [signed_angle(f"{u}{p}", f"{v}{p}", f"{u}{q}", f"{v}{q}") for p, q in zip(ring, ring[1:] + ring[:1])])
    return c.select("i", "j", F.round(total / F.lit(2 * np.pi)).cast("long").alias("index"))


def critical_points(grid: DataFrame, u: str = "u", v: str = "w") -> DataFrame:
    """Zeros of the vector field, linear on the two triangles of each cell: position, Jacobian (jxx, jxy, jyx, jyy) and kind.

    Kinds, from trace and determinant: saddle, source, sink, spiral source, spiral sink, centre.
    """
    c = cell_corners(grid, u, v)
    halves = [(("00", "10", "01"), (0, 0), (1, 0), (0, 1)), (("11", "01", "10"), (1, 1), (0, 1), (1, 0))]
    rows = []
    for k, (names, p0, p1, p2) in enumerate(halves):
        (u0, u1, u2), (v0, v1, v2) = ([F.col(f"{f}{n}") for n in names] for f in (u, v))
        a, b, cc, d = u1 - u0, u2 - u0, v1 - v0, v2 - v0
        det = a * d - b * cc
        s, t = (-u0 * d + v0 * b) / det, (-a * v0 + cc * u0) / det
        sign = 1 if k == 0 else -1  # the second triangle's edges run against the axes
        dx, dy = (p1[0] - p0[0], p2[0] - p0[0]), (p1[1] - p0[1], p2[1] - p0[1])
        x, y = F.col("i") + p0[0] + s * dx[0] + t * dx[1], F.col("j") + p0[1] + s * dy[0] + t * dy[1]
        # Jacobian in (i, j): the triangles' edges are the axes, up to sign.
        jxx, jxy, jyx, jyy = (a * sign, b * sign, cc * sign, d * sign)
        inside = (det != 0) & (s >= 0) & (t >= 0) & (s + t <= 1)
        rows.append(F.when(inside, F.struct(F.lit(k).cast("long").alias("half"), x.alias("x"), y.alias("y"), (jxx + jyy).alias("trace"), (jxx * jyy - jxy * jyx).alias("det"), jxx.alias("jxx"), jxy.alias("jxy"), jyx.alias("jyx"), jyy.alias("jyy"))))
    z = c.select("i", "j", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("z")).select("i", "j", "z.*")
    spiral = F.col("trace") * F.col("trace") < 4 * F.col("det")
    kind = F.when(F.col("det") < 0, "saddle").when(F.abs("trace") < 1e-12, "centre").when(spiral, F.when(F.col("trace") > 0, "spiral source").otherwise("spiral sink")).otherwise(F.when(F.col("trace") > 0, "source").otherwise("sink"))
    return z.withColumn("kind", kind)


def similar_critical_points(z: DataFrame, radius: float, least: float = 0.95, id: str = "id") -> DataFrame:
    """(id, kind, kept): critical points (with an id) by groups of similar ones, each under its smallest id.

    Two points no farther apart than the radius are similar if neither is a saddle, or if both are and their eigenvectors
    agree one by one: the absolute inner products are at least `least`.
    """
    names = ("e0x", "e0y", "e1x", "e1y")
    saddle = F.col("kind") == "saddle"
    z = z.withColumn("__saddle", saddle).withColumns({n: F.when(saddle, e) for n, e in zip(names, eigenvectors2("jxx", "jxy", "jyx", "jyy"))})
    side = lambda s: z.select(F.col(id).alias(f"{s}_id"), *[F.col(n).alias(f"{s}_{n}") for n in names])
    near = radius_join(z, z, radius, ["x", "y"], id, keys=("__saddle",), self_join=True).join(side("a"), "a_id").join(side("b"), "b_id")
    inner = lambda k: F.abs(F.col(f"a_e{k}x") * F.col(f"b_e{k}x") + F.col(f"a_e{k}y") * F.col(f"b_e{k}y"))
    like = near.filter(~F.col("__saddle") | ((inner(0) >= least) & (inner(1) >= least))).select("a_id", "b_id")
    groups = connected_components(like, "a_id", "b_id").withColumnRenamed("id", id)
    return z.join(groups, id, "left").select(id, "kind", F.coalesce("component", id).alias("kept"))


def value_span_cells(grid: DataFrame, value: float, column: str = "v") -> DataFrame:
    """Cells whose corners' range contains the value."""
    c = cell_corners(grid, column)
    four = [f"{column}{k}" for k in ("00", "10", "01", "11")]
    return c.select("i", "j", F.least(*four).alias("low"), F.greatest(*four).alias("high")).filter((F.col("low") <= value) & (F.col("high") >= value))


def mask_to_points(df: DataFrame, mask: str, origin: tuple, e0: tuple, e1: tuple, size: tuple[int, int]) -> DataFrame:
    """World positions px, py of the mask's non-zero pixels (i, j): origin + i * e0 / (size - 1) + j * e1 / (size - 1)."""
    at = lambda d: F.lit(float(origin[d])) + F.col("i") * F.lit(e0[d] / (size[0] - 1)) + F.col("j") * F.lit(e1[d] / (size[1] - 1))
    return df.filter(F.col(mask) != 0).withColumns({"px": at(0), "py": at(1)})


def ridge_curvature_test(gx, gy, hxx, hxy, hyy) -> Column:
    """ridge or valley by the curvature across the gradient; without a gradient by the Hessian's determinant: extremum or saddle."""
    gx, gy, hxx, hxy, hyy = (F.col(c) if isinstance(c, str) else c for c in (gx, gy, hxx, hxy, hyy))
    across = gy * gy * hxx - 2 * gx * gy * hxy + gx * gx * hyy
    flat = F.when(hxx * hyy - hxy * hxy > 0, "extremum").otherwise("saddle")
    return F.when((gx == 0) & (gy == 0), flat).when(across < 0, "ridge").when(across.isNotNull(), "valley")


def low_pass(grid: DataFrame, iterations: int, alpha: float, axes: list[str] = ("i", "j"), value: str = "v", every: int = 5) -> DataFrame:
    """(axes, smooth): `iterations` rounds of alpha * (mean of the existing axis neighbours) + (1 - alpha) * value.

    Then one offset is added everywhere, so that no result is below its input.
    """
    g = grid.select(*axes, F.col(value).cast("double").alias("v0"), F.col(value).cast("double").alias("s"))
    for n in range(iterations):
        parts = []
        for a in axes:
            g = _neighbours(g, list(axes), a, ["s"]).withColumnsRenamed({"s_p": f"p_{a}", "s_m": f"m_{a}"})
            parts += [f"p_{a}", f"m_{a}"]
        known = F.filter(F.array(*parts), lambda x: x.isNotNull())
        mean = F.aggregate(known, F.lit(0.0), lambda p, q: p + q) / F.size(known)
        g = g.withColumn("s", F.when(F.size(known) > 0, F.lit(alpha) * mean + F.lit(1 - alpha) * F.col("s")).otherwise(F.col("s"))).drop(*parts)
        if n % every == every - 1:
            g = materialise(g, "low-pass")
    lift = g.agg(F.max(F.col("v0") - F.col("s"))).first()[0] or 0.0
    return g.select(*axes, (F.col("s") + F.lit(float(max(0.0, lift)))).alias("smooth"))


def rectilinear_grid(spark, axes: list[list[float]], data: DataFrame, index: str = "index", value: str = "value", names: tuple = ("x", "y", "z")) -> DataFrame:
    """Grid points of coordinate arrays (small, one per axis) with the value of their linear index, first axis fastest."""
    from ..functions.expr import index_to_coord

    coords = index_to_coord(index, [len(a) for a in axes])
    place = [F.get(F.array(*[F.lit(float(v)) for v in a]), c.cast("int")).alias(n) for a, c, n in zip(axes, coords, names)]
    return data.select(index, *place, value)


def stack_time(slices: list[tuple[float, DataFrame]]) -> DataFrame:
    """Slices of several times as one table with column t."""
    return reduce(DataFrame.unionByName, [df.withColumn("t", F.lit(float(t))) for t, df in slices])


def upsample(grid: DataFrame, factors: dict[str, int], value: str = "v") -> DataFrame:
    """The grid refined by a factor along each axis: node i of an axis becomes node factor * i, and nodes between two neighbours are linear in all axes.

    Nodes of the grid keep their values; between a node and one that is missing there are none. Each axis is one equi-join
    with the next node.
    """
    axes = list(factors)
    out = grid.select(*axes, value)
    for a, f in factors.items():
        after = out.select(*[(F.col(c) - 1).alias(c) if c == a else F.col(c) for c in axes], F.col(value).alias("__next"))
        rows = out.join(after, axes, "left")
        step = F.explode(F.when(F.col("__next").isNotNull(), F.sequence(F.lit(0), F.lit(f - 1))).otherwise(F.array(F.lit(0)))).alias("__k")
        between = F.col(value) + (F.col("__next") - F.col(value)) * F.col("__k") / F.lit(float(f))
        rows = rows.select(*axes, value, "__next", step)
        out = rows.select(*[(F.col(c) * f + F.col("__k")).alias(c) if c == a else F.col(c) for c in axes], F.when(F.col("__k") == 0, F.col(value)).otherwise(between).alias(value))
    return out


def grid_edges(grid: DataFrame, axes: list[str], corners: bool = False) -> DataFrame:
    """Edges (<axis>, <axis>_to) between the nodes of a grid that exist and are neighbours along an axis, or at a corner, too; each in both directions."""
    shifts = F.array(*[F.struct(*[F.lit(d[a]).alias(a) for a in axes]) for d in grid_neighbours(axes, corners)])
    to = grid.select(*axes, F.explode(shifts).alias("__d")).select(*axes, *[(F.col(a) + F.col(f"__d.{a}")).alias(f"{a}_to") for a in axes])
    return to.join(grid.select(*[F.col(a).alias(f"{a}_to") for a in axes]), [f"{a}_to" for a in axes], "left_semi").select(*axes, *[f"{a}_to" for a in axes])


def grid_neighbours(axes: list[str], corners: bool = False) -> list[dict[str, int]]:
    """Index shifts of a node's axis neighbours, or of all nodes around it."""
    if not corners:
        return [{b: (s if a == b else 0) for b in axes} for a in axes for s in (-1, 1)]
    out: list[dict[str, int]] = [{}]
    for a in axes:
        out = [{**d, a: s} for d in out for s in (-1, 0, 1)]
    return [d for d in out if any(d.values())]


# The faces of each cell kind, as positions of its vertices, outward.
FACES = {
    "tetra": [[0, 2, 1], [0, 1, 3], [1, 2, 3], [0, 3, 2]],
    "hexahedron": [[0, 3, 2, 1], [4, 5, 6, 7], [0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7]],
    "prism": [[0, 2, 1], [3, 4, 5], [0, 1, 4, 3], [1, 2, 5, 4], [2, 0, 3, 5]],
    "pyramid": [[0, 3, 2, 1], [0, 1, 4], [1, 2, 4], [2, 3, 4], [3, 0, 4]],
}


def _inner_ends(kind: str) -> list[list[int]]:
    """For each face and each of its vertices: the first vertex outside the face that an edge of the cell joins it with."""
    edges = {(f[k - 1], f[k]) for f in FACES[kind] for k in range(len(f))}
    beside = lambda v, face: min(b for a, b in edges | {(b, a) for a, b in edges} if a == v and b not in face)
    return [[beside(v, f) for v in f] for f in FACES[kind]]


def cell_faces(cells: DataFrame) -> DataFrame:
    """(cell, face, verts, offset, key) of cells (cell, type, verts).

    offset: for each vertex of the face, the one that it is joined with across the cell; key: the sorted vertex ids, which
    name a face.
    """

    def face(kind: str) -> Column:
        pick = lambda ps: F.array(*[F.get("verts", F.lit(p)) for p in ps])
        return F.array(*[F.struct(F.lit(k).alias("face"), pick(ps).alias("verts"), pick(qs).alias("offset")) for k, (ps, qs) in enumerate(zip(FACES[kind], _inner_ends(kind)))])

    rows = F.coalesce(*[F.when(F.col("type") == kind, face(kind)) for kind in FACES])
    return cells.select("cell", F.explode(rows).alias("f")).select("cell", "f.face", "f.verts", "f.offset", F.array_sort("f.verts").alias("key"))


def boundary_faces(cells: DataFrame) -> DataFrame:
    """Faces that exactly one cell has: cell, face, verts, key, offset (see cell_faces())."""
    faces = cell_faces(cells)
    once = faces.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("cell", "face", "verts", "offset")).alias("f")).filter("n = 1")
    return once.select("f.cell", "f.face", "f.verts", "key", "f.offset")


def vertex_normals(faces: DataFrame, vertices: DataFrame, id: str = "id") -> DataFrame:
    """(id, nx, ny, nz): unit sums of the unit normals of a vertex's faces, each turned to agree with its first face's.

    A face without area counts as a zero vector; a vertex whose sum vanishes has nulls.
    """
    v = F.col("verts")
    at = lambda n, p: vertices.select(F.col(id).alias(f"__v{n}"), F.struct("x", "y", "z").alias(f"p{n}"))
    f = faces.withColumn("__f", F.xxhash64("key")).select("cell", "face", "verts", F.get(v, F.lit(0)).alias("__v0"), F.get(v, F.lit(1)).alias("__v1"), F.get(v, F.lit(2)).alias("__v2"), F.coalesce(F.get(v, F.lit(3)), F.get(v, F.lit(2))).alias("__v3"))
    for n in range(4):
        f = f.join(at(n, None), f"__v{n}")
    d = lambda a, b, c: F.col(f"p{a}.{c}") - F.col(f"p{b}.{c}")
    # The cross product of the diagonals is twice a quad's mean normal; of a triangle twice its own.
    a, b = [d(2, 0, c) for c in "xyz"], [d(3, 1, c) for c in "xyz"]
    tri = F.col("__v2") == F.col("__v3")
    a = [F.when(tri, d(1, 0, c)).otherwise(x) for c, x in zip("xyz", a)]
    b = [F.when(tri, d(2, 0, c)).otherwise(x) for c, x in zip("xyz", b)]
    n = {"nx": a[1] * b[2] - a[2] * b[1], "ny": a[2] * b[0] - a[0] * b[2], "nz": a[0] * b[1] - a[1] * b[0]}
    f = f.withColumns(n).withColumn("__n", F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2))
    f = f.withColumns({c: F.when(F.col("__n") > 0, F.col(c) / F.col("__n")).otherwise(0.0) for c in n})
    rows = f.select("cell", "face", F.explode("verts").alias(id), "nx", "ny", "nz")
    first = rows.groupBy(id).agg(F.min_by(F.struct("nx", "ny", "nz"), F.struct("cell", "face")).alias("r"))
    rows = rows.join(first, id)
    sign = F.when(F.col("nx") * F.col("r.nx") + F.col("ny") * F.col("r.ny") + F.col("nz") * F.col("r.nz") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    s = rows.groupBy(id).agg(*[F.sum(sign * F.col(c)).alias(c) for c in n])
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return s.withColumn("__n", size).select(id, *[F.when(F.col("__n") > 0, F.col(c) / F.col("__n")).alias(c) for c in n])


def tangential_at_boundary(cells: DataFrame, vertices: DataFrame, velocity: DataFrame, id: str = "id") -> DataFrame:
    """Per boundary vertex: the velocity of its inner vertex without the part along the vertex's normal.

    The inner vertex is the one that the vertex is joined with across the cell of its first face (least cell, then face).
    """
    faces = materialise(boundary_faces(cells), "faces")
    normals = vertex_normals(faces, vertices, id)
    inner = faces.select(F.explode(F.arrays_zip("verts", "offset")).alias("e"), "cell", "face").select(F.col("e.verts").alias(id), F.col("e.offset").alias("inner"), "cell", "face").groupBy(id).agg(F.min_by("inner", F.struct("cell", "face")).alias("inner"))
    rows = inner.join(velocity.select(F.col(id).alias("inner"), "u", "v", "w"), "inner").join(normals, id)
    along = F.col("u") * F.col("nx") + F.col("v") * F.col("ny") + F.col("w") * F.col("nz")
    return rows.withColumn("__d", along).select(id, *[(F.col(c) - F.col("__d") * F.col(n)).alias(f"t{c}") for c, n in zip("uvw", ("nx", "ny", "nz"))])


def pixel_triangles(points: DataFrame, most: float) -> DataFrame:
    """Triangles between each pixel's point and the nearest-depth points of the right and lower pixels, if all edges are below `most`.

    `points` has (id, u, v, x, y, z), several per pixel.
    """
    own = points.select(F.col("id").alias("a"), "u", "v", "z", F.struct("x", "y", "z").alias("pa")).filter("z IS NOT NULL")
    depths = materialise(own.groupBy("u", "v", "z").agg(F.min(F.struct(F.col("a").alias("id"), "pa")).alias("first")), "depths")

    def beside(du: int, dv: int, n: str) -> DataFrame:
        other = depths.select((F.col("u") - du).alias("u"), (F.col("v") - dv).alias("v"), "z", F.struct("z", "first.id", "first.pa").alias("known"), F.lit(0).alias("kind"))
        asked = depths.select("u", "v", "z", F.lit(None).cast(other.schema["known"].dataType).alias("known"), F.lit(1).alias("kind"))
        # The nearest depths from above and below, by windows over a pixel's depths and those beside it.
        w = lambda z: Window.partitionBy("u", "v").orderBy(z, "kind").rowsBetween(Window.unboundedPreceding, 0)
        rows = asked.unionByName(other).withColumn("lo", F.last("known", True).over(w(F.col("z").asc()))).withColumn("hi", F.last("known", True).over(w(F.col("z").desc()))).filter("kind = 1")
        key = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col("z") - F.col(f"{s}.z")).alias("far"), F.col(f"{s}.id").alias("id"), F.col(f"{s}.pa").alias("pa")))
        return rows.withColumn("m", F.least(key("lo"), key("hi"))).filter("m IS NOT NULL").select("u", "v", "z", F.col("m.id").alias(n), F.col("m.pa").alias(f"p{n}"))

    rows = own.join(beside(1, 0, "b").join(beside(0, 1, "c"), ["u", "v", "z"]), ["u", "v", "z"])
    edge = lambda p, q: F.sqrt(sum((F.col(f"{p}.{k}") - F.col(f"{q}.{k}")) ** 2 for k in "xyz"))
    return rows.withColumn("diameter", F.greatest(edge("pa", "pb"), edge("pb", "pc"), edge("pc", "pa"))).filter(F.col("diameter") < F.lit(float(most))).select("a", "b", "c", "diameter")


def split_edges(tris: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row per distinct edge (a < b): the number of its triangles and its midpoint."""
    pairs = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    edges = tris.select(F.explode(pairs).alias("e")).groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("triangles"))
    at = lambda n: vertices.select(F.col("id").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    return edges.join(at("a"), "a").join(at("b"), "b").select("a", "b", "triangles", ((F.col("xa") + F.col("xb")) / 2).alias("mx"), ((F.col("ya") + F.col("yb")) / 2).alias("my"))


def triangle_index(tris: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per triangle: the index (whole turns) of its corner vectors (id, vx, vy), and their total and greatest turning."""
    at = lambda n: vectors.select(F.col("id").alias(f"v{n}"), F.col("vx").alias(f"x{n}"), F.col("vy").alias(f"y{n}"))
    rows = tris.join(at(0), "v0").join(at(1), "v1").join(at(2), "v2")
    turns = [signed_angle(f"x{a}", f"y{a}", f"x{b}", f"y{b}") for a, b in ((0, 1), (1, 2), (2, 0))]
    return rows.select("tri", F.round(sum(turns[1:], turns[0]) / F.lit(2 * np.pi)).cast("long").alias("index"), sum(map(F.abs, turns[1:]), F.abs(turns[0])).alias("total_turn"), F.greatest(*map(F.abs, turns)).alias("greatest_turn"))


def period_compatible_triangles(quality: DataFrame, period: int, dq: float, tolerance: float = 0.0) -> DataFrame:
    """Triangles whose value span (widened by dq) meets q +- tolerance of a reduced fraction period / i."""
    import math as _m

    qs = [period / i for i in range(1, period + 1) if _m.gcd(period, i) == 1]
    hit = reduce(lambda a, b: a | b, [(F.col("low") - dq <= q + tolerance) & (F.col("high") + dq >= q - tolerance) for q in qs])
    return quality.filter(hit)


def linear_fit_error(tris: DataFrame, vertices: DataFrame, probes: DataFrame) -> DataFrame:
    """Per probe (tri, x, y, px, py, its own vector): relative error of the corner vectors' barycentric interpolant, and whether it is smaller than all corners."""
    at = lambda n: vertices.select(F.col("id").alias(f"v{n}"), *[F.col(c).alias(f"{c}{n}") for c in ("x", "y", "vx", "vy")])
    r = probes.join(tris, "tri").join(at(0), "v0").join(at(1), "v1").join(at(2), "v2")
    c = F.col
    det = (c("x1") - c("x0")) * (c("y2") - c("y0")) - (c("x2") - c("x0")) * (c("y1") - c("y0"))
    b1 = ((c("x") - c("x0")) * (c("y2") - c("y0")) - (c("x2") - c("x0")) * (c("y") - c("y0"))) / det
    b2 = ((c("x1") - c("x0")) * (c("y") - c("y0")) - (c("x") - c("x0")) * (c("y1") - c("y0"))) / det
    r = r.withColumns({"b1": b1, "b2": b2})
    fit = lambda k: c(f"{k}0") * (1 - c("b1") - c("b2")) + c(f"{k}1") * c("b1") + c(f"{k}2") * c("b2")
    size = F.hypot("px", "py")
    err = F.hypot(fit("vx") - c("px"), fit("vy") - c("py"))
    least = F.least(*[F.hypot(f"vx{n}", f"vy{n}") for n in range(3)])
    return r.select("tri", F.when(size > 0, err / size).alias("error"), (size < least).alias("smaller"))


def pca_project(df: DataFrame, columns: list[str], axes: tuple[int, int], key: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(key, p0, p1): projections on two principal axes (numbered by ascending eigenvalue); also the covariance and the mean.

    All moments come from one aggregation; the driver sees d * (d + 1) / 2 numbers, whatever the rows.
    """
    d = len(columns)
    if d > 64:
        raise ValueError("at most 64 columns")
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)], *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)]]
    r = df.agg(*aggs).first()
    n = max(1, r["n"])
    mean = np.array([(r[f"s{i}"] or 0.0) / n for i in range(d)])
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = (r[f"m{i}_{j}"] or 0.0) / n - mean[i] * mean[j]
    vectors = np.linalg.eigh(cov)[1]
    along = [sum(((F.col(c) - F.lit(float(m))) * F.lit(float(vectors[i, a])) for i, (c, m) in enumerate(zip(columns, mean))), F.lit(0.0)) for a in axes]
    return df.select(key, *[p.alias(f"p{k}") for k, p in enumerate(along)]), cov, mean


def unoriented_mean_direction(df: DataFrame, group: str, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Per group, the principal axis of the sum of d d^T: a mean that doesn't depend on the vectors' signs."""
    from ..functions.tensor import principal_vector3

    pairs = {"xx": (x, x), "xy": (x, y), "xz": (x, z), "yy": (y, y), "yz": (y, z), "zz": (z, z)}
    s = df.groupBy(group).agg(*[F.sum(F.col(a) * F.col(b)).alias(k) for k, (a, b) in pairs.items()])
    s = s.withColumn("l1", sym_eig3(*pairs)[0])
    ax = principal_vector3(*pairs, "l1")
    return s.select(group, "l1", *[c.alias(n) for c, n in zip(ax, ("ax", "ay", "az"))])


def align_to_mean(df: DataFrame, means: DataFrame, group: str, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """`df` with its vectors flipped where they point against their group's mean axis."""
    r = df.join(means.select(group, "ax", "ay", "az"), group)
    sign = F.when(F.col(x) * F.col("ax") + F.col(y) * F.col("ay") + F.col(z) * F.col("az") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return r.withColumn("__s", sign).withColumns({c: F.col("__s") * F.col(c) for c in (x, y, z)}).drop("__s", "ax", "ay", "az")
