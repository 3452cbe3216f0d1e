"""Column expressions: indices and positions, geography, periodic metrics, angles, durations, small mappings.

All take and return Columns and stay in generated code. Missing values are NULL throughout.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0

# Seconds of a duration's units (a month has 30 days).
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "mo": 2592000}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def index_to_coord(index, size: list[int]) -> list[Column]:
    """(i, j, ...) of a linear index, first axis fastest."""
    out, rest = [], _c(index)
    for n in size[:-1]:
        out.append((rest % n).cast("long"))
        rest = F.floor(rest / n)
    return [*out, rest.cast("long")]


def coord_to_index(coords: list, size: list[int]) -> Column:
    """The linear index of (i, j, ...), first axis fastest."""
    out, step = F.lit(0).cast("long"), 1
    for c, n in zip(coords, size):
        out = out + _c(c) * F.lit(step).cast("long")
        step *= n
    return out.cast("long")


def world_position(index, low: float, spacing: float) -> Column:
    return F.lit(float(low)) + _c(index) * F.lit(float(spacing))


def nearest_voxel(x, low: float, spacing: float, size: int | None = None) -> Column:
    """The index of the nearest node (halves go up); NULL outside of 0..size-1."""
    i = F.floor((_c(x) - F.lit(float(low))) / F.lit(float(spacing)) + F.lit(0.5)).cast("long")
    return i if size is None else F.when((i >= 0) & (i < size), i)


def in_box(bounds: dict[str, tuple[float, float]]) -> Column:
    """Whether every column lies in its closed range."""
    return reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in bounds.items()])


def in_cylinder(x, y, radius: float) -> Column:
    return _c(x) * _c(x) + _c(y) * _c(y) <= F.lit(float(radius) ** 2)


def in_slab(axis, eps: float) -> Column:
    return F.abs(_c(axis)) < F.lit(float(eps))


def central_angle(sin1, cos1, sin2, cos2, d) -> Column:
    """The angle between two points by the law of cosines, from their latitudes' sines and cosines and the difference of longitudes; the cosine is kept within [-1, 1]."""
    cosine = _c(sin1) * _c(sin2) + _c(cos1) * _c(cos2) * F.cos(_c(d))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def great_circle_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance by the law of cosines."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    return F.lit(EARTH_KM) * central_angle(F.sin(a), F.cos(a), F.sin(b), F.cos(b), F.radians(_c(lon2) - _c(lon1)))


def km_per_degree(lon, lat, dlon: float, dlat: float, eps: float = 0.01) -> Column:
    """Kilometres per degree in the direction (dlon, dlat), by a central difference of great_circle_km."""
    n = math.hypot(dlon, dlat)
    x, y = eps * dlon / n, eps * dlat / n
    return great_circle_km(_c(lon) - x, _c(lat) - y, _c(lon) + x, _c(lat) + y) / F.lit(2 * eps)


def periodic_modulo(x, period: float) -> Column:
    return F.pmod(_c(x), F.lit(float(period)))


def periodic_displacement(a, b, period: float | None) -> Column:
    """b - a by the nearest image: within half a period; plain where there is no period."""
    d = _c(b) - _c(a)
    if period is None:
        return d
    # Whole periods are taken off, so that a displacement within half a period stays as it is, without rounding.
    return d - F.lit(float(period)) * F.ceil(d / F.lit(float(period)) - 0.5)


def periodic_distance(a: list, b: list, periods: list) -> Column:
    return F.sqrt(reduce(lambda p, q: p + q, [periodic_displacement(x, y, p) ** 2 for x, y, p in zip(a, b, periods)]))


def signed_angle(ax, ay, bx, by) -> Column:
    """The angle from vector a to vector b, in (-pi, pi]."""
    ax, ay, bx, by = map(_c, (ax, ay, bx, by))
    return F.atan2(ax * by - ay * bx, ax * bx + ay * by)


def unsigned_angle(ax, ay, bx, by) -> Column:
    return F.abs(signed_angle(ax, ay, bx, by))


def turn_angle(x0, y0, x1, y1, x2, y2, periods: list | None = None) -> Column:
    """The signed angle between the displacements of three consecutive points."""
    px, py = periods or (None, None)
    d = periodic_displacement
    return signed_angle(d(x0, x1, px), d(y0, y1, py), d(x1, x2, px), d(y1, y2, py))


def euler_to_direction(phi1, phi) -> tuple[Column, Column, Column]:
    """The crystal's z axis of Bunge Euler angles (radians)."""
    a, b = _c(phi1), _c(phi)
    return F.sin(a) * F.sin(b), -F.cos(a) * F.sin(b), F.cos(b)


def misorientation_deg(u: tuple, v: tuple) -> Column:
    """The angle in degrees between two unit directions."""
    dot = reduce(lambda p, q: p + q, [_c(a) * _c(b) for a, b in zip(u, v)])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def tap_phase(t, pour: float, relaxation: float, frequency: float, gamma: float, gravity: float = 9.81) -> tuple[Column, Column]:
    """The phase within a tap's cycle, and the floor's height: a half sine of peak acceleration gamma * g, then at rest."""
    bump, omega = 0.5 / frequency, 2 * math.pi * frequency
    phase = F.when(_c(t) >= F.lit(float(pour)), F.pmod(_c(t) - F.lit(float(pour)), F.lit(relaxation + bump)))
    height = F.when(phase < F.lit(bump), F.lit(gamma * gravity / omega**2) * F.sin(F.lit(omega) * phase)).otherwise(F.lit(0.0))
    return phase, F.when(phase.isNotNull(), height)


def parse_duration(text) -> Column:
    """Seconds of a number with a unit (none: seconds); NULL for anything else."""
    pattern = r"^\s*([0-9]*\.?[0-9]+)\s*([a-z]*)\s*$"
    number, unit = F.regexp_extract(_c(text), pattern, 1), F.regexp_extract(_c(text), pattern, 2)
    factor = F.when(unit == "", F.lit(1.0))
    for k, v in UNIT_SECONDS.items():
        factor = factor.when(unit == k, F.lit(float(v)))
    return F.when(number != "", number.try_cast("double") * factor)


def seconds_text(seconds) -> Column:
    """h:mm:ss of a number of seconds."""
    s = F.floor(_c(seconds)).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long"))


def parse_timestamp_multi(text, formats: list[str]) -> Column:
    """The first of the formats that fits; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(_c(text), F.lit(f)) for f in formats])


def rational_table(most: int) -> list[tuple[int, int]]:
    """Reduced fractions num/den with 1 <= den <= num < most, ascending by (num, den)."""
    return [(n, d) for n in range(1, most) for d in range(1, n + 1) if math.gcd(n, d) == 1]


def rational_approx(value, most_num: int, most_den: int) -> Column:
    """STRUCT<num, den> nearest to the value, with num <= most_num and den <= most_den; ties: smallest num, then den."""
    nums, dens = F.sequence(F.lit(0), F.lit(most_num)), F.sequence(F.lit(1), F.lit(most_den))
    each = F.flatten(F.transform(nums, lambda n: F.transform(dens, lambda d: F.struct(F.abs(_c(value) - n / d).alias("e"), n.alias("num"), d.alias("den")))))
    best = F.array_min(each)
    return F.struct(best["num"].cast("long").alias("num"), best["den"].cast("long").alias("den"))


def signed_extreme(forward, backward) -> Column:
    return F.when(_c(forward) > _c(backward), _c(forward)).otherwise(-_c(backward))


def piecewise_linear(value, points: list[tuple[float, float]]) -> Column:
    """Linear interpolation through sorted control points; constant beyond the ends."""
    v = _c(value)
    out = F.when(v <= F.lit(float(points[0][0])), F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(v <= F.lit(float(x1)), F.lit(float(y0)) + (v - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0)))
    return out.when(v.isNotNull(), F.lit(float(points[-1][1])))


def coalesce_vector(a: list, b: list) -> list[Column]:
    """The components of b where vector a is exactly zero, else those of a."""
    zero = reduce(lambda p, q: p & q, [_c(x) == 0 for x in a])
    return [F.when(zero, _c(y)).otherwise(_c(x)) for x, y in zip(a, b)]


def parse_key_values(text, keys: list[str]) -> list[Column]:
    """Values of `key = value` or `key=value` in a header's text, each up to a separator; NULL where a key is missing."""
    found = [F.regexp_extract(_c(text), rf"(?:^|[\s,?&#;]){k}\s*=\s*([^\s,&;\]#]+)", 1) for k in keys]
    return [F.when(v != "", v).alias(k) for k, v in zip(keys, found)]


def stereographic_projection(coords: list, w, w0: float = 1.0) -> list[Column]:
    """coords / (w0 - w); NULL where w equals w0."""
    d = F.lit(float(w0)) - _c(w)
    return [F.when(d != 0, _c(c) / d) for c in coords]


def multi_word_match(text, words: list[str]) -> Column:
    """The smallest edit distance, ignoring case, to the words joined by nothing, _, -, a space, or to their initials."""
    forms = [s.join(words) for s in ("", "_", "-", " ")] + ["".join(w[:1] for w in words)]
    return F.least(*[F.levenshtein(F.lower(_c(text)), F.lit(f.lower())) for f in forms])


def norm(*v) -> Column:
    return F.sqrt(reduce(lambda p, q: p + q, [_c(x) * _c(x) for x in v]))


def dot(u: list, v: list) -> Column:
    return reduce(lambda p, q: p + q, [_c(a) * _c(b) for a, b in zip(u, v)])


def cross(u: list, v: list) -> list[Column]:
    (a, b, c), (x, y, z) = map(_c, u), map(_c, v)
    return [b * z - c * y, c * x - a * z, a * y - b * x]


def normalise(*v) -> list[Column]:
    """The unit vector; NULL components for a zero vector."""
    n = norm(*v)
    return [F.when(n > 0, _c(x) / n) for x in v]


def outer(u: list, v: list) -> list[list[Column]]:
    return [[_c(a) * _c(b) for b in v] for a in u]


def cubed(x) -> Column:
    return _c(x) * _c(x) * _c(x)


def binomial(n: int, k: int) -> int:
    return math.comb(n, k)


def polynomial_terms(dimensions: int, order: int) -> int:
    """Coefficients of a full polynomial of the order."""
    return math.comb(dimensions + order, order)


#: Kernels of a distance r with support s: Column -> Column. The compact ones are 0 from s on.
KERNELS = {
    "linear": lambda r, s: r,
    "quadratic": lambda r, s: r * r,
    "cubic": lambda r, s: r * r * r,
    "quartic": lambda r, s: r * r * r * r,
    "quintic": lambda r, s: r * r * r * r * r,
    "gaussian": lambda r, s: F.exp(-(r * r) / F.lit(float(s * s))),
    "truncated_gaussian": lambda r, s: F.when(r < F.lit(float(s)), F.exp(-(r * r) / F.lit(float(s * s)) * 9)).otherwise(F.lit(0.0)),
    "wendland": lambda r, s: F.when(r < F.lit(float(s)), F.pow(1 - r / F.lit(float(s)), F.lit(4)) * (4 * r / F.lit(float(s)) + 1)).otherwise(F.lit(0.0)),
    "multiquadric": lambda r, s: F.sqrt(r * r + F.lit(float(s * s))),
    "inverse_quadratic": lambda r, s: 1 / (r * r + F.lit(float(s * s))),
    "polyharmonic": lambda r, s: F.when(r > 0, r * r * F.log(r)).otherwise(F.lit(0.0)),
    "tent": lambda r, s: F.greatest(F.lit(0.0), 1 - r / F.lit(float(s))),
    "sinc": lambda r, s: F.when(r > 0, F.sin(F.lit(math.pi) * r / F.lit(float(s))) / (F.lit(math.pi) * r / F.lit(float(s)))).otherwise(F.lit(1.0)),
}


def kernel(name: str, r, support: float = 1.0) -> Column:
    return KERNELS[name](_c(r), support)
