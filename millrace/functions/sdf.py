"""Signed distances as columns, for points x, y, z: for tables of points, not for the rays' inner loop (see kernel)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.glyphs import HALF, Glyph, catalog, layout_of

#: Materials by number, the distance at which something is hit, and what nothing is away.
MATERIALS = ("None", "LetterBlack", "LetterWhite", "LetterRed", "LetterGreen", "LetterBlue", "LetterYellow", "GopherBlue", "GopherTeal", "Wall", "Sun", "AABB")
EPSILON, FAR, SUN_HEIGHT = 0.001, 1e9, 19.9
#: The room (lower part, upper part, planks every PLANK units) and the spheres x, y, z, radius, material.
LOWER, UPPER = ((-30.0, -0.5, -30.0), (30.0, 18.0, 30.0)), ((-25.0, 17.0, -25.0), (25.0, 20.0, 25.0))
PLANKS, PLANK = ((1.5, 18.5, -25.0), (6.5, 20.0, 25.0)), 8.0
SPHERES = ((10.0, 5.5, -12.0, 6.0, 7), (-6.0, 3.5, -16.0, 4.0, 4), (6.0, 1.5, 10.0, 2.0, 6), (-4.0, 2.5, 20.0, 3.0, 3))
LETTER, WALL, SUN, AABB = 1, 9, 10, 11

Point = tuple[Column, Column, Column]


def box(p: Point, low: tuple, high: tuple) -> Column:
    """Negative inside; outside, the largest distance along an axis."""
    return -F.least(*[d for v, a, b in zip(p, low, high, strict=True) for d in (v - a, F.lit(b) - v)])


def sphere(p: Point, centre: tuple, radius: float) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [(F.lit(c) - v) * (F.lit(c) - v) for v, c in zip(p, centre, strict=True)])) - radius


def sphere_model(p: Point, centre: tuple, radius: float, material: int = 0) -> Column:
    """d and material of a sphere; one without a material is GopherTeal."""
    return F.struct(sphere(p, centre, radius).alias("d"), F.lit(material or MATERIALS.index("GopherTeal")).alias("material"))


def room(p: Point) -> Column:
    x, y, z = p
    hollow = -F.least(box(p, *LOWER), box(p, *UPPER))
    return F.least(hollow, box((F.abs(x) % PLANK, y, z), *PLANKS))


def _line(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Squared distance to a line between two points."""
    ex, ey = x1 - x0, y1 - y0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * ex + (y - y0) * ey) / (ex * ex + ey * ey)))
    dx, dy = x - (x0 + ex * t), y - (y0 + ey * t)
    return dx * dx + dy * dy


def _arc(x: Column, y: Column, kind: str, cx: float, cy: float, r: float) -> Column:
    ox, oy = x - cx, y - cy
    round_ = F.abs(F.sqrt(ox * ox + oy * oy) - r)
    if kind == "o":
        return round_
    along, across, sign = {"r": (ox, oy, 1), "l": (ox, oy, -1), "u": (oy, ox, 1), "d": (oy, ox, -1)}[kind]
    end = F.when(across > 0, across - r).otherwise(across + r)
    return F.when(along * sign > 0, round_).otherwise(F.sqrt(along * along + end * end))


def letter(p: Point, glyph: Glyph) -> Column:
    """d and material: the distance to the bounding box away from it, else to the strokes, rounded to a depth of one unit."""
    x, y, z = p
    x0, x1, y0, y1 = glyph.box
    outer = box(p, (x0, y0, -HALF), (x1, y1, HALF))
    lines = [_line(x, y, *s) for s in glyph.lines]
    flat = F.least(F.sqrt(F.least(F.lit(FAR), *lines) if lines else F.lit(FAR)), *[_arc(x, y, *a) for a in glyph.arcs]) if glyph.arcs else F.sqrt(F.least(F.lit(FAR), *lines))
    solid = F.pow(F.pow(flat, F.lit(8.0)) + F.pow(z, F.lit(8.0)), F.lit(0.125)) - HALF
    away = outer > EPSILON
    return F.struct(F.when(away, outer).otherwise(solid).alias("d"), F.when(away, AABB).otherwise(LETTER).alias("material"))


def letter_of_row(p: Point, g: Column) -> Column:
    """The same for a row of the glyph table with its box, so that one expression serves all glyphs."""
    x, y, z = p
    outer = -F.least(x - g["x_min"], g["x_max"] - x, y - g["y_min"], g["y_max"] - y, z + HALF, HALF - z)
    flat = F.sqrt(F.aggregate(g["lines"], F.lit(FAR), lambda acc, s: F.least(acc, _line(x, y, s["x0"], s["y0"], s["x1"], s["y1"]))))

    def nearer(acc: Column, c: Column) -> Column:
        kinds = F.lit(None).cast("double")
        for kind in "orlud":
            kinds = F.when(c["kind"] == kind, _arc(x, y, kind, c["cx"], c["cy"], c["r"])).otherwise(kinds)
        return F.least(acc, kinds)

    flat = F.aggregate(g["curves"], flat, nearer)
    solid = F.pow(F.pow(flat, F.lit(8.0)) + F.pow(z, F.lit(8.0)), F.lit(0.125)) - HALF
    away = outer > EPSILON
    return F.struct(F.when(away, outer).otherwise(solid).alias("d"), F.when(away, AABB).otherwise(LETTER).alias("material"))


def scene(p: Point, word: str) -> Column:
    """d and material of the nearest model: in order, a model replaces the one before if it is less than EPSILON farther; the sun last, if nearer."""
    x, y, z = p
    of = lambda d, m: F.struct(d.alias("d"), F.lit(m).alias("material"))
    models = [letter((x - at, y, z), catalog()[c]) for c, at in layout_of(word)]
    models += [of(room(p), WALL)] + [sphere_model(p, s[:3], s[3], s[4]) for s in SPHERES]
    start = of(F.lit(FAR), 0)
    best = F.aggregate(F.array(*models), start, lambda acc, m: F.when(m["d"] < acc["d"] + EPSILON, m).otherwise(acc))
    return F.transform(F.array(best), lambda b: F.when(F.lit(SUN_HEIGHT) - y < b["d"], of(F.lit(SUN_HEIGHT) - y, SUN)).otherwise(b))[0]
