"""The whole render against a plain tracer that follows one ray at a time, with no arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import sdf
from millrace.functions.glyphs import catalog, layout_of, unknown_characters, validate
from millrace.functions.kernel import ALBEDO
from millrace.functions.rng import uniform_np
from millrace.plans.render import Image, render

LIGHT = [c / math.sqrt(0.6 * 0.6 + 0.6 * 0.6 + 1) for c in (0.6, 0.6, 1.0)]


def _add(a, b, by=1.0):
    return [x + y * by for x, y in zip(a, b, strict=True)]


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def _box(p, low, high):
    return -min(min(v - a, b - v) for v, a, b in zip(p, low, high, strict=True))


def _letter(p, glyph):
    x0, x1, y0, y1 = glyph.box
    if (away := _box(p, (x0, y0, -0.5), (x1, y1, 0.5))) > 0.001:
        return away, 11
    x, y, z = p
    near = 1e9
    for ax, ay, bx, by in glyph.lines:
        ex, ey = bx - ax, by - ay
        t = min(1, max(0, ((x - ax) * ex + (y - ay) * ey) / (ex * ex + ey * ey)))
        near = min(near, math.hypot(x - ax - ex * t, y - ay - ey * t))
    for kind, cx, cy, r in glyph.arcs:
        ox, oy = x - cx, y - cy
        out = {"o": 1, "r": ox, "l": -ox, "u": oy, "d": -oy}[kind]
        side = oy if kind in "rl" else ox
        near = min(near, abs(math.hypot(ox, oy) - r) if out > 0 else math.hypot(out, side - r if side > 0 else side + r))
    return (near**8 + z**8) ** 0.125 - 0.5, 1


def _scene(p, word):
    best = (1e9, 0)
    found = [_letter([p[0] - at, p[1], p[2]], catalog()[c]) for c, at in layout_of(word)]
    room = min(-min(_box(p, *sdf.LOWER), _box(p, *sdf.UPPER)), _box([math.fmod(abs(p[0]), 8), p[1], p[2]], *sdf.PLANKS))
    found += [(room, 9)] + [(math.dist(p, s[:3]) - s[3], s[4]) for s in sdf.SPHERES]
    for d, m in found:
        if d < best[0] + 0.001:
            best = (d, m)
    return (19.9 - p[1], 10) if 19.9 - p[1] < best[0] else best


def _march(o, d, word):
    t, steps = 0.0, 0
    while t < 100:
        p = _add(o, d, t)
        away, m = _scene(p, word)
        if away < 0.001 or steps > 99:
            n = [_scene([v + 0.001 * (k == i) for k, v in enumerate(p)], word)[0] - away for i in range(3)]
            size = math.sqrt(_dot(n, n))
            return m, p, [v / size if size else math.nan for v in n]
        t, steps = t + away, steps + 1
    return 0, None, None


def _trace(o, d, ray, word, bounces):
    colour, weight = [0.0] * 3, [1.0] * 3
    draw = lambda k: float(uniform_np(np.array([ray * (2 + 2 * bounces) + k]))[0])
    for bounce in range(bounces):
        m, p, n = _march(o, d, word)
        if not m:
            return colour
        albedo = [float(x) for x in ALBEDO[m]]
        if 1 <= m <= 6:
            d = _add(d, n, -2 * _dot(n, d))
            o, weight = _add(p, d, 0.1), [w * a for w, a in zip(weight, albedo, strict=True)]
        elif 7 <= m <= 9:
            phi, c = 6.283185 * draw(2 + 2 * bounce), draw(3 + 2 * bounce)
            sine, g = math.sqrt(1 - c), -1 if n[2] < 0 else 1
            u = -1 / (g + n[2])
            v = n[0] * n[1] * u
            d = _add(_add([x * math.cos(phi) * sine for x in (v, g + n[1] * n[1] * u, -n[1])], [1 + g * n[0] * n[0] * u, g * v, -g * n[0]], math.sin(phi) * sine), n, math.sqrt(c))
            o, weight = _add(p, d, 0.1), [w * a for w, a in zip(weight, albedo, strict=True)]
            lit = _dot(n, LIGHT)
            if lit > 0 and m != 7 and _march(_add(p, n, 0.1), LIGHT, word)[0] == 10:
                colour = [k + w * s * lit for k, w, s in zip(colour, weight, (500, 400, 100), strict=True)]
        elif m == 10:
            colour = [k + w * s for k, w, s in zip(colour, weight, (50, 80, 100), strict=True)]
        else:
            o, weight = _add(p, d, 0.1), [w * a for w, a in zip(weight, albedo, strict=True)]
            colour = [k + w * s for k, w, s in zip(colour, weight, (50, 0, 0), strict=True)]
    return colour


def test_render_against_one_ray_at_a_time(spark):
    image, word = Image(width=16, height=9, samples=2, bounces=3), "PIX R8"
    goal, left, up = ([float(v) for v in x] for x in image.camera)
    sums = {}
    for i in range(1, 16 * 9 * 2):
        px, py = i % 32 // 2, i // 32
        b, a = (float(uniform_np(np.array([i * 8 + k]))[0]) for k in (0, 1))
        d = _add(_add(goal, left, px - 8 + a), up, py - 4.5 + b)
        d = [v / math.sqrt(_dot(d, d)) for v in d]
        sums[px, py] = _add(sums.get((px, py), [0.0] * 3), _trace([-22.0, 5.0, 25.0], d, i, word, 3))
    want = {k: [int((c / 2 + 14 / 241) / (c / 2 + 14 / 241 + 1) * 255) for c in v] for k, v in sums.items()}
    got = {(r.px, r.py): [r.r, r.g, r.b] for r in render(spark, word, image).collect()}
    assert got.keys() == want.keys()
    assert sum(got[k] != want[k] for k in want) <= 1  # a ray that only just hits or misses


def test_words_are_checked_alike(spark):
    for word in ("pixar", "straße", "ıſ", "HI9", ""):
        lacks = spark.createDataFrame([(word,)], "w string").select(unknown_characters(F.col("w")).alias("u")).first().u
        if lacks:
            with pytest.raises(ValueError, match="no glyph"):
                validate(word)
        else:
            assert len(validate(word)) == len(word)


def test_sphere_without_a_material(spark):
    p = tuple(F.lit(float(v)) for v in (1, 2, 3))
    r = spark.range(1).select(sdf.sphere_model(p, (1.0, 2.0, 0.0), 1.0).alias("s"), sdf.sphere_model(p, (1.0, 2.0, 0.0), 1.0, 4).alias("t")).first()
    assert (r.s.d, r.s.material, r.t.material) == (2.0, 8, 4)


def test_random_numbers_refuse_keys_that_would_repeat():
    with pytest.raises(ValueError, match="2\\^32"):
        uniform_np(np.array([2**32]))
