import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import dispatch, glyphs, sdf
from millrace.functions.kernel import Scene, march, trace
from millrace.functions.rng import uniform, uniform_np
from millrace.functions.scalar import atoi, tone_mapped
from millrace.plans.render import POSITION, Image

POINTS = [(-22, 5, 25), (0, 4, 0), (10, 5.5, -12), (0, 19.5, 0), (-9.5, 4, 0), (6, 1.5, 10), (0, -0.5, 0), (-14, 2, 0.2), (2, 17.5, 3)]
FOUND = [(5, "Wall"), (0.394427, "LetterBlack"), (-6, "GopherBlue"), (0.4, "Sun"), (0, "LetterBlack"), (-2, "LetterYellow"), (0, "Wall"), (0.5, "AABB"), (0.5, "Wall")]


def test_catalog():
    c = glyphs.catalog()
    assert (len(c), sum(len(g.lines) for g in c.values()), sum(len(g.arcs) for g in c.values())) == (30, 80, 22)
    widths = {"I": 3, "E": 4, "F": 4, "L": 4, "D": 6, "G": 6, "#": 7, "W": 9}
    assert all(g.width == widths.get(k, 5) for k, g in c.items())
    assert c[" "].box[2:] == (-4.5, -3.5)
    assert all(g.box[2:] == (-0.5, 8.5) for k, g in c.items() if k != " ")


def test_layout():
    assert glyphs.layout_of("PIXAR") == [("P", -13), ("I", -7), ("X", -3), ("A", 3), ("R", 9)]
    assert glyphs.layout_of("A B") == [("A", -7), ("B", 3)]
    assert [x for _, x in glyphs.layout_of("GOPHER")] == [-16, -9, -3, 3, 9, 14]
    assert [x for _, x in glyphs.layout_of("ABCDEFGHIJ")] == [-16, -10, -4, 2, 9, 14, 19, 26, 32, 36]


def test_validation():
    assert glyphs.validate("a b #8") == "A B #8" and glyphs.validate("") == ""
    with pytest.raises(ValueError, match="'9'"):
        glyphs.validate("HI9")


def test_scene_in_numpy_and_columns(spark):
    d, m = Scene("PIXAR").query(*np.array(POINTS, dtype=float).T)
    assert [sdf.MATERIALS[i] for i in m] == [x for _, x in FOUND]
    assert np.allclose(d, [x for x, _ in FOUND], atol=1e-6)
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(POINTS)], "i int, x double, y double, z double")
    got = rows.select("i", sdf.scene((F.col("x"), F.col("y"), F.col("z")), "PIXAR").alias("s")).orderBy("i").select("s.*").collect()
    assert [sdf.MATERIALS[r.material] for r in got] == [x for _, x in FOUND]
    assert np.allclose([r.d for r in got], d, atol=1e-12)


def test_camera():
    goal, left, up = Image(width=960).camera
    assert np.allclose(goal, (0.6047766633752688, -0.031830350703961514, -0.7957587675990379))
    assert np.allclose(left, (-0.0008293356188782318, 0, -0.0006302950703474563))
    assert np.allclose(up, (2.0062513136137628e-05, 0.001041138839591142, -2.6398043600181083e-05))


def _march_one(origin, direction, scene):
    """A ray alone, step by step."""
    gone, steps = 0.0, 0
    while gone < 100:
        at = origin + direction * gone
        d, m = (x[0] for x in scene.query(*at[:, None]))
        if d < 0.001 or steps > 99:
            return m, at
        gone, steps = gone + d, steps + 1
    return 0, at


def test_march_is_the_same_alone_and_together():
    rng = np.random.default_rng(3)
    scene = Scene("AB8")
    d = rng.normal(size=(60, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    material, place, normal = march(np.broadcast_to(POSITION, d.shape), d, scene)
    for i in range(len(d)):
        m, at = _march_one(POSITION, d[i], scene)
        assert m == material[i]
        if m:
            assert np.allclose(at, place[i])
    size = np.linalg.norm(normal[material > 0], axis=1)
    assert np.all(np.isnan(size) | np.isclose(size, 1))


def test_trace_depends_on_the_ray_alone():
    rng = np.random.default_rng(4)
    scene = Scene("X")
    d = rng.normal(size=(40, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    ray = np.arange(40) + 7
    every = trace(POSITION, d, ray, scene, 3)
    some = trace(POSITION, d[10:20], ray[10:20], scene, 3)
    assert np.array_equal(every[10:20], some, equal_nan=True)
    up = np.array([[0.0, 1.0, 0.0]])
    hole = np.array([0.0, 10.0, 0.0])  # between planks the sun is seen, again at each bounce
    assert np.allclose(trace(hole, up, ray[:1], scene, 3), [[150, 240, 300]])
    assert np.allclose(trace(hole, up, ray[:1], scene, 3, stop_at_sun=True), [[50, 80, 100]])


@given(st.integers(0, 2**32 - 1))
def test_draws_are_in_range(k):
    assert 0 <= uniform_np(np.array([k]))[0] < 1


def test_draws_are_alike(spark):
    got = [r.u for r in spark.range(2000).select(uniform(F.col("id") * 2097153 % 2**32).alias("u")).collect()]
    assert np.array_equal(got, uniform_np(np.arange(2000) * 2097153 % 2**32))


def test_atoi(spark):
    cases = {"12": 12, "+5": 5, "-7": -7, "": 0, " 5 ": 0, "1.5": 0, "abc": 0, "12\n": 0, "9" * 20: 2**63 - 1, "-" + "9" * 20: -(2**63)}
    rows = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.v for r in rows.select("s", atoi(F.col("s")).alias("v")).collect()} == cases


def test_tone_map(spark):
    cases = {(0.0, 1): 14.0, (0.0, 16): 14.0, (1.0, 1): 131.098790, (50.0, 1): 250.005688, (500.0, 2): 253.984299, (100.0, 16): 220.107168}
    rows = spark.createDataFrame([(*k,) for k in cases], "c double, s int")
    for r in rows.select("c", "s", tone_mapped(F.col("c"), F.col("s")).alias("v")).collect():
        assert math.isclose(r.v, cases[r.c, r.s], abs_tol=1e-6)


def test_dispatch_forms_agree(spark):
    c = F.col("f")
    batches = dispatch.Registry(fallback=dispatch.series_adapter)
    forms = [dispatch.by_columns(c), dispatch.by_sql("f"), dispatch.by_switch(c), dispatch.by_registry(c, dispatch.standard_registry()), dispatch.by_registry(c, batches), dispatch.by_fused_series()(c)]
    row = spark.createDataFrame([(6.48074069841,)], "f double").select(*[f.alias(f"v{i}") for i, f in enumerate(forms)]).first()
    assert set(row) == {"42"}
    v = 6.48074069841
    for f in dispatch.PIPELINE:
        v = f.value(v)
    assert v == "42"


def test_dispatch_refuses():
    with pytest.raises(dispatch.UnknownSignature, match="register"):
        dispatch.Registry().caller(dispatch.SQUARE)
    with pytest.raises(TypeError, match="takes"):
        dispatch.by_columns(None, (dispatch.FORMAT, dispatch.SQUARE))
