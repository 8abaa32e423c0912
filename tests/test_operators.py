import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import bundles, combine, elementwise, metrics, outputs, sides, sinks
from millrace.operators.invoke import call_with
from millrace.plans import render as plan
from millrace.sources.generated import count_up, fan_out, impulse, ray_indexes


def test_sources(spark):
    assert [tuple(r) for r in impulse(spark).collect()] == [(bytearray(b""), None)]
    assert [r.v for r in count_up(spark, 10).collect()] == list(range(10))
    assert count_up(spark, 0).count() == 0 and fan_out(impulse(spark), 0).count() == 0
    assert sorted(r.v for r in fan_out(count_up(spark, 2), 3).collect()) == [0, 0, 1, 1, 2, 2]


@pytest.mark.parametrize("samples", [1, 2, 16])
def test_ray_indexes(spark, samples):
    rows = ray_indexes(spark, 8, 4, samples, parts=5).collect()
    assert len(rows) == 8 * 4 * samples - 1
    assert {(r.px, r.py, r.i % samples) for r in rows} == {(x, y, s) for x in range(8) for y in range(4) for s in range(samples)} - {(0, 0, 0)}
    assert ray_indexes(spark, 8, 4, samples, include_origin=True).count() == 8 * 4 * samples


@pytest.mark.parametrize("stages", [0, 1, 3, 100])
def test_identity_chain(spark, stages):
    assert sinks.discard(elementwise.identity(count_up(spark, 1000), stages)) == 1000


def test_stacked_increments_are_one_projection(spark):
    df = count_up(spark, 10)
    for _ in range(3):
        df = elementwise.increment(df, "v")
    assert df._jdf.queryExecution().executedPlan().toString().count("Project") == 1
    assert [r.v for r in df.collect()] == list(range(3, 13))


def test_side_inputs(spark):
    main, side = count_up(spark, 3), spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    assert {r.f for r in sides.with_first(main, side, "v", "k", "f", F.lit("none")).collect()} == {"a"}
    assert {r.f for r in sides.with_first(main, side.where("k > 5"), "v", "k", "f", F.lit("none")).collect()} == {"none"}
    assert {r.v: r.f for r in sides.lookup_first(main, "v", side.selectExpr("k", "v AS w"), "k", "w", "f", F.lit("-")).collect()} == {0: "-", 1: "a", 2: "b"}
    both = sides.with_scalars(main, tag1=(side, "v", "k"), tag2=(side, "k", "k")).collect()
    assert {(r.tag1, r.tag2) for r in both} == {("a", 1)}
    assert [len(r.s) for r in sides.iterate_side(main, side, "s").collect()] == [2, 2, 2]
    with pytest.raises(ValueError, match="more than 1"):
        sides.iterate_side(main, side, "s", most=1)


def test_tagged_outputs(spark):
    rows = outputs.tagged(count_up(spark, 6), even=F.col("v") % 2 == 0, large=F.col("v") > 3)
    assert sorted(r.v for r in outputs.output(rows, "even").collect()) == [0, 2, 4]
    assert sorted(r.v for r in outputs.output(rows, "large").collect()) == [4, 5]


def test_combine_is_partial_and_final(spark):
    df = count_up(spark, 100).select((F.col("v") % 3).alias("px"), F.lit(0).alias("py"), *[F.col("v").cast("double").alias(c) for c in "xyz"])
    out = combine.combine_per_key(df, ["px", "py"], combine.pixels(50))
    assert out._jdf.queryExecution().executedPlan().toString().count("HashAggregate") == 2
    mean = sum(range(0, 100, 3)) / 50 + 14 / 241
    assert np.isclose({r.px: r.r for r in out.collect()}[0], mean / (mean + 1) * 255)


def test_group_and_fixed_key(spark):
    kv = elementwise.to_kv(count_up(spark, 6), F.col("v") % 2, F.col("v"))
    assert {r.key: r["values"] for r in combine.group_by_key(kv).collect()} == {0: [0, 2, 4], 1: [1, 3, 5]}
    assert combine.add_fixed_key(count_up(spark, 3)).select("key").distinct().count() == 1


def test_bundles_go_parent_first(spark):
    def stage(name):
        one = lambda what: lambda: pa.RecordBatch.from_pydict({"s": [f"{name} {what}"]})
        add = lambda b: pa.RecordBatch.from_pydict({"s": [f"{x}>{name}" for x in b.column("s").to_pylist()]})
        return bundles.Stage(add, one("starts"), one("ends"))

    df = spark.createDataFrame([("x",)], "s string").coalesce(1)
    got = [r.s for r in bundles.run_bundles(df, [stage("a"), stage("b")], "s string").collect()]
    assert got == ["a starts>b", "b starts", "x>a>b", "a ends>b", "b ends"]


def test_counters(spark):
    run = metrics.Run()
    sinks.discard(run.counted(count_up(spark, 10), "n", small=F.col("v") < 4))
    assert run.counters == {"n.elements": 10, "n.small": 4}


def test_paths(spark):
    assert sinks.output_path("gs://b/out", "PIXAR", 16) == "gs://b/out/PIXAR.16.png"
    assert sinks.output_path("/tmp/x/", "A", 1) == "/tmp/x/A.1.png"
    with pytest.raises(ValueError, match="nosuch"):
        sinks.check_scheme(spark, "nosuch://a/b")


def _read_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, found = 8, {}
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        found[kind], at = body, at + 12 + n
    width, height = struct.unpack(">II", found[b"IHDR"][:8])
    return np.frombuffer(zlib.decompress(found[b"IDAT"]), dtype=np.uint8).reshape(height, 1 + 4 * width)[:, 1:].reshape(height, width, 4)


def test_raster_mirrors_and_leaves_gaps(spark):
    rows = spark.createDataFrame([(0, 1, 1, 2, 3)], "px int, py int, r int, g int, b int")
    image = _read_png(sinks.png(sinks.raster(rows, 3, 2)))
    assert image[0, 2].tolist() == [1, 2, 3, 255] and image[..., 3].sum() == 255


def test_quantised(spark):
    rows = spark.createDataFrame([(float("nan"),), (-1.0,), (14.9,), (254.99,), (300.0,)], "v double")
    assert [r[0] for r in rows.select(sinks.quantised(F.col("v"))).collect()] == [0, 0, 14, 254, 255]


def test_render(spark, tmp_path):
    image = plan.Image(width=16, height=9, samples=2, bounces=2)
    one, many = (sorted(map(tuple, plan.render(spark, "ab", image, parts=p).collect())) for p in (1, 7))
    assert one == many and len(one) == 16 * 9
    assert len(plan.render(spark, "ab", plan.Image(16, 9, 1, 1)).collect()) == 16 * 9 - 1
    done = plan.render_to_file(spark, "ab", image, str(tmp_path))
    assert done.counters["trace.elements"] == 16 * 9 * 2 - 1 and done.path.endswith("AB.2.png")
    assert _read_png(open(done.path, "rb").read()).shape == (9, 16, 4)
    with pytest.raises(ValueError, match="no glyph"):
        plan.render(spark, "a?", image)


def test_call_with_binds_by_name(spark):
    df = spark.createDataFrame([("foo", 42)], "k string, v int")

    def only(element, large):
        if element["v"] > 40:
            large(element)

    got = call_with(df, only, ["large", "small"], "k string, v int")
    assert [tuple(r) for r in got.collect()] == [("large", "foo", 42)]
    with pytest.raises(TypeError, match="nothing"):
        call_with(df, lambda element, nothing: None, [], "k string")
    assert call_with(df, lambda: None, [], "k string").count() == 0
