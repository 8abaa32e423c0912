"""The queries of the dataflow part, one for each operator, and the same in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dispatch, glyphs, sdf, vec
from millrace.functions.rng import uniform
from millrace.functions.scalar import atoi, itoa, toi, tone_mapped
from millrace.operators import bundles, combine, elementwise, outputs, sides, sinks
from millrace.operators.invoke import call_with
from millrace.operators.metrics import Run
from millrace.plans import render as plan
from millrace.plans.launch import launch_and_wait
from millrace.sources.generated import count_up, fan_out, impulse, literal, ray_indexes
from millrace.sources.tables import table
from millrace.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WORD, SMALL = "PIXAR", plan.Image(width=64, height=36, samples=4, bounces=3)
EVENT_TIME = "1973-11-29 21:33:09"  # 123456789 seconds


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- sources and sinks


@query("SELECT 1::BIGINT AS n, 0::BIGINT AS n_bytes")
def impulse_source(spark, sf_dir):
    return impulse(spark).agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).cast("long").alias("n_bytes"))


@query("SELECT 'a' AS key, 1::BIGINT AS value UNION ALL SELECT 'b', 2::BIGINT")
def literal_source(spark, sf_dir):
    return literal(spark, [("a", 1), ("b", 2)], "key string, value long")


@query("SELECT i AS v FROM range(10) t(i)")
def source_range(spark, sf_dir):
    return count_up(spark, 10)


@query("SELECT i AS v FROM range(10) t(i)")
def source_fan_out(spark, sf_dir):
    return fan_out(impulse(spark), 10)


@query("SELECT i, floor((i % (8 * 2)) / 2)::INTEGER AS px, floor(i / (8 * 2))::INTEGER AS py FROM range(1, 8 * 4 * 2) t(i)")
def ray_index(spark, sf_dir):
    return ray_indexes(spark, 8, 4, 2)


@query("SELECT count(*) AS n FROM events")
def discard_count(spark, sf_dir):
    n = sinks.discard(table(spark, sf_dir, "events"))
    return spark.createDataFrame([(n,)], "n long")


@query("SELECT n_nationkey, concat('gs://bucket/out/', n_name, '.', n_regionkey::VARCHAR, '.png') AS path FROM nation")
def output_path(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", sinks.output_path_column("gs://bucket/./out", F.col("n_name"), F.col("n_regionkey")).alias("path"))


@query("SELECT count(*) AS elements, count(*) FILTER (event_type = 'error') AS errors FROM events")
def counters(spark, sf_dir):
    run = Run()
    sinks.discard(run.counted(table(spark, sf_dir, "events"), "events", errors=F.col("event_type") == "error"))
    return spark.createDataFrame([(run.counters["events.elements"], run.counters["events.errors"])], "elements long, errors long")


@query(
    """
SELECT x::INTEGER AS x, y::INTEGER AS y, coalesce(n_regionkey * 50, 0)::INTEGER AS r, coalesce(n_nationkey * 10, 0)::INTEGER AS g, coalesce(length(n_name), 0)::INTEGER AS b,
  CASE WHEN n_nationkey IS NULL THEN 0 ELSE 255 END::INTEGER AS a FROM range(6) t(x) CROSS JOIN range(5) u(y) LEFT JOIN nation ON n_nationkey % 5 = 5 - x AND n_nationkey // 5 = 4 - y
"""
)
def png_file(spark, sf_dir):
    """A picture of 6 by 5 pixels with a column that never came, written to a file, read back and unpacked."""
    key = F.col("n_nationkey")
    pixels = table(spark, sf_dir, "nation").select((key % 5).alias("px"), F.floor(key / 5).alias("py"), (F.col("n_regionkey") * 50).alias("r"), (key * 10).alias("g"), F.length("n_name").alias("b"))
    path = f"{_scratch(spark)}/{sinks.output_path('', 'NATION', 1)}"
    sinks.write_file(spark, path, sinks.png(sinks.raster(pixels, 6, 5)))
    image = sinks.unpacked(sinks.read_file(spark, path))
    rows = [(x, y, *(int(v) for v in image[y, x])) for y in range(5) for x in range(6)]
    return literal(spark, rows, "x int, y int, r int, g int, b int, a int")


# ---------------------------------------------------------------- element-wise


@query("SELECT i + 1 AS v FROM range(10) t(i)")
def increment(spark, sf_dir):
    return elementwise.increment(count_up(spark, 10), "v")


@query("SELECT event_id, value FROM events")
def identity_chain(spark, sf_dir):
    return elementwise.identity(table(spark, sf_dir, "events").select("event_id", "value"), 100)


@query("SELECT p_partkey, trunc(p_retailprice * p_retailprice)::BIGINT::VARCHAR AS s FROM part")
def square_trunc_format(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", dispatch.by_columns(F.col("p_retailprice")).alias("s"))


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS s FROM orders")
def itoa_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", itoa(F.col("o_orderkey")).alias("s"))


@query(
    r"""
WITH s AS (
  SELECT p_partkey, 'brand' AS kind, substr(p_brand, 7) AS s FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part
  UNION ALL SELECT p_partkey, 'negative', concat('-', p_size::VARCHAR) FROM part UNION ALL SELECT p_partkey, 'spaced', concat(' ', p_size::VARCHAR) FROM part
  UNION ALL SELECT p_partkey, 'large', concat(p_size::VARCHAR, '99999999999999999999') FROM part
)
SELECT p_partkey, kind, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN
  coalesce(try_cast(s AS BIGINT), CASE WHEN s[1] = '-' THEN -9223372036854775808 ELSE 9223372036854775807 END) ELSE 0 END::BIGINT AS v FROM s
"""
)
def atoi_lenient(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    forms = {"brand": F.col("p_brand").substr(7, 100), "type": F.col("p_type"), "negative": F.concat(F.lit("-"), size), "spaced": F.concat(F.lit(" "), size), "large": F.concat(size, F.lit("99999999999999999999"))}
    rows = part.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("s")) for k, v in forms.items()])).alias("f"))
    return rows.select("p_partkey", "f.kind", atoi(F.col("f.s")).alias("v"))


@query("SELECT o_orderkey::VARCHAR AS key, o_orderkey AS value FROM orders")
def to_kv(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return elementwise.to_kv(o, itoa(F.col("o_orderkey")), F.col("o_orderkey"))


@query("SELECT o_orderkey AS k, o_totalprice AS c FROM orders")
def flatten_kv(spark, sf_dir):
    o = elementwise.to_kv(table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_totalprice"))
    return elementwise.flatten_kv(o).select(F.col("kv.key").alias("k"), F.col("kv.value").alias("c"))


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 10")
def conditional_emit(spark, sf_dir):
    return elementwise.emit_if(table(spark, sf_dir, "events"), (F.col("event_type") == "purchase") & (F.col("value") > 10)).select("event_id", "value")


@query("SELECT event_id, value * 2 AS doubled, upper(event_type) AS kind FROM events")
def map_direct(spark, sf_dir):
    return elementwise.map_to(table(spark, sf_dir, "events"), event_id=F.col("event_id"), doubled=F.col("value") * 2, kind=F.upper("event_type"))


@query("SELECT event_id, value + 1 AS more FROM events WHERE value > 1")
def par_do(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    def process(batches):
        for b in batches:
            b = b.filter(pc.greater(b.column("value"), 1.0))
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pc.add(b.column("value"), 1.0)], names=["event_id", "more"])

    return elementwise.par_do(table(spark, sf_dir, "events").select("event_id", "value"), process, "event_id long, more double")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def reshuffle(spark, sf_dir):
    return elementwise.reshuffled(table(spark, sf_dir, "events"), 4, "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, trunc((ascii(p_type) - 79) / 2e0)::INTEGER AS v FROM part")
def letter_coordinate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", toi(F.col("p_type")).alias("v"))


@query("SELECT event_id, unnest(string_split(event_type, 'i')) AS piece FROM events")
def flat_map(spark, sf_dir):
    return elementwise.flat_map(table(spark, sf_dir, "events"), "piece", F.split("event_type", "i"), "event_id")


# ---------------------------------------------------------------- side inputs


@query("SELECT n_nationkey, coalesce((SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 1), 0)::BIGINT AS first FROM nation")
def first_side_input(spark, sf_dir):
    return sides.with_first(table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), "s_suppkey", "s_suppkey", "found", F.lit(0)).select("n_nationkey", F.col("found").alias("first"))


@query("SELECT n_nationkey, 0::BIGINT AS first FROM nation")
def empty_side_input(spark, sf_dir):
    empty = table(spark, sf_dir, "supplier").where("s_suppkey < 0")
    return sides.with_first(table(spark, sf_dir, "nation"), empty, "s_suppkey", "s_suppkey", "found", F.lit(0)).select("n_nationkey", F.col("found").alias("first"))


@query("SELECT p_partkey, coalesce(v, 0)::BIGINT AS first_event FROM part LEFT JOIN (SELECT user_id, min(event_id) AS v FROM events GROUP BY 1) ON user_id = p_partkey")
def map_side_lookup(spark, sf_dir):
    return sides.lookup_first(table(spark, sf_dir, "part"), "p_partkey", table(spark, sf_dir, "events"), "user_id", "event_id", "first_event", F.lit(0)).select("p_partkey", "first_event")


@query("SELECT n_nationkey, (SELECT min(r_regionkey) FROM region) AS tag1, (SELECT min_by(s_name, s_suppkey) FROM supplier) AS tag2 FROM nation")
def tagged_sides(spark, sf_dir):
    region, supplier = table(spark, sf_dir, "region"), table(spark, sf_dir, "supplier")
    out = sides.with_scalars(table(spark, sf_dir, "nation"), tag1=(region, "r_regionkey", "r_regionkey"), tag2=(supplier, "s_name", "s_suppkey"))
    return out.select("n_nationkey", "tag1", "tag2")


@query("SELECT n_nationkey, count(*) AS n, sum(r_regionkey)::BIGINT AS total FROM nation CROSS JOIN region GROUP BY 1")
def iterable_side(spark, sf_dir):
    out = sides.iterate_side(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), "side")
    total = F.aggregate("side", F.lit(0).cast("long"), lambda acc, r: acc + r["r_regionkey"])
    return out.select("n_nationkey", F.size("side").cast("long").alias("n"), total.alias("total"))


# ---------------------------------------------------------------- outputs, bundles


@query("SELECT 'all' AS tag, l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT 'returned', l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def tagged_outputs(spark, sf_dir):
    rows = outputs.tagged(table(spark, sf_dir, "lineitem"), all=F.lit(True), returned=F.col("l_returnflag") == "R")
    return rows.select("tag", "l_orderkey", "l_linenumber")


@query("SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'rest' END AS tag, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def multi_emitter_route(spark, sf_dir):
    rows = outputs.routed(table(spark, sf_dir, "events"), F.col("event_type"), "view", "click")
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_id % 8 AS bundle_id, count(*) AS n FROM events GROUP BY 1")
def bundle_counts(spark, sf_dir):
    return bundles.bundle_counts(table(spark, sf_dir, "events"), F.col("event_id") % 8)


@query("SELECT sum(n)::BIGINT AS n FROM (SELECT count(*) AS n FROM events)")
def bundle_lifecycle(spark, sf_dir):
    import pyarrow as pa

    def stage() -> bundles.Stage:
        seen = [0]

        def setup() -> None:
            seen[0] = 0

        def process(batch: pa.RecordBatch) -> None:
            seen[0] += batch.num_rows

        return bundles.Stage(process, finish=lambda: pa.RecordBatch.from_pydict({"n": [seen[0]]}), setup=setup)

    keep = bundles.Stage(lambda batch: batch)
    return bundles.run_bundles(table(spark, sf_dir, "events").select("event_id"), [keep, stage()], "n long").agg(F.sum("n").alias("n"))


@query("SELECT i AS v FROM range(5) t(i)")
def early_stop(spark, sf_dir):
    """A stage that has enough after five elements; the rest of its bundle isn't read."""
    import pyarrow as pa

    def stage() -> bundles.Stage:
        seen = [0]

        def process(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = batch.slice(0, 5 - seen[0])
            seen[0] += own.num_rows
            if seen[0] == 5:
                raise bundles.Enough(own)
            return own

        return bundles.Stage(process)

    return bundles.run_bundles(count_up(spark, 10).coalesce(1), [stage()], "v long")


@query(f"SELECT sum(n)::BIGINT AS n, TIMESTAMP '{EVENT_TIME}' AS at FROM (SELECT count(*) AS n FROM events)")
def bundle_event_time(spark, sf_dir):
    """A count that a bundle's finish emits, at a time of its own."""
    import pyarrow as pa

    def stage() -> bundles.Stage:
        seen = [0]

        def process(batch: pa.RecordBatch) -> None:
            seen[0] += batch.num_rows

        return bundles.Stage(process, finish=lambda: bundles.at_time(pa.RecordBatch.from_pydict({"n": [seen[0]]}), 123456789))

    found = bundles.run_bundles(table(spark, sf_dir, "events").select("event_id"), [stage()], "n long, event_time timestamp")
    return found.groupBy(F.col("event_time").cast("timestamp_ntz").alias("at")).agg(F.sum("n").alias("n"))


@query(f"SELECT event_id, ts AS own_time, TIMESTAMP '{EVENT_TIME}' AS given_time, NULL::VARCHAR AS pane FROM events")
def element_event_time(spark, sf_dir):
    own = elementwise.with_event_time(table(spark, sf_dir, "events"), F.col("ts")).withColumn("own_time", F.col("event_time").cast("timestamp_ntz"))
    given = elementwise.with_event_time(own, F.lit(EVENT_TIME))
    return given.select("event_id", "own_time", F.col("event_time").cast("timestamp_ntz").alias("given_time"), "pane")


@query(
    """
SELECT t.tag, n_name AS k, n_nationkey AS v, 123456789::BIGINT AS at, (SELECT min(r_regionkey) FROM region)::BIGINT AS first, (SELECT min_by(r_name, r_regionkey) FROM region) AS word
FROM nation, (SELECT unnest(['output1', 'output2']) AS tag) t
"""
)
def dynamic_invoker(spark, sf_dir):
    region = table(spark, sf_dir, "region").orderBy("r_regionkey")

    def both(element, event_time, tag1, tag2, output1, output2):
        row = {"k": element["n_name"], "v": element["n_nationkey"], "at": event_time, "first": next(tag1, 0), "word": next(tag2, "")}
        output1(row)
        output2(row)

    sides_of = {"tag1": region.select("r_regionkey"), "tag2": region.select("r_name")}
    return call_with(table(spark, sf_dir, "nation"), both, ["output1", "output2"], "k string, v int, at long, first long, word string", sides_of, event_time=123456789)


@query("SELECT 'source' AS step, 10::BIGINT AS n UNION ALL SELECT 'sink', 10")
def launch(spark, sf_dir):
    def build(s: SparkSession, run: Run) -> dict[str, DataFrame]:
        source = fan_out(impulse(s), 10)
        return {"source": source, "sink": run.counted(elementwise.increment(source, "v"), "increment")}

    return spark.createDataFrame(list(launch_and_wait(spark, build, "demo").elements.items()), "step string, n long")


# ---------------------------------------------------------------- grouping


@query("SELECT o_custkey AS key, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS vals FROM orders GROUP BY 1")
def group_by_key(spark, sf_dir):
    o = elementwise.to_kv(table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderkey"))
    return combine.group_by_key(o).select("key", F.array_join(F.transform("values", itoa), ",").alias("vals"))


@query("SELECT 0 AS key, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def fixed_key_group(spark, sf_dir):
    keyed = combine.add_fixed_key(table(spark, sf_dir, "events").select("event_id", "value"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("value.value"), 4).alias("total"))


SQL["fixed_key_group"] = "SELECT 0 AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"


def _tone(x: str, samples: str) -> str:
    return f"(({x}) / {samples} + 14e0 / 241) / (({x}) / {samples} + 14e0 / 241 + 1) * 255"


@query(f"SELECT l_suppkey, {', '.join(f'round({_tone(f'sum({c})', '16e0')}, 6) AS {n}' for n, c in zip('rgb', ('l_quantity', 'l_discount', 'l_tax'), strict=True))} FROM lineitem GROUP BY 1")
def combine_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    out = combine.combine_per_key(rows, ["l_suppkey"], combine.pixels(16))
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in "rgb"])


@query(f"SELECT p_partkey, round({_tone('p_retailprice', '16e0')}, 6) AS v FROM part")
def tone_map(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(tone_mapped(F.col("p_retailprice"), 16), 6).alias("v"))


@query("SELECT l_orderkey, l_linenumber, 960 - 1 - l_linenumber AS x, floor(least(255, greatest(0, l_extendedprice / 100)))::INTEGER AS v FROM lineitem")
def quantise_flip(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.lit(960 - 1) - F.col("l_linenumber")).alias("x"), sinks.quantised(F.col("l_extendedprice") / 100).alias("v"))


@query("SELECT label, min(embedding[1])::DOUBLE - 0.5e0 AS x_min, max(embedding[1])::DOUBLE + 0.5e0 AS x_max, min(embedding[2])::DOUBLE - 0.5e0 AS y_min, max(embedding[2])::DOUBLE + 0.5e0 AS y_max FROM embeddings GROUP BY 1")
def bounding_box(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return combine.combine_per_key(rows, ["label"], combine.bounding_box("x", "y", 0.5))


# ---------------------------------------------------------------- dispatch


@query(" UNION ALL ".join(f"SELECT '{v}' AS variant, p_partkey, trunc(p_retailprice * p_retailprice)::BIGINT::VARCHAR AS s FROM part" for v in ("columns", "sql", "switch", "registry", "series", "fused")))
def function_registry(spark, sf_dir):
    c = F.col("p_retailprice")
    batches = dispatch.Registry(fallback=dispatch.series_adapter)
    forms = {
        "columns": dispatch.by_columns(c), "sql": dispatch.by_sql("p_retailprice"), "switch": dispatch.by_switch(c),
        "registry": dispatch.by_registry(c, dispatch.standard_registry()), "series": dispatch.by_registry(c, batches), "fused": dispatch.by_fused_series()(c),
    }
    part = table(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in forms.items()])
    return part.unpivot("p_partkey", list(forms), "variant", "s").select("variant", "p_partkey", "s")


# ---------------------------------------------------------------- glyphs


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else f"{v}"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names})"


_LINES = _values([(g.char, *s) for g in glyphs.catalog().values() for s in g.lines], "char, x0, y0, x1, y1")
_ARCS = _values([(g.char, *a) for g in glyphs.catalog().values() for a in g.arcs], "char, kind, cx, cy, r")
_BOXES = f"""
lines AS (SELECT * FROM {_LINES}), arcs AS (SELECT * FROM {_ARCS}), ends AS (
  SELECT char, x0 AS x, y0 AS y FROM lines UNION ALL SELECT char, x1, y1 FROM lines
  UNION ALL SELECT char, CASE WHEN kind <> 'r' THEN cx - r END, CASE WHEN kind <> 'u' THEN cy - r END FROM arcs
  UNION ALL SELECT char, CASE WHEN kind <> 'l' THEN cx + r END, CASE WHEN kind <> 'd' THEN cy + r END FROM arcs
), boxes AS (
  SELECT char, min(x) - 0.5e0 AS x_min, max(x) + 0.5e0 AS x_max, min(y) - 0.5e0 AS y_min, max(y) + 0.5e0 AS y_max FROM ends GROUP BY 1
)"""


@query(f"WITH {_BOXES} SELECT char, x_min, x_max, y_min, y_max, x_max - x_min AS width FROM boxes")
def glyph_bbox(spark, sf_dir):
    return glyphs.boxes(glyphs.glyph_table(spark))


_UNKNOWN = "regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyzıſ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZIS'), '[A-Z08# ]', '', 'g')"


@query(f"SELECT doc_id, {_UNKNOWN} = '' AS valid, length({_UNKNOWN})::INTEGER AS n_unknown, substr({_UNKNOWN}, 1, 1) AS first_unknown FROM documents")
def validate_word(spark, sf_dir):
    lacks = glyphs.unknown_characters(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", lacks.alias("u")).select("doc_id", (F.col("u") == "").alias("valid"), F.length("u").alias("n_unknown"), F.col("u").substr(1, 1).alias("first_unknown"))


@query(
    f"""
WITH {_BOXES}, words AS (
  SELECT DISTINCT w AS word FROM (
    SELECT unnest(['PIXAR', 'A B', 'GOPHER', 'ABCDEFGHIJ']) AS w
    UNION ALL SELECT regexp_replace(upper(r_name), '[^A-Z08# ]', '', 'g') FROM region UNION ALL SELECT regexp_replace(upper(n_name), '[^A-Z08# ]', '', 'g') FROM nation)
), chars AS (
  SELECT word, i::INTEGER AS pos, substr(word, i + 1, 1) AS char FROM words, LATERAL (SELECT unnest(range(length(word)))) t(i)
), sized AS (
  SELECT word, pos, char, CASE WHEN char = ' ' THEN 4e0 ELSE x_max - x_min + 1 END AS advance FROM chars JOIN boxes USING (char)
)
SELECT * FROM (
  SELECT word, pos, char, greatest(-16e0, -((sum(advance) OVER (PARTITION BY word) - 1) / 2) + 0.5e0)
    + coalesce(sum(advance) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM sized
) WHERE char <> ' '
"""
)
def word_layout(spark, sf_dir):
    named = [spark.createDataFrame([(w,) for w in ("PIXAR", "A B", "GOPHER", "ABCDEFGHIJ")], "word string")]
    for name in ("region", "nation"):
        named.append(table(spark, sf_dir, name).select(F.regexp_replace(F.upper(F.col(f"{name[0]}_name")), "[^A-Z08# ]", "").alias("word")))
    words = named[0].unionByName(named[1]).unionByName(named[2]).distinct()
    return glyphs.layout(words, glyphs.glyph_table(spark))


# ---------------------------------------------------------------- vectors and distances

_POINTS = "points AS (SELECT vec_id, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y, embedding[3]::DOUBLE * 20 AS z FROM embeddings)"


def _points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[(F.get("embedding", F.lit(i)).cast("double") * 20).alias(n) for i, n in enumerate("xyz")])


def _p() -> tuple:
    return F.col("x"), F.col("y"), F.col("z")


@query(
    f"""
WITH {_POINTS}, n AS (SELECT *, sqrt(x * x + y * y + z * z) AS s FROM points)
SELECT vec_id, round(x + y + z, 6) AS dotted, round(z - y, 6) AS cx, round(x - z, 6) AS cy, round(y - x, 6) AS cz, round(x / s, 6) AS nx,
  round(x * 2 - y, 6) AS mixed, greatest(0e0, least(1e0, x)) AS clamped, least(x, y) AS low, greatest(x, y) AS high FROM n
"""
)
def vector_algebra(spark, sf_dir):
    p, one = vec.vec(*_p()), vec.vec(1, 1, 1)
    c = vec.cross(one, p)
    r = lambda v: F.round(v, 6)
    mixed = vec.minus(vec.plus(p, vec.times(p, one)), vec.scaled(vec.vec(F.col("y"), F.col("y"), F.col("y")), 1.0))
    return _points(spark, sf_dir).select(
        "vec_id", r(vec.dot(p, one)).alias("dotted"), r(c["x"]).alias("cx"), r(c["y"]).alias("cy"), r(c["z"]).alias("cz"), r(vec.normalised(p)["x"]).alias("nx"),
        r(mixed["x"]).alias("mixed"), vec.clamped(F.col("x"), 0.0, 1.0).alias("clamped"), vec.smaller(F.col("x"), F.col("y")).alias("low"), vec.larger(F.col("x"), F.col("y")).alias("high"),
    )


def _box_sql(x: str, y: str, z: str, low: tuple, high: tuple) -> str:
    return "-least(" + ", ".join(f"{v} - ({a}::DOUBLE), {b}::DOUBLE - {v}" for v, a, b in zip((x, y, z), low, high, strict=True)) + ")"


def _sphere_sql(s: tuple) -> str:
    return "sqrt(" + " + ".join(f"({c}::DOUBLE - {v}) * ({c}::DOUBLE - {v})" for v, c in zip("xyz", s, strict=False)) + f") - {s[3]}::DOUBLE"


_ROOM = f"least(-least({_box_sql(*'xyz', *sdf.LOWER)}, {_box_sql(*'xyz', *sdf.UPPER)}), {_box_sql('(abs(x) % 8e0)', 'y', 'z', *sdf.PLANKS)})"


@query(f"WITH {_POINTS} SELECT vec_id, round({_box_sql(*'xyz', (-1.0, -2.0, -3.0), (3.0, 2.0, 1.0))}, 6) AS d FROM points")
def box_sdf(spark, sf_dir):
    return _points(spark, sf_dir).select("vec_id", F.round(sdf.box(_p(), (-1.0, -2.0, -3.0), (3.0, 2.0, 1.0)), 6).alias("d"))


@query(f"WITH {_POINTS} SELECT vec_id, round({_sphere_sql((1.0, 2.0, 3.0, 4.0))}, 6) AS d FROM points")
def sphere_sdf(spark, sf_dir):
    return _points(spark, sf_dir).select("vec_id", F.round(sdf.sphere(_p(), (1.0, 2.0, 3.0), 4.0), 6).alias("d"))


@query(f"WITH {_POINTS} SELECT vec_id, round({_ROOM}, 6) AS d FROM points")
def room_sdf(spark, sf_dir):
    return _points(spark, sf_dir).select("vec_id", F.round(sdf.room(_p()), 6).alias("d"))


#: d and material of placed letters: standing(vec_id, idx, char, x, y, z) -> letters
_LETTERS = """
flat AS (
  SELECT a.vec_id, a.idx, min(dx * dx + dy * dy) AS sq FROM (
    SELECT a.*, l.x0, l.y0, l.x1 - l.x0 AS ex, l.y1 - l.y0 AS ey,
      greatest(0e0, least(1e0, ((a.x - l.x0) * (l.x1 - l.x0) + (a.y - l.y0) * (l.y1 - l.y0)) / ((l.x1 - l.x0) * (l.x1 - l.x0) + (l.y1 - l.y0) * (l.y1 - l.y0)))) AS t,
      a.x - (l.x0 + (l.x1 - l.x0) * t) AS dx, a.y - (l.y0 + (l.y1 - l.y0) * t) AS dy
    FROM standing a JOIN lines l USING (char)) a GROUP BY ALL
), curved AS (
  SELECT vec_id, idx, min(CASE WHEN kind = 'o' OR along > 0 THEN abs(sqrt(ox * ox + oy * oy) - r)
    ELSE sqrt(along * along + (CASE WHEN across > 0 THEN across - r ELSE across + r END) ** 2) END) AS d FROM (
    SELECT a.*, r, kind, a.x - cx AS ox, a.y - cy AS oy, CASE kind WHEN 'r' THEN ox WHEN 'l' THEN -ox WHEN 'u' THEN oy ELSE -oy END AS along,
      CASE WHEN kind IN ('r', 'l') THEN oy ELSE ox END AS across
    FROM standing a JOIN arcs USING (char)) GROUP BY ALL
), letters AS (
  SELECT a.vec_id, a.idx, a.char, -least(x - x_min, x_max - x, y - y_min, y_max - y, z + 0.5e0, 0.5e0 - z) AS away,
    least(sqrt(least(1e9::DOUBLE, coalesce(f.sq, 1e9))), coalesce(c.d, 1e9)) AS near,
    CASE WHEN away > 0.001e0 THEN away ELSE pow(pow(near, 8) + pow(z, 8), 0.125e0) - 0.5e0 END AS d, CASE WHEN away > 0.001e0 THEN 11 ELSE 1 END AS material
  FROM standing a JOIN boxes b USING (char) LEFT JOIN flat f ON f.vec_id = a.vec_id AND f.idx = a.idx LEFT JOIN curved c ON c.vec_id = a.vec_id AND c.idx = a.idx
)"""


@query(f"WITH {_BOXES}, {_POINTS}, standing AS (SELECT vec_id, char AS idx, char, x / 2 + 2 AS x, y / 2 + 4 AS y, z / 20 AS z FROM points CROSS JOIN boxes), {_LETTERS} SELECT vec_id, char, round(d, 6) AS d, material FROM letters")
def letter_sdf(spark, sf_dir):
    p = (F.col("x") / 2 + 2, F.col("y") / 2 + 4, F.col("z") / 20)
    table_of = glyphs.glyph_table(spark)
    shapes = table_of.join(glyphs.boxes(table_of), "char").agg(F.collect_list(F.struct("*")).alias("shapes"))  # the catalog: 30 rows, whatever the input
    rows = _points(spark, sf_dir).crossJoin(F.broadcast(shapes)).select("vec_id", "x", "y", "z", F.explode("shapes").alias("g"))
    return rows.select("vec_id", "g.char", sdf.letter_of_row(p, F.col("g")).alias("s")).select("vec_id", "char", F.round("s.d", 6).alias("d"), F.col("s.material").alias("material"))


@query(
    f"""
WITH {_BOXES}, {_POINTS}, placed AS (SELECT * FROM {_values([(i, c, x) for i, (c, x) in enumerate(glyphs.layout_of(WORD))], "idx, char, shift")}),
standing AS (SELECT vec_id, idx, char, x - shift AS x, y, z FROM points CROSS JOIN placed), {_LETTERS}, models AS (
  SELECT vec_id, idx, d, material FROM letters UNION ALL SELECT vec_id, 100, {_ROOM}, 9 FROM points
  {" ".join(f"UNION ALL SELECT vec_id, {101 + i}, {_sphere_sql(s)}, {s[4]} FROM points" for i, s in enumerate(sdf.SPHERES))}
), best AS (
  SELECT vec_id, list_reduce(list({{'d': d, 'm': material}} ORDER BY idx), lambda acc, m: CASE WHEN m.d < acc.d + 0.001e0 THEN m ELSE acc END, {{'d': 1e9::DOUBLE, 'm': 0}}) AS b FROM models GROUP BY 1
)
SELECT vec_id, round(CASE WHEN 19.9e0 - y < b.d THEN 19.9e0 - y ELSE b.d END, 6) AS d, CASE WHEN 19.9e0 - y < b.d THEN 10 ELSE b.m END AS material FROM best JOIN points USING (vec_id)
"""
)
def scene_nearest(spark, sf_dir):
    return _points(spark, sf_dir).select("vec_id", sdf.scene(_p(), WORD).alias("s")).select("vec_id", F.round("s.d", 6).alias("d"), F.col("s.material").alias("material"))


# ---------------------------------------------------------------- rays

_UNIFORM = """
k1 AS (SELECT i, n, xor(k, k >> 16) * 73244475 & 4294967295::BIGINT AS k FROM k0), k2 AS (SELECT i, n, xor(k, k >> 16) * 73244475 & 4294967295::BIGINT AS k FROM k1),
u AS (SELECT i, n, xor(k, k >> 16) / 4294967296::DOUBLE AS u FROM k2)"""


@query(f"WITH k0 AS (SELECT i, n, i * 8 + n AS k FROM range(1, 64 * 36 * 4) t(i), range(8) s(n)), {_UNIFORM} SELECT i, n, u FROM u")
def random_draws(spark, sf_dir):
    rows = ray_indexes(spark, SMALL.width, SMALL.height, SMALL.samples).select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("n"))
    return rows.select("i", "n", uniform(F.col("i") * 8 + F.col("n")).alias("u"))


def _aimed() -> str:
    goal, left, up = SMALL.camera
    parts = [f"{goal[k]!r}::DOUBLE + a * {left[k]!r}::DOUBLE + b * {up[k]!r}::DOUBLE AS {n}" for k, n in enumerate("xyz")]
    return ", ".join(parts).replace("np.float64(", "(")


@query(
    f"""
WITH k0 AS (SELECT i, n, i * 8 + n AS k FROM range(1, 64 * 36 * 4) t(i), range(2) s(n)), {_UNIFORM}, p AS (
  SELECT i, floor((i % 256) / 4)::INTEGER AS px, floor(i / 256)::INTEGER AS py, max(u) FILTER (n = 0) AS up, max(u) FILTER (n = 1) AS aside FROM u GROUP BY 1
), d AS (SELECT *, py - 18 + up AS b, px - 32 + aside AS a, {_aimed()} FROM p)
SELECT i, px, py, round(x / sqrt(x * x + y * y + z * z), 9) AS dx, round(y / sqrt(x * x + y * y + z * z), 9) AS dy, round(z / sqrt(x * x + y * y + z * z), 9) AS dz FROM d
"""
)
def ray_jitter(spark, sf_dir):
    return plan.rays(spark, SMALL).select("i", "px", "py", *[F.round(c, 9).alias(c) for c in ("dx", "dy", "dz")])


def _nearest_sql(word: str) -> list[str]:
    """Distances of the models of a scene from x, y, z, in order, as SQL with constants."""
    models = []
    for char, shift in glyphs.layout_of(word):
        g = glyphs.catalog()[char]
        x0, x1, y0, y1 = g.box
        x = f"(x - ({shift!r}::DOUBLE))"
        away = _box_sql(x, "y", "z", (x0, y0, -0.5), (x1, y1, 0.5))
        near = ["1e9::DOUBLE"]
        for ax, ay, bx, by in g.lines:
            ex, ey = bx - ax, by - ay
            t = f"greatest(0e0, least(1e0, (({x} - {ax}::DOUBLE) * {ex}::DOUBLE + (y - {ay}::DOUBLE) * {ey}::DOUBLE) / {ex * ex + ey * ey}::DOUBLE))"
            near.append(f"sqrt(({x} - {ax}::DOUBLE - {ex}::DOUBLE * {t}) ** 2 + (y - {ay}::DOUBLE - {ey}::DOUBLE * {t}) ** 2)")
        for kind, cx, cy, r in g.arcs:
            ox, oy = f"({x} - {cx}::DOUBLE)", f"(y - {cy}::DOUBLE)"
            ring = f"abs(sqrt({ox} ** 2 + {oy} ** 2) - {r}::DOUBLE)"
            along, across = {"o": ("1", "0"), "r": (ox, oy), "l": (f"(-{ox})", oy), "u": (oy, ox), "d": (f"(-{oy})", ox)}[kind]
            near.append(f"CASE WHEN {along} > 0 THEN {ring} ELSE sqrt({along} ** 2 + (CASE WHEN {across} > 0 THEN {across} - {r}::DOUBLE ELSE {across} + {r}::DOUBLE END) ** 2) END")
        solid = f"pow(pow(least({', '.join(near)}), 8) + pow(z, 8), 0.125e0) - 0.5e0"
        models.append((f"CASE WHEN {away} > 0.001e0 THEN {away} ELSE {solid} END", f"CASE WHEN {away} > 0.001e0 THEN 11 ELSE 1 END"))
    models.append((_ROOM, "9"))
    return models + [(_sphere_sql(s), str(s[4])) for s in sdf.SPHERES]


def _march_sql() -> str:
    """Rays of SMALL from the camera, a step of each in each round; a model later in order replaces one before if it is less than 0.001 farther."""
    models = _nearest_sql(WORD)
    fold = "SELECT *, " + ", ".join(f"{d} AS d{n}, {m} AS m{n}" for n, (d, m) in enumerate(models)) + ", 1e9::DOUBLE AS best, 0 AS kind FROM here"
    for n in range(len(models)):
        fold = f"SELECT * EXCLUDE (best, kind), CASE WHEN d{n} < best + 0.001e0 THEN d{n} ELSE best END AS best, CASE WHEN d{n} < best + 0.001e0 THEN m{n} ELSE kind END AS kind FROM ({fold})"
    x, y, z = (float(v) for v in plan.POSITION)
    return f"""
WITH RECURSIVE k0 AS (SELECT i, n, i * 8 + n AS k FROM range(1, 64 * 36 * 4) t(i), range(2) s(n)), {_UNIFORM}, p AS (
  SELECT i, floor((i % 256) / 4)::INTEGER AS px, floor(i / 256)::INTEGER AS py, max(u) FILTER (n = 0) AS up, max(u) FILTER (n = 1) AS aside FROM u GROUP BY 1
), aimed AS (SELECT i, {_aimed()} FROM (SELECT *, py - 18 + up AS b, px - 32 + aside AS a FROM p)), way AS (
  SELECT i, x / sqrt(x * x + y * y + z * z) AS dx, y / sqrt(x * x + y * y + z * z) AS dy, z / sqrt(x * x + y * y + z * z) AS dz FROM aimed
), steps AS (
  SELECT i, dx, dy, dz, 0e0 AS t, 0 AS step, NULL::INTEGER AS material FROM way
  UNION ALL
  SELECT i, dx, dy, dz, t + best, step + 1, CASE WHEN best < 0.001e0 OR step > 99 THEN kind WHEN t + best >= 100 THEN 0 END FROM (
    SELECT * EXCLUDE (best, kind), CASE WHEN 19.9e0 - y < best THEN 19.9e0 - y ELSE best END AS best, CASE WHEN 19.9e0 - y < best THEN 10 ELSE kind END AS kind
    FROM ({fold.replace("FROM here", f"FROM (SELECT *, {x} + dx * t AS x, {y} + dy * t AS y, {z} + dz * t AS z FROM steps WHERE material IS NULL) here")}))
)
SELECT material, count(*) AS n FROM steps WHERE material IS NOT NULL GROUP BY 1"""


@query(_march_sql())
def ray_march(spark, sf_dir):
    found = plan.first_hits(plan.rays(spark, SMALL), WORD)
    return found.groupBy("material").agg(F.count("*").alias("n"))


@query()
def render_pixels(spark, sf_dir):
    return plan.render(spark, WORD, SMALL)


# ---------------------------------------------------------------- event time


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    rows = streams.timed(table(spark, sf_dir, "events"), F.col("ts"), "10 minutes")
    out = streams.tumbling(rows, "1 hour", ["event_type"], n=F.count("*"), total=F.round(F.sum("value"), 4))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE AS window_start, count(*) AS n FROM events, range(2) t(o) GROUP BY 1")
def sliding_window(spark, sf_dir):
    rows = streams.timed(table(spark, sf_dir, "events"), F.col("ts"))
    return streams.sliding(rows, "1 hour", "30 minutes", [], n=F.count("*")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query(
    """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, no
"""
)
def session_windows(spark, sf_dir):
    rows = streams.timed(table(spark, sf_dir, "events"), F.col("ts"))
    out = streams.sessions(rows, "30 minutes", ["user_id"], n=F.count("*"))
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")


def _scratch(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """Runs a query over all that its source has, and returns what it wrote."""
    at = _scratch(spark)

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/rows/batch={n}")

    run = streams.finish_batches(df, lambda b, n: keep(b.drop("batch"), n), mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    schema = df.schema
    return spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(f"{at}/rows")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def stream_state(spark, sf_dir):
    rows = streams.from_files(spark, f"{sf_dir}/events.parquet").select("user_id")
    told = _streamed(spark, streams.running_counts(rows, "user_id"), "update")
    return told.groupBy("user_id").agg(F.max("n").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window(spark, sf_dir):
    rows = streams.timed(streams.from_files(spark, f"{sf_dir}/events.parquet"), F.col("ts"), "1 hour")
    told = _streamed(spark, streams.tumbling(rows, "1 hour", ["event_type"], n=F.count("*")), "update")
    return told.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.max("n").alias("n"))
