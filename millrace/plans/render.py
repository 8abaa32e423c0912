"""The flagship plan: a word, as glyphs in a room, ray-traced into an image.

Ray indexes are a range, so samples of a pixel are in the same part; colours are summed before the
one shuffle, by pixel; the driver gets a row for each pixel only to write the image.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.glyphs import validate
from millrace.functions.kernel import Scene, march, trace
from millrace.functions.rng import uniform
from millrace.operators.combine import combine_per_key, pixels
from millrace.operators.metrics import Run
from millrace.operators.sinks import check_scheme, output_path, png, quantised, raster, write_file
from millrace.sources.generated import ray_indexes

#: Where the camera is and what it looks at.
POSITION, TARGET = np.array([-22.0, 5.0, 25.0]), np.array([-3.0, 4.0, 0.0])
#: Rays that a worker traces together.
TOGETHER = 8192


@dataclass(frozen=True)
class Image:
    width: int = 960
    height: int = 540
    samples: int = 1
    bounces: int = 3
    zoom: float | None = None  # the width that the camera is set for; none: the image's

    @property
    def camera(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """goal, left and up."""
        unit = lambda v: v / np.sqrt((v * v).sum())
        goal = unit(TARGET - POSITION)
        left = unit(np.array([goal[2], 0.0, -goal[0]])) / (self.zoom or self.width)
        return goal, left, np.cross(goal, left)


@lru_cache(maxsize=8)
def _scene(word: str) -> Scene:
    """Once for each worker."""
    return Scene(word)


def rays(spark: SparkSession, image: Image, parts: int | None = None, include_origin: bool = False) -> DataFrame:
    """i, px, py, dx, dy, dz: directions through a random place of each pixel; the draw for up comes first."""
    goal, left, up = image.camera
    key = F.col("i") * (2 + 2 * image.bounces)
    at = ray_indexes(spark, image.width, image.height, image.samples, parts, include_origin)
    b, a = F.col("py") - image.height / 2 + uniform(key), F.col("px") - image.width / 2 + uniform(key + 1)
    aimed = at.select("i", "px", "py", *[(F.lit(float(goal[k])) + a * float(left[k]) + b * float(up[k])).alias(n) for k, n in enumerate("xyz")])
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return aimed.select("i", "px", "py", *[(F.col(n) / size).alias(f"d{n}") for n in "xyz"])


def _directions(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(f"d{n}").to_numpy() for n in "xyz"], axis=1)


def traced(found: DataFrame, word: str, bounces: int, stop_at_sun: bool = False) -> DataFrame:
    """px, py, x, y, z: the colour of each ray."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene = _scene(word)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                colour = trace(POSITION, _directions(batch), batch.column("i").to_numpy(), scene, bounces, stop_at_sun)
                yield pa.RecordBatch.from_arrays([batch.column("px"), batch.column("py"), *(pa.array(colour[:, k]) for k in range(3))], names=["px", "py", "x", "y", "z"])

    return found.mapInArrow(run, "px int, py int, x double, y double, z double")


def first_hits(found: DataFrame, word: str) -> DataFrame:
    """i, px, py, material, and the place of what each ray hits first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene = _scene(word)
        for batch in batches:
            d = _directions(batch)
            material, place, _ = march(np.broadcast_to(POSITION, d.shape), d, scene)
            cols = [batch.column(c) for c in ("i", "px", "py")] + [pa.array(material.astype(np.int32))] + [pa.array(place[:, k]) for k in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names=["i", "px", "py", "material", "x", "y", "z"])

    return found.mapInArrow(run, "i long, px int, py int, material int, x double, y double, z double")


def pixel_values(colours: DataFrame, samples: int | Column) -> DataFrame:
    """px, py, r, g, b from 0 to 255."""
    mapped = combine_per_key(colours, ["px", "py"], pixels(samples))
    return mapped.select("px", "py", *[quantised(F.col(c)).alias(c) for c in "rgb"])


def render(spark: SparkSession, word: str, image: Image, parts: int | None = None, include_origin: bool = False) -> DataFrame:
    return pixel_values(traced(rays(spark, image, parts, include_origin), validate(word), image.bounces), image.samples)


@dataclass(frozen=True)
class Rendered:
    path: str
    counters: dict[str, int]


def render_to_file(spark: SparkSession, word: str, image: Image, folder: str) -> Rendered:
    word, run = validate(word), Run()
    path = output_path(folder, word, image.samples)
    check_scheme(spark, path)
    colours = run.counted(traced(rays(spark, image), word, image.bounces), "trace")
    found = run.counted(pixel_values(colours, image.samples), "pixels")
    write_file(spark, path, png(raster(found, image.width, image.height)))
    return Rendered(path, run.counters)
