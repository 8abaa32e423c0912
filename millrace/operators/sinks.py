"""Sinks: discard and count, PNG images, and where they go."""

from __future__ import annotations

import posixpath
import struct
import zlib
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.metrics import Run


def discard(df: DataFrame) -> int:
    """Makes every row, keeps none, returns their number."""
    run = Run()
    run.counted(df, "discard").write.format("noop").mode("overwrite").save()
    return run.counters["discard.elements"]


def output_path(folder: str, word: str, samples: int) -> str:
    """folder/WORD.samples.png; a scheme keeps its two slashes."""
    return posixpath.normpath(posixpath.join(folder, f"{word}.{samples}.png")).replace(":/", "://", 1)


def output_path_column(folder: str, word: Column, samples: Column) -> Column:
    clean = posixpath.normpath(folder).replace(":/", "://", 1)
    return F.concat(F.lit(clean), F.lit("/"), word, F.lit("."), samples.cast("string"), F.lit(".png"))


def check_scheme(spark: SparkSession, path: str) -> None:
    """Fails before any work if no file system is known for the path's scheme."""
    jvm = spark._jvm
    try:
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    except Exception as e:
        raise ValueError(f"no file system for the scheme {urlsplit(path).scheme!r} of {path}") from e


def quantised(v: Column) -> Column:
    """Down to a whole number from 0 to 255; NaN is 0."""
    return F.when(F.isnan(v), 0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(v, F.lit(255.0))))).cast("int")


def raster(pixels: DataFrame, width: int, height: int) -> np.ndarray:
    """px, py, r, g, b as an RGBA image, both axes mirrored; pixels that never came stay transparent. It holds width times height pixels, whatever the number of samples."""
    out = np.zeros((height, width, 4), dtype=np.uint8)
    rows = pixels.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)).select("px", "py", "r", "g", "b").toPandas().to_numpy(dtype=np.int64)
    out[height - 1 - rows[:, 1], width - 1 - rows[:, 0], :3] = rows[:, 2:]
    out[height - 1 - rows[:, 1], width - 1 - rows[:, 0], 3] = 255
    return out


def png(image: np.ndarray) -> bytes:
    height, width, _ = image.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.hstack([np.zeros((height, 1), dtype=np.uint8), image.reshape(height, width * 4)])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def unpacked(data: bytes) -> np.ndarray:
    """The image of a file that png() made: one without interlacing, whose lines aren't filtered."""
    at, body, width, height = 8, b"", 0, 0
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        own = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + own):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", own[:8])
        body += own if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, 1 + 4 * width)[:, 1:].reshape(height, width, 4)


def read_file(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """To any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
