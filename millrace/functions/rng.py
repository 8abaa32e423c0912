"""Random numbers keyed by (ray, draw): two rounds of a 32-bit xor-shift-multiply finaliser, alike in columns and NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_FACTOR, _LOW = 73244475, 0xFFFFFFFF


def uniform(key: Column) -> Column:
    """A double in [0, 1) from a long from 0 up to 2^32."""
    for _ in range(2):
        key = (key.bitwiseXOR(F.shiftright(key, 16)) * F.lit(_FACTOR)).bitwiseAND(F.lit(_LOW))
    return key.bitwiseXOR(F.shiftright(key, 16)) / F.lit(2.0**32)


def uniform_np(key: np.ndarray) -> np.ndarray:
    key = key.astype(np.int64)
    if len(key) and not 0 <= key.min() <= key.max() <= _LOW:
        raise ValueError("random numbers are keyed by numbers from 0 up to 2^32; beyond they would repeat")
    for _ in range(2):
        key = ((key ^ (key >> 16)) * _FACTOR) & _LOW
    return (key ^ (key >> 16)) / 2.0**32
