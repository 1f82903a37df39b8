"""S2 cells of points, vectorised."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_LEVEL = 30


def _st(u: np.ndarray) -> np.ndarray:
    return np.where(u >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(u)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(u)))


def leaf_cells(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Leaf cell ids (uint64): face, then the place on the face's Hilbert curve."""
    p, t = np.radians(lat), np.radians(lon)
    x, y, z = np.cos(p) * np.cos(t), np.cos(p) * np.sin(t), np.sin(p)
    xyz = np.stack([x, y, z])
    axis = np.argmax(np.abs(xyz), 0)
    face = np.where(np.take_along_axis(xyz, axis[None], 0)[0] < 0, axis + 3, axis)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        v = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    size = 1 << MAX_LEVEL
    i, j = (np.clip(np.floor(_st(w) * size).astype(np.int64), 0, size - 1) for w in (u, v))
    # orientation: bit 0 swaps the axes, bit 1 inverts; an odd face starts swapped
    order = np.array([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]])  # of quadrant 2 * i + j
    turn = np.array([1, 0, 0, 3])  # of the place on the curve
    state, cell = face & 1, face.astype(np.uint64)
    for k in range(MAX_LEVEL - 1, -1, -1):
        place = order[state, 2 * ((i >> k) & 1) + ((j >> k) & 1)]
        cell = (cell << np.uint64(2)) | place.astype(np.uint64)
        state = state ^ turn[place]
    return (cell << np.uint64(1)) | np.uint64(1)


def parent(cell: np.ndarray, level: int) -> np.ndarray:
    low = np.uint64(1 << (2 * (MAX_LEVEL - level)))
    return (cell & ~(low - np.uint64(1) | low)) | low


def token(cell: int) -> str:
    return f"{int(cell):016x}".rstrip("0") or "X"


def s2_token(lat: Column, lon: Column, level: int) -> Column:
    @F.pandas_udf(StringType())
    def run(a: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([token(c) for c in parent(leaf_cells(a.to_numpy(float), o.to_numpy(float)), level)])

    return run(lat, lon)
