"""Hilbert curve positions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coordinate domains (xmin, ymin, xmax, ymax) of the known reference systems.
DOMAINS = {
    0: (-180.0, -90.0, 180.0, 90.0),
    4326: (-180.0, -90.0, 180.0, 90.0),
    3857: (-20037508.3427892, -20037508.3430388, 20037508.3427892, 20037508.3430388),
    2029: (309888.257034626, 4617073.21036364, 690111.742965374, 6139847.98761672),
}


def domain_of_srid(srid: int) -> tuple[float, float, float, float]:
    if srid not in DOMAINS:
        raise ValueError(f"no Hilbert domain for reference system {srid}; there are {', '.join(map(str, sorted(DOMAINS)))}")
    return DOMAINS[srid]


def cell(v: Column, low: float, high: float, bits: int) -> Column:
    """The grid cell of a coordinate in [low, high]."""
    return F.least(F.floor((v - F.lit(low)) / F.lit(high - low) * F.lit(float(2**bits))), F.lit(2**bits - 1)).cast("long")


def hilbert(x: Column, y: Column, bits: int = 16) -> Column:
    """Position of grid cell (x, y) on the curve of 2^bits cells a side; up to 31 bits.

    A fold over the bits from the highest; it takes the quadrant and turns the
    rest of the coordinates into it.
    """
    if not 1 <= bits <= 31:
        raise ValueError("1 to 31 bits")
    full = F.lit(2**bits - 1).cast("long")
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc, i):
        bit = F.expr("1L")
        rx = F.call_function("shiftright", acc["x"], i).bitwiseAND(bit)
        ry = F.call_function("shiftright", acc["y"], i).bitwiseAND(bit)
        quadrant = (F.lit(3) * rx).bitwiseXOR(ry)
        fx = F.when((ry == 0) & (rx == 1), full - acc["x"]).otherwise(acc["x"])
        fy = F.when((ry == 0) & (rx == 1), full - acc["y"]).otherwise(acc["y"])
        return F.struct(
            F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), (acc["d"] * 4 + quadrant).cast("long").alias("d")
        )

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["d"])


def hilbert_array(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """The same for arrays, up to 32 bits, unsigned."""
    x, y = x.astype(np.uint64), y.astype(np.uint64)
    d = np.zeros_like(x)
    full = np.uint64(2**bits - 1)
    for i in range(bits - 1, -1, -1):
        s = np.uint64(i)
        rx, ry = (x >> s) & np.uint64(1), (y >> s) & np.uint64(1)
        d = (d << np.uint64(2)) + ((np.uint64(3) * rx) ^ ry)
        flip = (ry == 0) & (rx == 1)
        x, y = np.where(flip, full - x, x), np.where(flip, full - y, y)
        x, y = np.where(ry == 0, y, x), np.where(ry == 0, x, y)
    return d


def hilbert_of(x: int, y: int, bits: int) -> int:
    """The same for one cell."""
    d, full = 0, 2**bits - 1
    for i in range(bits - 1, -1, -1):
        rx, ry = (x >> i) & 1, (y >> i) & 1
        d = (d << 2) + ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = full - x, full - y
            x, y = y, x
    return d


def cell_of(d: int, bits: int) -> tuple[int, int]:
    """The cell at a position: the inverse of the curve."""
    x = y = 0
    for i in range(bits):
        q = (d >> (2 * i)) & 3
        rx, ry = q >> 1, (q ^ (q >> 1)) & 1
        if ry == 0:
            if rx:
                x, y = (1 << i) - 1 - x, (1 << i) - 1 - y
            x, y = y, x
        x, y = x + (rx << i), y + (ry << i)
    return x, y


def ordered_unsigned(d: np.ndarray) -> np.ndarray:
    """64-bit unsigned values as signed ones in the same order."""
    return (d.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
