"""The global pixel grid: projection, windows, chunks and coordinates, for numbers and for columns.

The projection is the cylindrical equal-area one on the WGS 84 ellipsoid with a standard parallel of
30 degrees (Snyder, Map Projections, 1987, section 10). Pixels are squares of RES metres, counted from
the north-west corner; chunks are CHUNK by CHUNK pixels; windows are half-open and made of whole chunks.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the grid.
RES, CHUNK = 10, 256
X0, Y_TOP = -17_369_600, 7_326_720
WIDTH_PX, HEIGHT_PX = 3_473_920, 1_465_344

#: Fixed values of the ellipsoid and the projection.
A, FLAT = 6_378_137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
ECC = math.sqrt(E2)
K0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)
QP = (1 - E2) * (1 / (1 - E2) - math.log((1 - ECC) / (1 + ECC)) / (2 * ECC))
SERIES = (
    E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040,
    23 * E2**2 / 360 + 251 * E2**3 / 3780,
    761 * E2**3 / 45360,
)


class Window(NamedTuple):
    row0: int
    row1: int
    col0: int
    col1: int


def project(lon: float, lat: float) -> tuple[float, float]:
    s = math.sin(math.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))
    return A * K0 * math.radians(lon), A * q / (2 * K0)


def unproject(x: float, y: float) -> tuple[float, float]:
    beta = math.asin(max(-1.0, min(1.0, 2 * y * K0 / (A * QP))))
    lat = beta + sum(c * math.sin(2 * (k + 1) * beta) for k, c in enumerate(SERIES))
    return math.degrees(x / (A * K0)), math.degrees(lat)


def window_of(bbox: tuple[float, float, float, float]) -> Window:
    """The window of whole chunks around [west, south, east, north]; a ValueError off the grid."""
    west, south, east, north = bbox
    if west >= east or south >= north:
        raise ValueError(f"empty or reversed box {bbox}")
    (x0, y0), (x1, y1) = project(west, south), project(east, north)
    step = RES * CHUNK
    w = Window(*(CHUNK * k for k in (math.floor((Y_TOP - y1) / step), math.ceil((Y_TOP - y0) / step), math.floor((x0 - X0) / step), math.ceil((x1 - X0) / step))))
    if w.row0 < 0 or w.col0 < 0 or w.row1 > HEIGHT_PX or w.col1 > WIDTH_PX:
        raise ValueError(f"box {bbox} lies off the grid")
    return w


def chunks_of(w: Window) -> list[tuple[int, int]]:
    return [(cy, cx) for cy in range(w.row0 // CHUNK, w.row1 // CHUNK) for cx in range(w.col0 // CHUNK, w.col1 // CHUNK)]


def extent_of(w: Window) -> tuple[int, int, int, int]:
    """West, south, east, north in metres."""
    return X0 + w.col0 * RES, Y_TOP - w.row1 * RES, X0 + w.col1 * RES, Y_TOP - w.row0 * RES


def bbox_of(w: Window) -> tuple[float, float, float, float]:
    x0, y0, x1, y1 = extent_of(w)
    return (*unproject(x0, y0), *unproject(x1, y1))


def project_columns(lon: Column, lat: Column) -> tuple[Column, Column]:
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))
    return A * K0 * F.radians(lon), A * q / (2 * K0)


def unproject_columns(x: Column, y: Column) -> tuple[Column, Column]:
    beta = F.asin(2 * y * K0 / (A * QP))
    lat = beta
    for k, c in enumerate(SERIES):
        lat = lat + c * F.sin(2 * (k + 1) * beta)
    return F.degrees(x / (A * K0)), F.degrees(lat)


def with_extent(df: DataFrame) -> DataFrame:
    """Adds the projected corners x0, y0, x1, y1 of west, south, east, north."""
    x0, y0 = project_columns(F.col("west"), F.col("south"))
    x1, y1 = project_columns(F.col("east"), F.col("north"))
    return df.withColumns({"x0": x0, "y0": y0, "x1": x1, "y1": y1})


def with_window(df: DataFrame) -> DataFrame:
    """Adds row0, row1, col0, col1 of the chunk-aligned window."""
    step = RES * CHUNK
    return with_extent(df).withColumns(
        {
            "row0": (F.floor((Y_TOP - F.col("y1")) / step) * CHUNK).cast("int"),
            "row1": (F.ceil((Y_TOP - F.col("y0")) / step) * CHUNK).cast("int"),
            "col0": (F.floor((F.col("x0") - X0) / step) * CHUNK).cast("int"),
            "col1": (F.ceil((F.col("x1") - X0) / step) * CHUNK).cast("int"),
        }
    )


def _span(low: Column, high: Column) -> Column:
    """low to high - 1, empty where there is none."""
    return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))


def with_chunks(df: DataFrame) -> DataFrame:
    """A row for each chunk (cy, cx) of each window, row by row."""
    rows = df.withColumn("cy", F.explode(_span((F.col("row0") / CHUNK).cast("int"), (F.col("row1") / CHUNK).cast("int"))))
    return rows.withColumn("cx", F.explode(_span((F.col("col0") / CHUNK).cast("int"), (F.col("col1") / CHUNK).cast("int"))))


def bounding_window(df: DataFrame, *keys: str) -> DataFrame:
    """The window around the chunks (cy, cx) of each key."""
    return df.groupBy(*keys).agg(
        (F.min("cy") * CHUNK).alias("row0"), ((F.max("cy") + 1) * CHUNK).alias("row1"), (F.min("cx") * CHUNK).alias("col0"), ((F.max("cx") + 1) * CHUNK).alias("col1")
    )


def with_centres(df: DataFrame) -> DataFrame:
    """Adds the centre (px_x, px_y) in metres of pixel (row, col)."""
    return df.withColumns({"px_x": X0 + (F.col("col") + 0.5) * RES, "px_y": Y_TOP - (F.col("row") + 0.5) * RES})


def solar_day(ts: Column, lon: Column) -> Column:
    """Date of the UTC time shifted by 240 seconds for each degree of longitude."""
    return F.to_date(F.timestamp_add("SECOND", (lon * 240).cast("int"), ts))
