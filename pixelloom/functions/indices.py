"""Spectral indices as column expressions, and their registry.

Missing is NULL throughout: a digital number of zero or nodata has no reflectance, and a quotient by zero
has no value. All arithmetic is on 32-bit floats.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SENSOR

#: Fixed value: digital numbers of a reflectance of one.
SCALE = 10_000.0


class Index(NamedTuple):
    bands: tuple[str, ...]
    build: Callable[..., Column]


REGISTRY: dict[str, Index] = {}


def register_index(name: str, bands: tuple[str, ...], build: Callable[..., Column]) -> None:
    """Makes an index known by name; build gets the reflectance of each band in turn."""
    REGISTRY[name] = Index(bands, build)


def reflectance(band: str, nodata: int = SENSOR.band_nodata) -> Column:
    dn = F.col(band)
    return F.when((dn != 0) & (dn != nodata), (dn.cast("float") / F.lit(SCALE)).cast("float"))


def normalised(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b).cast("float")


def _ndvi(nir: Column, red: Column) -> Column:
    return normalised(nir, red)


register_index("NDVI", ("nbart_nir_1", "nbart_red"), _ndvi)
register_index("CFI", ("nbart_nir_1", "nbart_red", "nbart_green", "nbart_blue"), lambda nir, red, green, blue: _ndvi(nir, red) * (red + green + green - blue))
register_index("NIRv", ("nbart_nir_1", "nbart_red"), lambda nir, red: _ndvi(nir, red) * nir)
register_index("NDTI", ("nbart_swir_2", "nbart_swir_3"), normalised)
register_index("CAI", ("nbart_swir_2", "nbart_swir_3", "nbart_nir_1"), lambda a, b, nir: F.lit(0.5).cast("float") * (a + b) - nir)


def add_indices(pixels: DataFrame, names: tuple[str, ...] | list[str], nodata: int = SENSOR.band_nodata) -> DataFrame:
    """Adds one float column an index; a ValueError names those that are not known."""
    unknown = sorted(set(names) - set(REGISTRY))
    if unknown:
        raise ValueError(f"unknown indices {unknown}; known are {sorted(REGISTRY)}")
    return pixels.withColumns({n: REGISTRY[n].build(*(reflectance(b, nodata) for b in REGISTRY[n].bands)) for n in names}) if names else pixels
