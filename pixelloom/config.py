"""Immutable settings of a sensor, of cleaning, and of where a cube is stored."""

from __future__ import annotations

from dataclasses import dataclass

#: The bands as the archive names them, class band first.
BANDS = (
    "oa_fmask", "nbart_blue", "nbart_green", "nbart_red", "nbart_red_edge_1", "nbart_red_edge_2",
    "nbart_red_edge_3", "nbart_nir_1", "nbart_nir_2", "nbart_swir_2", "nbart_swir_3",
)


@dataclass(frozen=True)
class SensorConfig:
    """What is stored, and which class codes mean what. Swap fields with dataclasses.replace."""

    collections: tuple[str, ...] = ("ga_s2am_ard_3", "ga_s2bm_ard_3")
    bands: tuple[str, ...] = BANDS
    class_band: str = "oa_fmask"
    band_nodata: int = -999
    class_nodata: int = 0
    cloud: int = 2
    shadow: int = 3
    snow: int = 4
    water: int = 5
    max_cloud_cover: float = 80.0
    screen_cloud_fraction: float = 0.9
    crs: str = "EPSG:6933"

    @property
    def reflectance(self) -> tuple[str, ...]:
        return tuple(b for b in self.bands if b != self.class_band)

    def nodata(self, band: str) -> int:
        return self.class_nodata if band == self.class_band else self.band_nodata


@dataclass(frozen=True)
class CleanOptions:
    max_cloud_fraction: float = 0.5
    min_valid_fraction: float = 0.2
    mask_snow: bool = True
    mask_water: bool = False
    buffer_px: int = 5


@dataclass(frozen=True)
class StorePaths:
    """Folders of a cube below one root, in any store that Spark writes to."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name in ("cells_data", "cells", "scenes", "searches"):
            return f"{self.root.rstrip('/')}/{name}"
        raise AttributeError(name)


SENSOR = SensorConfig()
