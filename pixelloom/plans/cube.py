"""The cube: fill what is missing, read a window lazily, clean it and add indices."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SENSOR, CleanOptions, SensorConfig, StorePaths
from ..functions import grid
from ..functions.indices import add_indices
from ..operators.frames import CubeFrame, clean
from ..sources import store
from ..sources.ledger import CELL, Ledger, done_cells, missing_cells, scenes_between
from ..sources.pixel_source import PixelSource


def passing(cells: DataFrame, sensor: SensorConfig, threshold: float | None = None) -> DataFrame:
    """Cells whose class array holds valid pixels, of which at most the threshold is cloud or shadow."""
    limit = sensor.screen_cloud_fraction if threshold is None else threshold
    codes = F.col(sensor.class_band)
    valid = F.size(F.filter(codes, lambda v: v != sensor.class_nodata))
    bad = F.size(F.filter(codes, lambda v: v.isin(sensor.cloud, sensor.shadow)))
    return cells.filter((valid > 0) & (F.try_divide(bad, valid) <= limit)).select(*CELL)


class Cube:
    """One grid, one store, one ledger. `window_of` maps a box to a window; the default is the global grid."""

    def __init__(self, spark: SparkSession, root: str, source: PixelSource, sensor: SensorConfig = SENSOR, chunk: int = grid.CHUNK, window_of=grid.window_of):
        self.spark, self.paths, self.source, self.sensor, self.chunk, self.window_of = spark, StorePaths(root), source, sensor, chunk, window_of
        self.ledger = Ledger(spark, self.paths)

    def _wanted(self, window, start: dt.date, end: dt.date) -> DataFrame:
        return self._chunks(scenes_between(self.ledger.scenes(), start, end, self.sensor.max_cloud_cover).select("solar_day").distinct(), window)

    def _chunks(self, days: DataFrame, window) -> DataFrame:
        """Every chunk of the window on each day."""
        c = self.chunk
        rows, cols = F.explode(F.sequence(F.lit(window[0] // c), F.lit(window[1] // c - 1))), F.explode(F.sequence(F.lit(window[2] // c), F.lit(window[3] // c - 1)))
        return days.select("solar_day", rows.alias("cy")).select("*", cols.alias("cx"))

    def fill(self, bbox, start: dt.date, end: dt.date) -> int:
        """Stores every cell of the box and range that is not there yet; the number of cells fetched.

        Class bands go first; the others are fetched only for cells that pass the screen. Pixels are
        written before the ledger, so a run that breaks off is made good by the next."""
        window = self.window_of(bbox)
        extent = grid.extent_of(grid.Window(*window))
        if not self.ledger.search_covered(extent, start, end):
            self.ledger.upsert_scenes(self.source.search(bbox, start, end))
            self.ledger.record_search(extent, start, end)
        missing = missing_cells(self._wanted(window, start, end), self.ledger.cells()).persist()
        try:
            n = missing.count()
            if n:
                codes = self.source.cells(missing, [self.sensor.class_band]).persist()
                good = passing(codes, self.sensor)
                rest = self.source.cells(good, list(self.sensor.reflectance))
                store.write_cells(codes.join(rest, CELL, "left"), self.paths, self.sensor)
                self.ledger.mark(missing.join(good.withColumn("screened", F.lit(False)), CELL, "left").withColumn("screened", F.coalesce("screened", F.lit(True))))
                codes.unpersist()
            return n
        finally:
            missing.unpersist()

    def read(self, bbox, start: dt.date, end: dt.date, bands: list[str] | None = None) -> DataFrame:
        """Dense pixels of the window on the eligible days that are stored."""
        window, bands = self.window_of(bbox), bands or list(self.sensor.bands)
        eligible = scenes_between(self.ledger.scenes(), start, end, self.sensor.max_cloud_cover).select("solar_day").distinct()
        stored = done_cells(self._wanted(window, start, end), self.ledger.cells()).select("solar_day").distinct()
        days = sorted(r[0] for r in eligible.join(stored, "solar_day", "left_semi").collect())  # one row a day of the request
        cells = store.read_cells(self.spark, self.paths, window, days, bands, self.sensor, self.chunk)
        # stored cells are whole chunks, so gaps are filled by cells of no bands: keys are joined, pixels are not
        frames = self._chunks(cells.select("solar_day").distinct(), window)
        gaps = frames.join(cells.select(*CELL), CELL, "left_anti")
        return store.to_pixels(cells.unionByName(gaps, allowMissingColumns=True), bands, self.sensor, self.chunk)

    def get(self, bbox, start: dt.date, end: dt.date, cleaned: bool = False, indices: tuple[str, ...] = (), fill: bool = True, **options) -> CubeFrame:
        """Fills, reads and, if asked, cleans the window; indices imply cleaning."""
        if fill:
            self.fill(bbox, start, end)
        pixels, stamp = self.read(bbox, start, end), {"read_at": dt.datetime.now(dt.UTC).isoformat()}
        if not (cleaned or indices):
            return CubeFrame(pixels, pixels.select("solar_day").distinct(), {"crs": self.sensor.crs, **stamp})
        out = clean(pixels, CleanOptions(**options), self.sensor)
        return replace(out, pixels=add_indices(out.pixels, list(indices), self.sensor.band_nodata), attrs={**out.attrs, **stamp})

    def fill_query(self, query) -> int:
        """As fill, for an object with bbox, start and end."""
        return self.fill(query.bbox, query.start, query.end)

    def get_query(self, query, **options) -> CubeFrame:
        return self.get(query.bbox, query.start, query.end, **options)
