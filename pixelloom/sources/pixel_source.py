"""Where scenes and pixels come from: the protocol, a table-backed source, and a Python data source."""

from __future__ import annotations

import glob
import json
import os
import time
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.grid import CHUNK, solar_day
from ..operators.frames import collapse_max
from .ledger import CELL
from .store import from_pixels

#: Replies after which a request is worth repeating.
RETRY_CODES = (408, 429, 502, 503, 504)


class PixelSource(Protocol):
    """Gives scenes of a box and range, and cells already on the grid."""

    def search(self, bbox, start, end) -> DataFrame:
        """item_id, solar_day, cloud_cover, item (JSON)."""

    def cells(self, wanted: DataFrame, bands: list[str]) -> DataFrame:
        """solar_day, cy, cx and an array a band; cells without data are left out."""


class TableSource:
    """A source over a scene table (item_id, ts, lon, cloud_cover) and an observation table.

    Observations of a pixel and day collapse to their largest values; pixels of a cell that none
    covers, and bands that the table lacks, read as nodata."""

    def __init__(self, scenes: DataFrame, observations: DataFrame, chunk: int = CHUNK):
        self.scenes, self.observations, self.chunk, self.fetched = scenes, observations, chunk, 0

    def search(self, bbox, start, end) -> DataFrame:
        day = solar_day(F.col("ts"), F.col("lon"))
        rows = self.scenes.filter(F.to_date("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        return rows.select("item_id", day.alias("solar_day"), "cloud_cover", F.to_json(F.struct("item_id", "ts", "lon", "cloud_cover")).alias("item"))

    def cells(self, wanted: DataFrame, bands: list[str]) -> DataFrame:
        from ..config import SENSOR

        c = self.chunk
        keyed = self.observations.withColumns({"cy": F.floor(F.col("row") / c).cast("int"), "cx": F.floor(F.col("col") / c).cast("int")})
        seen = collapse_max(keyed.join(wanted, CELL, "left_semi").drop("cy", "cx"))
        there = seen.select("solar_day", F.floor(F.col("row") / c).cast("int").alias("cy"), F.floor(F.col("col") / c).cast("int").alias("cx")).distinct()
        places = there.select("*", F.explode(F.sequence(F.lit(0), F.lit(c * c - 1))).alias("p"))
        full = places.select("solar_day", (F.col("cy") * c + F.floor(F.col("p") / c)).cast("int").alias("row"), (F.col("cx") * c + F.col("p") % c).cast("int").alias("col"))
        full = full.join(seen, ["solar_day", "row", "col"], "left")
        values = {b: F.coalesce(F.col(b) if b in seen.columns else F.lit(None), F.lit(SENSOR.nodata(b))).cast("short") for b in bands}
        return from_pixels(full.select("solar_day", "row", "col", *[v.alias(b) for b, v in values.items()]), bands, c)


def fetch_with_retry(fetch, tries: int = 5, wait: float = 1.0, sleep=time.sleep):
    """Calls fetch until it gives an answer; errors with a code of RETRY_CODES are tried again, each wait twice the last."""
    for k in range(tries + 1):
        try:
            return fetch()
        except OSError as e:
            if k == tries or getattr(e, "code", None) not in RETRY_CODES:
                raise
            sleep(0 if k == 0 else wait * 2 ** (k - 1))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _CatalogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tolerant = options["path"], str(options.get("failOnError", "false")).lower() == "false"

    def partitions(self):
        files = sorted(glob.glob(os.path.join(self.path, "*.json"))) if os.path.isdir(self.path) else [self.path]
        return [_File(f) for f in files]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                try:
                    item = json.loads(line)
                    west, _, east, _ = item["bbox"]
                    yield item["id"], item["properties"]["datetime"], (west + east) / 2, item["properties"].get("eo:cloud_cover"), line.strip()
                except (ValueError, KeyError, TypeError):
                    if not self.tolerant:
                        raise


class SceneCatalog(DataSource):
    """Scene items as JSON lines: spark.read.format("scene_catalog").load(folder or file).

    Lines that are not items are left out unless failOnError is set. The folder must be one that
    executors reach; each file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "scene_catalog"

    def schema(self) -> str:
        return "item_id string, sensed string, lon double, cloud_cover double, item string"

    def reader(self, schema) -> DataSourceReader:
        return _CatalogReader(self.options)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """item_id, ts (UTC), lon, cloud_cover, item of a catalogue."""
    spark.dataSource.register(SceneCatalog)
    rows = spark.read.format("scene_catalog").load(path)
    return rows.select("item_id", F.to_timestamp("sensed").cast("timestamp_ntz").alias("ts"), "lon", "cloud_cover", "item")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
