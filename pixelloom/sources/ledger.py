"""What is known and what is stored: scenes, cells and past searches.

Tables are append-only Parquet folders; an upsert appends, and readers see the latest row of each key.
The functions work on any tables with the right columns; Ledger binds them to a cube's folders.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import StorePaths

SCHEMAS = {
    "scenes": "item_id string, solar_day date, cloud_cover double, item string, seen_at timestamp",
    "cells": "solar_day date, cy int, cx int, screened boolean, written_at timestamp",
    "searches": "x0 double, y0 double, x1 double, y1 double, start date, end date, searched_at timestamp",
}
CELL = ["solar_day", "cy", "cx"]
#: Side in metres of the tiles on which requests and searches meet.
TILE = 100_000


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest order value; ties go to the largest row."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    top = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("__top"))
    return top.select(*keys, *[F.col(f"__top.{c}").alias(c) for c in rows.columns if c not in keys]).select(*rows.columns)


def scenes_between(scenes: DataFrame, start, end, max_cloud: float) -> DataFrame:
    """Scenes of the days from start to end whose cloud cover is unknown or low enough, in order."""
    days = F.col("solar_day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return scenes.filter(days & (F.col("cloud_cover").isNull() | (F.col("cloud_cover") <= max_cloud))).orderBy("solar_day", "item_id")


def scenes_by_day(scenes: DataFrame) -> DataFrame:
    """The sorted item ids of each day."""
    return scenes.groupBy("solar_day").agg(F.array_sort(F.collect_list("item_id")).alias("items"))


def least_cloud(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("solar_day").agg(F.min("cloud_cover").alias("scene_cloud"))


def missing_cells(wanted: DataFrame, done: DataFrame) -> DataFrame:
    return wanted.join(done, CELL, "left_anti")


def done_cells(wanted: DataFrame, done: DataFrame) -> DataFrame:
    return wanted.join(done, CELL, "left_semi")


def covered(requests: DataFrame, searches: DataFrame) -> DataFrame:
    """Requests (x0, y0, x1, y1, start, end) that one past search contains in space and time.

    A search holds the request's south-west corner, so both meet on that corner's tile by an equi-join."""
    tile = lambda c: F.floor(c / TILE).cast("int")
    over = searches.select(*[F.col(c).alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1", "start", "end")]).distinct()
    over = over.withColumn("tx", F.explode(F.sequence(tile(F.col("s_x0")), tile(F.col("s_x1")))))
    over = over.withColumn("ty", F.explode(F.sequence(tile(F.col("s_y0")), tile(F.col("s_y1")))))
    inside = (
        (F.col("tx") == tile(F.col("x0"))) & (F.col("ty") == tile(F.col("y0")))
        & (F.col("s_x0") <= F.col("x0")) & (F.col("s_y0") <= F.col("y0")) & (F.col("s_x1") >= F.col("x1")) & (F.col("s_y1") >= F.col("y1"))
        & (F.col("s_start") <= F.col("start")) & (F.col("s_end") >= F.col("end"))
    )
    return requests.join(over, inside, "left_semi")


class Ledger:
    def __init__(self, spark: SparkSession, paths: StorePaths):
        self.spark, self.paths = spark, paths
        for name, schema in SCHEMAS.items():
            spark.createDataFrame([], schema).write.mode("append").parquet(getattr(paths, name))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(getattr(self.paths, name))

    def _append(self, df: DataFrame, name: str, stamp: str) -> None:
        rows = df.withColumn(stamp, F.current_timestamp())
        self.spark.createDataFrame([], SCHEMAS[name]).unionByName(rows, allowMissingColumns=True).write.mode("append").parquet(getattr(self.paths, name))

    def upsert_scenes(self, scenes: DataFrame) -> None:
        self._append(scenes.select("item_id", "solar_day", "cloud_cover", "item"), "scenes", "seen_at")

    def scenes(self) -> DataFrame:
        return latest(self.table("scenes"), ["item_id"], "seen_at")

    def mark(self, cells: DataFrame) -> None:
        self._append(cells.select(*CELL, "screened"), "cells", "written_at")

    def cells(self) -> DataFrame:
        return latest(self.table("cells"), CELL, "written_at")

    def record_search(self, extent: tuple[float, float, float, float], start: dt.date, end: dt.date) -> None:
        row = self.spark.createDataFrame([(*map(float, extent), start, end)], "x0 double, y0 double, x1 double, y1 double, start date, end date")
        self._append(row, "searches", "searched_at")

    def search_covered(self, extent: tuple[float, float, float, float], start: dt.date, end: dt.date) -> bool:
        x0, y0, x1, y1 = map(float, extent)
        inside = f"x0 <= {x0} AND y0 <= {y0} AND x1 >= {x1} AND y1 >= {y1} AND start <= DATE'{start}' AND end >= DATE'{end}'"
        return not self.table("searches").filter(inside).limit(1).isEmpty()
