"""The pixel store: one row a cell (day and chunk), one array of whole-chunk pixels a band."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SENSOR, SensorConfig, StorePaths
from ..functions.grid import CHUNK
from .ledger import CELL


def cell_schema(sensor: SensorConfig = SENSOR) -> str:
    return "cy int, cx int, written_at timestamp, " + ", ".join(f"{b} array<short>" for b in sensor.bands) + ", solar_day date"


def from_pixels(pixels: DataFrame, bands: list[str], chunk: int = CHUNK) -> DataFrame:
    """Cells whose arrays hold whole chunks in row-major order; pixels must be dense within a cell."""
    place = ((F.col("row") % chunk) * chunk + F.col("col") % chunk).alias("p")
    keyed = pixels.select("solar_day", F.floor(F.col("row") / chunk).cast("int").alias("cy"), F.floor(F.col("col") / chunk).cast("int").alias("cx"), place, *bands)
    packed = keyed.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("p", *bands))).alias("v"))
    return packed.select(*CELL, *[F.expr(f"transform(v, p -> CAST(p.{b} AS SMALLINT))").alias(b) for b in bands])


def to_pixels(cells: DataFrame, bands: list[str], sensor: SensorConfig = SENSOR, chunk: int = CHUNK) -> DataFrame:
    """Pixels (solar_day, row, col, bands) of cells; a band that a cell lacks reads as nodata."""
    full = {b: F.coalesce(F.col(b), F.array_repeat(F.lit(sensor.nodata(b)).cast("short"), chunk * chunk)).alias(b) for b in bands}
    flat = cells.select(*CELL, F.posexplode(F.arrays_zip(*full.values())))
    row, col = F.col("cy") * chunk + F.floor(F.col("pos") / chunk), F.col("cx") * chunk + F.col("pos") % chunk
    return flat.select("solar_day", row.cast("int").alias("row"), col.cast("int").alias("col"), *[F.col(f"col.{b}").alias(b) for b in bands])


def write_cells(cells: DataFrame, paths: StorePaths, sensor: SensorConfig = SENSOR) -> None:
    """Appends cells; a cell that is there already is hidden by the later copy."""
    rows = cells.withColumn("written_at", F.current_timestamp())
    lacking = {b: F.lit(None).cast("array<short>") for b in sensor.bands if b not in rows.columns}
    rows = rows.withColumns(lacking) if lacking else rows
    rows = rows.select("cy", "cx", "written_at", *sensor.bands, "solar_day")
    # by ranges, so that a day of many cells is written by many tasks and chunk statistics still prune
    rows.repartitionByRange("solar_day", "cy", "cx").sortWithinPartitions("solar_day", "cy", "cx").write.mode("append").partitionBy("solar_day").parquet(paths.cells_data)


def read_cells(spark: SparkSession, paths: StorePaths, window, days: list, bands: list[str], sensor: SensorConfig = SENSOR, chunk: int = CHUNK) -> DataFrame:
    """The latest copy of each stored cell of the window on those days, with those bands only.

    Days prune folders, chunk ids prune row groups; the arrays are read for surviving copies alone."""
    all_cells = spark.read.schema(cell_schema(sensor)).parquet(paths.cells_data)
    inside = F.col("cy").between(window[0] // chunk, window[1] // chunk - 1) & F.col("cx").between(window[2] // chunk, window[3] // chunk - 1)
    mine = all_cells.filter(F.col("solar_day").isin(days) & inside) if days else all_cells.limit(0)
    last = mine.groupBy(*CELL).agg(F.max("written_at").alias("written_at"))
    return mine.join(last, [*CELL, "written_at"], "left_semi").dropDuplicates(CELL).select(*CELL, *bands)
