"""Filling from a stream of scene files: each micro-batch records its scenes and fetches their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import solar_day
from ..plans.cube import Cube

SCENE = "item_id string, ts timestamp_ntz, lon double, cloud_cover double"


def follow(spark: SparkSession, folder: str, cube: Cube, bbox, start, end, checkpoint: str):
    """A query that fills the cube whenever scene files arrive in the folder.

    The ledger makes a batch that is run again harmless: scenes are upserted by id, and cells that are
    done are not fetched again."""

    def batch(rows: DataFrame, _) -> None:
        day = solar_day(F.col("ts"), F.col("lon"))
        cube.ledger.upsert_scenes(rows.select("item_id", day.alias("solar_day"), "cloud_cover", F.to_json(F.struct(*rows.columns)).alias("item")))
        cube.fill(bbox, start, end)

    stream = spark.readStream.schema(SCENE).json(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
