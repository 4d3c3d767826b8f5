"""The test tables read as raster tables, for Spark and, as CTEs, for DuckDB.

Observations come from lineitem: a month is a day of the cube, and they lie on a swath of SIDE columns that
runs on as long as orders do: ORDERS of them share a row, the part number gives the column. So pixels grow
with lineitem, at about one row a pixel. The keys give digital numbers and blobs of cloud, shadow, snow and water.
Scenes come from orders, boxes of interest from customer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SENSOR
from ..operators.frames import collapse_max, densify

SIDE = 16
CHUNK = 8
ORDERS = 320
_H = "(l_orderkey * 7919 + l_partkey * 31 + l_suppkey * 17 + l_linenumber * 13)"
_M = "(year(l_shipdate) * 12 + month(l_shipdate))"
_ROW = f"CAST((l_orderkey - l_orderkey % {ORDERS}) / {ORDERS} AS INT)"
_BLOB = f"(({_M} * 37 + ({_ROW} - {_ROW} % 4) * 3 + (l_partkey % {SIDE} - l_partkey % 4) * 5) % 29)"

OBS = {
    "solar_day": "CAST(date_trunc('month', l_shipdate) AS DATE)",
    "row": _ROW,
    "col": f"CAST(l_partkey % {SIDE} AS INT)",
    "oa_fmask": f"CAST(CASE WHEN {_H} % 11 = 0 THEN 0 WHEN {_BLOB} < 2 * ({_M} % 6) THEN 2 WHEN {_BLOB} < 2 * ({_M} % 6) + 2 THEN 3 WHEN {_BLOB} = 27 THEN 4 WHEN {_BLOB} = 28 THEN 5 ELSE 1 END AS SMALLINT)",
}
for _k, _b in enumerate(SENSOR.reflectance):
    OBS[_b] = f"CAST(CASE WHEN ({_H} * {7 + _k}) % {61 + _k} = 0 THEN -999 WHEN ({_H} * {3 + _k}) % {83 + _k} = 0 THEN 0 ELSE 200 + ({_H} * {101 + 2 * _k}) % 4000 END AS SMALLINT)"

SCENES = {
    "item_id": "concat('S', CAST(o_orderkey AS VARCHAR(20)))",
    "ts": "o_orderdate",
    "lon": "CAST(o_custkey % 360 AS DOUBLE) - 179.5",
    "cloud_cover": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 1000 AS DOUBLE) / 10.0 END",
}
AOI = {
    "aoi": "c_custkey",
    "west": "CAST((c_custkey * 37) % 34000 AS DOUBLE) / 100.0 - 170.0",
    "south": "CAST((c_custkey * 91) % 14000 AS DOUBLE) / 100.0 - 70.0",
    "east": "CAST((c_custkey * 37) % 34000 AS DOUBLE) / 100.0 - 170.0 + 0.02",
    "north": "CAST((c_custkey * 91) % 14000 AS DOUBLE) / 100.0 - 70.0 + 0.02",
}
#: Cells done so far and the times they were written, several times some of them.
DONE = {
    "solar_day": "CAST(date_trunc('month', o_orderdate) AS DATE)",
    "cy": "CAST(o_custkey % 5 AS INT)",
    "cx": "CAST(o_orderkey % 3 AS INT)",
    "screened": "(o_orderkey % 2 = 0)",
    "written_at": "o_orderdate",
}


def _table(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*[F.expr(e.replace("VARCHAR(20)", "STRING")).alias(c) for c, e in columns.items()])


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash, month and row of each line are worked out once, and not again in every band."""
    rows, once = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), {"__h": _H, "__m": _M, "__row": _ROW}
    rows = rows.select("l_partkey", "l_shipdate", *[F.expr(e).alias(c) for c, e in once.items()])
    return rows.select(*[F.expr(reduce(lambda e, c: e.replace(once[c], c), once, e)).alias(c) for c, e in OBS.items()])


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_max(observations(spark, sf_dir))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("solar_day").distinct()


def window(spark: SparkSession, sf_dir: str) -> tuple[int, int, int, int]:
    """Whole chunks around all observations."""
    last = observations(spark, sf_dir).agg(F.max("row")).first()[0]
    return (0, 0 if last is None else (last // CHUNK + 1) * CHUNK, 0, SIDE)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(pixels(spark, sf_dir), days(spark, sf_dir), window(spark, sf_dir))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders", SCENES)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer", AOI)


def done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders", DONE)


def _cte(name: str, table: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {table})"


_BANDS = SENSOR.bands
OBS_CTE = _cte("obs", "lineitem", OBS)
PIX_CTE = OBS_CTE + ', pix AS (SELECT solar_day, "row", "col", ' + ", ".join(f"max({b}) AS {b}" for b in _BANDS) + ' FROM obs GROUP BY solar_day, "row", "col")'
DENSE_CTE = (
    PIX_CTE
    + f', swath AS (SELECT CAST(unnest(range(0, (max("row") // {CHUNK} + 1) * {CHUNK})) AS INT) AS "row" FROM obs)'
    + f', full_grid AS (SELECT solar_day, "row", CAST(c AS INT) AS "col" FROM (SELECT DISTINCT solar_day FROM obs), swath, range(0, {SIDE}) u(c))'
    + ', dense AS (SELECT solar_day, "row", "col", '
    + ", ".join(f"CAST(coalesce({b}, {SENSOR.nodata(b)}) AS SMALLINT) AS {b}" for b in _BANDS)
    + ' FROM full_grid LEFT JOIN pix USING (solar_day, "row", "col"))'
)
SCENES_CTE = _cte("scenes", "orders", SCENES) + ", dated AS (SELECT *, CAST(ts + to_seconds(CAST(lon * 240 AS INT)) AS DATE) AS solar_day FROM scenes)"
AOI_CTE = _cte("aoi", "customer", AOI)
DONE_CTE = _cte("done", "orders", DONE)
