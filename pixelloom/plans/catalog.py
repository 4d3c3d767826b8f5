"""Registry of the raster queries and of the SQL that must agree with them."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SENSOR, CleanOptions
from ..functions import grid
from ..functions.indices import REGISTRY, add_indices
from ..operators import frames as fr
from ..sources import ledger, store
from ..sources.pixel_source import TableSource, read_csv, write_csv
from . import views
from .cube import Cube, passing

QUERIES: dict = {}
ORACLE_SQL: dict = {}
START, END = dt.date(1994, 1, 1), dt.date(1996, 12, 31)
BUFFER = 3
SCREEN = 0.5
KEYS = ["solar_day", "row", "col"]
_D = 'solar_day, "row", "col"'
_VALID, _BAD = "oa_fmask <> 0", "oa_fmask IN (2, 3)"


def _plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, which reads the same in every engine."""
    return df.select(*[F.col(c).cast("string").alias(c) if t in ("date", "timestamp_ntz") else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, days: tuple[str, ...] = ("solar_day",)):
    """Registers a query; `days` are the columns of its SQL that are dates or times."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: _plain(f(spark, sf_dir))
        if sql:
            text = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in days)
            ORACLE_SQL[name] = f"SELECT * REPLACE ({text}) FROM ({sql})" if text else sql
        return f

    return add


def _folder(spark, label: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pixelloom-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


# indices -----------------------------------------------------------------------------------------


def _refl(band: str) -> str:
    return f"(CASE WHEN {band} NOT IN (0, -999) THEN CAST({band} AS FLOAT) / CAST(10000 AS FLOAT) END)"


_N, _R, _G, _B = (_refl(f"nbart_{b}") for b in ("nir_1", "red", "green", "blue"))
_S2, _S3 = _refl("nbart_swir_2"), _refl("nbart_swir_3")
_ND = "(({a} - {b}) / nullif({a} + {b}, CAST(0 AS FLOAT)))"
_NDVI = _ND.format(a=_N, b=_R)
INDEX_SQL = {
    "NDVI": _NDVI,
    "CFI": f"({_NDVI} * ({_R} + {_G} + {_G} - {_B}))",
    "NIRv": f"({_NDVI} * {_N})",
    "NDTI": _ND.format(a=_S2, b=_S3),
    "CAI": f"(CAST(0.5 AS FLOAT) * ({_S2} + {_S3}) - {_N})",
}


def _index(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        return add_indices(views.pixels(spark, sf_dir), [name]).select(*KEYS, F.col(name).cast("double").alias("value"))

    return run


for _name in REGISTRY:
    query(f"index_{_name.lower()}", f"WITH {views.PIX_CTE} SELECT {_D}, CAST({INDEX_SQL[_name]} AS DOUBLE) AS value FROM pix")(_index(_name))


@query("indices_all", f"WITH {views.PIX_CTE} SELECT {_D}, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n.lower()}" for n, e in INDEX_SQL.items()) + " FROM pix")
def indices_all(spark, sf_dir):
    return add_indices(views.pixels(spark, sf_dir), list(REGISTRY)).select(*KEYS, *[F.col(n).cast("double").alias(n.lower()) for n in REGISTRY])


# masks and frames --------------------------------------------------------------------------------


def _masked_sql(source: str, clear: str) -> str:
    return f"SELECT {_D}, " + ", ".join(f"CASE WHEN {clear} AND {b} <> -999 THEN CAST({b} AS DOUBLE) END AS {b}" for b in SENSOR.reflectance) + f" FROM {source}"


def _masked(pixels: DataFrame, options: CleanOptions) -> DataFrame:
    m = fr.mask_columns(pixels, options)
    return m.select(*KEYS, *[F.when(F.col("clear") & (F.col(b) != -999), F.col(b)).cast("double").alias(b) for b in SENSOR.reflectance])


@query("mask_pixels", f"WITH {views.PIX_CTE} " + _masked_sql("pix", "oa_fmask IN (1, 5)"))
def mask_pixels(spark, sf_dir):
    return _masked(views.pixels(spark, sf_dir), CleanOptions(buffer_px=0))


@query("mask_water", f"WITH {views.PIX_CTE} " + _masked_sql("pix", "oa_fmask IN (1, 4)"))
def mask_water(spark, sf_dir):
    return _masked(views.pixels(spark, sf_dir), CleanOptions(buffer_px=0, mask_water=True, mask_snow=False))


@query("collapse_max", f"WITH {views.PIX_CTE} SELECT * FROM pix")
def collapse_max(spark, sf_dir):
    return views.pixels(spark, sf_dir)


@query("densify", f"WITH {views.DENSE_CTE} SELECT * FROM dense")
def densify(spark, sf_dir):
    return views.dense(spark, sf_dir)


@query("missing_band", f"WITH {views.DENSE_CTE} SELECT {_D}, oa_fmask, CAST(-999 AS SMALLINT) AS nbart_red FROM dense")
def missing_band(spark, sf_dir):
    some = views.pixels(spark, sf_dir).select(*KEYS, "oa_fmask")
    return fr.densify(some, views.days(spark, sf_dir), views.window(spark, sf_dir), replace(SENSOR, bands=("oa_fmask", "nbart_red")))


_STATS_SQL = f"""SELECT solar_day, count(*) FILTER ({_VALID}) / CAST(count(*) AS DOUBLE) AS valid_frac,
CASE WHEN count(*) FILTER ({_VALID}) > 0 THEN count(*) FILTER ({_BAD}) / CAST(count(*) FILTER ({_VALID}) AS DOUBLE) ELSE 1.0 END AS cloud_frac, """ + ", ".join(
    f"CASE WHEN count(*) FILTER ({_VALID}) > 0 THEN count(*) FILTER (oa_fmask = {c}) / CAST(count(*) FILTER ({_VALID}) AS DOUBLE) ELSE 0.0 END AS {n}_frac"
    for n, c in (("cloud_only", 2), ("shadow", 3), ("snow", 4), ("water", 5))
)


@query("frame_stats", f"WITH {views.DENSE_CTE} {_STATS_SQL} FROM dense GROUP BY solar_day")
def frame_stats(spark, sf_dir):
    return fr.survey_stats(views.dense(spark, sf_dir))


def _near_cte(radius: int) -> str:
    """Pixels that a disk around a bad one reaches: bad pixels moved by every offset of the disk, so joins are on keys."""
    span = f"range({-radius}, {radius + 1})"
    return f""", disk AS (SELECT i, j FROM {span} a(i), {span} b(j) WHERE i * i + j * j <= {radius * radius}),
    near AS (SELECT DISTINCT solar_day, "row" + CAST(i AS INT) AS "row", "col" + CAST(j AS INT) AS "col" FROM dense, disk WHERE oa_fmask IN (2, 3)),
    flags AS (SELECT dense.*, near.solar_day IS NOT NULL AS hit FROM dense LEFT JOIN near USING (solar_day, "row", "col"))"""


def _clean_cte(gate: str, source: str) -> str:
    return f""", marked AS (SELECT *, {_VALID} AS valid, {gate} AND {_VALID} AS gate, oa_fmask = 4 AS snow FROM {source}),
    fractions AS (SELECT solar_day, count(*) FILTER (valid) AS n_valid, count(*) FILTER (valid) / CAST(count(*) AS DOUBLE) AS valid_fraction,
      CASE WHEN count(*) FILTER (valid) > 0 THEN count(*) FILTER (gate) / CAST(count(*) FILTER (valid) AS DOUBLE) ELSE 1.0 END AS cloud_fraction,
      CASE WHEN count(*) FILTER (valid) > 0 THEN count(*) FILTER (snow) / CAST(count(*) FILTER (valid) AS DOUBLE) ELSE 0.0 END AS snow_fraction
      FROM marked GROUP BY solar_day),
    kept AS (SELECT * FROM fractions WHERE valid_fraction >= 0.2 AND cloud_fraction <= 0.5),
    cleaned AS ({_masked_sql("marked SEMI JOIN kept USING (solar_day)", "valid AND NOT gate AND NOT snow")})"""


_PLAIN = f"WITH {views.DENSE_CTE}{_clean_cte(_BAD, 'dense')}"
_FULL = f"WITH {views.DENSE_CTE}{_near_cte(BUFFER)}{_clean_cte('hit', 'flags')}"
_OPTIONS = CleanOptions(buffer_px=BUFFER)


def _doubles(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, *[F.col(b).cast("double").alias(b) for b in SENSOR.reflectance])


@query("frame_gate", _FULL + " SELECT solar_day, valid_fraction, cloud_fraction, snow_fraction FROM kept")
def frame_gate(spark, sf_dir):
    fractions = fr.frame_fractions(fr.mask_columns(views.dense(spark, sf_dir), _OPTIONS))
    return fr.gate_frames(fractions, _OPTIONS).drop("n_valid")


@query("frame_fractions", _FULL + " SELECT * FROM fractions")
def frame_fractions(spark, sf_dir):
    return fr.frame_fractions(fr.mask_columns(views.dense(spark, sf_dir), _OPTIONS))


@query("clean_no_buffer", _PLAIN + " SELECT * FROM cleaned")
def clean_no_buffer(spark, sf_dir):
    return _doubles(fr.clean(views.dense(spark, sf_dir), CleanOptions(buffer_px=0)).pixels)


@query("clean_full", _FULL + " SELECT * FROM cleaned")
def clean_full(spark, sf_dir):
    return _doubles(fr.clean(views.dense(spark, sf_dir), _OPTIONS).pixels)


_DILATE = f"WITH {views.DENSE_CTE}{_near_cte(5)} SELECT {_D}, hit AS near_bad FROM flags"


def _dilated(kind: str):
    def run(spark, sf_dir: str) -> DataFrame:
        return fr.DILATIONS[kind](views.dense(spark, sf_dir), fr.is_bad(), 5).select(*KEYS, "near_bad")

    return run


query("dilate", _DILATE)(_dilated("rows"))
query("dilate_offsets", _DILATE)(_dilated("offsets"))
query("dilate_kernel", _DILATE)(_dilated("kernel"))


@query("halo", f"WITH {views.DENSE_CTE}{_near_cte(5)} SELECT {_D} FROM flags WHERE hit AND NOT ({_BAD})")
def halo(spark, sf_dir):
    return fr.dilate_rows(views.dense(spark, sf_dir), fr.is_bad(), 5).filter(F.col("near_bad") & ~fr.is_bad()).select(*KEYS)


_C = views.CHUNK
_SCREEN = f""", chunks AS (SELECT solar_day, CAST("row" // {_C} AS INT) AS cy, CAST("col" // {_C} AS INT) AS cx, count(*) FILTER ({_VALID}) AS n_valid, count(*) FILTER ({_BAD}) AS n_bad
  FROM dense GROUP BY ALL), good AS (SELECT * FROM chunks WHERE n_valid > 0 AND n_bad / CAST(n_valid AS DOUBLE) <= {SCREEN})"""


@query("screen_chunks", f"WITH {views.DENSE_CTE}{_SCREEN} SELECT * FROM good")
def screen_chunks(spark, sf_dir):
    return fr.screen_chunks(views.dense(spark, sf_dir), _C, SCREEN)


@query("screen_semi", f'WITH {views.DENSE_CTE}{_SCREEN} SELECT {_D}, nbart_red FROM dense SEMI JOIN good ON dense.solar_day = good.solar_day AND "row" // {_C} = cy AND "col" // {_C} = cx')
def screen_semi(spark, sf_dir):
    d = views.dense(spark, sf_dir)
    good = fr.screen_chunks(d, _C, SCREEN).select("solar_day", "cy", "cx")
    keyed = d.withColumns({"cy": F.floor(F.col("row") / _C).cast("int"), "cx": F.floor(F.col("col") / _C).cast("int")})
    return keyed.join(good, ["solar_day", "cy", "cx"], "left_semi").select(*KEYS, "nbart_red")


# grid --------------------------------------------------------------------------------------------

_S = "sin(radians({0}))"
_Q = f"({1 - grid.E2!r} * ({_S} / (1 - {grid.E2!r} * {_S} * {_S}) - ln((1 - {grid.ECC!r} * {_S}) / (1 + {grid.ECC!r} * {_S})) / {2 * grid.ECC!r}))"
_X, _Y = f"({grid.A * grid.K0!r} * radians({{0}}))", f"({grid.A!r} * {_Q} / {2 * grid.K0!r})"
_STEP = grid.RES * grid.CHUNK
_AOI_CTE = f"""{views.AOI_CTE}, ext AS (SELECT *, {_X.format("west")} AS x0, {_Y.format("south")} AS y0, {_X.format("east")} AS x1, {_Y.format("north")} AS y1 FROM aoi),
 win AS (SELECT *, CAST(floor(({grid.Y_TOP} - y1) / {_STEP}) * 256 AS INT) AS row0, CAST(ceil(({grid.Y_TOP} - y0) / {_STEP}) * 256 AS INT) AS row1,
  CAST(floor((x0 - {grid.X0}) / {_STEP}) * 256 AS INT) AS col0, CAST(ceil((x1 - {grid.X0}) / {_STEP}) * 256 AS INT) AS col1 FROM ext),
 cells AS (SELECT aoi, cy, CAST(unnest(range(col0 // 256, col1 // 256)) AS INT) AS cx FROM (SELECT *, CAST(unnest(range(row0 // 256, row1 // 256)) AS INT) AS cy FROM win))"""


@query("grid_project", f"WITH {_AOI_CTE} SELECT aoi, round(x0, 3) AS x0, round(y0, 3) AS y0, round(x1, 3) AS x1, round(y1, 3) AS y1 FROM ext", days=())
def grid_project(spark, sf_dir):
    e = grid.with_extent(views.boxes(spark, sf_dir))
    return e.select("aoi", *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("grid_window", f"WITH {_AOI_CTE} SELECT aoi, row0, row1, col0, col1 FROM win", days=())
def grid_window(spark, sf_dir):
    return grid.with_window(views.boxes(spark, sf_dir)).select("aoi", "row0", "row1", "col0", "col1")


@query("grid_chunks", f"WITH {_AOI_CTE} SELECT * FROM cells", days=())
def grid_chunks(spark, sf_dir):
    return grid.with_chunks(grid.with_window(views.boxes(spark, sf_dir))).select("aoi", "cy", "cx")


@query("grid_extent", f"WITH {_AOI_CTE} SELECT aoi, {grid.X0} + col0 * 10 AS west_m, {grid.Y_TOP} - row1 * 10 AS south_m, {grid.X0} + col1 * 10 AS east_m, {grid.Y_TOP} - row0 * 10 AS north_m FROM win", days=())
def grid_extent(spark, sf_dir):
    w = grid.with_window(views.boxes(spark, sf_dir))
    return w.select("aoi", (grid.X0 + F.col("col0") * 10).alias("west_m"), (grid.Y_TOP - F.col("row1") * 10).alias("south_m"), (grid.X0 + F.col("col1") * 10).alias("east_m"), (grid.Y_TOP - F.col("row0") * 10).alias("north_m"))


_BETA = f"asin(2 * ({{0}}) * {grid.K0!r} / {grid.A * grid.QP!r})"
_LAT = f"degrees({_BETA} + " + " + ".join(f"{c!r} * sin({2 * (k + 1)} * {_BETA})" for k, c in enumerate(grid.SERIES)) + ")"


@query("grid_inverse", f"WITH {_AOI_CTE} SELECT aoi, round(degrees(CAST({grid.X0} + col0 * 10 AS DOUBLE) / {grid.A * grid.K0!r}), 6) AS west, round({_LAT.format(f'CAST({grid.Y_TOP} - row1 * 10 AS DOUBLE)')}, 6) AS south FROM win", days=())
def grid_inverse(spark, sf_dir):
    w = grid.with_window(views.boxes(spark, sf_dir))
    lon, lat = grid.unproject_columns(grid.X0 + F.col("col0") * 10, grid.Y_TOP - F.col("row1") * 10)
    return w.select("aoi", F.round(lon, 6).alias("west"), F.round(lat, 6).alias("south"))


@query("pixel_coords", f'WITH {views.PIX_CTE} SELECT {_D}, {grid.X0} + ("col" + CAST(0.5 AS DOUBLE)) * 10 AS px_x, {grid.Y_TOP} - ("row" + CAST(0.5 AS DOUBLE)) * 10 AS px_y FROM pix')
def pixel_coords(spark, sf_dir):
    return grid.with_centres(views.pixels(spark, sf_dir)).select(*KEYS, "px_x", "px_y")


@query("geobox", f"WITH {_AOI_CTE} SELECT aoi, row1 - row0 AS height, col1 - col0 AS width, CAST(10 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST({grid.X0} + col0 * 10 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS d, CAST(-10 AS DOUBLE) AS e, CAST({grid.Y_TOP} - row0 * 10 AS DOUBLE) AS f FROM win", days=())
def geobox(spark, sf_dir):
    """Shape and affine coefficients of each window."""
    w = grid.with_window(views.boxes(spark, sf_dir))
    affine = {"a": F.lit(10.0), "b": F.lit(0.0), "c": (grid.X0 + F.col("col0") * 10).cast("double"), "d": F.lit(0.0), "e": F.lit(-10.0), "f": (grid.Y_TOP - F.col("row0") * 10).cast("double")}
    return w.select("aoi", (F.col("row1") - F.col("row0")).alias("height"), (F.col("col1") - F.col("col0")).alias("width"), *[c.alias(n) for n, c in affine.items()])


@query("window_of_chunks", f"WITH {_AOI_CTE} SELECT aoi, min(cy) * 256 AS row0, (max(cy) + 1) * 256 AS row1, min(cx) * 256 AS col0, (max(cx) + 1) * 256 AS col1 FROM cells GROUP BY aoi", days=())
def window_of_chunks(spark, sf_dir):
    return grid.bounding_window(grid_chunks(spark, sf_dir), "aoi")


@query("km_offset", f"WITH {_AOI_CTE} SELECT aoi, round((x1 - x0) / 1000, 4) AS km_x, round((y1 - y0) / 1000, 4) AS km_y FROM ext", days=())
def km_offset(spark, sf_dir):
    e = grid.with_extent(views.boxes(spark, sf_dir))
    return e.select("aoi", F.round((F.col("x1") - F.col("x0")) / 1000, 4).alias("km_x"), F.round((F.col("y1") - F.col("y0")) / 1000, 4).alias("km_y"))


#: Chunks of all boxes, and of all boxes moved by one chunk east.
_PAIR = f"WITH {_AOI_CTE}, a AS (SELECT DISTINCT cy, cx FROM cells), b AS (SELECT DISTINCT cy, CAST(cx + 1 AS INT) AS cx FROM cells) "


def _pair(spark, sf_dir):
    c = grid_chunks(spark, sf_dir).select("cy", "cx").distinct()
    return c, c.select("cy", (F.col("cx") + 1).alias("cx"))


@query("chunk_intersect", _PAIR + "SELECT * FROM a INTERSECT SELECT * FROM b", days=())
def chunk_intersect(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a.intersect(b)


@query("chunk_union", _PAIR + "SELECT * FROM a UNION SELECT * FROM b", days=())
def chunk_union(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a.unionByName(b).distinct()


@query("chunk_subtract", _PAIR + "SELECT * FROM a EXCEPT SELECT * FROM b", days=())
def chunk_subtract(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a.subtract(b)


# scenes and ledger -------------------------------------------------------------------------------


def _dated(spark, sf_dir):
    return views.scenes(spark, sf_dir).withColumn("solar_day", grid.solar_day(F.col("ts"), F.col("lon")))


@query("solar_day", f"WITH {views.SCENES_CTE} SELECT item_id, solar_day FROM dated")
def solar_day(spark, sf_dir):
    return _dated(spark, sf_dir).select("item_id", "solar_day")


_RANGE = f"solar_day BETWEEN DATE '{START}' AND DATE '{END}' AND (cloud_cover IS NULL OR cloud_cover <= 80.0)"


@query("scenes_for_range", f"WITH {views.SCENES_CTE} SELECT item_id, solar_day, cloud_cover FROM dated WHERE {_RANGE}")
def scenes_for_range(spark, sf_dir):
    return ledger.scenes_between(_dated(spark, sf_dir), START, END, SENSOR.max_cloud_cover).select("item_id", "solar_day", "cloud_cover")


@query("scenes_by_day", f"WITH {views.SCENES_CTE} SELECT solar_day, string_agg(item_id, ',' ORDER BY item_id) AS items, count(*) AS n FROM dated WHERE {_RANGE} GROUP BY solar_day")
def scenes_by_day(spark, sf_dir):
    by = ledger.scenes_by_day(scenes_for_range(spark, sf_dir))
    return by.select("solar_day", F.array_join("items", ",").alias("items"), F.size("items").cast("long").alias("n"))


@query("scene_min_cloud", f"WITH {views.SCENES_CTE} SELECT solar_day, min(cloud_cover) AS scene_cloud FROM dated GROUP BY solar_day")
def scene_min_cloud(spark, sf_dir):
    return ledger.least_cloud(_dated(spark, sf_dir))


@query("scene_json", f"WITH {views.SCENES_CTE} SELECT item_id, cloud_cover, lon FROM scenes", days=())
def scene_json(spark, sf_dir):
    """Items written as JSON and read back."""
    text = views.scenes(spark, sf_dir).select(F.to_json(F.struct("item_id", "lon", "cloud_cover")).alias("item"))
    item = F.from_json("item", "item_id string, lon double, cloud_cover double").alias("i")
    return text.select(item).select("i.item_id", "i.cloud_cover", "i.lon")


@query("day_labels", f"WITH {views.SCENES_CTE} SELECT DISTINCT solar_day, strftime(solar_day, '%Y-%m-%d') AS label, strftime(solar_day, '%m-%d') AS short_label, CAST(solar_day - DATE '1970-01-01' AS INT) AS epoch_day FROM dated")
def day_labels(spark, sf_dir):
    d = _dated(spark, sf_dir).select("solar_day").distinct()
    return d.select("solar_day", F.date_format("solar_day", "yyyy-MM-dd").alias("label"), F.date_format("solar_day", "MM-dd").alias("short_label"), F.unix_date("solar_day").alias("epoch_day"))


_WANTED = """, wanted AS (SELECT DISTINCT solar_day, CAST(y AS INT) AS cy, CAST(x AS INT) AS cx FROM (SELECT DISTINCT solar_day FROM done), range(0, 6) t(y), range(0, 4) u(x))"""


def _wanted(spark, sf_dir):
    d = views.done(spark, sf_dir).select("solar_day").distinct()
    return d.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("cy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cx"))


@query("ledger_missing", f"WITH {views.DONE_CTE}{_WANTED} SELECT * FROM wanted ANTI JOIN done USING (solar_day, cy, cx)")
def ledger_missing(spark, sf_dir):
    return ledger.missing_cells(_wanted(spark, sf_dir), views.done(spark, sf_dir))


@query("ledger_done", f"WITH {views.DONE_CTE}{_WANTED} SELECT * FROM wanted SEMI JOIN done USING (solar_day, cy, cx)")
def ledger_done(spark, sf_dir):
    return ledger.done_cells(_wanted(spark, sf_dir), views.done(spark, sf_dir))


@query("ledger_upsert", f"WITH {views.DONE_CTE} SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY solar_day, cy, cx ORDER BY written_at DESC, screened DESC) = 1", days=("solar_day", "written_at"))
def ledger_upsert(spark, sf_dir):
    return ledger.latest(views.done(spark, sf_dir), ["solar_day", "cy", "cx"], "written_at")


@query("cells_missing_count", f"WITH {views.DONE_CTE}{_WANTED} SELECT count(*) AS n FROM wanted ANTI JOIN done USING (solar_day, cy, cx)", days=())
def cells_missing_count(spark, sf_dir):
    return ledger_missing(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


_DATES = "DATE '2024-01-01' AS \"start\", DATE '2024-02-01' AS \"end\""
_COVER = f"""WITH {_AOI_CTE}, past AS (SELECT floor(x0 / 50000) * 50000 AS x0, floor(y0 / 50000) * 50000 AS y0, floor(x0 / 50000) * 50000 + 60000 AS x1, floor(y0 / 50000) * 50000 + 60000 AS y1,
  aoi % 2 = 0 AS early FROM ext)
SELECT aoi FROM ext r WHERE EXISTS (SELECT 1 FROM past s WHERE early AND s.x0 <= r.x0 AND s.y0 <= r.y0 AND s.x1 >= r.x1 AND s.y1 >= r.y1)"""


@query("search_covered", _COVER, days=())
def search_covered(spark, sf_dir):
    """Boxes that a past search contains; searches of odd boxes begin too late."""
    e = grid.with_extent(views.boxes(spark, sf_dir))
    asked = e.select("aoi", "x0", "y0", "x1", "y1", F.lit(START).alias("start"), F.lit(END).alias("end"))
    low = {c: F.floor(F.col(c) / 50_000).cast("double") * 50_000 for c in ("x0", "y0")}
    begin = F.when(F.col("aoi") % 2 == 0, F.lit(START)).otherwise(F.lit(END))
    past = e.select(low["x0"].alias("x0"), low["y0"].alias("y0"), (low["x0"] + 60_000).alias("x1"), (low["y0"] + 60_000).alias("y1"), begin.alias("start"), F.lit(END).alias("end"))
    return ledger.covered(asked, past).select("aoi")


# store -------------------------------------------------------------------------------------------


@query("window_read", f'WITH {views.DENSE_CTE} SELECT {_D}, nbart_red, nbart_nir_1 FROM dense WHERE "col" BETWEEN 8 AND 15 AND solar_day BETWEEN DATE \'{START}\' AND DATE \'{END}\'')
def window_read(spark, sf_dir):
    """Two bands of the swath's right half, read back from cells."""
    from ..config import StorePaths

    paths, (row0, row1, _, col1) = StorePaths(_folder(spark, "cells")), views.window(spark, sf_dir)
    store.write_cells(store.from_pixels(views.dense(spark, sf_dir), list(SENSOR.bands), _C), paths)
    days = sorted(r[0] for r in views.days(spark, sf_dir).filter(F.col("solar_day").between(F.lit(START), F.lit(END))).collect())
    cells = store.read_cells(spark, paths, (row0, row1, col1 - _C, col1), days, ["nbart_red", "nbart_nir_1"], chunk=_C)
    return store.to_pixels(cells, ["nbart_red", "nbart_nir_1"], chunk=_C)


@query("tile_explode", f"WITH {views.DENSE_CTE} SELECT * FROM dense")
def tile_explode(spark, sf_dir):
    """Pixels packed into cell arrays and taken out again."""
    bands = list(SENSOR.bands)
    return store.to_pixels(store.from_pixels(views.dense(spark, sf_dir), bands, _C), bands, chunk=_C)


@query("cell_screen", f"WITH {views.DENSE_CTE}{_SCREEN} SELECT solar_day, cy, cx FROM good")
def cell_screen(spark, sf_dir):
    """The screen on cell arrays, as fill applies it."""
    return passing(store.from_pixels(views.dense(spark, sf_dir).select(*KEYS, "oa_fmask"), ["oa_fmask"], _C), SENSOR, SCREEN)


def _cube(spark, sf_dir) -> Cube:
    """A cube over the observations; its scenes are one a day of theirs."""
    seen = views.observations(spark, sf_dir)
    daily = seen.select(F.concat(F.lit("D"), F.col("solar_day").cast("string")).alias("item_id"), F.col("solar_day").cast("timestamp_ntz").alias("ts"), F.lit(0.0).alias("lon"), F.lit(None).cast("double").alias("cloud_cover")).distinct()
    swath = grid.Window(*views.window(spark, sf_dir))
    return Cube(spark, _folder(spark, "cube"), TableSource(daily, seen, _C), replace(SENSOR, screen_cloud_fraction=SCREEN), chunk=_C, window_of=lambda _: swath)


_INSIDE = f"solar_day BETWEEN DATE '{START}' AND DATE '{END}'"
#: Cells that fail the screen keep their classes and have no other band; cells of no observation are nodata.
_STORED = (
    f"WITH {views.DENSE_CTE}{_SCREEN}, stored AS (SELECT {_D}, oa_fmask, "
    + ", ".join(f"CAST(CASE WHEN cy IS NULL THEN -999 ELSE {b} END AS SMALLINT) AS {b}" for b in SENSOR.reflectance)
    + f' FROM (SELECT *, "row" // {_C} AS gy, "col" // {_C} AS gx FROM dense WHERE {_INSIDE}) d'
    + " LEFT JOIN (SELECT solar_day AS gd, cy, cx FROM good) g ON d.solar_day = gd AND gy = cy AND gx = cx)"
)


@query("fill_roundtrip", _STORED + " SELECT * FROM stored")
def fill_roundtrip(spark, sf_dir):
    cube = _cube(spark, sf_dir)
    first, again = cube.fill(None, START, END), cube.fill(None, START, END)
    if not first or again:
        raise RuntimeError(f"fill fetched {first} cells, then {again}")
    return cube.read(None, START, END)


@query("get_clean_indices", _STORED + _clean_cte(_BAD, "stored") + f" SELECT {_D}, CAST({INDEX_SQL['NDVI']} AS DOUBLE) AS ndvi, CAST({INDEX_SQL['CAI']} AS DOUBLE) AS cai FROM (SELECT {_D}, " + ", ".join(f"coalesce({b}, -999) AS {b}" for b in SENSOR.reflectance) + " FROM cleaned)")
def get_clean_indices(spark, sf_dir):
    got = _cube(spark, sf_dir).get(None, START, END, indices=("NDVI", "CAI"), buffer_px=0)
    return got.pixels.select(*KEYS, F.col("NDVI").cast("double").alias("ndvi"), F.col("CAI").cast("double").alias("cai"))


@query("csv_roundtrip", f"WITH {views.SCENES_CTE} SELECT item_id, cloud_cover FROM scenes", days=())
def csv_roundtrip(spark, sf_dir):
    path = _folder(spark, "csv")
    write_csv(views.scenes(spark, sf_dir).select("item_id", "cloud_cover"), path)
    return read_csv(spark, path, "item_id string, cloud_cover double")


# survey ------------------------------------------------------------------------------------------

_SERIES = f"{_FULL}, nd AS (SELECT solar_day, CAST({_NDVI} AS DOUBLE) AS v FROM (SELECT solar_day, " + ", ".join(f"coalesce({b}, -999) AS {b}" for b in SENSOR.reflectance) + " FROM cleaned))"


@query("ndvi_series", _SERIES + " SELECT solar_day, round(median(v), 6) AS med, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75 FROM nd GROUP BY solar_day")
def ndvi_series(spark, sf_dir):
    px = add_indices(fr.clean(views.dense(spark, sf_dir), _OPTIONS).pixels, ["NDVI"]).select("solar_day", F.col("NDVI").cast("double").alias("v"))
    return px.groupBy("solar_day").agg(F.round(F.median("v"), 6).alias("med"), F.round(F.percentile("v", 0.25), 6).alias("p25"), F.round(F.percentile("v", 0.75), 6).alias("p75"))


@query("best_frame", f"WITH {views.DENSE_CTE}, s AS ({_STATS_SQL} FROM dense GROUP BY solar_day), e AS (SELECT * FROM s WHERE valid_frac >= 0.2) SELECT (SELECT solar_day FROM e ORDER BY cloud_frac, solar_day LIMIT 1) AS clearest, (SELECT solar_day FROM e ORDER BY cloud_frac DESC, solar_day LIMIT 1) AS cloudiest", days=("clearest", "cloudiest"))
def best_frame(spark, sf_dir):
    """The clearest and the cloudiest eligible day, the first of equals."""
    s = frame_stats(spark, sf_dir).filter("valid_frac >= 0.2")
    day = F.unix_date("solar_day")
    return s.agg(F.min_by("solar_day", F.struct("cloud_frac", day)).alias("clearest"), F.max_by("solar_day", F.struct(F.col("cloud_frac"), -day)).alias("cloudiest"))


def _stretch_sql(band: str) -> str:
    return f"coalesce(CASE WHEN {band} <> -999 THEN least(greatest(CAST({band} AS DOUBLE) / 10000.0 / 0.25, 0.0), 1.0) END, 0.93)"


@query("rgb_stretch", f"WITH {views.PIX_CTE} SELECT {_D}, " + ", ".join(f"{_stretch_sql(f'nbart_{b}')} AS {b}" for b in ("red", "green", "blue")) + " FROM pix")
def rgb_stretch(spark, sf_dir):
    """True colour from 0 to 1; what is missing takes the paper's grey."""
    shown = {b: F.when(F.col(f"nbart_{b}") != -999, F.least(F.greatest(F.col(f"nbart_{b}").cast("double") / 10000.0 / 0.25, F.lit(0.0)), F.lit(1.0))) for b in ("red", "green", "blue")}
    return views.pixels(spark, sf_dir).select(*KEYS, *[F.coalesce(c, F.lit(0.93)).alias(b) for b, c in shown.items()])


_RINGS = f"""WITH {views.DENSE_CTE}, steps AS (SELECT i, j, ceil(sqrt(i * i + j * j) - 1e-12) AS d FROM range(-4, 5) a(i), range(-4, 5) b(j) WHERE i * i + j * j <= 16),
  reached AS (SELECT solar_day, "row" + CAST(i AS INT) AS "row", "col" + CAST(j AS INT) AS "col", CAST(min(d) AS INT) AS distance FROM dense, steps WHERE oa_fmask IN (2, 3) GROUP BY ALL),
  rings AS (SELECT solar_day, "row", "col", nbart_blue, nbart_nir_1, distance FROM dense LEFT JOIN reached USING (solar_day, "row", "col") WHERE oa_fmask = 1)"""
_PROFILE = _RINGS + """, far AS (SELECT solar_day, count(*) AS n, median(nbart_blue) AS fb, median(nbart_nir_1) AS fn FROM rings WHERE distance IS NULL GROUP BY solar_day HAVING count(*) >= 20),
 prof AS (SELECT solar_day, distance AS distance_px, count(*) AS n_pixels, round(median(nbart_blue) / any_value(fb), 6) AS nbart_blue, round(median(nbart_nir_1) / any_value(fn), 6) AS nbart_nir_1
  FROM rings JOIN far USING (solar_day) WHERE distance IS NOT NULL AND fb > 0 AND fn > 0 GROUP BY solar_day, distance HAVING count(*) >= 5)"""
_SHOWN = ["nbart_blue", "nbart_nir_1"]


@query("ring_distance", _RINGS + f" SELECT {_D}, distance FROM rings")
def ring_distance(spark, sf_dir):
    return fr.ring_distances(views.dense(spark, sf_dir), 4).select(*KEYS, "distance")


@query("far_field", _RINGS + f" SELECT {_D} FROM rings WHERE distance IS NULL")
def far_field(spark, sf_dir):
    return ring_distance(spark, sf_dir).filter("distance IS NULL").select(*KEYS)


@query("ring_profile", _PROFILE + " SELECT * FROM prof")
def ring_profile(spark, sf_dir):
    p = fr.ring_profiles(views.dense(spark, sf_dir), _SHOWN, 4, 20, 5)
    return p.select("solar_day", "distance_px", "n_pixels", *[F.round(b, 6).alias(b) for b in _SHOWN])


@query("profile_quantiles", _PROFILE + " SELECT distance_px, round(median(nbart_blue), 5) AS med, round(quantile_cont(nbart_blue, 0.25), 5) AS p25, round(quantile_cont(nbart_blue, 0.75), 5) AS p75 FROM prof GROUP BY distance_px", days=())
def profile_quantiles(spark, sf_dir):
    p = ring_profile(spark, sf_dir)
    return p.groupBy("distance_px").agg(F.round(F.median("nbart_blue"), 5).alias("med"), F.round(F.percentile("nbart_blue", 0.25), 5).alias("p25"), F.round(F.percentile("nbart_blue", 0.75), 5).alias("p75"))


#: Regions are quarters of the year; a frame's scene cloud is the least of its scenes.
_FRAMES = f"""WITH {views.DENSE_CTE}, {views.SCENES_CTE}, st AS ({_STATS_SQL} FROM dense GROUP BY solar_day),
 low AS (SELECT solar_day, min(cloud_cover) AS scene_cloud FROM dated GROUP BY solar_day),
 fr AS (SELECT st.*, quarter(solar_day) AS region, scene_cloud FROM st LEFT JOIN low USING (solar_day))"""


def _frames(spark, sf_dir):
    stats = frame_stats(spark, sf_dir).withColumn("region", F.quarter("solar_day").cast("long"))
    return stats.join(scene_min_cloud(spark, sf_dir), "solar_day", "left")


@query("frames_table", _FRAMES + " SELECT * FROM fr")
def frames_table(spark, sf_dir):
    return _frames(spark, sf_dir)


@query("gate_sweep", _FRAMES + " SELECT region, CAST(s AS INT) AS step, count(*) FILTER (cloud_frac <= s / 50.0::DOUBLE) AS kept FROM fr, range(0, 51) t(s) WHERE valid_frac >= 0.2 GROUP BY region, s", days=())
def gate_sweep(spark, sf_dir):
    return fr.gate_sweep(_frames(spark, sf_dir))


_SHARES = ("cloud_only_frac", "shadow_frac", "snow_frac", "water_frac")


@query("composition", _FRAMES + " SELECT region, " + ", ".join(f"round(coalesce(100 * avg({c}) FILTER (valid_frac >= 0.2), 0), 6) AS {c}" for c in _SHARES) + " FROM fr GROUP BY region", days=())
def composition(spark, sf_dir):
    """Mean class shares of usable frames in percent, by region."""
    usable = F.col("valid_frac") >= 0.2
    return _frames(spark, sf_dir).groupBy("region").agg(*[F.round(F.coalesce(100 * F.avg(F.when(usable, F.col(c))), F.lit(0.0)), 6).alias(c) for c in _SHARES])


@query("filter_tradeoff", _FRAMES + " SELECT region, count(*) FILTER (scene_cloud > 30 AND cloud_frac <= 0.5 AND valid_frac >= 0.2) AS lost, count(*) FILTER (cloud_frac <= 0.5 AND valid_frac >= 0.2) AS usable FROM fr WHERE scene_cloud IS NOT NULL GROUP BY region", days=())
def filter_tradeoff(spark, sf_dir):
    """Usable frames, and those of them that a scene-level cloud filter would lose."""
    usable = (F.col("cloud_frac") <= 0.5) & (F.col("valid_frac") >= 0.2)
    return _frames(spark, sf_dir).filter("scene_cloud IS NOT NULL").groupBy("region").agg(F.count_if((F.col("scene_cloud") > 30) & usable).alias("lost"), F.count_if(usable).alias("usable"))


@query("cloud_corr", _FRAMES + " SELECT round(corr(valid_frac, cloud_frac), 6) AS r FROM fr", days=())
def cloud_corr(spark, sf_dir):
    return _frames(spark, sf_dir).agg(F.round(F.corr("valid_frac", "cloud_frac"), 6).alias("r"))


@query("frame_rank", _FRAMES + " SELECT solar_day, cloud_frac FROM fr WHERE valid_frac >= 0.2 ORDER BY cloud_frac, solar_day LIMIT 10")
def frame_rank(spark, sf_dir):
    """The ten clearest usable frames."""
    return _frames(spark, sf_dir).filter("valid_frac >= 0.2").orderBy("cloud_frac", "solar_day").limit(10).select("solar_day", "cloud_frac")


@query("clean_frames", _FULL + " SELECT solar_day, round_even(valid_fraction, 4) AS valid_fraction, round_even(cloud_fraction, 4) AS cloud_fraction, round_even(snow_fraction, 4) AS snow_fraction FROM kept")
def clean_frames(spark, sf_dir):
    """The coordinates of each frame that cleaning keeps."""
    return fr.clean(views.dense(spark, sf_dir), _OPTIONS).frames


@query("gate_counts", _FRAMES + """ SELECT count(*) FILTER (valid_frac >= 0.2 AND cloud_frac <= 0.5) AS kept, count(*) FILTER (NOT (valid_frac >= 0.2 AND cloud_frac <= 0.5)) AS dropped,
 count(*) FILTER (valid_frac = 0) AS off_swath, count(*) FILTER (valid_frac >= 0.2 AND cloud_frac < 0.02) AS clear FROM fr""", days=())
def gate_counts(spark, sf_dir):
    """Frames that the gates keep and drop, those without valid pixels, and the kept ones that are clear."""
    keep = (F.col("valid_frac") >= 0.2) & (F.col("cloud_frac") <= 0.5)
    counts = {"kept": keep, "dropped": ~keep, "off_swath": F.col("valid_frac") == 0, "clear": keep & (F.col("cloud_frac") < 0.02)}
    return _frames(spark, sf_dir).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


_CANDIDATES = f", stat AS ({_STATS_SQL} FROM dense GROUP BY solar_day) SELECT prof.* FROM prof SEMI JOIN (SELECT solar_day FROM stat WHERE cloud_frac BETWEEN 0.03 AND 0.7 AND valid_frac > 0.5) USING (solar_day)"


@query("ring_candidates", _PROFILE + _CANDIDATES)
def ring_candidates(spark, sf_dir):
    """Ring profiles of the frames with some cloud but not too much: only these are searched for rings."""
    some = frame_stats(spark, sf_dir).filter(F.col("cloud_frac").between(0.03, 0.7) & (F.col("valid_frac") > 0.5)).select("solar_day")
    # one row a frame at most: broadcast, or else pixels would be dealt out by their few days before these are known
    p = fr.ring_profiles(views.dense(spark, sf_dir).join(F.broadcast(some), "solar_day", "left_semi"), _SHOWN, 4, 20, 5)
    return p.select("solar_day", "distance_px", "n_pixels", *[F.round(b, 6).alias(b) for b in _SHOWN])


@query("ring_steps", _PROFILE + " SELECT DISTINCT distance_px FROM prof ORDER BY distance_px", days=())
def ring_steps(spark, sf_dir):
    return ring_profile(spark, sf_dir).select("distance_px").distinct().orderBy("distance_px")


@query("ndvi_peak", f"SELECT max(p75) AS peak FROM ({ORACLE_SQL['ndvi_series']})", days=())
def ndvi_peak(spark, sf_dir):
    """The largest upper quartile of all frames."""
    return ndvi_series(spark, sf_dir).agg(F.max("p75").alias("peak"))
