"""Frames: collapsing repeats, filling gaps, masks, dilation, gates, screens and survey statistics.

A pixel table has solar_day, row, col and a column a band. A frame is one solar day. Frames are dense
where an operator says so: `densify` makes them so.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SENSOR, CleanOptions, SensorConfig

KEYS = ["solar_day", "row", "col"]
#: Frames are dilated in tiles of so many pixels a side, each with a margin from its neighbours.
TILE = 512
#: A task lists so many places of a grid or more, where there are more of them than tasks run at once.
BLOCK = 4096


@dataclass(frozen=True)
class CubeFrame:
    """Pixels, one row a frame with its statistics, and metadata."""

    pixels: DataFrame
    frames: DataFrame
    attrs: dict = field(default_factory=dict)


def collapse_max(observations: DataFrame, sensor: SensorConfig = SENSOR) -> DataFrame:
    """One row a pixel and day: the largest value of each band, class codes included."""
    return observations.groupBy(*KEYS).agg(*[F.max(b).alias(b) for b in sensor.bands if b in observations.columns])


def grid_of(days: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """Every pixel of the window on every day. Places are a range, dealt over tasks and of a size that Spark
    knows, so a join does not take the grid for as small as the days that it repeats; only these are broadcast."""
    if row0 >= row1 or col0 >= col1:
        return days.select("solar_day", F.lit(0).alias("row"), F.lit(0).alias("col")).limit(0)
    spark, wide, n = days.sparkSession, col1 - col0, (row1 - row0) * (col1 - col0)
    tasks = min(n, max(spark.sparkContext.defaultParallelism, min(n // BLOCK, BLOCK)))
    row, col = F.expr(f"CAST({row0} + id div {wide} AS INT)").alias("row"), F.expr(f"CAST({col0} + id % {wide} AS INT)").alias("col")
    return spark.range(0, n, 1, tasks).select(row, col).crossJoin(F.broadcast(days.select("solar_day"))).select(*KEYS)


def densify(pixels: DataFrame, days: DataFrame, window: tuple[int, int, int, int], sensor: SensorConfig = SENSOR) -> DataFrame:
    """The window in full; what was never sensed, bands that are missing altogether included, is nodata."""
    kept = pixels.select(*KEYS, *[b for b in sensor.bands if b in pixels.columns])
    # the size of pixels is guessed from compressed files, so it must not decide whether the driver gets them all
    full = grid_of(days, *window).join(kept.hint("merge"), KEYS, "left")
    gaps = {b: F.coalesce(F.col(b) if b in kept.columns else F.lit(None), F.lit(sensor.nodata(b))).cast("short") for b in sensor.bands}
    return full.select(*KEYS, *[c.alias(b) for b, c in gaps.items()])


def is_valid(sensor: SensorConfig = SENSOR) -> Column:
    return F.col(sensor.class_band) != sensor.class_nodata


def is_bad(sensor: SensorConfig = SENSOR) -> Column:
    return F.col(sensor.class_band).isin(sensor.cloud, sensor.shadow)


def half_widths(radius: int) -> list[int]:
    """For each row distance within the disk, how far it reaches to either side."""
    return [math.isqrt(radius * radius - k * k) for k in range(radius + 1)]


def _tiled(pixels: DataFrame, radius: int, tile: int) -> DataFrame:
    """Each pixel once for every tile (__ty, __tx) that it is part of or lies within radius of; __own marks the first kind."""
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / tile), F.floor((F.col(c) + radius) / tile)))
    spread = pixels.select("*", near("row").alias("__ty")).select("*", near("col").alias("__tx"))
    return spread.withColumn("__own", (F.floor(F.col("row") / tile) == F.col("__ty")) & (F.floor(F.col("col") / tile) == F.col("__tx")))


def dilate_rows(pixels: DataFrame, bad: Column, radius: int, name: str = "near_bad", tile: int = TILE) -> DataFrame:
    """Dilation by a disk in two window passes over tiles of dense frames: along rows, then across them.

    Tiles are dealt out once, which serves both passes."""
    along = Window.partitionBy("solar_day", "__ty", "__tx", "row").orderBy("col")
    across = Window.partitionBy("solar_day", "__ty", "__tx", "col").orderBy("row")
    flat = _tiled(pixels.withColumn("__b", bad.cast("byte")), radius, tile).repartition("solar_day", "__ty", "__tx")
    flat = flat.withColumns({f"__h{k}": F.max("__b").over(along.rowsBetween(-w, w)) for k, w in enumerate(half_widths(radius))})
    hits = [F.col("__h0")]
    for k in range(1, radius + 1):
        hits += [F.coalesce(F.lag(f"__h{k}", k).over(across), F.lit(0).cast("byte")), F.coalesce(F.lead(f"__h{k}", k).over(across), F.lit(0).cast("byte"))]
    out = flat.withColumn(name, (F.greatest(*hits) if len(hits) > 1 else hits[0]) == 1).filter("__own")
    return out.drop("__b", "__ty", "__tx", "__own", *[f"__h{k}" for k in range(radius + 1)])


def _offsets(radius: int) -> Column:
    disk = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    ring = lambda dy, dx: math.ceil(math.sqrt(dy * dy + dx * dx) - 1e-12)
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(ring(dy, dx)).alias("d")) for dy, dx in disk])


def bad_distance(pixels: DataFrame, bad: Column, radius: int, tile: int = TILE) -> DataFrame:
    """solar_day, row, col and ring distance (rounded up) of every place within radius of a bad pixel.

    Bad pixels are dealt out by tiles and spread within these, so that one row a place leaves a task and not one a pixel and offset."""
    tasks = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named: else few would be left, as few rows come in for each that is made
    dealt = _tiled(pixels.filter(bad).select(*KEYS), radius, tile).repartition(tasks, "solar_day", "__ty", "__tx")
    spread = dealt.select("solar_day", "__ty", "__tx", "row", "col", F.explode(_offsets(radius)).alias("o"))
    moved = spread.select("solar_day", "__ty", "__tx", (F.col("row") + F.col("o.dy")).alias("row"), (F.col("col") + F.col("o.dx")).alias("col"), F.col("o.d").alias("distance"))
    own = moved.filter((F.floor(F.col("row") / tile) == F.col("__ty")) & (F.floor(F.col("col") / tile) == F.col("__tx")))
    return own.groupBy("solar_day", "__ty", "__tx", "row", "col").agg(F.min("distance").alias("distance")).select(*KEYS, "distance")


def dilate_offsets(pixels: DataFrame, bad: Column, radius: int, name: str = "near_bad") -> DataFrame:
    """Dilation by spreading bad pixels and joining back; frames may be sparse."""
    near = bad_distance(pixels, bad, radius).select(*KEYS, F.lit(True).alias(name))
    return pixels.join(near.hint("merge"), KEYS, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def dilate_kernel(pixels: DataFrame, bad: Column, radius: int, name: str = "near_bad", tile: int = TILE) -> DataFrame:
    """Dilation of tiles as arrays, one Arrow group a tile with its margin."""
    import numpy as np

    widths = half_widths(radius)

    def plane_of(pdf):
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        r, c = r - r.min(), c - c.min()
        plane = np.zeros((r.max() + 1 + 2 * radius, c.max() + 1 + 2 * radius), bool)
        plane[r + radius, c + radius] = pdf["__b"].to_numpy()
        out = np.zeros_like(plane)
        for dy in range(-radius, radius + 1):
            for dx in range(-widths[abs(dy)], widths[abs(dy)] + 1):
                out |= np.roll(np.roll(plane, dy, 0), dx, 1)
        return pdf[KEYS].assign(**{name: out[r + radius, c + radius]})[pdf["__own"].to_numpy()]

    keyed = _tiled(pixels.select(*KEYS, bad.alias("__b")), radius, tile)
    flags = keyed.groupBy("solar_day", "__ty", "__tx").applyInPandas(plane_of, f"solar_day date, row int, col int, {name} boolean")
    return pixels.join(flags.hint("merge"), KEYS)


DILATIONS = {"rows": dilate_rows, "offsets": dilate_offsets, "kernel": dilate_kernel}


def mask_columns(pixels: DataFrame, options: CleanOptions, sensor: SensorConfig = SENSOR, dilation: str = "rows") -> DataFrame:
    """Adds valid, gate (cloud and shadow, dilated), snow and clear."""
    valid, code = is_valid(sensor), F.col(sensor.class_band)
    if options.buffer_px:
        pixels = DILATIONS[dilation](pixels, is_bad(sensor), options.buffer_px, "__near")
    else:
        pixels = pixels.withColumn("__near", is_bad(sensor))
    pixels = pixels.withColumns({"valid": valid, "gate": F.col("__near") & valid, "snow": (code == sensor.snow) & valid})
    masks = [F.col("gate")] + [F.col("snow")] * options.mask_snow + [(code == sensor.water) & valid] * options.mask_water
    return pixels.withColumn("clear", valid & ~reduce(lambda a, b: a | b, masks)).drop("__near")


def frame_fractions(masked: DataFrame) -> DataFrame:
    """n_valid and the unrounded fractions of each dense frame."""
    n, share = F.count_if("valid"), lambda c, none: F.when(F.count_if("valid") > 0, F.count_if(c) / F.count_if("valid")).otherwise(F.lit(none))
    return masked.groupBy("solar_day").agg(
        n.alias("n_valid"), (n / F.count(F.lit(1))).alias("valid_fraction"), share("gate", 1.0).alias("cloud_fraction"), share("snow", 0.0).alias("snow_fraction")
    )


def gate_frames(frames: DataFrame, options: CleanOptions) -> DataFrame:
    return frames.filter((F.col("valid_fraction") >= options.min_valid_fraction) & (F.col("cloud_fraction") <= options.max_cloud_fraction))


def clean(pixels: DataFrame, options: CleanOptions | None = None, sensor: SensorConfig = SENSOR, dilation: str = "rows") -> CubeFrame:
    """Masks pixels and drops unusable frames of a dense pixel table, whoever made it.

    The gate needs class codes alone; bands are masked only in the frames that it keeps.

    The gate uses unrounded fractions; those in `frames` are rounded half-even to four places."""
    options = options or CleanOptions()
    kept = gate_frames(frame_fractions(mask_columns(pixels, options, sensor, dilation)), options)
    shown = kept.select("solar_day", *[F.bround(c, 4).alias(c) for c in ("valid_fraction", "cloud_fraction", "snow_fraction")])
    bands = [b for b in sensor.reflectance if b in pixels.columns]
    values = [F.when(F.col("clear") & (F.col(b) != sensor.nodata(b)), F.col(b)).cast("float").alias(b) for b in bands]
    # one row a frame at most: broadcast, or else pixels would be dealt out by their few days before these are known
    usable = pixels.join(F.broadcast(kept.select("solar_day")), "solar_day", "left_semi")
    out = mask_columns(usable, options, sensor, dilation).select(*KEYS, *values)
    classes = [sensor.cloud, sensor.shadow] + [sensor.snow] * options.mask_snow + [sensor.water] * options.mask_water
    attrs = {
        "max_cloud_fraction": options.max_cloud_fraction, "min_valid_fraction": options.min_valid_fraction, "cloud_buffer_px": options.buffer_px,
        "frame_gate_classes": [sensor.cloud, sensor.shadow], "masked_fmask_classes": sorted(classes), "crs": sensor.crs,
    }
    return CubeFrame(out, shown, attrs)


def screen_chunks(pixels: DataFrame, chunk: int, threshold: float | None = None, sensor: SensorConfig = SENSOR) -> DataFrame:
    """Chunks (solar_day, cy, cx) with valid pixels of which at most the threshold is cloud or shadow."""
    limit = sensor.screen_cloud_fraction if threshold is None else threshold
    cell = pixels.groupBy("solar_day", F.floor(F.col("row") / chunk).cast("int").alias("cy"), F.floor(F.col("col") / chunk).cast("int").alias("cx"))
    counts = cell.agg(F.count_if(is_valid(sensor)).alias("n_valid"), F.count_if(is_bad(sensor) & is_valid(sensor)).alias("n_bad"))
    return counts.filter((F.col("n_valid") > 0) & (F.try_divide("n_bad", "n_valid") <= limit))


def survey_stats(pixels: DataFrame, *extra: str, sensor: SensorConfig = SENSOR) -> DataFrame:
    """Undilated class shares of each dense frame."""
    valid, code = is_valid(sensor), F.col(sensor.class_band)
    n = F.count_if(valid)
    share = lambda c, none=0.0: F.when(n > 0, F.count_if(c) / n).otherwise(F.lit(none))
    return pixels.groupBy("solar_day", *extra).agg(
        (n / F.count(F.lit(1))).alias("valid_frac"),
        share(is_bad(sensor) & valid, 1.0).alias("cloud_frac"),
        share(code == sensor.cloud).alias("cloud_only_frac"),
        share(code == sensor.shadow).alias("shadow_frac"),
        share(code == sensor.snow).alias("snow_frac"),
        share(code == sensor.water).alias("water_frac"),
    )


#: Fixed value: the class code of clear land.
CLEAR_LAND = 1


def ring_distances(pixels: DataFrame, radius: int, sensor: SensorConfig = SENSOR) -> DataFrame:
    """Clear-land pixels with their ring distance to the nearest bad pixel; null beyond the radius."""
    clear = pixels.filter(F.col(sensor.class_band) == CLEAR_LAND)
    return clear.join(bad_distance(pixels, is_bad(sensor), radius).hint("merge"), KEYS, "left")


def ring_profiles(pixels: DataFrame, bands: list[str], radius: int, least_far: int, least_ring: int, sensor: SensorConfig = SENSOR) -> DataFrame:
    """Median of each band in each ring over the same frame's far-field median.

    Frames with too small a far field or a median that is not positive, and small rings, are left out."""
    rings = ring_distances(pixels, radius, sensor)
    # the far field is the ring without a distance: one pass over the pixels serves both
    each = rings.groupBy("solar_day", F.col("distance").alias("distance_px")).agg(F.count(F.lit(1)).alias("n_pixels"), *[F.median(b).alias(b) for b in bands])
    frame, is_far = Window.partitionBy("solar_day"), F.col("distance_px").isNull()
    each = each.withColumns({f"__{c}": F.max(F.when(is_far, F.col(c))).over(frame) for c in ["n_pixels", *bands]})
    fit = reduce(lambda a, b: a & b, [F.col(f"__{b}") > 0 for b in bands], F.col("__n_pixels") >= least_far)
    near = each.filter(fit & ~is_far & (F.col("n_pixels") >= least_ring))
    return near.select("solar_day", "distance_px", "n_pixels", *[(F.col(b) / F.col(f"__{b}")).alias(b) for b in bands])


def gate_sweep(stats: DataFrame, steps: int = 50, least_valid: float = 0.2) -> DataFrame:
    """Frames kept by region at cloud gates from 0 to 1."""
    gates = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    wide = stats.filter(F.col("valid_frac") >= least_valid).select("region", "cloud_frac", gates.alias("step"))
    return wide.groupBy("region", "step").agg(F.count_if(F.col("cloud_frac") <= F.col("step") / F.lit(float(steps))).alias("kept"))
