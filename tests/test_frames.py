import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.config import CleanOptions
from pixelloom.operators import frames as fr

DAY = dt.date(2024, 1, 1)
SCHEMA = "solar_day date, row int, col int, oa_fmask short, nbart_red short"


def plane(spark, codes, day=DAY, red=801):
    codes = np.asarray(codes)
    return spark.createDataFrame([(day, r, c, int(codes[r, c]), red) for r in range(codes.shape[0]) for c in range(codes.shape[1])], SCHEMA)


def disk_dilate(bad, r):
    out = np.zeros_like(bad)
    for y, x in zip(*np.nonzero(bad), strict=True):
        for i in range(bad.shape[0]):
            for j in range(bad.shape[1]):
                out[i, j] |= (i - y) ** 2 + (j - x) ** 2 <= r * r
    return out


@pytest.mark.parametrize("kind", ["rows", "offsets", "kernel"])
@pytest.mark.parametrize("radius", [1, 3, 5])
def test_dilations_agree_with_the_disk(spark, kind, radius):
    codes = np.random.default_rng(radius).choice([0, 1, 2, 3, 4], (14, 11), p=[0.1, 0.8, 0.03, 0.03, 0.04])
    got = fr.DILATIONS[kind](plane(spark, codes), fr.is_bad(), radius).collect()
    want = disk_dilate(np.isin(codes, [2, 3]), radius)
    assert len(got) == codes.size
    assert all(r.near_bad == want[r.row, r.col] for r in got)


@pytest.mark.parametrize("kind", ["rows", "kernel"])
def test_tiles_do_not_show(spark, kind):
    """Disks cross the edges and corners of tiles; each pixel comes back once."""
    codes = np.random.default_rng(7).choice([1, 2], (23, 19), p=[0.97, 0.03])
    got = fr.DILATIONS[kind](plane(spark, codes), fr.is_bad(), 3, tile=8).collect()
    want = disk_dilate(codes == 2, 3)
    assert sorted((r.row, r.col) for r in got) == [(r, c) for r in range(23) for c in range(19)]
    assert all(r.near_bad == want[r.row, r.col] for r in got)


def test_grid_lists_rows_in_blocks(spark):
    days = spark.createDataFrame([(DAY,)], "solar_day date")
    got = fr.grid_of(days, 5, 5 + 2 * fr.BLOCK + 1, 0, 2)
    assert got.count() == got.distinct().count() == 2 * (2 * fr.BLOCK + 1)
    assert got.agg(F.min("row"), F.max("row")).first() == (5, 5 + 2 * fr.BLOCK)
    assert fr.grid_of(days, 0, 0, 0, 2).count() == 0


def clean(spark, codes, **options):
    return fr.clean(plane(spark, codes), CleanOptions(**options))


def test_clean_drops_classes_and_keeps_values(spark):
    codes = np.ones((10, 10), int)
    out = clean(spark, codes)
    assert out.pixels.columns == ["solar_day", "row", "col", "nbart_red"]
    assert {r.nbart_red for r in out.pixels.collect()} == {801.0}
    assert out.attrs["frame_gate_classes"] == [2, 3] and out.attrs["masked_fmask_classes"] == [2, 3, 4]


@pytest.mark.parametrize(
    ("valid", "bad", "stays"),
    [(20, 0, True), (19, 0, False), (100, 50, True), (100, 51, False), (64, 32, True), (64, 33, False), (0, 0, False)],
)
def test_frame_gates(spark, valid, bad, stays):
    """Of 100 pixels so many are valid and so many of these bad; both limits are themselves allowed."""
    codes = np.repeat([2, 1, 0], [bad, valid - bad, 100 - valid]).reshape(5, 20)
    got = clean(spark, codes, buffer_px=0).frames.collect()
    assert [(r.valid_fraction, r.cloud_fraction) for r in got] == [(valid / 100, round(bad / valid, 4))] * stays if valid else got == []
    shares = fr.frame_fractions(fr.mask_columns(plane(spark, codes), CleanOptions(buffer_px=0))).first()
    assert (shares.n_valid, shares.snow_fraction) == (valid, 0.0) and (valid or shares.cloud_fraction == 1.0)


def test_gate_uses_unrounded_fractions(spark):
    codes = np.ones((100, 200), int)
    codes.reshape(-1)[:10_001] = 2
    assert clean(spark, codes, buffer_px=0).frames.collect() == []
    assert clean(spark, codes, buffer_px=0, max_cloud_fraction=0.50005).frames.first().cloud_fraction == 0.5


def test_buffer_masks_neighbours(spark):
    codes = np.ones((20, 20), int)
    codes[10, 10] = 2
    values = {(r.row, r.col): r.nbart_red for r in clean(spark, codes, buffer_px=3).pixels.collect()}
    assert values[10, 12] is None and values[10, 13] is None and values[10, 14] == 801.0 and values[13, 12] == 801.0


def test_snow_and_water(spark):
    codes = np.full((4, 4), 4)
    codes[0] = 5
    out = clean(spark, codes, buffer_px=0)
    assert out.frames.first().snow_fraction == 0.75
    assert {r.row: r.nbart_red for r in out.pixels.collect()} == {0: 801.0, 1: None, 2: None, 3: None}
    wet = clean(spark, codes, buffer_px=0, mask_water=True, mask_snow=False)
    assert {r.row: r.nbart_red for r in wet.pixels.collect()} == {0: None, 1: 801.0, 2: 801.0, 3: 801.0}


def test_nodata_and_no_frames(spark):
    out = fr.clean(plane(spark, np.ones((3, 3), int), red=-999), CleanOptions())
    assert {r.nbart_red for r in out.pixels.collect()} == {None}
    none = fr.clean(spark.createDataFrame([], SCHEMA), CleanOptions())
    assert none.pixels.collect() == [] and none.frames.collect() == []


def test_collapse_takes_the_largest_code(spark):
    rows = [(DAY, 0, 0, 2, 10), (DAY, 0, 0, 5, 7), (DAY, 0, 1, 1, None)]
    got = fr.collapse_max(spark.createDataFrame(rows, SCHEMA)).orderBy("col").collect()
    assert [tuple(r)[3:] for r in got] == [(5, 10), (1, None)]


def test_screen(spark):
    codes = np.ones((8, 8), int)
    codes[:4, :4] = 2
    codes[:4, 4:] = 0
    codes[4:, :4] = np.array([[2] * 4] * 3 + [[1] * 4])
    got = {(r.cy, r.cx) for r in fr.screen_chunks(plane(spark, codes), 4).collect()}
    assert got == {(1, 0), (1, 1)}
    assert (0, 0) in {(r.cy, r.cx) for r in fr.screen_chunks(plane(spark, codes), 4, threshold=1.0).collect()}


def test_rings(spark):
    codes = np.ones((9, 9), int)
    codes[4, 4] = 3
    got = {(r.row, r.col): r.distance for r in fr.ring_distances(plane(spark, codes), 3).collect()}
    assert got[4, 5] == 1 and got[5, 5] == 2 and got[4, 7] == 3 and got[6, 6] == 3 and got[0, 0] is None and (4, 4) not in got
    shown = fr.ring_profiles(plane(spark, codes), ["nbart_red"], 2, 10, 1).orderBy("distance_px").collect()
    assert [(r.distance_px, r.n_pixels, r.nbart_red) for r in shown] == [(1, 4, 1.0), (2, 8, 1.0)]
    assert fr.ring_profiles(plane(spark, codes), ["nbart_red"], 2, 1000, 1).collect() == []


def test_densify_fills_days_and_bands(spark):
    some = spark.createDataFrame([(DAY, 1, 1, 1, 5)], SCHEMA).drop("nbart_red")
    days = spark.createDataFrame([(DAY,), (dt.date(2024, 1, 2),)], "solar_day date")
    got = fr.densify(some, days, (0, 2, 0, 2))
    assert got.count() == 8 and got.filter("oa_fmask = 1").count() == 1
    assert got.select(F.max("nbart_red")).first()[0] == -999


def test_grid_is_dealt_over_tasks(spark):
    """However few days there are: one task would list every pixel of all frames."""
    days = spark.createDataFrame([(DAY,)], "solar_day date").distinct().coalesce(1)
    assert fr.grid_of(days, 0, 64, 0, 64).rdd.getNumPartitions() > 1


def test_clean_dilates_once_dealt_and_kept_frames_only(spark):
    out = clean(spark, np.ones((4, 4), int)).pixels._jdf.queryExecution()
    plan = out.optimizedPlan().toString()
    assert 0 <= plan.index("Window") < plan.index("LeftSemi")
    tiled = fr.dilate_rows(plane(spark, np.ones((4, 4), int)), fr.is_bad(), 2)._jdf.queryExecution().executedPlan().toString()
    assert tiled.count("Exchange hashpartitioning") == 1


def test_spreading_crosses_tiles(spark):
    """Distances of sparse pixels, places below zero included, do not depend on the tiles in which they are spread."""
    bad = [(0, 0), (7, 7), (8, 20), (30, 3)]
    some = spark.createDataFrame([(DAY, r, c, 2, 801) for r, c in bad], SCHEMA)
    got = fr.bad_distance(some, fr.is_bad(), 4, tile=8).collect()
    near = lambda y, x: min((y - r) ** 2 + (x - c) ** 2 for r, c in bad)
    want = {(y, x): int(np.ceil(np.sqrt(near(y, x)))) for y in range(-5, 36) for x in range(-5, 26) if near(y, x) <= 16}
    assert len(got) == len(want) and {(r.row, r.col): r.distance for r in got} == want


def test_bad_pixels_are_spread_after_they_are_dealt(spark):
    """Before, a row for each bad pixel and offset was shuffled."""
    plan = fr.bad_distance(plane(spark, np.ones((4, 4), int)), fr.is_bad(), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("explode([[") < plan.index("Exchange")


def test_ring_profiles_pass_once(spark):
    """Far field and rings come from one pass over the pixels; a frame without bad pixels has no ring, and one without far field no profile."""
    codes = np.ones((9, 9), int)
    codes[4, 4] = 3
    frames = plane(spark, codes).union(plane(spark, np.ones((9, 9), int), dt.date(2024, 1, 2))).union(plane(spark, codes[2:7, 2:7], dt.date(2024, 1, 3)))
    got = fr.ring_profiles(frames, ["nbart_red"], 3, 20, 5)
    assert got._jdf.queryExecution().executedPlan().toString().count("explode([[") == 1
    assert sorted((r.solar_day, r.distance_px, r.n_pixels, r.nbart_red) for r in got.collect()) == [(DAY, 2, 8, 1.0), (DAY, 3, 16, 1.0)]
