import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.functions import grid

#: Boxes on both hemispheres, over the equator and the zero meridian.
BOXES = [(12.4, 41.85, 12.55, 41.95), (-0.2, -0.15, 0.1, 0.2), (-70.7, -33.5, -70.6, -33.4), (77.1, 28.5, 77.101, 28.501), (-152.0, 61.0, -151.9, 61.1)]


def boxes():
    return st.tuples(st.floats(-170, 169), st.floats(-80, 79), st.floats(0.001, 0.5), st.floats(0.001, 0.5)).map(lambda b: (b[0], b[1], b[0] + b[2], b[1] + b[3]))


def area(south, north, steps=20_000):
    """Square metres of a degree of longitude between two latitudes of the ellipsoid, by summation."""
    lat = np.radians(np.linspace(south, north, steps + 1))
    mid = (lat[1:] + lat[:-1]) / 2
    w = 1 - grid.E2 * np.sin(mid) ** 2
    return float((grid.A**2 * (1 - grid.E2) * np.cos(mid) / w**2).sum() * (lat[1] - lat[0]) * math.radians(1))


@pytest.mark.parametrize(("south", "north"), [(0, 1), (-45, -44), (29, 31), (60, 75)])
def test_areas_are_kept(south, north):
    (x0, y0), (x1, y1) = grid.project(5, south), grid.project(6, north)
    assert math.isclose((x1 - x0) * (y1 - y0), area(south, north), rel_tol=1e-6)


def test_true_scale_at_the_standard_parallel():
    radius = grid.A / math.sqrt(1 - grid.E2 * 0.25) * math.cos(math.radians(30))
    assert math.isclose(grid.project(1, 30)[0], radius * math.radians(1), rel_tol=1e-12)
    assert grid.project(0, 0) == (0, 0) and math.isclose(grid.project(40, -20)[1], -grid.project(40, 20)[1])


@settings(max_examples=100, deadline=None)
@given(st.floats(-179, 179), st.floats(-84, 84))
def test_round_trip(lon, lat):
    x, y = grid.unproject(*grid.project(lon, lat))
    assert math.isclose(x, lon, abs_tol=1e-9) and math.isclose(y, lat, abs_tol=1e-6)


@settings(max_examples=200, deadline=None)
@given(boxes())
def test_windows_are_the_smallest_of_whole_chunks(box):
    w, step = grid.window_of(box), grid.RES * grid.CHUNK
    x0, y0, x1, y1 = grid.extent_of(w)
    (west, south), (east, north) = grid.project(*box[:2]), grid.project(*box[2:])
    assert all(-1e-6 <= gap < step for gap in (west - x0, x1 - east, south - y0, y1 - north))  # metres
    assert len(grid.chunks_of(w)) == (w.row1 - w.row0) * (w.col1 - w.col0) / grid.CHUNK**2
    assert {grid.CHUNK * cy for cy, _ in grid.chunks_of(w)} == set(range(w.row0, w.row1, grid.CHUNK))


@settings(max_examples=50, deadline=None)
@given(boxes(), st.floats(0, 1), st.floats(0, 1))
def test_parts_of_a_box_need_no_other_chunks(box, a, b):
    part = (box[0] + (box[2] - box[0]) * min(a, b) / 2, box[1], box[2], box[3] - (box[3] - box[1]) * max(a, b) / 2)
    assert set(grid.chunks_of(grid.window_of(part))) <= set(grid.chunks_of(grid.window_of(box)))


@pytest.mark.parametrize("box", [(10, 0, 9, 1), (10, 1, 11, 1), (10, 80, 11, 89), (10, -89, 11, -80)])
def test_boxes_off_the_grid(box):
    with pytest.raises(ValueError):
        grid.window_of(box)


def test_columns_agree_with_numbers(spark):
    df = spark.createDataFrame(BOXES, "west double, south double, east double, north double")
    windows = [grid.window_of(b) for b in BOXES]
    assert [(r.row0, r.row1, r.col0, r.col1) for r in grid.with_window(df).collect()] == windows
    chunks = grid.with_chunks(grid.with_window(df.limit(1))).select("cy", "cx").collect()
    assert [tuple(r) for r in chunks] == grid.chunks_of(windows[0])
    empty = spark.createDataFrame([(512, 512, 0, 256)], "row0 int, row1 int, col0 int, col1 int")
    assert grid.with_chunks(empty).collect() == []
