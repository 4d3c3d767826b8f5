import datetime as dt
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pixelloom.config import SENSOR, StorePaths
from pixelloom.functions.grid import Window
from pixelloom.plans.cube import Cube
from pixelloom.sources import ledger, store
from pixelloom.sources.pixel_source import TableSource, fetch_with_retry, read_catalog, read_csv, write_csv
from pixelloom.streaming.arrivals import follow

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 5)
C = 4


def observations(spark):
    bands = ", ".join(f"{b} short" for b in SENSOR.bands)
    rows = []
    for day in (D1, D2):
        for r in range(8):
            for c in range(8):
                code = 2 if day == D2 and r < 4 and c < 4 else 1
                rows.append((day, r, c, code, *[1000 + k for k in range(10)]))
    return spark.createDataFrame(rows, f"solar_day date, row int, col int, {bands}")


def scenes(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 1), 148.0, 10.0), ("b", dt.datetime(2024, 1, 5, 1), 148.0, None), ("c", dt.datetime(2024, 1, 3, 1), 148.0, 95.0)]
    return spark.createDataFrame(rows, "item_id string, ts timestamp_ntz, lon double, cloud_cover double")


class Counting(TableSource):
    calls: list = []

    def cells(self, wanted, bands):
        self.calls.append((len(bands), wanted.count()))
        return super().cells(wanted, bands)


@pytest.fixture
def cube(spark, tmp_path):
    boxes = {"all": Window(0, 8, 0, 8), "part": Window(0, 4, 0, 8)}
    source = Counting(scenes(spark), observations(spark), C)
    source.calls = []
    return Cube(spark, str(tmp_path / "cube"), source, chunk=C, window_of=boxes.__getitem__)


def test_fill_fetches_only_what_is_missing(cube):
    assert cube.fill("part", D1, D2) == 4
    assert cube.source.calls == [(1, 4), (10, 3)]  # the cloudy cell gets no other bands
    assert cube.fill("part", D1, D2) == 0
    assert cube.fill("all", D1, D2) == 4
    assert cube.source.calls[2:] == [(1, 4), (10, 4)]
    assert cube.fill("all", D1, D2) == 0
    assert cube.ledger.cells().filter("screened").count() == 1


def test_read_and_get(cube):
    raw = cube.get("all", D1, D2).pixels
    assert raw.count() == 128
    cloudy = raw.filter(f"solar_day = '{D2}' AND row < 4 AND col < 4")
    assert {(r.oa_fmask, r.nbart_red) for r in cloudy.collect()} == {(2, -999)}
    got = cube.get("all", D1, D2, indices=("NDVI",), buffer_px=0)
    assert got.pixels.filter("NDVI IS NOT NULL").count() == 112
    assert got.frames.count() == 2
    assert cube.get("all", D1, D2, cleaned=True, buffer_px=0, max_cloud_fraction=0.1).frames.count() == 1
    q = SimpleNamespace(bbox="all", start=D1, end=D2)
    assert cube.fill_query(q) == 0 and cube.get_query(q).pixels.count() == 128
    assert cube.read("all", D1, D1, ["nbart_red"]).columns == ["solar_day", "row", "col", "nbart_red"]
    assert cube.get("all", dt.date(2023, 1, 1), dt.date(2023, 1, 2), cleaned=True).pixels.collect() == []


def test_a_broken_run_is_made_good(cube, spark):
    """Pixels without a ledger row are fetched again, and the older copy is hidden."""
    cube.fill("all", D1, D2)
    again = Cube(spark, cube.paths.root, cube.source, chunk=C, window_of=cube.window_of)
    again.ledger.cells = lambda: spark.createDataFrame([], ledger.SCHEMAS["cells"])
    assert again.fill("all", D1, D2) == 8
    assert cube.read("all", D1, D2).count() == 128


def test_ledger(spark, tmp_path):
    led = ledger.Ledger(spark, StorePaths(str(tmp_path / "l")))
    row = lambda i, c: spark.createDataFrame([(i, D1, c, "{}")], "item_id string, solar_day date, cloud_cover double, item string")
    for r in (row("a", 10.0), row("a", 90.0), row("b", None), row("c", 80.0)):
        led.upsert_scenes(r)
    assert [r.item_id for r in ledger.scenes_between(led.scenes(), D1, D1, 80.0).collect()] == ["b", "c"]
    assert not led.search_covered((0, 0, 10, 10), D1, D2)
    led.record_search((0, 0, 10, 10), D1, D2)
    assert led.search_covered((1, 1, 10, 9), D1, D1)
    assert not led.search_covered((1, 1, 11, 9), D1, D1) and not led.search_covered((1, 1, 9, 9), D1, dt.date(2024, 1, 6))


def test_cells_round_trip(spark):
    px = observations(spark)
    bands = list(SENSOR.bands)
    back = store.to_pixels(store.from_pixels(px, bands, C), bands, chunk=C)
    assert back.exceptAll(px).isEmpty() and px.exceptAll(back).isEmpty()
    lacking = store.from_pixels(px, bands, C).withColumn("nbart_red", F.lit(None).cast("array<short>"))
    assert store.to_pixels(lacking, bands, chunk=C).select("nbart_red").distinct().first()[0] == -999


def test_catalogue_and_csv(spark, tmp_path):
    item = {"id": "x", "bbox": [147.0, -34, 149.0, -33], "properties": {"datetime": "2024-01-01T23:30:00Z", "eo:cloud_cover": 3.5}}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.json").write_text(json.dumps(item) + "\nnot json\n" + json.dumps({"id": "y"}) + "\n")
    got = read_catalog(spark, str(tmp_path / "c")).collect()
    assert [(r.item_id, r.lon, r.cloud_cover) for r in got] == [("x", 148.0, 3.5)] and json.loads(got[0].item) == item
    table = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    write_csv(table, str(tmp_path / "csv"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "csv"), "k string, v double").collect())) == [("a", 1.5), ("b", None)]


def test_retry():
    waits, replies = [], [503, 504, None]

    def fetch():
        if code := replies.pop(0):
            e = OSError("busy")
            e.code = code
            raise e
        return "here"

    assert fetch_with_retry(fetch, sleep=waits.append) == "here" and waits == [0, 1.0]
    with pytest.raises(OSError):
        fetch_with_retry(lambda: (_ for _ in ()).throw(OSError("other")), sleep=waits.append)


def test_follow_fills_as_files_arrive(cube, spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"item_id": "a", "ts": "2024-01-01T01:00:00", "lon": 148.0, "cloud_cover": 1.0}) + "\n")
    cube.ledger.record_search((-1e9, -1e9, 1e9, 1e9), D1, D2)
    follow(spark, str(folder), cube, "all", D1, D2, str(tmp_path / "cp")).awaitTermination(120)
    assert cube.ledger.cells().count() == 4
    (folder / "2.json").write_text(json.dumps({"item_id": "b", "ts": "2024-01-05T01:00:00", "lon": 148.0, "cloud_cover": None}) + "\n")
    follow(spark, str(folder), cube, "all", D1, D2, str(tmp_path / "cp")).awaitTermination(120)
    assert cube.ledger.cells().count() == 8
