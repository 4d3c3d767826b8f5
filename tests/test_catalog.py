import duckdb
import pytest

import __spark_entry__ as entry
from pixelloom.plans import catalog

SF = "/root/testdata/sf0.001"
#: One of each kind; tools/verify.py compares them all.
SOME = ["indices_all", "clean_full", "screen_semi", "grid_window", "scenes_by_day", "ledger_upsert", "search_covered", "get_clean_indices", "ring_profile", "gate_sweep", "best_frame"]


def test_registry():
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    mine = sorted(str([r[c] for c in cols]) for r in got.collect())
    assert mine == sorted(str([r[want.columns.index(c)] for c in cols]) for r in want.fetchall())
    assert mine


def test_plans_prune_columns(spark):
    """An index of two bands reads what those bands are made of, and filters reach the scan."""
    plan = catalog.QUERIES["index_ndvi"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_comment" not in plan
    plan = catalog.QUERIES["scenes_for_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["solar_day", "med", "p25", "p75"]
    got.collect()


@pytest.mark.parametrize("name", ["dilate_kernel", "far_field", "dilate_offsets", "profile_quantiles", "ring_candidates", "ring_distance", "ring_profile", "ring_steps"])
def test_pixels_are_not_sent_to_the_driver(spark, name):
    """A grid has far more rows than the days it is made of, whose size is all that Spark once knew of it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        got = catalog.QUERIES[name](spark, SF)
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "row#" in line]


def test_candidate_frames_are_broadcast(spark):
    """Else all pixels were dealt out by their few days before it was known that the frames to keep are few."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["ring_candidates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)
