import pytest
from pyspark.sql import functions as F

from pixelloom.functions.indices import REGISTRY, add_indices, register_index

BANDS = ["nbart_nir_1", "nbart_red", "nbart_green", "nbart_blue", "nbart_swir_2", "nbart_swir_3"]
DN = (6000, 2000, 1500, 1000, 3000, 1000)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"{b} short" for b in BANDS))


@pytest.mark.parametrize(("name", "value"), [("NDVI", 0.5), ("NDTI", 0.5), ("CAI", -0.4), ("CFI", 0.2), ("NIRv", 0.3)])
def test_known_values(spark, name, value):
    got = add_indices(table(spark, DN), [name])
    assert got.schema[name].dataType.simpleString() == "float"
    assert got.first()[name] == pytest.approx(value, abs=1e-6)


def test_missing_values(spark):
    zero, none, same = (6000, 0, *DN[2:]), (6000, -999, *DN[2:]), (-2000, 2000, *DN[2:])
    assert [r.NDVI for r in add_indices(table(spark, zero, none, same), ["NDVI"]).collect()] == [None, None, None]


def test_names(spark):
    df = table(spark, DN)
    with pytest.raises(ValueError, match="NDWI"):
        add_indices(df, ["NDVI", "NDWI"])
    assert add_indices(df, []).columns == df.columns
    register_index("TEST", ("nbart_red",), lambda red: red * F.lit(2).cast("float"))
    try:
        assert add_indices(df, ["TEST"]).first().TEST == pytest.approx(0.4)
    finally:
        del REGISTRY["TEST"]
