"""Shared pieces: the scratch folder, table reading, ASCII lower-casing and word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared checkpoint folder that the session names.

    Only a local session that names none (tests, a laptop) gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pixelloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys of rows to drop that are broadcast at most; more are dropped by a sort-merge join.
FEW_KEYS = 500_000


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not among the taken ones (case aside)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def without(docs: DataFrame, dropped: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows of docs, in all their columns, whose keys are not among the rows of dropped (in the order of keys).

    Texts are shuffled only if dropped has more than FEW_KEYS distinct rows, as counted."""
    gone = materialise(dropped.toDF(*[f"k{i}" for i in range(len(keys))]).distinct(), "dropped")
    few = gone.count() <= FEW_KEYS
    return narrowed(docs, gone, few, keys, "left_anti")


def narrowed(docs: DataFrame, wanted: DataFrame, few: bool, keys: list[Column], how: str) -> DataFrame:
    """docs joined (left_anti, left_semi) with wanted, whose columns are the keys in order; broadcast if few."""
    names = [fresh(f"key{i}", docs.columns) for i in range(len(keys))]
    rows = docs.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    wanted = wanted.toDF(*names)
    return rows.join(F.broadcast(wanted) if few else wanted.hint("merge"), names, how).select(*[F.col(f"`{c}`") for c in docs.columns])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of one byte a character take the faster built-in way."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def batches_of(batch, column: str):
    """The values of an Arrow column as UTF-8 bytes, without copying through str; None for null."""
    import pyarrow as pa

    return batch.column(column).cast(pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary()).to_pylist()


def release() -> None:
    """Gives freed memory of this Python worker back to the system, for workers outlive their tasks."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
