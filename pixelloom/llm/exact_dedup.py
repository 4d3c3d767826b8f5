"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch of documents is reduced to one row per
digest, set against the index by a sort-merge anti-join, and what is new is appended. Only DataFrame
operations run here.

Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts in
the batch that brings a digest in, the largest doc_id stays; null doc_ids lose against any other, and
if all are null keep_id is null. Rows that repeat both doc_id and text are copies of one document:
one of them stays. Texts of any length are hashed whole. Empty tables give empty results. Other columns are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW_KEYS, ascii_lower, materialise, narrowed, without

#: A digest with at least this share of all rows is joined by broadcast: there are at most as many.
HOT_SHARE = 512


class DigestIndex:
    """Digests seen so far: (digest, keep_id, group_size), bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 32):
        self.spark, self.name, self.buckets = spark, name, buckets
        if spark.catalog.tableExists(f"{name}_compact"):  # a compaction was cut short
            done = not spark.catalog.tableExists(name)
            spark.sql(f"ALTER TABLE {name}_compact RENAME TO {name}" if done else f"DROP TABLE {name}_compact")
        if not spark.catalog.tableExists(name):
            self._append(spark.createDataFrame([], "digest string, keep_id long, group_size long"))

    def compact(self) -> None:
        """Rewrites the table with one sorted file a bucket, to be called after many batches: each adds a file a bucket,
        and joins must sort a bucket that has more than one. The old table goes only when the new one is whole."""
        self._append(self.table(), f"{self.name}_compact")
        self.spark.sql(f"DROP TABLE {self.name}")
        self.spark.sql(f"ALTER TABLE {self.name}_compact RENAME TO {self.name}")

    def _append(self, df: DataFrame, name: str | None = None) -> None:
        (
            df.select("digest", "keep_id", "group_size")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(name or self.name)
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Appends what is new in docs and returns a row for each row of docs:
        doc_id, keep_id, group_size, kept, text_sha256. Documents whose digest an earlier
        batch brought in are not kept and carry that batch's keep_id and size."""
        text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"))
        rows = materialise(rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "digests")
        # written before the anti-join, which Catalyst would else push below the aggregate, to the unreduced rows
        groups = materialise(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
        known = self.table().select("digest")
        fresh = materialise(groups.join(known.hint("merge"), "digest", "left_anti"), "fresh")
        self._append(fresh)
        return self._judged(rows, fresh)

    def _judged(self, rows: DataFrame, fresh: DataFrame) -> DataFrame:
        found = self.table().join(fresh.select("digest", F.lit(True).alias("is_new")).hint("merge"), "digest", "left")
        total = rows.agg(F.sum("copies")).first()[0] or 0
        # at most HOT_SHARE digests can hold a HOT_SHARE-th of the rows each
        hot = rows.groupBy("digest").agg(F.sum("copies").alias("n")).filter(F.col("n") * HOT_SHARE >= max(total, HOT_SHARE)).select("digest")
        hot_found = F.broadcast(materialise(found.join(F.broadcast(hot), "digest", "left_semi"), "hot"))
        cold = rows.join(hot_found.select("digest"), "digest", "left_anti").join(found.hint("merge"), "digest")
        both = cold.unionByName(rows.join(hot_found, "digest"))
        return both.select(
            "doc_id",
            "keep_id",
            "group_size",
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
            F.coalesce(F.col("is_new"), F.lit(False)).alias("is_new"),
            F.col("digest").alias("text_sha256"),
        ).select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )


def exact_dedup(docs: DataFrame, index: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judges docs against the named index, or against a new one that is dropped again."""
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = index or f"digests_{uuid.uuid4().hex}"
    judged = DigestIndex(spark, name, buckets).add(docs, id_col, text_col)
    if index is None:
        judged = materialise(judged, "judged")
        spark.sql(f"DROP TABLE {name}")
    return judged


def keep_first_rows(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, in all their columns, that stay: one for each kept (doc_id, digest).

    Of rows that repeat both, the one whose columns come first as JSON stays. Only keys are joined, and texts are
    shuffled only if more than FEW_KEYS keys go."""
    digest = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    own = F.col(id_col).cast("long")
    keys = [F.coalesce(own, F.lit(0).cast("long")), own.isNull(), digest]
    each = judged.groupBy(F.coalesce("doc_id", F.lit(0).cast("long")).alias("k0"), F.col("doc_id").isNull().alias("k1"), F.col("text_sha256").alias("k2"))
    each = materialise(each.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "keys")
    rows = without(docs, each.filter("NOT kept").select("k0", "k1", "k2"), keys)
    twice = each.filter("kept AND n > 1").select("k0", "k1", "k2")
    many = twice.count()
    if not many:
        return rows
    once = narrowed(rows, twice, many <= FEW_KEYS, keys, "left_anti")
    names = docs.columns
    every = F.struct(*[F.col(f"`{c}`") for c in names])
    again = narrowed(rows, twice, many <= FEW_KEYS, keys, "left_semi").groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    first = again.agg(F.min_by(every, F.to_json(every)).alias("row")).select("row.*").toDF(*names)
    return once.unionByName(first)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM n
"""
