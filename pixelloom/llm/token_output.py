"""Token ids as Simple-8b segments in ascending doc_id order, and their reader.

Documents are dealt by ranges of doc_id and sorted; each task encodes its texts and writes segments of
whole documents (simple8b.pack_segment) as rows of a Parquet dataset, so that Spark's committer covers
lost executors and any store that Spark reaches will do. part and seq give the order of segments;
start_in_part counts the ids of the same part before a segment.

A null text has no ids but the end id. Null doc_ids come first. Rows of equal doc_id are ordered by text.
An empty table gives no segments. Other columns are never read.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import scratch, table
from .tokens import encoder, forget, slices

#: Ids in a segment at least, but for a part's last one.
SEGMENT_IDS = 1 << 21
SEGMENTS = "part int, seq int, start_in_part long, n_docs long, n_ids long, payload binary"
ROWS = "doc_id long, start_in_part long, n_tokens long, ids_crc32 long"


def _write(batches, tokenizer: str, end_id: int):
    from pyspark import TaskContext

    part, seq, before = TaskContext.get().partitionId(), 0, 0
    enc = encoder(tokenizer)
    docs, lengths, coded, held = [], [], [], 0

    def close():
        nonlocal docs, lengths, coded, held, seq, before
        payload = simple8b.pack_segment(docs, lengths, np.concatenate(coded))
        row = pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before]), pa.array([len(docs)]), pa.array([held]), pa.array([payload], pa.binary())],
            ["part", "seq", "start_in_part", "n_docs", "n_ids", "payload"],
        )
        seq, before = seq + 1, before + held
        docs, lengths, coded, held = [], [], [], 0
        return row

    for whole in batches:
        for batch in slices(whole, 1):
            number, ids = enc.encode(batch.column(1))
            ends = np.cumsum(number)
            ids = np.insert(ids, ends, end_id)  # after the last id of each document
            ends += np.arange(1, len(ends) + 1)
            names, number, first, at = batch.column(0).to_pylist(), (number + 1).tolist(), 0, 0
            while first < len(names):  # a segment is closed by the document that fills it
                full = int(np.searchsorted(ends, at + SEGMENT_IDS - held))
                last = min(full + 1, len(names))
                docs += names[first:last]
                lengths += number[first:last]
                coded.append(ids[at : ends[last - 1]])
                held += int(ends[last - 1]) - at
                first, at = last, int(ends[last - 1])
                if held >= SEGMENT_IDS:
                    yield close()
    if docs:
        yield close()
    del enc
    forget()


def write_token_ids(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, parts: int | None = None) -> None:
    """Encodes docs(doc_id, text) and writes their segments to path."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(partial(_write, tokenizer=tokenizer, end_id=end_id), SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def _digest(batches):
    for batch in batches:
        for part, before, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            docs, lengths, ids = simple8b.unpack_segment(raw)
            little, ends = ids.astype("<u4"), np.cumsum(lengths)
            starts = ends - lengths
            sums = [zlib.crc32(little[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts + before), pa.array(lengths), pa.array(sums, pa.int64())],
                ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    segments = read_segments(spark, path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # a row for each part, so as many as the writer had partitions
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = segments.select("part", "start_in_part", "payload").mapInArrow(_digest, "part int, " + ROWS)
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token_ids")
    write_token_ids(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
