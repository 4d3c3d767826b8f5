"""Removal of repeated runs of lines, by winnowing over line hashes.

A line's hash covers its words, lower-cased (A-Z), so white space does not count; blank lines belong to
no run and are passed over. A window is the shortest block of lines from a line on (or up to a line) that
holds at least MIN_WORDS words. Two equal runs of so many words hold equal windows, which is the guarantee.

* Winnowing. Of each window only the line with the least hash (the last of equals) is selected. Neighbouring windows
  mostly select the same line, so a text has few fingerprints: hash and position. Equal windows select equal lines.
* Join of positions. Fingerprints that occur at one place only are dropped by an aggregation that is combined before its
  shuffle. The texts with positions that are left are read again, and only the windows that selected one of these positions
  are compared, by a hash of their lines; each is joined with the first window that equals it.
* Extension. Windows start at, and end at, every line of a match, so those around a fingerprint that equal
  windows of an earlier place carry the match on both ways, up to its first and last line. One row a window is joined,
  with one source, so no pairs of copies are made, however many there are.
* Deletion. Earlier is by (doc_id, line); lines of windows that have an earlier equal are deleted, so the first copy of a
  run stays.

Null and empty texts have no lines. Null doc_ids come last in order. Rows of equal doc_id are ordered by
a hash of their text; rows that repeat both are one document: their lines are marked alike, and against
each other they are not earlier. Texts of any length are read whole. Empty tables give empty results. Other columns are
never read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, materialise, table
from .words import SPACED, mix, word_hashes

MIN_WORDS = 50
#: Texts (windows) that a broadcast may name; more are found by sort-merge joins.
FEW = 200_000


def line_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, hash, words) of the lines that hold words."""
    words, counts = word_hashes(lines, SPACED)
    index = np.flatnonzero(counts)
    sizes = counts[index]
    if not len(index):
        return index, np.empty(0, np.uint64), sizes
    ends = np.cumsum(sizes)
    place = np.arange(len(words)) - np.repeat(ends - sizes, sizes)
    with np.errstate(over="ignore"):
        salted = mix(words + mix(place.astype(np.uint64)))  # so that the order of words counts
        hashes = mix(np.add.reduceat(salted, ends - sizes) + sizes.astype(np.uint64))
    return index, hashes, sizes


def windows(doc: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the distinct windows from each line on and up to each line, within a document."""
    ends = np.cumsum(sizes)
    starts, n = ends - sizes, len(sizes)
    line = np.arange(n)
    last = np.searchsorted(ends, starts + least)
    first = np.searchsorted(starts, ends - least, side="right") - 1
    ahead = (last < n) & (doc[np.minimum(last, n - 1)] == doc) if n else np.empty(0, bool)
    behind = (first >= 0) & (doc[np.maximum(first, 0)] == doc) if n else np.empty(0, bool)
    both = np.unique(np.concatenate([line[ahead] << 32 | last[ahead], first[behind] << 32 | line[behind]]).astype(np.int64))
    return both >> 32, both & 0xFFFFFFFF


def _content(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the lines a to b of each gram."""
    out = np.zeros(len(a), np.uint64)
    with np.errstate(over="ignore"):
        live = np.arange(len(a))
        at = a.copy()
        while len(live):
            out[live] = mix(out[live] * np.uint64(0xC4CEB9FE1A85EC53) + hashes[at[live]])
            at[live] += 1
            live = live[at[live] <= b[live]]
    return out


def _selected(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The line that each window a to b selects: its least hash, the last of equals."""
    out, live, at = a.copy(), np.arange(len(a)), a.copy()
    while len(live):
        out[live] = np.where(hashes[at[live]] <= hashes[out[live]], at[live], out[live])
        at[live] += 1
        live = live[at[live] <= b[live]]
    return out


def _split(texts: list[bytes], least: int):
    """(text, number in it, hash) of each line with words, and the windows: first, last, selected line (places among these)."""
    split = [t.split(b"\n") for t in texts]
    counts = np.array([len(x) for x in split], np.int64)
    index, hashes, sizes = line_hashes([line for x in split for line in x])
    doc = np.repeat(np.arange(len(split)), counts)[index]
    a, b = windows(doc, sizes, least)
    return doc, index - (np.cumsum(counts) - counts)[doc], hashes, a, b, _selected(hashes, a, b)


def _fingerprints(batches, least: int):
    """A row for each line that some window selects."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            doc, number, hashes, _, _, selected = _split(batches_of(batch, "text"), least)
            lines = np.unique(selected)
            place = pa.array(doc[lines])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(number[lines].astype(np.int32)), pa.array(hashes[lines].view(np.int64))], ["doc_id", "tkey", "line", "mark"])


def _windows(batches, least: int):
    """Texts with positions of shared fingerprints -> the windows that selected these, with a hash of their lines."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            doc, number, hashes, a, b, selected = _split(batches_of(batch, "text"), least)
            asked = batch.column(3)
            offsets = asked.offsets.to_numpy()
            wanted = np.repeat(np.arange(batch.num_rows), np.diff(offsets)) << 32 | asked.flatten().to_numpy().astype(np.int64)
            keep = np.isin(doc[selected] << 32 | number[selected], wanted)
            a, b = a[keep], b[keep]
            place = pa.array(doc[a])
            cols = [number[a].astype(np.int32), number[b].astype(np.int32), _content(hashes, a, b).view(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), *map(pa.array, cols)], ["doc_id", "tkey", "first", "last", "content"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def _beside(rows: DataFrame, each: DataFrame, column: str, how: str) -> DataFrame:
    """The texts next to what `each` holds for them: doc_id, tkey, text and the column."""
    each = materialise(each.select(F.col("doc_id").alias("own_doc"), F.col("tkey").alias("own_key"), column), column)
    few = each.agg(F.sum(F.size(column))).first()[0] or 0
    same = rows["doc_id"].eqNullSafe(each["own_doc"]) & (rows["tkey"] == each["own_key"])
    return rows.join(F.broadcast(each) if few <= 5 * FEW else each.hint("merge"), same, how).select("doc_id", "tkey", "text", column)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Blocks of lines that have an earlier equal: doc_id, tkey (hash of the text), first, last, and the
    document (src_id, src_line) where the content stands first."""
    rows = _keyed(docs)
    marks = materialise(rows.mapInArrow(partial(_fingerprints, least=min_words), "doc_id long, tkey long, line int, mark long"), "fingerprints")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey", "line")
    shared = marks.groupBy("mark").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).filter("lo != hi").select("mark")
    asked = marks.join(shared.hint("merge"), "mark", "left_semi").groupBy("doc_id", "tkey").agg(F.collect_set("line").alias("lines"))
    found = _beside(rows, asked, "lines", "inner").mapInArrow(partial(_windows, least=min_words), "doc_id long, tkey long, first int, last int, content long")
    found = materialise(found.distinct(), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey", "first", "last")
    earliest = materialise(found.groupBy("content").agg(F.min(place).alias("src"), F.max(place).alias("end")).filter("src != end").select("content", "src"), "earliest")
    earliest = F.broadcast(earliest) if earliest.count() <= FEW else earliest.hint("merge")
    again = found.join(earliest, "content").filter(~place.eqNullSafe(F.col("src")))
    # a match that overlaps its own first copy takes only what lies behind that
    same = F.col("doc_id").eqNullSafe(F.col("src.doc_id")) & (F.col("tkey") == F.col("src.tkey"))
    first = F.when(same, F.greatest("first", F.col("src.last") + 1)).otherwise(F.col("first"))
    return again.select("doc_id", "tkey", first.alias("first"), "last", F.col("src.doc_id").alias("src_id"), F.col("src.first").alias("src_line")).distinct()


def _cut(batches):
    """Texts with their repeated blocks -> the text that is left, and what was taken out."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        for doc, tkey, raw, blocks in zip(*(batch.column(k).to_pylist() for k in range(2)), batches_of(batch, "text"), batch.column(3).to_pylist(), strict=True):
            lines = raw.split(b"\n")
            gone: set[int] = set()
            for block in blocks or ():
                gone.update(range(block["first"], block["last"] + 1))
            kept = [x for i, x in enumerate(lines) if i not in gone]
            runs: list[list[int]] = []
            for i in sorted(gone):
                if runs and runs[-1][1] == i - 1:
                    runs[-1][1] = i
                else:
                    runs.append([i, i])
            words = sum(len(lines[i].split()) for i in gone)
            for c, v in zip(out, (doc, tkey, len(lines) if raw else 0, len(gone), words, [{"first": a, "last": b} for a, b in runs], b"\n".join(kept).decode()), strict=True):
                c.append(v)
        run = pa.struct([("first", pa.int32()), ("last", pa.int32())])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(run), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "tkey", "n_lines", "n_removed", "words_removed", "runs", "text"])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, tkey, n_lines, n_removed, words_removed, the
    runs of lines that were deleted, and the text that is left."""
    blocks = repeated_lines(docs, min_words)
    each = blocks.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("first", "last")).alias("blocks"))
    schema = "doc_id long, tkey long, n_lines long, n_removed long, words_removed long, runs array<struct<first int, last int>>, text string"
    return _beside(_keyed(docs), each, "blocks", "left").mapInArrow(_cut, schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", "words_removed", F.expr("transform(runs, r -> concat(r.first, '-', r.last))").alias("runs"), F.sha2("text", 256).alias("kept_sha256"))
