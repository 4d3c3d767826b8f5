"""Benchmark decontamination over a positional inverted index of the training texts.

The index is a Parquet dataset of segments, each a self-contained inverted index of some documents:
sorted term hashes, and for each term the ascending positions where it occurs, one document after the
other with a gap between them. Segments are built where the texts are read, without a shuffle.

A phrase is found in a segment by taking its rarest term's positions, shifted by the term's offset in
the phrase, and intersecting them with the shifted lists of the others, rarest first. Proximity search
takes the places near the rarest term's positions and slides over the merged lists. The test phrases
go to all segments in blocks of items of at most BLOCK_TERMS words, one job a block, so what is broadcast is bounded.

Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII. Null and empty texts
have none; a null item_id is reported as an empty string; items of no words never match; repeated rows are
judged each on its own, whatever their doc_id. Texts of any length are indexed whole; a segment ends with the text
that fills it, and positions are 32-bit, so a text may hold four thousand million words. Empty tables give empty or clean results. Other columns
are never read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, materialise, scratch, table, without
from .words import ALNUM, word_hashes

WINDOW = 13
#: Words in a segment at least, but for a task's last one.
SEGMENT_WORDS = 1 << 20
#: Words of test items that are broadcast together at most, but for a single item.
BLOCK_TERMS = 200_000
SEGMENTS = "part int, seq int, doc_ids array<long>, n_words array<long>, terms binary, offsets binary, positions binary"
SPANS = "part int, seq int, doc_no int, doc_id long, n_words long, items array<string>, starts array<long>, ends array<long>"


def _index(batches):
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    ids, counts, hashes, held = [], [], [], 0

    def close():
        nonlocal seq, ids, counts, hashes, held
        words, lengths = np.concatenate([np.empty(0, np.uint64), *hashes]), np.concatenate(counts)
        doc_of = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(words, kind="stable")
        terms, first = np.unique(words[order], return_index=True)
        positions = (np.arange(len(words)) + doc_of)[order]
        row = [[part], [seq], [ids], [lengths.tolist()], [terms.astype("<u8").tobytes()], [np.append(first, len(words)).astype("<u4").tobytes()], [positions.astype("<u4").tobytes()]]
        seq, ids, counts, hashes, held = seq + 1, [], [], [], 0
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "seq", "doc_ids", "n_words", "terms", "offsets", "positions"])

    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            got, lengths = word_hashes(batches_of(batch, "text"), ALNUM)
            ids += batch.column(0).to_pylist()
            counts.append(lengths)
            hashes.append(got)
            held += len(got)
            if held >= SEGMENT_WORDS:
                yield close()
    if ids:
        yield close()


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Writes the segments of docs(doc_id, text) to path and returns them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows.mapInArrow(_index, SEGMENTS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(SEGMENTS).parquet(path)


class Segment:
    def __init__(self, doc_ids, n_words, terms, offsets, positions):
        self.doc_ids, self.n_words = doc_ids, np.array(n_words, np.int64)
        self.terms, self.offsets = np.frombuffer(terms, "<u8"), np.frombuffer(offsets, "<u4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<u4")
        self.starts = np.cumsum(self.n_words) - self.n_words + np.arange(len(self.n_words))

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of each term, its count of positions; 0 if it doesn't occur)."""
        if not len(self.terms):
            return np.zeros(hashes.shape, np.int64), np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return at, np.where(self.terms[at] == hashes, self.offsets[at + 1] - self.offsets[at], 0)

    def postings(self, at: int) -> np.ndarray:
        return self.positions[self.offsets[at] : self.offsets[at + 1]].astype(np.int64)

    def phrase(self, at: np.ndarray, df: np.ndarray) -> np.ndarray:
        """Positions where the terms follow one another, from the rarest one's list."""
        order = np.argsort(df, kind="stable")
        found = self.postings(at[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            there = self.postings(at[k]) - k
            spot = np.minimum(np.searchsorted(there, found), len(there) - 1)
            found = found[there[spot] == found]
        return found

    def near(self, hashes: np.ndarray, within: int) -> list[tuple[int, int]]:
        """Shortest spans (first, last position) of at most `within` words that hold all the terms."""
        at, df = self.lookup(np.unique(hashes))
        if not len(at) or (df == 0).any():
            return []
        rare = self.postings(at[np.argmin(df)])
        merged = []
        for k in range(len(at)):
            p = self.postings(at[k])
            spot = np.searchsorted(rare, p)
            left = np.where(spot > 0, p - rare[np.maximum(spot - 1, 0)], within)
            right = np.where(spot < len(rare), rare[np.minimum(spot, len(rare) - 1)] - p, within)
            merged += [(int(x), k) for x in p[np.minimum(left, right) < within]]
        merged.sort()
        last, spans = {}, []
        for x, k in merged:
            last[k] = x
            if len(last) == len(at) and x - (low := min(last.values())) < within and self.doc_of(low) == self.doc_of(x):
                if spans and spans[-1][0] == low:
                    continue
                spans.append((low, x))
        return spans

    def doc_of(self, position):
        return np.searchsorted(self.starts, position, side="right") - 1


def _segments(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            part, seq, *rest = (batch.column(j)[k].as_py() for j in range(7))
            yield part, seq, Segment(*rest)


def _rows(part, seq, segment, found: dict[int, tuple[set, list]], every: bool):
    docs = range(len(segment.doc_ids)) if every else sorted(found)
    cols = [[part] * len(docs), [seq] * len(docs), list(docs), [segment.doc_ids[d] for d in docs], [int(segment.n_words[d]) for d in docs], [], [], []]
    for d in docs:
        items, spans = found.get(d, ((), ()))
        cols[5].append(sorted(items))
        cols[6].append([a for a, _ in spans])
        cols[7].append([b for _, b in spans])
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "seq", "doc_no", "doc_id", "n_words", "items", "starts", "ends"])


def _merge(spans: np.ndarray) -> list[tuple[int, int]]:
    """Sorted disjoint half-open spans."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _find_phrases(batches, block, window: int, every: bool):
    phrases = _windows(block.value, window)
    for part, seq, segment in _segments(batches):
        items_of: dict[int, set] = {}
        spans_of: dict[int, list] = {}
        for size, (grams, items) in phrases.items():
            at, df = segment.lookup(grams)
            for w in np.flatnonzero((df > 0).all(axis=1)):
                starts = segment.phrase(at[w], df[w])
                if not len(starts):
                    continue
                docs = segment.doc_of(starts)
                for d in np.unique(docs).tolist():
                    items_of.setdefault(d, set()).update(items[w])
                    local = starts[docs == d] - segment.starts[d]
                    spans_of.setdefault(d, []).append(np.stack([local, local + size], axis=1))
        found = {d: (items_of[d], _merge(np.concatenate(v))) for d, v in spans_of.items()}
        yield _rows(part, seq, segment, found, every)


def _find_near(batches, block, within: int, every: bool):
    for part, seq, segment in _segments(batches):
        items_of: dict[int, set] = {}
        spans_of: dict[int, list] = {}
        for item, hashes in block.value:
            for a, b in segment.near(hashes, within):
                d = int(segment.doc_of(a))
                items_of.setdefault(d, set()).add(item)
                spans_of.setdefault(d, []).append((a - segment.starts[d], b + 1 - segment.starts[d]))
        found = {d: (items_of[d], _merge(np.array(v))) for d, v in spans_of.items()}
        yield _rows(part, seq, segment, found, every)


def _item_blocks(tests: DataFrame):
    """Lists of (item id as a string, word hashes), of at most BLOCK_TERMS words each."""
    rows = tests.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        words = word_hashes([r["text"].encode()], ALNUM)[0]
        if block and size + len(words) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        if len(words):
            block.append((r["item"], words))
            size += len(words)
    yield block


def _windows(block: list, window: int) -> dict[int, tuple[np.ndarray, list]]:
    """Length -> (distinct phrases of that length as rows of hashes, the item ids of each)."""
    by: dict[int, dict[bytes, set]] = {}
    for item, words in block:
        size = min(window, len(words))
        grams = np.lib.stride_tricks.sliding_window_view(words, size)
        for g in grams:
            by.setdefault(size, {}).setdefault(g.tobytes(), set()).add(item)
    return {size: (np.frombuffer(b"".join(d), np.uint64).reshape(-1, size), list(d.values())) for size, d in by.items()}


def _blockwise(segments: DataFrame, tests: DataFrame, search) -> DataFrame:
    """Runs search(broadcast, every) over all segments for each block of tests and joins the findings of each document.

    With more than one block, each is a job of its own whose broadcast is given back before the next."""
    context = segments.sparkSession.sparkContext
    blocks = _item_blocks(tests)
    block, following, found = next(blocks), next(blocks, None), None
    if following is None:
        return segments.mapInArrow(search(context.broadcast(block), True), SPANS)
    while block is not None:
        sent = context.broadcast(block)
        rows = materialise(segments.mapInArrow(search(sent, found is None), SPANS), "hits")
        sent.unpersist()
        found = rows if found is None else found.unionByName(rows)
        block, following = following, next(blocks, None)
    return found.groupBy("part", "seq", "doc_no").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("ends")).alias("ends"),
    )


def find_phrases(segments: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document with the items that share a window of words with it and the spans of words hit:
    part, seq, doc_no, doc_id, n_words, items, starts, ends (spans half-open, in words; those of
    different blocks of tests may overlap)."""
    return _blockwise(segments, tests, lambda block, every: partial(_find_phrases, block=block, window=window, every=every))


def find_near(segments: DataFrame, tests: DataFrame, within: int) -> DataFrame:
    """As find_phrases, for documents that hold all words of an item, in any order, within so many words."""
    return _blockwise(segments, tests, lambda block, every: partial(_find_near, block=block, within=within, every=every))


def _verdicts(batches):
    for batch in batches:
        docs, words, items, starts, ends = (batch.column(k).to_pylist() for k in range(5))
        hit = [sum(b - a for a, b in _merge(np.array(list(zip(s, e, strict=True))))) if s else 0 for s, e in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(docs, pa.int64()),
                pa.array(words, pa.int64()),
                pa.array(hit, pa.int64()),
                pa.array([len(i) for i in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]),
                pa.array([h > 0 and 20 * h >= n for h, n in zip(hit, words, strict=True)]),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    spark = docs.sparkSession
    segments = build_index(docs, scratch(spark, "postings"))
    found = find_phrases(segments, tests, window).select("doc_id", "n_words", "items", "starts", "ends")
    return found.mapInArrow(_verdicts, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, in all their columns, that hold no window of any test, however small its share of the text.

    Rows are found again by a 64-bit hash of the text: what is judged is the text alone."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    segments = build_index(docs.select(key.alias("doc_id"), "text"), scratch(docs.sparkSession, "postings"))
    return without(docs, find_phrases(segments, tests, window).filter("size(starts) > 0").select("doc_id"), [key])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark
), bs AS (
  SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bs
), ds AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw)
), hits AS (
  SELECT DISTINCT doc_id, i, ds.k AS k, item_id FROM ds JOIN bw ON ds.k = bw.k AND array_to_string(w[i:i + ds.k - 1], ' ') = g
), places AS (
  SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits
), hw AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM places GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""
