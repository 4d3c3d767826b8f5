"""Best-fit packing into sequences of several permitted lengths.

Documents count their token ids and an end id; what is longer than the longest permitted length is cut
into pieces of that length and a rest. Pieces are dealt evenly to groups of about GROUP pieces (only
ids and lengths move, not texts), and each group is packed on its own:

* pieces go by falling length, each into the open bin with the least room that still takes it;
* if none takes it, a bin is opened. All permitted lengths compete at every opening: each is filled on trial with the
  piece and then, longest first, with pieces that are still to come, and the length whose shrunk trial bin costs least
  for each of its tokens is opened (the shortest of equals);
* at last each bin shrinks to the shortest permitted length that holds its contents.

cost(L) = L + overhead + L * L / quadratic: the tokens, a fixed price of a sequence and attention.

Null and empty texts are one end id long. Repeated rows are packed each on its own; null doc_ids stay
null. Empty tables give empty results. Other columns are never read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .tokens import encoder, forget, slices

LENGTHS = (512, 1024, 2048, 4096)
GROUP = 50_000
PIECES = "doc_id long, piece int, start long, length int, bin_id long, capacity int, offset int"


def cost(length: int, overhead: int = 64, quadratic: int = 16_384) -> float:
    """Price of a sequence of that length."""
    return length + overhead + length * length / quadratic


def _trial(n: int, size: int, left: list[int], have: int) -> int:
    """What a bin of that size would hold: a piece of length n, then the longest of the pieces left that fit."""
    room, cap = size - n, size - n
    while cap > 0 and (fits := have & ((1 << (cap + 1)) - 1)):
        m = fits.bit_length() - 1
        room -= m * min(left[m], room // m)
        cap = min(room, m - 1)
    return size - room


def pack(lengths: np.ndarray, permitted: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset there, length of each bin). No piece may exceed the longest permitted length."""
    sizes = sorted(permitted)
    prices = {size: cost(size) for size in sizes}
    shrink = lambda used: next(s for s in sizes if s >= used)
    order = np.argsort(-lengths, kind="stable").tolist()
    values = lengths.tolist()
    left = np.bincount(lengths.astype(np.int64), minlength=sizes[-1] + 1).tolist()  # pieces to come, by length
    have = sum(1 << n for n, times in enumerate(left) if times)
    rooms: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # bins by their room
    some = 0  # bit r is set where rooms[r] has a bin
    bins, offsets, used = [0] * len(values), [0] * len(values), []
    for k in order:
        n = values[k]
        left[n] -= 1
        if not left[n]:
            have &= ~(1 << n)
        above = some >> n
        if above:  # the bin with the least room; of equals the one that came to it last
            room = (above & -above).bit_length() - 1 + n
            b = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            trials = ((s, _trial(n, s, left, have)) for s in sizes if s >= n)
            room = min((prices[shrink(held)] / held, s) for s, held in trials)[1]
            b = len(used)
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += n
        room -= n
        if room:
            rooms[room].append(b)
            some |= 1 << room
    return bins, offsets, [shrink(u) for u in used]


def _count(batches, tokenizer: str):
    enc = encoder(tokenizer)
    for whole in batches:
        for batch in slices(whole, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(enc.count(batch.column(1)) + 1, pa.int64())], ["doc_id", "n_tokens"])
    del enc
    forget()


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id and n_tokens (with an end id) of every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(partial(_count, tokenizer=tokenizer), "doc_id long, n_tokens long")


def _pack_group(batches, permitted: tuple[int, ...], most: int):
    """Packs a task's documents, so many pieces at a time."""
    from pyspark import TaskContext

    part, seq, longest = TaskContext.get().partitionId(), 0, max(permitted)
    docs: list = []
    counts: list[np.ndarray] = []
    held = 0

    def close():
        nonlocal docs, counts, held, seq
        n = np.concatenate(counts)
        parts = -(-n // longest)
        owner = np.repeat(np.arange(len(n)), parts)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = piece * longest
        length = np.minimum(n[owner] - start, longest)
        bins, offsets, sizes = pack(length, permitted)
        first = (part << 40) + (seq << 28)
        doc = pa.array(docs, pa.int64()).take(pa.array(owner))
        capacity = np.array(sizes, np.int32)[bins]
        out = [doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(np.array(bins, np.int64) + first), pa.array(capacity), pa.array(np.array(offsets, np.int32))]
        docs, counts, held, seq = [], [], 0, seq + 1
        return pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "bin_id", "capacity", "offset"])

    for batch in batches:
        n = batch.column(1).to_numpy(zero_copy_only=False)
        docs += batch.column(0).to_pylist()
        counts.append(n)
        held += int((-(-n // longest)).sum())
        if held >= most:
            yield close()
    if held:
        yield close()


def pack_documents(counts: DataFrame, permitted: tuple[int, ...] = LENGTHS, group: int = GROUP) -> DataFrame:
    """Packs counts(doc_id, n_tokens); a row for each piece: doc_id, piece, start (in the document),
    length, bin_id, capacity (of the bin), offset (in the bin)."""
    counts = materialise(counts.select("doc_id", "n_tokens"), "token_counts")
    pieces = counts.agg(F.sum(F.ceil(F.col("n_tokens") / max(permitted)))).first()[0] or 0
    dealt = counts.repartition(max(1, -(-pieces // group)))
    return dealt.mapInArrow(partial(_pack_group, permitted=tuple(permitted), most=4 * group), PIECES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(token_counts(table(spark, sf_dir, "documents")))
