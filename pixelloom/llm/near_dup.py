"""Exact Jaccard similarity join of shingle sets, as a metric-space join with pivots.

1 - Jaccard is a metric. Documents of equal shingle sets are one node. Let r be the threshold as a distance.

* Pivots. A bounded net of documents, no two of them alike (at most PIVOTS, of PIVOT_SHINGLES shingles
  together), is broadcast as an inverted index, which measures every node against all of them.
* Voronoi regions. A node nearer than NEAR to some pivot belongs to the region of the nearest. Windows
  replicate nodes at boundaries, by the triangle inequality: a partner y of x that lives in the region of q
  has d(x, q) <= d(y, q) + r < NEAR + r, and d(x, q) <= d(y, q) + r <= d(y, p) + r <= d(x, p) + 2r, p being
  the pivot of x; x is a guest of all regions that fulfil both. Nodes far from all pivots (most documents
  share nothing with each other and are at distance 1 from nearly all) form one more region, around the
  empty set, whose nodes are guests elsewhere by the first bound.
* Within a region, nodes are held as their difference to the pivot. Moving all sets by the pivot leaves the
  differences between them as they are, so two nodes within r of each other, of which one is further than
  r from the pivot, must share elements of their differences. Each node enters the cells of so many of its
  rarest elements (in an order fixed for the region) that such a pair surely meets in one. Nodes within r of
  the pivot are linked through it, and pairs of such nodes are passed over.
* Recursion. Every cell elects one of its documents as pivot, and the cells that elect the same one are
  a region of the next level. Regions of at most REGION_ROWS nodes and REGION_SHINGLES shingles are joined by one
  task, as above: pivot, differences, cells, a window on the distances to the pivot, then exact
  measurement of what is left. Larger regions are parted again over many tasks, level after level. One that DEPTH levels
  have not parted is cut into blocks, of which every two meet.

So every pair of nodes in different components has been measured or is ruled out by a bound, and components
are exact. Rarity is judged by a table of 2**DF_BITS counters over all documents; it orders elements and
spreads cells of very common ones over tasks, and has no part in what is linked.

Words are runs of anything but ASCII white space, with A-Z lower-cased. Sets of shorter texts hold
their whole sequence as one shingle; null and empty texts link with nothing. Shingles are compared by
64-bit hashes. Rows that repeat a text are one node; rows of equal or null doc_id but different texts
are different nodes. Texts of any length are read whole. Empty tables give empty results. Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, materialise, release, table, without
from .components import components
from .words import SPACED, mix, spread, word_hashes

DF_BITS = 22
_SLICES = 16
#: Pivots of the first level, and their shingles, at most: the bound of what is broadcast.
PIVOTS = 512
PIVOT_SHINGLES = 1 << 20
#: Candidates for pivots that a task names, and the shingles of one at most.
_NAMED, _LARGEST = 16, PIVOT_SHINGLES // 16
#: Pivots are further apart than this, and a region reaches less far than NEAR.
APART, NEAR = 0.6, 0.5
#: A region that one task joins has at most so many nodes and shingles.
REGION_ROWS = 4096
REGION_SHINGLES = 1 << 22
#: All pairs of so few nodes are measured outright.
FEW = 6
DEPTH = 3
#: A cell is spread over tasks from so many documents beyond four times the mean counter on.
SALT_ROWS = 20_000
#: Nodes whose texts are found by a broadcast of their ids at most; more are found by a sort-merge join.
FEW_NODES = 200_000
#: Nodes with at least this share of all rows are joined by broadcast: there are at most as many.
HOT_SHARE = 512
#: Elements worked on at a time when a task joins a region.
CHUNK = 1 << 21


def shingle_sets(texts: list[bytes | None], k: int):
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts, SPACED)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        grams = np.zeros(len(words), np.uint64)
        for j in range(min(k, len(words))):
            grams[: len(words) - j] = grams[: len(words) - j] * np.uint64(0xFF51AFD7ED558CCD) + words[j:]
        grams = mix(grams)
        for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
            if n >= k:
                yield np.unique(grams[end - n : end - k + 1])
            elif n:
                whole = np.uint64(n)
                for w in words[end - n : end]:
                    whole = whole * np.uint64(0xC4CEB9FE1A85EC53) + w
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def _digest(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    import xxhash

    raw = xxhash.xxh3_128_digest(shingles.tobytes(), seed)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


_SIGNED = "doc_id long, pid long, tkey long, n int, node long, more long, part int, payload binary"


def _sign(batches, k: int, seed: int):
    """A row for each text; then the slices of this task's table of counters, and its candidates for pivots (part -1)."""
    mask, size = np.uint64((1 << DF_BITS) - 1), 1 << DF_BITS
    totals = np.zeros(size, np.uint32)
    names = ["doc_id", "pid", "tkey", "n", "node", "more", "part", "payload"]
    named: dict[int, np.ndarray] = {}

    def extra(nodes, sizes, parts, payloads):
        none = pa.nulls(len(parts), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()), none, pa.array(parts, pa.int32()), pa.array(payloads, pa.binary())], names)

    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            sets = list(shingle_sets(batches_of(batch, "text"), k))
            places, times = np.unique(np.concatenate(sets) & mask, return_counts=True)
            totals[places.astype(np.int64)] += times.astype(np.uint32)
            ids = [_digest(s, seed) for s in sets]
            m = len(sets)
            named.update((a, s) for (a, _), s in zip(ids, sets, strict=True) if 0 < len(s) <= _LARGEST)
            named = {a: named[a] for a in sorted(named)[:_NAMED]}  # digests are random, so this is a random choice
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(s) for s in sets], pa.int32()), pa.array([a for a, _ in ids], pa.int64()), pa.array([b for _, b in ids], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
    if totals.any():
        yield extra([None] * _SLICES, [None] * _SLICES, range(_SLICES), [zlib.compress(x.tobytes(), 1) for x in totals.reshape(_SLICES, -1)])
        yield extra(list(named), [len(s) for s in named.values()], [-1] * len(named), [s.tobytes() for s in named.values()])
    del totals
    release()


def _add_counts(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
            sums[part] = sums[part] + got if part in sums else got
    if sums:
        rows = [np.minimum(s, 2**32 - 1).astype(np.uint32).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(rows, pa.binary())], ["part", "payload"])


def _frequencies(signed: DataFrame) -> np.ndarray:
    """The table of counters over all documents: 2**DF_BITS numbers, whatever the corpus."""
    parts = signed.filter("part >= 0").select("part", "payload").repartition(_SLICES, "part").mapInArrow(_add_counts, "part int, payload binary")
    whole = np.zeros((_SLICES, (1 << DF_BITS) // _SLICES), np.uint32)
    for r in parts.collect():
        whole[r["part"]] = np.frombuffer(r["payload"], np.uint32)
    return whole.reshape(-1)


class Threshold:
    """A similarity of at least num / den, and what it says of sets and of their differences to a pivot."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.t, self.reach = num / den, 1 - num / den
        self.near = min(NEAR, self.t - 1e-6)  # so that windows end before distance 1, at which all strangers are
        self.c = (1 - self.t) / (1 + self.t)  # linked sets of sizes a and b differ in at most c * (a + b) elements

    def linked(self, a, b, shared):
        return self.den * shared >= self.num * (a + b - shared)

    def fits(self, a, b):
        """Sizes that alone do not rule a link out."""
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def plain(self, n: int) -> tuple[int, int]:
        """How many of a set's rarest shingles it offers to larger sets, and how many it seeks among smaller ones."""
        return n - -(-2 * self.num * n // (self.num + self.den)) + 1, n - -(-self.num * n // self.den) + 1

    def moved(self, n, d, near, p):
        """The same of the differences (of d elements) that sets of n shingles have to a pivot of p shingles.

        Sets within the threshold differ in at most `most` elements, so they share at least (d + other - most) / 2.
        One of them is not near the pivot, so its difference is at least `least` (and shares at least one)."""
        most = np.floor(n * (self.den - self.num) / self.num + 1e-9)
        least = np.where(near, np.floor(self.c * (self.t * n + p) - 1e-9), 0)
        offered = np.maximum(1, np.ceil((d + np.maximum(d, least) - most) / 2 - 1e-9))
        sought = np.maximum(1, np.ceil((d + np.maximum(d - most, least) - most) / 2 - 1e-9))
        return np.maximum(0, d - offered + 1).astype(np.int64), np.where(near & (least > d), 0, np.maximum(0, d - sought + 1)).astype(np.int64)


#: Bits of the column `kind`: the node offers the element, seeks it, is not near the pivot.
OFFERS, SEEKS, AWAY = 1, 2, 4


def difference(s: np.ndarray, shared: int, pivot: np.ndarray, df: np.ndarray, rule: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(elements, kinds): the part of a set's difference to the pivot by which its partners are found."""
    d = np.setxor1d(s, pivot, assume_unique=True)
    near = bool(rule.linked(len(s), len(pivot), shared))
    offers, seeks = (int(x) for x in rule.moved(np.int64(len(s)), np.int64(len(d)), np.bool_(near), len(pivot)))
    inside = pivot[np.minimum(np.searchsorted(pivot, d), len(pivot) - 1)] == d  # what the pivot has comes last
    pick = np.lexsort((d, df[(d & np.uint64(len(df) - 1)).astype(np.int64)], inside))[: max(offers, seeks)]
    at = np.arange(len(pick))
    return d[pick], ((at < offers) * OFFERS + (at < seeks) * SEEKS + (0 if near else AWAY)).astype(np.int8)


class Net:
    """The pivots of the first level: nodes, their sets, and an inverted index of them."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray]):
        self.nodes, self.sets, self.sizes = nodes, sets, np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([np.empty(0, np.uint64), *sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.tokens, self.owner = flat[order], owner[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(flat & np.uint64(len(self.sieve) - 1)).astype(np.int64)] = True

    def shared(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, pivot, size of their intersection) of all that have one, in the order of the sets."""
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        may = self.sieve[(flat & np.uint64(len(self.sieve) - 1)).astype(np.int64)]
        flat, owner = flat[may], owner[may]
        low = np.searchsorted(self.tokens, flat)
        count = np.searchsorted(self.tokens, flat, side="right") - low
        width = max(1, len(self.nodes))
        got = np.bincount(np.repeat(owner, count) * width + self.owner[spread(low, count)], minlength=1) if len(self.tokens) else np.zeros(1, np.int64)
        at = np.flatnonzero(got)
        return at // width, at % width, got[at]


def choose_net(nodes: list[int], sets: list[np.ndarray]) -> Net:
    """Takes candidates in order, but none that is not APART from all before it."""
    if not sets:
        return Net([], [])
    every, times = np.unique(np.concatenate(sets), return_counts=True)
    common = every[times > 1]
    owners, chosen = defaultdict(list), []
    for k, s in enumerate(sets):
        mine = s[np.isin(s, common, assume_unique=True)].tolist()
        shared = Counter(j for h in mine for j in owners[h])
        if all(1 - w / (len(s) + len(sets[j]) - w) > APART for j, w in shared.items()):
            chosen.append(k)
            for h in mine:
                owners[h].append(k)
    return Net([nodes[k] for k in chosen], [sets[k] for k in chosen])


_CELLS = "cell long, salt int, node long, n int, kind byte"


def _in_region(elements: np.ndarray, region: int) -> np.ndarray:
    """Cells of an element in different regions are different."""
    with np.errstate(over="ignore"):
        return mix(elements + mix(np.array([region], np.int64).view(np.uint64)))


class _Rows:
    """Gathers rows of _CELLS."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, cells: np.ndarray, salts, node: int, n: int, kinds) -> None:
        m = len(cells)
        self.parts.append((cells.view(np.int64), np.broadcast_to(np.asarray(salts, np.int32), m), np.full(m, node, np.int64), np.full(m, n, np.int32), np.broadcast_to(np.asarray(kinds, np.int8), m)))

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*self.parts, strict=True)], ["cell", "salt", "node", "n", "kind"])
        self.parts = []
        return out


def _first_level(batches, k: int, seed: int, rule: Threshold, counters, net):
    """Rows of _CELLS for each node, once a task: its cells in its own region and in those that it is a guest of.

    Its links with pivots are rows of kind 0, whose cell is the pivot's node."""
    df, net = counters.value, net.value
    mask, usual = np.uint64(len(df) - 1), 4 * int(df.mean())
    seen: set[int] = set()
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            fresh = {}
            for s in shingle_sets(batches_of(whole.slice(at, 500), "text"), k):
                if len(s) and (node := _digest(s, seed)[0]) not in seen:
                    fresh[node] = s
            if len(seen) > 200_000:
                seen.clear()
            seen.update(fresh)
            if not fresh:
                continue
            nodes, sets, rows = list(fresh), list(fresh.values()), _Rows()
            which, pivot, shared = net.shared(sets)
            bounds = np.searchsorted(which, np.arange(len(sets) + 1))
            for i, (node, s) in enumerate(zip(nodes, sets, strict=True)):
                n, mine = len(s), slice(bounds[i], bounds[i + 1])
                own, both = pivot[mine], shared[mine]
                distance = 1 - both / (n + net.sizes[own] - both) if len(own) else np.ones(0)
                home = int(np.argmin(distance)) if len(own) and distance.min() < rule.near else None
                limit = rule.near + rule.reach if home is None else min(distance[home] + 2 * rule.reach, rule.near + rule.reach)
                for j in np.flatnonzero(distance <= limit + 1e-9).tolist():
                    q = int(own[j])
                    found, kinds = difference(s, int(both[j]), net.sets[q], df, rule)
                    if len(found):
                        rows.add(_in_region(found, q + 1), -1, node, n, kinds)
                    if node != net.nodes[q] and rule.linked(n, net.sizes[q], both[j]):
                        rows.add(np.array([net.nodes[q]], np.int64).view(np.uint64), (node & 0x7FFFFFFF) % 1024, node, n, 0)
                if home is None:
                    count = df[(s & mask).astype(np.int64)]
                    offers, seeks = rule.plain(n)
                    pick = np.lexsort((s, count))[: max(offers, seeks)]
                    groups = -(-np.maximum(count[pick].astype(np.int64) - usual, 0) // SALT_ROWS)
                    place = np.arange(len(pick))
                    rows.add(s[pick], np.where(groups > 1, (node & 0x7FFFFFFF) % np.maximum(groups, 1), -1), node, n, (place < offers) * OFFERS + (place < seeks) * SEEKS + AWAY)
            if rows.parts:
                yield rows.batch()
    del seen, df, net
    release()


_MEMBERS = "region long, node long, n int"


def _elect(cols: list[np.ndarray], whole: bool, merge: bool, rule: Threshold) -> pa.RecordBatch:
    """Rows of cells, sorted by cell, salt and node -> (region, node, n) of the cells that may hold a link.

    The region is the cell's least node, or the cell itself unless `merge`. Spread cells stay as they are; links get
    n = -1. Unless `whole`, the cells have more rows than are here; whole ones are cut where sizes are too far apart."""
    cell, salt, node, n, kind = cols
    new = np.ones(len(cell), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1])
    once = new.copy()
    once[1:] |= node[1:] != node[:-1]
    cell, salt, node, n, kind, new = (x[once] for x in (cell, salt, node, n, kind, new))
    if whole and len(cell):
        order = np.lexsort((n, np.cumsum(new)))
        cell, salt, node, n, kind = (x[order] for x in (cell, salt, node, n, kind))
        new[1:] |= (salt[1:] < 0) & ~rule.fits(n[1:].astype(np.int64), n[:-1].astype(np.int64))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(new)))
    kinds, least = (np.bitwise_or.reduceat(kind, start), np.minimum.reduceat(node, start)) if len(start) else (kind, node)
    keep = np.repeat((salt[start] >= 0) | (not whole) | ((size > 1) & (kinds == OFFERS | SEEKS | AWAY)), size)
    region = np.where((salt >= 0) | (not merge), cell, np.repeat(least, size))
    size = np.where(kind == 0, -1, n)
    got = np.unique(np.stack([region[keep], node[keep], size[keep].astype(np.int64)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1]), pa.array(got[:, 2].astype(np.int32))], ["region", "node", "n"])


def _regions(batches, merge: bool, rule: Threshold):
    """Streams sorted rows of cells. Of a cell that goes on, only so many rows are held, then its first alone."""
    held, open_ = None, False
    for batch in batches:
        cols = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(5)]
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        if open_ and len(new):  # the rest of a cell whose first rows have been judged
            yield _elect([c[: new[0]] for c in cols], False, merge, rule)
            cols, new, open_ = [c[new[0] :] for c in cols], new[1:] - new[0], False
        if len(new):
            yield _elect([c[: new[-1]] for c in cols], True, merge, rule)
        held = [c[new[-1] if len(new) else 0 :] for c in cols]
        if len(held[0]) > REGION_ROWS:
            yield _elect(held, False, merge, rule)
            held, open_ = [c[:1] for c in held], True
    if held is not None:
        yield _elect(held, not open_, merge, rule)


_PLACED = "region long, salt int, first int, node long, shingles binary"


def _sets(batches, k: int):
    """Rows (node, places, text) -> a row of the text's set for each place (region, salt, first); a node once a task."""
    seen: set[int] = set()
    for whole in batches:
        for at in range(0, whole.num_rows, 100):
            batch = whole.slice(at, 100)
            nodes, places = batch.column(0).to_pylist(), batch.column(1)
            again = np.array([x in seen or seen.add(x) is not None for x in nodes], bool)
            sets = pa.array([s.tobytes() for s in shingle_sets(batches_of(batch, "text"), k)], pa.binary())
            counts = np.where(again, 0, places.value_lengths().to_numpy())
            which, flat = np.repeat(np.arange(len(nodes)), counts), places.flatten()
            kept = flat.take(pa.array(spread(places.offsets.to_numpy()[:-1] - places.offsets[0].as_py(), counts)))
            for start in range(0, len(which), 500):
                part, rows = kept.slice(start, 500), pa.array(which[start : start + 500])
                yield pa.RecordBatch.from_arrays([*part.flatten(), batch.column(0).take(rows), sets.take(rows)], ["region", "salt", "first", "node", "shingles"])


def spanning(pairs) -> list[tuple[int, int]]:
    """As many of the pairs as connect what all of them connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def region_links(sets: list[np.ndarray], rule: Threshold) -> list[tuple[int, int]]:
    """Links that connect all linked sets of a region, as pairs of their numbers."""
    m, n = len(sets), np.array([len(s) for s in sets], np.int64)
    if m <= FEW:
        shared = lambda a, b: len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return spanning((a, b) for a in range(m) for b in range(a) if rule.fits(n[a], n[b]) and rule.linked(n[a], n[b], shared(a, b)))
    tokens, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(m), n)
    # the pivot's shingles are the most common ones; it is no larger than most, which bounds the differences
    central = np.where(n <= np.median(n), np.bincount(own, often[ids], m) / n, -1.0)
    pivot = int(np.argmax(central))
    place = np.full(len(tokens), -1, np.int64)
    place[ids[own == pivot]] = np.arange(n[pivot])
    common = place[ids] >= 0
    shared = np.bincount(own[common], minlength=m)
    d, near = n + n[pivot] - 2 * shared, rule.linked(n, n[pivot], shared)
    links = [(pivot, x) for x in np.flatnonzero(near).tolist() if x != pivot]
    has = np.zeros((m, int(n[pivot])), bool)
    has[own[common], place[ids[common]]] = True
    lacks, what = np.nonzero(~has)
    del has
    own, token = np.concatenate([own[~common], lacks]), np.concatenate([ids[~common], ids[np.cumsum(n)[pivot] - n[pivot] :][: n[pivot]][what]])
    order = np.lexsort((token, np.bincount(token, minlength=len(tokens))[token], own))
    own, token = own[order], token[order]
    first = np.cumsum(d) - d
    rank = np.arange(len(own)) - first[own]
    offers, seeks = rule.moved(n, d, near, int(n[pivot]))
    offered = np.flatnonzero(rank < offers[own])
    offered = offered[np.argsort(token[offered], kind="stable")]
    keys = token[offered]
    sought = np.flatnonzero(rank < seeks[own])
    low = np.searchsorted(keys, token[sought])
    count = np.searchsorted(keys, token[sought], side="right") - low
    found = np.empty(0, np.int64)
    for part in _parts(count):
        x, y = own[offered[spread(low[part], count[part])]], np.repeat(own[sought[part]], count[part])
        # the lesser difference offers; distances to the pivot that are too far apart leave a window empty
        keep = ((d[x] < d[y]) | ((d[x] == d[y]) & (x < y))) & ~(near[x] & near[y]) & rule.fits(n[x], n[y]) & (d[y] - d[x] <= rule.c * (n[x] + n[y]) + 1e-9)
        found = np.unique(np.concatenate([found, x[keep] * m + y[keep]]))
    x, y = found // m, found % m
    held = np.sort(own * len(tokens) + token)
    for part in _parts(d[x]):
        a, b, count = x[part], y[part], d[x[part]]
        asked = np.repeat(b, count) * len(tokens) + token[spread(first[a], count)]
        hit = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked
        both = np.bincount(np.repeat(np.arange(len(a)), count)[hit], minlength=len(a))
        common = (n[a] + n[b] - (d[a] + d[b] - 2 * both)) // 2
        links += zip(*(z[rule.linked(n[a], n[b], common)].tolist() for z in (a, b)), strict=True)
    return spanning(links)


def _parts(count: np.ndarray):
    """Slices that hold about CHUNK in sum, but at least one entry."""
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
        yield slice(at, end)
        at = end


def _join_regions(batches, rule: Threshold):
    """Rows of _PLACED sorted by region and node -> links (a, b)."""

    def close():
        links = region_links([np.frombuffer(s, "<u8") for s in sets], rule) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in links], pa.int64()), pa.array([nodes[j] for _, j in links], pa.int64())], ["a", "b"])

    now, nodes, sets = None, [], []
    for batch in batches:
        for region, node, raw in zip(*(batch.column(j).to_pylist() for j in (0, 3, 4)), strict=True):
            if region != now:
                if len(nodes) > 1:
                    yield close()
                now, nodes, sets = region, [], []
            if not nodes or nodes[-1] != node:  # rows that repeat id and text give a node from several tasks
                nodes.append(node)
                sets.append(raw)
    if len(nodes) > 1:
        yield close()


def _part_regions(batches, rule: Threshold, counters):
    """Rows of _PLACED sorted by region and salt, the pivot (first = 0) ahead of the others -> rows of _CELLS."""
    df, now, pivot, leader = counters.value, None, None, None
    for batch in batches:
        rows = _Rows()
        for region, salt, first, node, raw in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
            s = np.frombuffer(raw, "<u8")
            if first == 0:
                now, pivot, leader = (region, salt), s, node
                continue
            if now != (region, salt):
                raise AssertionError("a region without its pivot")
            shared = len(np.intersect1d(s, pivot, assume_unique=True))
            found, kinds = difference(s, shared, pivot, df, rule)
            if len(found):
                rows.add(_in_region(found, region), -1, node, len(s), kinds)
            if rule.linked(len(s), len(pivot), shared):
                rows.add(np.array([leader], np.int64).view(np.uint64), (node & 0x7FFFFFFF) % 1024, node, len(s), 0)
        if rows.parts:
            yield rows.batch()


class JaccardJoin:
    """One join: docs(doc_id, text), sets of k-word shingles, similarity of at least num / den."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.spark, self.k, self.rule = docs.sparkSession, k, Threshold(num, den)
        tkey = F.xxhash64(F.coalesce("text", F.lit("")))
        # where a text is found again: by its id, or by its hash if it has none
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), tkey).alias("pid"), tkey.alias("tkey"), F.coalesce("text", F.lit("")).alias("text"))
        self.seed = 0
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def sign(self) -> None:
        """Signs every text; a second time with another seed, should two sets share a 64-bit node."""
        while True:
            self.signed = materialise(self.texts.mapInArrow(partial(_sign, k=self.k, seed=self.seed), _SIGNED), "signed")
            self.rows = self.signed.filter("part IS NULL").select("doc_id", "pid", "tkey", "n", "node", "more")
            nodes = self.rows.filter("n > 0").groupBy("node").agg(
                F.min(F.struct("pid", "tkey")).alias("place"), F.min("doc_id").alias("first_id"), F.min("more").alias("low"), F.max("more").alias("high"), F.count(F.lit(1)).alias("copies")
            )
            self.nodes = materialise(nodes, "nodes")
            if self.nodes.filter("low != high").isEmpty():
                return
            self.seed += 1

    def net(self) -> Net:
        """Pivots of the first level, from what the tasks named: a bounded number of bounded sets."""
        named = self.signed.filter("part = -1")
        order, held = [], 0
        for r in named.select("node", "n").distinct().orderBy(F.xxhash64("node")).limit(PIVOTS).collect():
            if held + r["n"] <= PIVOT_SHINGLES:
                order.append(r["node"])
                held += r["n"]
        sets = {r["node"]: np.frombuffer(r["payload"], "<u8") for r in named.filter(F.col("node").isin(order)).select("node", "payload").dropDuplicates(["node"]).collect()} if order else {}
        return choose_net(order, [sets[x] for x in order])

    def found(self, cells: DataFrame, merge: bool, label: str) -> tuple[DataFrame, DataFrame]:
        """(links, members of regions) from rows of cells."""
        dealt = cells.repartition(self.parts, "cell", "salt").sortWithinPartitions("cell", "salt", "node")
        rows = materialise(dealt.mapInArrow(partial(_regions, merge=merge, rule=self.rule), _MEMBERS).distinct(), label)
        return rows.filter("n < 0").select(F.col("region").alias("a"), F.col("node").alias("b")), rows.filter("n > 0")

    def placed(self, rows: DataFrame, label: str) -> DataFrame:
        """rows(region, salt, first, node) with the sets of their nodes. Sets are made anew from the texts, next to which
        go the places that ask for them, so each is shuffled once for each place."""
        asked = rows.groupBy("node").agg(F.collect_set(F.struct("region", "salt", "first")).alias("places"))
        asked = materialise(asked.join(self.nodes.select("node", "place.pid", "place.tkey").hint("merge"), "node"), f"asked-{label}")
        texts = self.texts.select("pid", "tkey", "text").join(F.broadcast(asked) if rows.count() <= FEW_NODES else asked.hint("merge"), ["pid", "tkey"])
        return texts.select("node", "places", "text").mapInArrow(partial(_sets, k=self.k), _PLACED)

    def links(self) -> DataFrame:
        """Links (a, b) that suffice for the components."""
        context = self.spark.sparkContext
        counters, net = context.broadcast(_frequencies(self.signed)), context.broadcast(self.net())
        cells = self.texts.select("text").mapInArrow(partial(_first_level, k=self.k, seed=self.seed, rule=self.rule, counters=counters, net=net), _CELLS)
        links, members = self.found(cells, True, "regions0")
        for level in range(1, DEPTH + 1):
            sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.min("node").alias("pivot"))
            large = materialise(sizes.filter((F.col("m") > REGION_ROWS) | (F.col("total") > REGION_SHINGLES)), f"large{level}")
            if large.isEmpty():
                return self.joined(links, members, level)
            links = self.joined(links, members.join(large.select("region").hint("merge"), "region", "left_anti"), level)
            members = members.join(large.hint("merge"), "region")
            if level == DEPTH:
                break
            more, members = self.found(self.parted(members, level, counters), False, f"regions{level}")
            links = links.unionByName(more)
        return self.joined(links, self.blocks(members), DEPTH + 1)

    def joined(self, links: DataFrame, members: DataFrame, level: int) -> DataFrame:
        """The links and those within the regions of members, each region joined by one task."""
        rows = self.placed(members.select("region", F.lit(0).alias("salt"), F.lit(0).alias("first"), "node"), f"join{level}")
        rows = rows.repartition(self.parts, "region").sortWithinPartitions("region", "node")
        return materialise(links.unionByName(rows.mapInArrow(partial(_join_regions, rule=self.rule), "a long, b long")), "links")

    def pieces(self) -> F.Column:
        """How many tasks a large region is spread over."""
        return F.greatest(F.ceil(2 * F.col("m") / REGION_ROWS), F.ceil(2 * F.col("total") / REGION_SHINGLES)).cast("int")

    def parted(self, members: DataFrame, level: int, counters) -> DataFrame:
        """Rows of cells of large regions: members against the pivot, which every task of a region gets."""
        pivots = members.filter("node = pivot").select("region", F.explode(F.sequence(F.lit(0), self.pieces() - 1)).alias("salt"), F.lit(0).alias("first"), "node")
        others = members.filter("node != pivot").select("region", F.pmod(F.xxhash64("node"), self.pieces()).cast("int").alias("salt"), F.lit(1).alias("first"), "node")
        rows = self.placed(pivots.unionByName(others), f"part{level}")
        rows = rows.repartition(self.parts, "region", "salt").sortWithinPartitions("region", "salt", "first")
        return rows.mapInArrow(partial(_part_regions, rule=self.rule, counters=counters), _CELLS)

    def blocks(self, members: DataFrame) -> DataFrame:
        """Regions of any two blocks of each region: the exact way for what no pivot parts."""
        block = F.pmod(F.xxhash64("node"), self.pieces()).cast("int")
        other = F.explode(F.sequence(F.lit(0), self.pieces() - 1))
        rows = members.select("region", "node", "n", block.alias("i"), other.alias("j"))
        return rows.select(F.xxhash64("region", F.least("i", "j"), F.greatest("i", "j")).alias("region"), "node", "n")

    def run(self) -> DataFrame:
        """doc_id, tkey, n_shingles and component_id of every row."""
        self.sign()
        labels = components(self.links())
        named = self.nodes.select("node", "first_id", "copies").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
        names = materialise(named.join(smallest.hint("merge"), "label").select("node", "component_id", "copies"), "names")
        rows = self.rows.select("doc_id", "tkey", "n", "node")
        total = names.agg(F.sum("copies")).first()[0] or 0
        # at most HOT_SHARE nodes can hold a HOT_SHARE-th of the rows each
        hot = F.broadcast(materialise(names.filter(F.col("copies") * HOT_SHARE >= max(total, HOT_SHARE)).select("node", "component_id"), "hot"))
        full = rows.filter("n > 0")
        cold = full.join(hot.select("node"), "node", "left_anti").join(names.select("node", "component_id").hint("merge"), "node")
        bare = rows.filter("n = 0").withColumn("component_id", F.col("doc_id"))
        every = cold.unionByName(full.join(hot, "node")).unionByName(bare)
        return every.select("doc_id", "tkey", F.col("n").cast("long").alias("n_shingles"), "component_id")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, tkey (hash of the text), n_shingles, component_id of every row of docs(doc_id, text).

    component_id is the smallest doc_id of the component, null if none of its documents has one."""
    return JaccardJoin(docs, k, num, den).run()


def keep_one(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of docs, in all their columns, that stay: of each component the one with the smallest
    doc_id. Rows without a doc_id, and texts without words, stay."""
    dropped = judged.filter("n_shingles > 0 AND doc_id > component_id").select("doc_id", "tkey")
    return without(docs, dropped, [F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))])


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"), 4, 85, 100)
    return rows.select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM starts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION
  SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other
), component AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM component LEFT JOIN sizes USING (doc_id)
"""
