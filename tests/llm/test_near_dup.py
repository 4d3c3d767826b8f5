import re

import numpy as np
import pytest

from pixelloom.llm import near_dup

SCHEMA = "doc_id long, text string, n int, node string"


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d is None, d or 0, len(s), ids.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(spark, rows, k, num, den):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, k, num, den).collect()), key=str)


def corpus(seed, groups, size):
    """Groups of copies with a growing number of words changed, a passage that many documents share, and lone texts."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocab, 40))
    rows = []
    for g in range(groups):
        base = list(rng.choice(vocab, int(rng.integers(6, 150))))
        for c in range(int(rng.integers(1, size))):
            w = base.copy()
            for _ in range(int(rng.integers(0, 1 + c % 9))):
                w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
            rows.append(" ".join(w).upper() if c % 5 == 1 else " \n".join(w))
            if g % 3 == 0:
                rows[-1] += " " + passage
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (3, 40, 100)])
def test_against_brute_force(spark, k, num, den):
    rows = corpus(k, 30, 25)
    assert run(spark, rows, k, num, den) == brute(rows, k, num, den)


@pytest.mark.parametrize(("rows", "depth"), [(20, 2), (12, 1)])
def test_large_regions(spark, monkeypatch, rows, depth):
    """Regions of so few nodes count as large: they are parted over tasks, or cut into blocks where levels end."""
    monkeypatch.setattr(near_dup, "REGION_ROWS", rows)
    monkeypatch.setattr(near_dup, "DEPTH", depth)
    docs = corpus(rows + depth, 12, 60)
    assert run(spark, docs, 4, 85, 100) == brute(docs, 4, 85, 100)


@pytest.mark.parametrize("pivots", [0, 3])
def test_pivots_of_the_first_level(spark, monkeypatch, pivots):
    monkeypatch.setattr(near_dup, "PIVOTS", pivots)
    docs = corpus(7, 15, 40)
    assert run(spark, docs, 5, 80, 100) == brute(docs, 5, 80, 100)


def test_spread_cells(spark, monkeypatch):
    """Counters that look large spread every cell over tasks."""
    real = near_dup._frequencies
    monkeypatch.setattr(near_dup, "_frequencies", lambda s: real(s) * np.uint32(3 * near_dup.SALT_ROWS))
    rows = corpus(11, 12, 20)
    assert run(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)


def linked_pairs(sets, num, den):
    return {(a, b) for a in range(len(sets)) for b in range(a) if den * (w := len(sets[a] & sets[b])) >= num * (len(sets[a]) + len(sets[b]) - w)}


def classes(pairs, m):
    root = list(range(m))
    for a, b in sorted(pairs):
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize(("seed", "num"), [(s, n) for s in range(6) for n in (30, 60, 85, 95)])
def test_links_of_a_region(seed, num):
    """Sets at all distances from each other, of very different sizes, in regions of one task."""
    rng = np.random.default_rng(seed)
    base = rng.choice(10**6, int(rng.integers(3, 60)), replace=False)
    sets = []
    for _ in range(int(rng.integers(7, 60))):
        drop, new = rng.random(len(base)) < rng.random() * 0.6, rng.choice(10**6, int(rng.integers(0, 12)))
        sets.append(set(base[~drop].tolist()) | set(new.tolist()) | {int(rng.integers(10**6))})
    got = near_dup.region_links([np.array(sorted(s), np.uint64) for s in sets], near_dup.Threshold(num, 100))
    want = linked_pairs(sets, num, 100)
    assert {(max(p), min(p)) for p in got} <= want
    assert classes({(max(p), min(p)) for p in got}, len(sets)) == classes(want, len(sets))


def test_cells_that_span_batches(monkeypatch):
    """A cell is judged whole however its rows are cut into batches, and by its first node alone once it is long."""
    import pyarrow as pa

    monkeypatch.setattr(near_dup, "REGION_ROWS", 3)
    rows = [(1, -1, 5, 9, 7)] + [(2, -1, x, 9, 1 if x < 17 else 6) for x in range(10, 20)] + [(3, -1, 1, 9, 1), (3, -1, 2, 9, 1), (4, -1, 7, 9, 7), (4, -1, 8, 9, 7), (5, 2, 3, 9, 0)]
    want = {(10, x, 9) for x in range(10, 20)} | {(7, 7, 9), (7, 8, 9), (5, 3, -1)}
    for size in range(1, 9):
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int8()]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), kinds, strict=True)], list("abcde")) for i in range(0, len(rows), size)]
        got = {tuple(r.values()) for b in near_dup._regions(iter(batches), True, near_dup.Threshold(85, 100)) for r in b.to_pylist()}
        assert {g for g in got if g[0] != 1 or g[1] != 1} == want


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "One  two"), (6, "one"), (None, "a b c d e f"), (None, "A b c d e f"), (None, None), (7, "same id"), (7, "other text here"), (8, "tie tie"), (8, "tie tie"), (9, long), (10, long + " end")]
    assert run(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)
    assert run(spark, [], 4, 85, 100) == []
    assert run(spark, [(1, None), (2, "")], 4, 85, 100) == brute([(1, None), (2, "")], 4, 85, 100)


def test_keep_one(spark):
    text = " ".join(f"x{i}" for i in range(50))
    rows = [(3, text), (1, text.upper()), (2, text + " more"), (4, "else"), (5, None), (6, None), (None, text)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = near_dup.keep_one(df, near_dup.near_duplicates(df))
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (True, 0)]
