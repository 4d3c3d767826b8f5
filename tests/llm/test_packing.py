from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.llm import packing
from pixelloom.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, length string, bin_id int"


def slow_trial(n, size, to_come):
    held = n
    for m in sorted(to_come, reverse=True):
        if held + m <= size:
            held += m
    return held


def slow_pack(lengths, permitted):
    """The same rules with plain searches through all bins and all pieces to come."""
    bins, place = [], [None] * len(lengths)  # a bin: [room, used, when it came to that room]
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    shrink = lambda u: min(s for s in permitted if s >= u)
    for step, k in enumerate(order):
        n = lengths[k]
        fits = [i for i, b in enumerate(bins) if b[0] >= n]
        if fits:
            at = min(fits, key=lambda i: (bins[i][0], -bins[i][2]))
        else:
            to_come = [lengths[j] for j in order[step + 1 :]]
            trials = [(packing.cost(shrink(h)) / h, s) for s in permitted if s >= n for h in [slow_trial(n, s, to_come)]]
            bins.append([min(trials)[1], 0, 0])
            at = len(bins) - 1
        place[k] = (at, bins[at][1])
        bins[at] = [bins[at][0] - n, bins[at][1] + n, step]
    return place, [shrink(b[1]) for b in bins]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_rules(lengths):
    permitted = (8, 32, 64)
    bins, offsets, sizes = packing.pack(np.array(lengths), permitted)
    filled = defaultdict(list)
    for k, (b, o) in enumerate(zip(bins, offsets, strict=True)):
        filled[b].append((o, o + lengths[k]))
    for b, spans in filled.items():
        spans.sort()
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert sizes[b] == min(s for s in permitted if s >= spans[-1][1])
    assert len(filled) == len(sizes)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=40), st.sampled_from([(8, 32, 64), (64,), (16, 24, 40, 64)]))
def test_fillings_against_a_plain_search(lengths, permitted):
    bins, offsets, sizes = packing.pack(np.array(lengths), permitted)
    assert (list(zip(bins, offsets, strict=True)), sizes) == slow_pack(lengths, permitted)


def test_all_lengths_compete():
    """What is opened depends on the pieces that there are, and a further permitted length lowers the cost."""
    assert set(packing.pack(np.full(900, 510))[2]) == {1024}
    assert set(packing.pack(np.full(900, 400))[2]) >= {2048}
    assert set(packing.pack(np.array([512] * 9 + [1024] * 9))[2]) <= {512, 1024}
    lengths = np.clip(np.random.default_rng(3).lognormal(6, 1, 20_000).astype(int), 1, 4096)
    price = lambda permitted: sum(map(packing.cost, packing.pack(lengths, permitted)[2]))
    assert price(packing.LENGTHS) <= price((1024, 2048, 4096)) <= price((2048, 4096)) <= price((4096,))


def test_dense_and_cheap():
    lengths = np.random.default_rng(5).integers(1, 2000, 5000)
    _, _, sizes = packing.pack(lengths)
    assert lengths.sum() / sum(sizes) > 0.99
    single = sum(next(s for s in packing.LENGTHS if s >= n) for n in lengths)
    assert sum(map(packing.cost, sizes)) < packing.cost(4096) * (single / 4096)


def test_documents(spark):
    rows = [(k, "word and more " * (k % 50)) for k in range(300)] + [(None, "null id"), (400, None), (401, ""), (402, "long text here " * 30_000), (5, "tie"), (5, "tie")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    got = packing.pack_documents(packing.token_counts(docs), group=100).collect()
    enc = Encoder("word_bpe_49k.json").tokenizer
    want = sorted((d is None, d or 0, len(enc.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in rows)
    whole = defaultdict(list)
    for r in got:
        whole[r.doc_id].append((r.piece, r.start, r.length))
    assert sum(r.length for r in got) == sum(n for *_, n in want)
    assert sorted(whole[402]) == [(i, 4096 * i, min(4096, sum(x[2] for x in whole[402]) - 4096 * i)) for i in range(len(whole[402]))]
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id, r.capacity].append((r.offset, r.offset + r.length))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), spans in bins.items():
        spans.sort()
        assert capacity in packing.LENGTHS and spans[-1][1] <= capacity
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = [tuple(r) for r in packing.pack_documents(packing.token_counts(docs)).collect()]
    assert got == [(None, 0, 0, 1, 0, 512, 0)] * len(rows)
