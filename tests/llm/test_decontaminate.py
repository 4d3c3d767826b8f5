import hashlib
import re

import numpy as np
import pytest

from pixelloom.llm import decontaminate as dc
from pixelloom.llm import words

DOCS = "doc_id long, text string, items string, n_words int"
TESTS = "item_id long, text string, lang string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, tests, window):
    out = []
    for d, text in rows:
        w = split(text)
        hit, items = set(), set()
        for item, t in tests:
            g = split(t)
            n = min(window, len(g))
            grams = {tuple(g[i : i + n]) for i in range(len(g) - n + 1)} if g else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    items.add("" if item is None else str(item))
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def case(seed):
    rng = np.random.default_rng(seed)
    vocab = ["the", "Of", "a1", "über", "x", "Zed", "q9", "日本"]
    say = lambda n: " ".join(rng.choice(vocab, n))
    tests = [(k, say(int(rng.integers(1, 9)))) for k in range(12)] + [(None, say(4)), (3, say(5)), (20, None), (21, "..."), (22, "")]
    rows = [(k, say(int(rng.integers(0, 40))) + ",\x00" + tests[k % 12][1].upper()) for k in range(40)] + [(None, None), (7, ""), (7, "tie a1"), (7, "tie a1")]
    return rows, tests


@pytest.mark.parametrize("block", [2_000_000, 100])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_TERMS", block)
    rows, tests = case(1)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(3)
    got = dc.decontaminate(docs, spark.createDataFrame([(*t, "x") for t in tests], TESTS), 4)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows, tests, 4)))


def test_near(spark, tmp_path):
    rows = [(1, "a b c x x d"), (2, "d c b a"), (3, "a b x x x x c d"), (4, "a b"), (5, "c d")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).coalesce(1)
    segments = dc.build_index(docs, str(tmp_path / "i"))
    got = {r.doc_id: list(zip(r.starts, r.ends, strict=True)) for r in dc.find_near(segments, spark.createDataFrame([(9, "a d c b", "x")], TESTS), 6).collect()}
    assert got == {1: [(0, 6)], 2: [(0, 4)], 3: [], 4: [], 5: []}


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "x", 1)], DOCS)
    tests = spark.createDataFrame([], TESTS)
    assert dc.decontaminate(none, tests).collect() == []
    assert [tuple(r)[:4] for r in dc.decontaminate(some, tests).collect()] == [(1, 2, 0, 0)]


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = b"  Some words, \xc3\xa9t\xc3\xa9 and " + b"y" * 300 + b" more 12 " * 40
    want, counts = words.word_hashes([text, None, b"", b"some"], words.SPACED)
    monkeypatch.setattr(words, "CHUNK", 50)
    got, more = words.word_hashes([text, None, b"", b"some"], words.SPACED)
    assert (got == want).all() and more.tolist() == counts.tolist() == [len(text.split()), 0, 0, 1]
    assert want[0] == want[-1]
