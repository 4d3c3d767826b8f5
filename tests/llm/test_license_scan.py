import numpy as np
import pytest

from pixelloom.llm import license_scan as ls
from pixelloom.llm.licenses import TEMPLATES

SCHEMA = "doc_id long, text string, license string, coverage int"


def slow_align(text, template):
    """Smith-Waterman over the whole plane; the matches on a best path."""
    best, score = (0, 0), {}
    for i in range(len(template) + 1):
        for j in range(len(text) + 1):
            if not i or not j:
                score[i, j] = 0
                continue
            d = 1 if template[i - 1] == text[j - 1] else -1
            score[i, j] = max(0, score[i - 1, j - 1] + d, score[i - 1, j] - 1, score[i, j - 1] - 1)
            if score[i, j] > score[best]:
                best = i, j
    return score[best]


def path_score(text, template, matched, first, last):
    """A bound of the score of an alignment from its matches and its span."""
    return matched - max(0, last - first + 1 - matched)


@pytest.mark.parametrize("seed", range(8))
def test_band_holds_the_best_alignment(seed):
    rng = np.random.default_rng(seed)
    template = rng.integers(0, 1000, 40).astype(np.uint64)
    edited = template.tolist()
    for _ in range(4):
        k = int(rng.integers(len(edited)))
        (edited.__setitem__(k, 5000), edited.insert(k, 6000), edited.pop(k))[int(rng.integers(1))]
    text = np.array([*rng.integers(2000, 3000, 30), *edited, *rng.integers(2000, 3000, 20)], np.uint64)
    matched, first, last = ls.align(text, template, 30 - ls.BAND, 30 + ls.BAND)
    want = slow_align(text.tolist(), template.tolist())
    assert want <= matched <= want + 8 and 30 <= first < last <= 30 + len(edited)
    assert path_score(text, template, matched, first, last) >= want - 8


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    run = rng.integers(0, 2**60, ls.GRAM + ls.WINDOW - 1).astype(np.uint64)
    for _ in range(50):
        a, b = (ls.gram_hashes(np.concatenate([rng.integers(0, 2**60, 5).astype(np.uint64), run, rng.integers(0, 2**60, 4).astype(np.uint64)])) for _ in range(2))
        assert set(a[ls.winnow(a)].tolist()) & set(b[ls.winnow(b)].tolist())


def scan(spark, rows, templates=None):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return ls.scan_licenses(df, templates).collect()


def test_templates_are_found_where_they_stand(spark):
    rows = [(k, f"Some words é before.\n{t.upper()}\nand after, words.") for k, t in enumerate(TEMPLATES.values())]
    got = scan(spark, rows)
    for k, (name, t) in enumerate(TEMPLATES.items()):
        mine = [r for r in got if r.doc_id == k and r.license == name]
        assert len(mine) == 1 and mine[0].coverage == 1.0, name
        found = rows[k][1].encode()[mine[0].start_byte : mine[0].end_byte].decode()
        assert ls._WORD.findall(found.lower().encode()) == ls._WORD.findall(t.lower().encode())


def test_edits_copies_and_clean_texts(spark):
    mit = TEMPLATES["mit"]
    edited = mit.replace("copy, modify, merge", "copy, change and, merge").replace("free of charge, ", "").replace("KIND", "KIND WHATSOEVER")
    note = TEMPLATES["notice-mit"]
    rows = [(1, edited), (2, " ".join(mit.split()[:60])), (3, f"{note}\n{note}\n" + "other words " * 50 + note), (4, "licensed software is free for all to use and to copy")]
    got = scan(spark, rows)
    assert [(r.license, r.coverage > 0.95) for r in got if r.doc_id == 1] == [("mit", True)]
    assert not [r for r in got if r.doc_id in (2, 4)]
    assert len({r.first_word for r in got if r.doc_id == 3 and r.license == "notice-mit"}) >= 2


def test_edges(spark):
    note = TEMPLATES["notice-mit"]
    rows = [(1, None), (2, ""), (None, note), (3, note), (3, note), (4, "x " * 100_000 + note), (5, "a"), (6, "a b")]
    got = scan(spark, rows)
    assert sorted(str(r.doc_id) for r in got if r.license == "notice-mit") == ["3", "3", "4", "None"]
    assert scan(spark, []) == [] and scan(spark, rows, {}) == []


def test_templates_too_short_for_winnowing(spark):
    short = {"one": "Freeware", "two": "Public domain.", "three": "All rights reserved.", "four": "Not for commercial use"}
    rows = [(10 * k + n, f"{'before ' * n}{t}{' after' * n}") for k, t in enumerate(short.values()) for n in range(8)]
    got = scan(spark, rows, short)
    assert sorted((r.doc_id, r.license, r.coverage, r.first_word) for r in got) == sorted((10 * k + n, name, 1.0, n) for k, name in enumerate(short) for n in range(8))
    got = scan(spark, [(1, "x\nAll rights reserved.\nAll Rights Reserved\ny"), (2, "all rights are reserved"), (3, "reserved all rights")])
    assert sorted((r.doc_id, r.license, r.first_word) for r in got) == [(1, "notice-all-rights-reserved", 1), (1, "notice-all-rights-reserved", 4)]


def test_long_insertions_and_omissions_keep_the_license(spark):
    mit = TEMPLATES["mit"].split()
    clause = "to deal in the Software without restriction, including without limitation the rights to use, copy,".split()
    at = next(k for k in range(len(mit)) if mit[k : k + len(clause)] == clause)
    rows = [
        (1, " ".join(mit[:80] + [f"inserted{k}" for k in range(60)] + mit[80:])),
        (2, " ".join(mit[:at] + mit[at + len(clause) :])),
        (3, " ".join(mit[:50] + ["x"] * 12 + mit[50:110] + ["y"] * 300 + mit[110:])),
        (4, " ".join(mit[80:] + ["z"] * 30 + mit[:80])),
        (5, " ".join(mit[:80])),
    ]
    got = {r.doc_id: r for r in scan(spark, rows, {"mit": TEMPLATES["mit"]})}
    assert sorted(got) == [1, 2, 3]
    n = len(ls._WORD.findall(TEMPLATES["mit"].encode()))
    assert got[1].matched == n and len(got[1].spans) == 2 and got[3].matched == n and len(got[3].spans) == 3
    assert got[2].matched == n - len(clause) and got[1].last_word == n + 59 and got[3].last_word == n + 311
    for r in got.values():
        assert (r.first_word, r.last_word) == (r.spans[0].first_word, r.spans[-1].last_word)
        text = dict(rows)[r.doc_id].encode()
        held = [text[s.start_byte : s.end_byte].decode() for s in r.spans]
        assert not any("inserted" in x or " x " in x or " y " in x for x in held)


def test_adjacent_copies_are_all_returned(spark):
    notes = {k: v for k, v in TEMPLATES.items() if k in ("notice-mit", "notice-cc-by-nc-4.0", "notice-apache-2.0")}
    rows = [(k, f"a\n{(v + chr(10)) * 7}b") for k, v in enumerate(notes.values())]
    edited = "Licensed under CC BY-NC 4.1.\n"
    rows += [(10, edited * 5), (11, ("Licensed under the Apache License, Version 3.0.\n" + notes["notice-apache-2.0"] + "\n") * 4)]
    got = scan(spark, rows, notes)
    for k, (name, v) in enumerate(notes.items()):
        size = len(ls._WORD.findall(v.encode()))
        assert sorted((r.license, r.first_word, r.coverage) for r in got if r.doc_id == k) == [(name, 1 + size * j, 1.0) for j in range(7)]
    assert sorted((r.first_word, r.matched) for r in got if r.doc_id == 10) == [(7 * j, 6) for j in range(5)]
    assert sorted((r.first_word, r.matched) for r in got if r.doc_id == 11) == [(8 * j, 6 + 2 * (j % 2)) for j in range(8)]
