import numpy as np
import pytest

from pixelloom.llm import line_dedup

SCHEMA = "doc_id long, text string, first int, tkey string"


def key(line):
    return tuple("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).split())


def brute(rows, least):
    """Marks every run of lines of enough words that stands earlier, by trying all runs."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    texts = []
    for d, t in order:
        lines = (t or "").split("\n")
        texts.append((d, t, lines, [i for i, x in enumerate(lines) if key(x)]))
    seen, out = {}, {}
    for n, (d, t, lines, solid) in enumerate(texts):
        gone = set()
        for a in range(len(solid)):
            words = 0
            for b in range(a, len(solid)):
                words += len(key(lines[solid[b]]))
                if words < least:
                    continue
                content = tuple(key(lines[solid[i]]) for i in range(a, b + 1))
                if content not in seen:
                    seen[content] = (n, solid[a], solid[b])
                else:
                    m, _, end = seen[content]
                    first = max(solid[a], end + 1) if m == n else solid[a]
                    gone.update(range(first, solid[b] + 1))
        out[d, t] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    return [(d, *out[d, t]) for d, t in rows]


def run(spark, rows, least):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    return line_dedup.dedup_lines(df, least).collect()


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    lines = [" ".join(f"w{int(x)}" for x in rng.integers(0, 9, int(rng.integers(1, 6)))) for _ in range(12)] + ["", "  "]
    blocks = ["\n".join(rng.choice(lines, int(rng.integers(1, 5)))) for _ in range(6)]
    rows = [(k, "\n".join(rng.choice(blocks, int(rng.integers(0, 5)))).upper() if k % 4 == 0 else "\n".join(rng.choice(blocks + lines, int(rng.integers(0, 7))))) for k in range(40)]
    got = run(spark, rows, 7)
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == sorted(brute(rows, 7))


def test_passages_go_and_short_lines_stay(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"one\nhead line\n{passage}"), (2, f"two\nhead line\n{passage.upper()}\nend"), (3, f"head line\n{passage[:-4]}"), (4, "head line")]
    got = {r.doc_id: (r.text, r.words_removed, [tuple(x) for x in r.runs]) for r in run(spark, rows, 50)}
    assert got[1] == (rows[0][1], 0, []) and got[3] == (rows[2][1], 0, []) and got[4] == ("head line", 0, [])
    assert got[2] == ("two\nend", 57, [(1, 2)])


def test_only_window_minima_are_selected():
    """Equal windows select equal lines, and a text of like lines has few fingerprints."""
    rng = np.random.default_rng(4)
    text = "\n".join(" ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, 10)) for _ in range(2000)).encode()
    doc, number, hashes, a, b, selected = line_dedup._split([b"head\n" + text, text + b"\nend"], 50)
    assert len(np.unique(selected)) < 0.5 * len(a)
    of = {}
    for x, y, s in zip(a.tolist(), b.tolist(), selected.tolist(), strict=True):
        assert hashes[s] == hashes[x : y + 1].min()
        assert of.setdefault(hashes[x : y + 1].tobytes(), s - x) == s - x


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", -1)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(k, f"own {k}\n{passage}\nx{k % 3}") for k in range(50)] + [(None, passage), (51, None)]
    assert sorted((str(r.doc_id), r.text, r.n_removed) for r in run(spark, rows, 20)) == sorted((str(d), t, n) for d, t, n in brute(rows, 20))


def test_edges(spark):
    text = "\n".join(["same line here"] * 40)
    rows = [(None, None), (1, ""), (2, text), (2, text), (None, text), (3, "x " * 100_000), (4, "x " * 100_000), (5, "\n\n")]
    got = run(spark, rows, 9)
    assert sorted((str(r.doc_id), r.text, r.n_removed) for r in got) == sorted((str(d), t, n) for d, t, n in brute(rows, 9))
    assert run(spark, [], 9) == []
