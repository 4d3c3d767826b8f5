"""Quality scores from a generalised additive model with pairwise interactions.

Each text becomes FEATURES, numbers that do not depend on its language, source or id. The model holds
one lookup table a feature and one a pair of features. They are learnt by cyclic boosting: round after
round, each feature and then each pair in turn gets a shallow tree fitted to the gradient of the logistic
loss, and the tree's leaves are added to its table. A score is the sum of the looked-up values, passed
through the logistic function, so scoring is a search for bins and additions over whole batches.

Training sees at most `sample` labelled rows (drawn by a hash of doc_id); every text is scored whole.
Texts of any length are scored whole; empty and null texts are scored as texts without words. Rows without a label or with a null doc_id are
never learnt from; repeated labels count as often as they occur. With fewer than 20 usable rows, or of
one class only, the score is the share of label 1 (0.5 without labels). Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, fresh, release, table

#: Labelled rows that training may see at most.
SAMPLE = 20_000
THRESHOLD = 0.3
FEATURES = [
    "log_bytes", "log_words", "mean_word", "upper", "digits", "stops", "marks", "space", "wide", "distinct_words",
    "adjacent_repeats", "top_word", "distinct_trigrams", "log_lines", "distinct_lines", "words_a_line", "lines_ended",
    "short_lines", "odd_endings", "longest_word", "distinct_bytes", "loud_words",
]

#: Classes of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 full stop and comma, 5 other ASCII mark, 6 white space, 7 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[k for k in range(33, 127) if not chr(k).isalnum()]] = 5
_CLASS[[ord("."), ord(",")]] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 6
_CLASS[128:] = 7
_ENDS = frozenset(b".!?:;")
_SOFT = frozenset(b".,!?:;)\"'")


def features(raw: bytes | None) -> list[float]:
    """FEATURES of one text in UTF-8."""
    raw = raw or b""
    n = len(raw)
    codes = np.frombuffer(raw, np.uint8)
    seen = np.bincount(codes, minlength=256)
    kinds = np.bincount(_CLASS, weights=seen, minlength=8)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    m, k = len(words), len(lines)
    letters = max(1.0, kinds[1] + kinds[2])
    counts = Counter(words)
    per_line = [x.count(b" ") + 1 for x in lines]
    return [
        math.log1p(n),
        math.log1p(m),
        (n - kinds[6]) / max(1, m),
        kinds[2] / letters,
        kinds[3] / max(1, n),
        kinds[4] / max(1, m),
        kinds[5] / max(1, m),
        kinds[6] / max(1, n),
        kinds[7] / max(1, n),
        len(counts) / max(1, m),
        sum(map(bytes.__eq__, words, words[1:])) / max(1, m - 1),
        max(counts.values(), default=0) / max(1, m),
        len(set(zip(words, words[1:], words[2:]))) / max(1, m - 2),  # noqa: B905
        math.log1p(k),
        len(set(lines)) / max(1, k),
        m / max(1, k),
        sum(x.rstrip()[-1] in _ENDS for x in lines) / max(1, k),
        sum(c < 5 for c in per_line) / max(1, k),
        sum(c for w, c in counts.items() if not (w[-1] > 127 or _CLASS[w[-1]] in (1, 2, 3) or w[-1] in _SOFT)) / max(1, m),
        math.log1p(max(map(len, counts), default=0)),
        float(np.count_nonzero(seen)),
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / max(1, m),
    ]


class Model:
    """cuts: bin edges of each feature; tables: one value a bin; pairs: (i, j) -> values over coarse bins."""

    def __init__(self, base: float, cuts: list | None = None, tables: list | None = None, coarse: list | None = None, pairs: dict | None = None):
        self.base, self.cuts, self.tables, self.coarse, self.pairs = base, cuts or [], tables or [], coarse or [], pairs or {}

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, (cut, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[np.searchsorted(cut, x[:, i], side="right")]
        for (i, j), values in self.pairs.items():
            total += values[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, bins on the left) of the best cut of histograms of gradients and curvatures."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    gain = a**2 / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values over the bins of a tree of that depth."""
    gain, k = _best_split(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a plane: its gain, and the values of the four quadrants over the cells."""
    a, b = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    a[1:, 1:], b[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(s):
        ul = s[1:-1, 1:-1]
        return ul, s[1:-1, -1:] - ul, s[-1:, 1:-1] - ul, s[-1, -1] - s[1:-1, -1:] - s[-1:, 1:-1] + ul

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gain = sum(p**2 / (q + 1) for p, q in zip(parts(a), parts(b), strict=True)) - a[-1, -1] ** 2 / (b[-1, -1] + 1)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    values = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            values[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return float(gain[i, j]), values


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, first: int = 8, n_pairs: int = 8, rate: float = 0.1, bins: int = 48, coarse_bins: int = 8) -> Model:
    """Fits the model: `first` rounds over single features, by whose residuals the pairs are chosen, then rounds over
    features and pairs together. A fifth of the rows decides how many rounds are kept (none, if none helps)."""
    share = float(y.mean()) if len(y) else 0.5
    base = math.log((share + 1e-6) / (1 - share + 1e-6))
    if len(y) < 20 or share in (0.0, 1.0):
        return Model(base)
    width = x.shape[1]
    cuts, coarse = [_cuts(x[:, i], bins) for i in range(width)], [_cuts(x[:, i], coarse_bins) for i in range(width)]
    fine = [np.searchsorted(cuts[i], x[:, i], side="right") for i in range(width)]
    rough = [np.searchsorted(coarse[i], x[:, i], side="right") for i in range(width)]
    test = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~test)
    tables = [np.zeros(len(c) + 1) for c in cuts]
    pairs: dict = {}
    total = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(total[fit], -30, 30)))
        return y[fit] - p, np.maximum(p * (1 - p), 1e-6)

    def loss():
        return float(np.logaddexp(0, -(2 * y[test] - 1) * total[test]).mean())

    def singles():
        for i in range(width):
            g, h = slopes()
            at = fine[i][fit]
            tree = rate * _tree(np.bincount(at, g, len(tables[i])), np.bincount(at, h, len(tables[i])), 2)
            tables[i] += tree
            total[:] += tree[fine[i]]

    def plane(i, j, g, h):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = rough[i][fit] * shape[1] + rough[j][fit]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    def doubles():
        for i, j in pairs:
            values = rate * _quadrants(*plane(i, j, *slopes()))[1]
            pairs[i, j] += values
            total[:] += values[rough[i], rough[j]]

    def state():
        return [x.copy() for x in tables], {k: v.copy() for k, v in pairs.items()}

    best, kept, stale = loss(), state(), 0
    for turn in range(rounds):
        if turn == first:
            g, h = slopes()
            gains = sorted(((_quadrants(*plane(i, j, g, h))[0], i, j) for i in range(width) for j in range(i)), reverse=True)
            pairs.update({(i, j): np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for _, i, j in gains[:n_pairs]})
        singles()
        doubles()
        now = loss()
        if now < best - 1e-6:
            best, stale, kept = now, 0, state()
        elif (stale := stale + 1) >= 10:
            break
    return Model(base, cuts, kept[0], coarse, kept[1])


def _matrix(values: list) -> np.ndarray:
    return np.array([features(v) for v in values], float).reshape(-1, len(FEATURES))


def _gather(batches):
    for batch in batches:
        rows = _matrix(batches_of(batch, "text"))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["y", "x"])


def _score(batches, model: Model):
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            scores = model.score(_matrix(batches_of(batch, "text")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])
    release()


def held_out(doc_id) -> F.Column:
    """True for the fold that is never learnt from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled rows outside the held-out fold."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).dropna()
    usable = usable.filter(~held_out(F.col("doc_id")))
    drawn = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)  # the bound of the broadcast and of what is collected
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn), "doc_id").select("y", "text")
    got = rows.mapInArrow(_gather, "y double, x array<double>").toPandas()
    if not len(got):
        return Model(0.0)
    x, y = np.array(got["x"].tolist(), float), got["y"].to_numpy(float)
    order = np.lexsort([*x.T, y])  # the same order whatever the partitions were, then mixed
    order = order[np.random.default_rng(7).permutation(len(order))]
    return train(x[order], (y[order] > 0.5).astype(float))


def score_quality(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all unless given) and, last, the score of each whole text: `score`, with as many
    underscores behind it as make the name a new one."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = rows.mapInArrow(partial(_score, model=model), f"{schema}, score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(fresh("score", keep)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    rows = score_quality(docs, model, ["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
