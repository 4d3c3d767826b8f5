"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and texts are read as words (lower-cased A-Z, digits and characters beyond ASCII). Of every WINDOW
consecutive hashes of GRAM words the smallest is a fingerprint, so any run of GRAM + WINDOW - 1 words that a
text shares with a template shares a fingerprint. An inverted index leads from fingerprints to places in
templates. Templates of fewer words than that, which winnowing cannot guarantee, are found by the hash of
all their words at every place of a text, and must match whole. The places of a
longer template that stand in a text word for word are reported first. The other hits gather by diagonals
(place in the text less place in the template); each gathering, widened by BAND words, is aligned locally (a
match 1, a mismatch or a skipped word -1), again and again outside of what it has matched, so that it yields a
piece for each copy. Pieces that follow each other in both text and template are chained: a chain scores its
matched words less log2(1 + skipped words of text and template) for each link, and where pieces overlap the
later one loses its first words. Chains that match at least COVERAGE of the template's words and MIN_WORDS
words are reported with the spans of their pieces, best first, and what is outside of them is aligned again.
A template without words matches nothing.

Templates are given by the caller and are sent to every task; texts stay where they are read. Null and
empty texts match nothing; null doc_ids stay null; repeated rows are reported each on its own. Empty
tables give empty results. Other columns are never read.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, table
from .licenses import TEMPLATES
from .words import ALNUM, mix, word_hashes

GRAM = 3
WINDOW = 3
BAND = 8
COVERAGE = 0.7
MIN_WORDS = 4
#: Words of all templates together at most; they are sent to every task.
TEMPLATE_WORDS = 2_000_000
MATCHES = "doc_id long, license string, coverage double, matched int, first_word long, last_word long, start_byte long, end_byte long, spans array<struct<first_word long, last_word long, start_byte long, end_byte long>>"
_SPAN = pa.struct([(x, pa.int64()) for x in ("first_word", "last_word", "start_byte", "end_byte")])
_NAMES = ["doc_id", "license", "coverage", "matched", *_SPAN.names, "spans"]
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def gram_hashes(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * np.uint64(0xFF51AFD7ED558CCD) + words[j : j + n]
        return mix(out)


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the smallest hash of every WINDOW consecutive ones, the last of equals."""
    if not len(hashes):
        return np.empty(0, np.int64)
    if len(hashes) <= WINDOW:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    return np.unique(np.arange(len(views)) + WINDOW - 1 - np.argmin(views[:, ::-1], axis=1))


class TemplateIndex:
    """Words of the templates, an inverted index of their fingerprints, and the hashes of short ones by their length."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [word_hashes([templates[n].encode()], ALNUM)[0] for n in self.names]
        if sum(map(len, self.words)) > TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {TEMPLATE_WORDS} words are scanned in several calls")
        marks, owners, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        whole: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            if len(words) < GRAM + WINDOW - 1:
                if len(words):
                    whole.setdefault(len(words), []).append((int(gram_hashes(words, len(words))[0]), t))
                continue
            hashes = gram_hashes(words)
            at = winnow(hashes)
            marks.append(hashes[at])
            owners.append(np.full(len(at), t))
            places.append(at)
        marks, owners, places = map(np.concatenate, (marks, owners, places))
        order = np.argsort(marks, kind="stable")
        self.marks, self.owners, self.places = marks[order], owners[order], places[order]
        self.short = {n: (np.array([h for h, _ in sorted(x)], np.uint64), [t for _, t in sorted(x)]) for n, x in whole.items()}

    def known(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which of the texts that follow each other in `words` hold a fingerprint or a short template."""
        ends = np.cumsum(counts)
        out = np.zeros(len(counts), bool)
        for size, marks in [(GRAM, self.marks), *((n, x[0]) for n, x in self.short.items())]:
            hashes = gram_hashes(words, size)
            if not len(marks) or not len(hashes):
                continue
            found = marks[np.minimum(np.searchsorted(marks, hashes), len(marks) - 1)] == hashes
            sums = np.concatenate([[0], np.cumsum(found)])
            limit = np.maximum(ends - size + 1, ends - counts)
            out |= sums[np.minimum(limit, len(found))] > sums[np.minimum(ends - counts, len(found))]
        return out

    def whole(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(template, first word) of the short templates in a text; copies of one do not overlap."""
        out = []
        for n, (marks, owners) in self.short.items():
            hashes = gram_hashes(words, n)
            for mark, t in zip(marks, owners, strict=True):
                free = 0
                for p in np.flatnonzero(hashes == mark).tolist():
                    if p >= free:
                        out.append((t, p))
                        free = p + n
        return out

    def hits(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, template, place in the template) of the fingerprints at those places."""
        low, high = np.searchsorted(self.marks, hashes[at]), np.searchsorted(self.marks, hashes[at], side="right")
        n = high - low
        row = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return np.repeat(at, n), self.owners[row], self.places[row]


def matches(text: np.ndarray, template: np.ndarray, low: int, high: int) -> np.ndarray:
    """Best local alignment on the diagonals low to high: a row (place in the text, place in the template) for each matched word."""
    width, rows = high - low + 1, len(template)
    score = np.zeros((rows + 1, width + 2), np.int32)  # a column for each diagonal, one to spare on either side
    step = np.arange(width)
    columns = np.arange(width) + low
    for i in range(rows):
        p = i + columns
        inside = (p >= 0) & (p < len(text))
        equal = inside & (text[np.clip(p, 0, len(text) - 1)] == template[i])
        best = np.maximum(score[i, 1:-1] + np.where(equal, 1, -1), score[i, 2:] - 1)
        best = np.where(inside, np.maximum(best, 0), 0)
        score[i + 1, 1:-1] = np.maximum.accumulate(best + step) - step  # words of the text skipped within the row
    i, c = np.unravel_index(int(np.argmax(score)), score.shape)
    pairs = []
    while i > 0 and score[i, c] > 0:
        p = i - 1 + columns[c - 1]
        same = 0 <= p < len(text) and text[p] == template[i - 1]
        if same and score[i, c] == score[i - 1, c] + 1:
            pairs.append((p, i - 1))
            i -= 1
        elif not same and score[i, c] == score[i - 1, c] - 1:
            i -= 1
        elif score[i, c] == score[i - 1, c + 1] - 1:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return np.array(pairs[::-1], np.int64).reshape(-1, 2)


def align(text: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment on the diagonals low to high: (matched words, first and last matched word of the text)."""
    pairs = matches(text, template, low, high)
    return (len(pairs), int(pairs[0, 0]), int(pairs[-1, 0])) if len(pairs) else (0, -1, -1)


def chains(pieces: list[np.ndarray], size: int, least: float) -> list[list[np.ndarray]]:
    """Chains of pieces of a template of `size` words that match at least `least`, best first; chains share no words of the text."""
    pieces = sorted(pieces, key=lambda x: (x[-1, 0], x[-1, 1], len(x)))
    ends = np.array([x[-1] for x in pieces])
    score = np.zeros(len(pieces))
    before, cut = np.full(len(pieces), -1), np.zeros(len(pieces), np.int64)
    for k, piece in enumerate(pieces):
        score[k] = len(piece)
        near = int(np.searchsorted(ends[:k, 0], piece[0, 0] - (1 << min(size, 40))))  # a link over more words costs more than all the template's
        a = near + np.flatnonzero((ends[near:k] < piece[-1]).all(axis=1))
        if not len(a):
            continue
        # what of the piece is left behind the end of each earlier one
        lost = np.maximum(np.searchsorted(piece[:, 0], ends[a, 0], side="right"), np.searchsorted(piece[:, 1], ends[a, 1], side="right"))
        skipped = (piece[lost] - ends[a] - 1).sum(axis=1)
        total = score[a] + len(piece) - lost - np.log2(1 + skipped)
        best = int(np.argmax(total))
        if total[best] > score[k]:
            score[k], before[k], cut[k] = total[best], a[best], lost[best]
    out: list[list[np.ndarray]] = []
    taken = np.zeros(int(ends[-1, 0]) + 1 if len(ends) else 0, bool)
    for k in np.argsort(-score, kind="stable").tolist():
        if score[k] > 0:
            chain = []
            while k >= 0:
                chain.append(pieces[k][cut[k] :])
                k = int(before[k])
            spans = [(int(x[0, 0]), int(x[-1, 0])) for x in chain]
            if sum(map(len, chain)) >= least and not any(taken[a : b + 1].any() for a, b in spans):
                out.append(chain[::-1])
                for a, b in spans:
                    taken[a : b + 1] = True
    return out


def _pieces(text: np.ndarray, free: np.ndarray, template: np.ndarray, place: np.ndarray, diagonal: np.ndarray) -> list[np.ndarray]:
    """Local alignments around the hits at `place` in the free words of a text."""
    out = []
    order = np.argsort(diagonal, kind="stable")
    place, diagonal = place[order], diagonal[order]
    for group in np.split(np.arange(len(place)), np.flatnonzero(np.diff(diagonal) > BAND) + 1):
        # a long chain of near diagonals is several copies; each is aligned within a template's length
        far = (diagonal[group] - diagonal[group[0]]) // max(len(template), BAND + 1)
        for part in np.split(group, np.flatnonzero(np.diff(far)) + 1):
            low, high = int(diagonal[part[0]]) - BAND, int(diagonal[part[-1]]) + BAND
            start = max(0, low)
            words, left = text[start : high + len(template)], free[start : high + len(template)].copy()
            hits = place[part] - start
            while len(hits):
                # taken words become word 0, which is no word's hash but by a chance of 2**-64
                pairs = matches(np.where(left, words, np.uint64(0)), template, low - start, high - start)
                if len(pairs) < GRAM:
                    break
                out.append(pairs + [start, 0])
                left[pairs[0, 0] : pairs[-1, 0] + 1] = False
                hits = hits[np.all([left[hits + j] for j in range(GRAM)], axis=0)]
    return out


def scan_text(words: np.ndarray, index: TemplateIndex) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(template, matched words, first and last word of each piece) of each copy of a template."""
    hashes = gram_hashes(words)
    place, owner, there = index.hits(hashes, winnow(hashes))
    out = [(t, len(index.words[t]), [(p, p + len(index.words[t]) - 1)]) for t, p in index.whole(words)]
    held = np.unique(words) if len(owner) else words
    for t in np.unique(owner).tolist():
        template, free = index.words[t], np.ones(len(words), bool)
        n, own = len(template), owner == t
        least = max(min(MIN_WORDS, n), COVERAGE * n)
        if np.isin(template, held).sum() < least:  # the text lacks too many of its words
            continue
        at, diagonal = place[own], (place - there)[own]
        for d in np.unique(diagonal).tolist():  # word for word
            if 0 <= d <= len(words) - n and free[d : d + n].all() and np.array_equal(words[d : d + n], template):
                out.append((t, n, [(d, d + n - 1)]))
                free[d : d + n] = False
        while True:
            live = np.all([free[at + j] for j in range(GRAM)], axis=0)
            at, diagonal = at[live], diagonal[live]
            found = chains(_pieces(words, free, template, at, diagonal), n, least) if len(at) else []
            if not found:
                break
            for chain in found:
                spans = [(int(x[0, 0]), int(x[-1, 0])) for x in chain]
                out.append((t, sum(map(len, chain)), spans))
                for first, last in spans:
                    free[first : last + 1] = False
    return sorted(out, key=lambda x: (x[0], x[2]))


def _scan(batches, index: TemplateIndex):
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            raws = batches_of(batch, "text")
            words, counts = word_hashes(raws, ALNUM)
            ends = np.cumsum(counts)
            rows: list[list] = [[] for _ in range(9)]
            for k in np.flatnonzero(index.known(words, counts)).tolist():  # one look for all texts of the batch
                found = scan_text(words[ends[k] - counts[k] : ends[k]], index)
                if not found:
                    continue
                spans = [m.span() for m in _WORD.finditer(raws[k])]
                doc = batch.column(0)[k].as_py()
                for t, matched, runs in found:
                    first, last = runs[0][0], runs[-1][1]
                    each = [(a, b, spans[a][0], spans[b][1]) for a, b in runs]
                    for c, v in zip(rows, (doc, index.names[t], matched / len(index.words[t]), matched, first, last, spans[first][0], spans[last][1], [dict(zip(_SPAN.names, x, strict=True)) for x in each]), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(_SPAN)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], _NAMES)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each copy of a template in a row of docs(doc_id, text): the share and count of the template's
    words that match, the first and last matched word of the text, the bytes from one to the other, and the same
    of each piece that matches."""
    index = TemplateIndex(TEMPLATES if templates is None else templates)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_scan, index=index), MATCHES)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
