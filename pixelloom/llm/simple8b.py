"""Simple-8b: unsigned ids in 64-bit words, a 4-bit selector and 60 bits of payload in each.

Selectors 1 to 14 pack PACKED[s] = (count, bits) values, first value lowest. Selector 15 is an escape:
the word after it holds one value of up to 64 bits. Ids are coded in blocks that begin on a word of
their own, so a block can be decoded alone; a block's last word is filled with zeros.
"""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the format: selector -> (values in a word, bits of each).
PACKED = {
    1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7),
    8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60),
}
ESCAPE = 15
BLOCK = 4096
MAGIC = b"S8B1"
HEAD = struct.Struct("<4sIQQQQQ")


def _by_steps(values: np.ndarray) -> np.ndarray:
    width = np.zeros(len(values), np.uint8)
    steps = sorted({0, *(b for _, b in PACKED.values())})
    for bits, wider in zip(steps, [*steps[1:], 64], strict=True):
        width[values >= np.uint64(1 << bits)] = wider
    return width


_SMALL = _by_steps(np.arange(1 << 16, dtype=np.uint64))


def _widths(values: np.ndarray) -> np.ndarray:
    """The bits of the narrowest selector that takes each value; 64 for those that need an escape."""
    return _SMALL[values] if int(values.max()) < len(_SMALL) else _by_steps(values)


def _choose(width: np.ndarray) -> np.ndarray:
    """For each position, the densest selector whose count of values from there on fits."""
    n = len(width)
    best = np.full(n, ESCAPE, np.uint8)
    span, most = 1, width.copy()  # most[i] is the widest of width[i : i + span]
    runs = {1: most}
    for count in sorted({c for c, _ in PACKED.values()}):
        while span < count:  # widen by the largest known run that keeps within count
            add = max(r for r in runs if r <= count - span)
            wide = most.copy()
            wide[: n - span] = np.maximum(most[: n - span], runs[add][span : n]) if add + span <= n + add else most[: n - span]
            most, span = wide, span + add
        runs[count] = most
    for s in sorted(PACKED, reverse=True):
        count, bits = PACKED[s]
        best[runs[count] <= bits] = s
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block and the end, word indexes of the escapes)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.uint64), np.empty(0, np.uint64)
    row = BLOCK + 60
    padded = np.zeros((blocks, row), np.uint64)
    full = n // BLOCK
    padded[:full, :BLOCK] = ids[: full * BLOCK].reshape(full, BLOCK)
    if full < blocks:
        padded[full, : n - full * BLOCK] = ids[full * BLOCK :]
    flat = padded.reshape(-1)
    chosen = _choose(_widths(flat))
    step = np.ones(16, np.int64)
    for s, (count, _) in PACKED.items():
        step[s] = count
    length = np.full(blocks, BLOCK, np.int64)
    length[-1] = n - (blocks - 1) * BLOCK
    base = np.arange(blocks, dtype=np.int64) * row
    cursor, live, seen = base.copy(), np.ones(blocks, bool), []
    while live.any():  # all blocks advance by one word together
        seen.append(np.where(live, cursor, -1))
        cursor = np.where(live, cursor + step[chosen[np.minimum(cursor, len(flat) - 1)]], cursor)
        live = cursor < base + length
    at = np.stack(seen, axis=1)
    counts = (at >= 0).sum(axis=1)
    start = at[at >= 0]
    sel = chosen[start]
    takes = np.where(sel == ESCAPE, 2, 1)
    place = np.cumsum(takes) - takes
    words = np.zeros(int(takes.sum()), np.uint64)
    for s, (count, bits) in PACKED.items():
        mine = np.flatnonzero(sel == s)
        if len(mine):
            got = np.full(len(mine), s << 60, np.uint64)
            for k in range(count):
                got |= flat[start[mine] + k] << np.uint64(k * bits)
            words[place[mine]] = got
    escapes = place[sel == ESCAPE]
    words[escapes] = np.uint64(ESCAPE << 60)
    words[escapes + 1] = flat[start[sel == ESCAPE]]
    ends = np.concatenate([[0], np.cumsum(counts)])
    offsets = np.concatenate([place, [len(words)]])[ends]
    return words, offsets.astype(np.uint64), escapes.astype(np.uint64)


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids, or those of a run of blocks: pass its words, its offsets less the first, its escapes less the same."""
    if not n:
        return np.empty(0, np.uint64)
    raw = np.zeros(len(words), bool)
    raw[escapes.astype(np.int64) + 1] = True
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.ones(16, np.int64)
    for s, (c, _) in PACKED.items():
        count[s] = c
    takes = np.where(raw, 0, count[sel])
    before = np.cumsum(takes) - takes
    block = np.searchsorted(offsets.astype(np.int64), np.arange(len(words)), side="right") - 1
    first = before[offsets[:-1].astype(np.int64)]
    to = block * BLOCK + before - first[block]
    limit = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(len(offsets) * BLOCK + 60, np.uint64)
    for s, (c, bits) in PACKED.items():
        mine = np.flatnonzero((sel == s) & ~raw)
        if len(mine):
            mask = np.uint64((1 << bits) - 1)
            for k in range(c):
                fits = to[mine] + k < limit[mine]
                out[to[mine][fits] + k] = (words[mine][fits] >> np.uint64(k * bits)) & mask
    marks = escapes.astype(np.int64)
    out[to[marks]] = words[marks + 1]
    return out[:n]


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A segment: header, null marks, doc ids, lengths, block offsets, escapes, words; all little-endian."""
    words, offsets, escapes = encode(ids)
    head = HEAD.pack(MAGIC, BLOCK, len(doc_ids), len(ids), len(offsets) - 1, len(words), len(escapes))
    marks = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, marks.tobytes(), keys.tobytes(), np.array(lengths, "<u8").tobytes(), offsets.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def unpack_segment(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a segment."""
    magic, block, docs, n, blocks, n_words, n_escapes = HEAD.unpack_from(raw)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a segment of this format")
    at = HEAD.size
    marks = np.frombuffer(raw, np.uint8, docs, at)
    at += docs
    parts = []
    for kind, size in (("<i8", docs), ("<u8", docs), ("<u8", blocks + 1), ("<u8", n_escapes), ("<u8", n_words)):
        parts.append(np.frombuffer(raw, kind, size, at))
        at += 8 * size
    keys, lengths, offsets, escapes, words = parts
    ids = decode(words, offsets, escapes, n)
    return [None if m else int(k) for m, k in zip(marks, keys, strict=True)], lengths.astype(np.int64), ids
