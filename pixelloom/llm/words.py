"""Words of UTF-8 texts as 64-bit hashes, computed over whole buffers with numpy.

A word's hash is its polynomial in an odd base modulo 2**64, mixed. Two different words share a hash
with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed at a time; longer texts are cut between words.
CHUNK = 1 << 18
_POWERS: list[np.ndarray] = []


def byte_table(separators: bytes) -> bytes:
    """A table for bytes.translate: A-Z lower-cased, separators to spaces."""
    return bytes(32 if c in separators else c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Words are runs of digits, letters a-z and all beyond ASCII.
ALNUM = byte_table(bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)))
#: Words are runs of anything but ASCII white space.
SPACED = byte_table(b" \t\n\x0b\x0c\r")


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start[i], start[i] + 1, ... (count[i] of them), one run after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _hash_chunk(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a buffer whose separators are spaces."""
    codes = np.frombuffer(raw, np.uint8)
    n = len(codes)
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (_BASE, _UNBASE)]
    solid = codes != 32
    edges = np.diff(solid.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    with np.errstate(over="ignore"):
        sums = np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _POWERS[0][:n], dtype=np.uint64)
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        return starts, mix((sums[ends - 1] - before) * _POWERS[1][starts])


def word_hashes(texts: list[bytes | None], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of the texts in order, count of words of each text)."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[int] = []
    size = 0

    def flush():
        nonlocal group, size
        if group:
            raw = b" ".join([texts[k] for k in group]).translate(table)
            starts, got = _hash_chunk(raw)
            lengths = np.array([len(texts[k]) + 1 for k in group])
            counts[group] = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)])))
            hashes.append(got)
        group, size = [], 0

    for k, t in enumerate(texts):
        if not t:
            continue
        if len(t) > CHUNK:
            flush()
            low, at = t.translate(table), 0
            while at < len(low):
                end = len(low) if len(low) - at <= CHUNK else low.rfind(b" ", at, at + CHUNK) + 1
                if end <= at:  # a word longer than a chunk
                    end = low.find(b" ", at + CHUNK) + 1 or len(low)
                got = _hash_chunk(low[at:end])[1]
                hashes.append(got)
                counts[k] += len(got)
                at = end
            continue
        group.append(k)
        size += len(t) + 1
        if size >= CHUNK:
            flush()
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts
