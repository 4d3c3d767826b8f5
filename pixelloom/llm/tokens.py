"""Token ids of whole texts, a batch at a time.

Where a tokenizer drops white space, a text's ids are those of its white-space separated words one after the other
(texts go to other tokenizers whole). Where the tokenizer lower-cases, ASCII letters are lower-cased
first, which leaves fewer words. A batch's words are dictionary-encoded, and each distinct word is encoded once:

* plain words, a run of letters of Latin-1 between runs of ASCII marks (no apostrophe), are cut into these runs, which
  are the tokenizer's own pre-tokens, and all distinct runs are merged at once (`Merges`);
* all others go to the tokenizer, joined by a mark that tells them apart.

Ids are then gathered by the words' places. Nothing is remembered from batch to batch, so memory is bounded by a
batch's bytes, or by one text that is longer.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release
from .words import spread

#: Bytes of text encoded at a time, but for a longer text.
BATCH = 8 << 20
#: Longer runs, in bytes, are left to the tokenizer.
LONGEST = 48
_NONE = np.int32(2**31 - 1)
_MARKS = r"[!-&(-/:-@\[-`{-~]*"
#: Lower-casing a letter beyond Latin-1 may give one of Latin-1, so words are judged before it.
_PLAIN = f"^{_MARKS}[A-Za-zÀ-ÖØ-öø-ÿ]+{_MARKS}$"
_RUNS = f"^(?P<a>{_MARKS})(?P<b>[a-zß-öø-ÿ]+)(?P<c>{_MARKS})$"
#: Runs by which Merges is held against the tokenizer before it is used.
_PROBE = "the internationalization zzzzqqq aaaaaaaa été garçon naïveté straße ÿøû ... !!! $% (\" :-) ]] x a thtionthsh banana mississippi ;;;;;; ~~ überall".split()
_ENCODERS: dict = {}


def encoder(name: str) -> Encoder:
    """The encoder of a tokenizer file, one for each Python worker. name: a path, or a file of public_tokenizers."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def forget() -> None:
    """Drops the encoders of this worker, for the tasks of other operators that it runs next."""
    _ENCODERS.clear()
    release()


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next one from U+0100 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in kept else next(others)) for b in range(256)]


class Merges:
    """Byte-pair merges with ends of words, applied to many runs at once.

    Runs of one length are rows of a matrix. Each round merges the best pair of every row, the leftmost of equals,
    so rows stay equally long until no pair of theirs is listed."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # a table of open addresses, at most a quarter full
        self.bits = int(4 * len(keys)).bit_length()
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        left, at, self.steps = np.arange(len(keys))[::-1], self._slot(keys)[::-1], 0
        while len(left):
            self.steps += 1
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]
            self.ranks[at[mine]] = left[mine]
            left, at = left[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.size + b
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.steps - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def apply(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, number, flat): the ids of run k are flat[start[k] : start[k] + number[k]]. No run is empty."""
        raw, at = runs.cast(pa.large_binary()), np.frombuffer(runs.cast(pa.large_binary()).buffers()[1], np.int64)[: len(runs) + 1]
        codes, sizes = np.frombuffer(raw.buffers()[2], np.uint8), np.diff(at)
        number, done = np.zeros(len(runs), np.int64), []
        for size in np.unique(sizes).tolist():
            every = np.flatnonzero(sizes == size)
            for first in range(0, len(every), 20_000):
                for which, ids in self._merge(every[first : first + 20_000], codes, at, size):
                    number[which] = ids.shape[1]
                    done.append((which, ids))
        start = np.cumsum(number) - number
        flat = np.empty(int(number.sum()), np.uint32)
        for which, ids in done:
            flat[start[which][:, None] + np.arange(ids.shape[1])] = ids
        return start, number, flat

    def _merge(self, mine: np.ndarray, codes: np.ndarray, at: np.ndarray, size: int):
        """Yields (numbers of runs, their ids as rows of a matrix) of runs of one length; every run comes once."""
        raw = codes[at[mine][:, None] + np.arange(size)]
        now = self.inner[raw]
        now[:, -1] = self.last[raw[:, -1]]
        ranks = self._rank(now[:, :-1].reshape(-1), now[:, 1:].reshape(-1)).reshape(len(mine), size - 1)
        while now.shape[1] > 1:
            j = ranks.argmin(axis=1)
            best = ranks[np.arange(len(mine)), j]
            done = best == _NONE
            if done.any():
                yield mine[done], now[done]
                mine, now, ranks, j, best = mine[~done], now[~done], ranks[~done], j[~done], best[~done]
            if not len(mine):
                return
            rows, width = np.arange(len(mine)), now.shape[1] - 1
            before = np.arange(width) < j[:, None]
            now = np.where(before, now[:, :-1], now[:, 1:])
            now[rows, j] = self.result[best]
            ranks = np.where(before[:, : width - 1], ranks[:, :-1], ranks[:, 1:])
            left, right = np.flatnonzero(j > 0), np.flatnonzero(j < width - 1)
            ranks[left, j[left] - 1] = self._rank(now[left, j[left] - 1], now[left, j[left]])
            ranks[right, j[right]] = self._rank(now[right, j[right]], now[right, j[right] + 1])
        yield mine, now


class Encoder:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(name)
        special = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        self.mark, self.mark_text = special[-1] if special else (None, None)
        probe = [self._whole(w).tolist() for w in ("Quick", "quick")]
        self.lowers = probe[0] == probe[1]
        # a tokenizer that keeps white space gets its texts whole
        self.splits = self._whole("a b\tc").tolist() == np.concatenate([self._whole(w) for w in "abc"]).tolist()
        self.merges = self._merges()

    def _merges(self) -> Merges | None:
        """The tokenizer's merges, if it lower-cases, marks ends of words, and they give its ids for the probe."""
        model = json.loads(self.tokenizer.to_str())["model"]
        if not self.lowers or not self.splits or model.get("type") != "BPE" or not model.get("end_of_word_suffix") or model.get("dropout"):
            return None
        merges = Merges(model)
        start, number, flat = merges.apply(pa.array(_PROBE))
        return merges if all(flat[a : a + n].tolist() == self._whole(w).tolist() for w, a, n in zip(_PROBE, start, number, strict=True)) else None

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _joined(self, words: list[str]):
        """The ids of each word, encoded in one go; the mark between words tells them apart."""
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            plain = self.mark is not None and not any(self.mark_text in w for w in part)
            ids = self._whole(self.mark_text.join(part)) if plain else np.empty(0, np.uint32)
            marks = np.flatnonzero(ids == self.mark) if plain else []
            yield from self._cut(ids, marks) if plain and len(marks) == len(part) - 1 else map(self._whole, part)

    @staticmethod
    def _cut(ids: np.ndarray, marks: np.ndarray):
        for a, b in zip([0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)], strict=True):
            yield ids[a:b]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, number, flat) of distinct words."""
        plain = np.zeros(len(words), bool)
        if self.merges:
            fits = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.less_equal(pc.binary_length(words), LONGEST))
            plain = pc.and_(fits, pc.invert(pc.match_substring(words, "<|"))).to_numpy(zero_copy_only=False)
        number, pieces = np.zeros(len(words), np.int64), [np.empty(0, np.uint32)]
        mine = np.flatnonzero(plain)
        if len(mine):
            runs = pc.extract_regex(pc.utf8_lower(words.take(pa.array(mine))), _RUNS)
            runs = pa.concat_arrays([runs.field(k) for k in range(3)]).dictionary_encode()
            which = runs.indices.to_numpy().reshape(3, -1).T.reshape(-1)  # the three runs of each word in turn
            solid = np.flatnonzero(pc.binary_length(runs.dictionary).to_numpy())
            a, n, flat = self.merges.apply(runs.dictionary.take(pa.array(solid)))
            starts, sizes = np.zeros(len(runs.dictionary), np.int64), np.zeros(len(runs.dictionary), np.int64)
            starts[solid], sizes[solid] = a, n
            number[mine] = sizes[which].reshape(-1, 3).sum(axis=1)
            pieces.append(flat[spread(starts[which], sizes[which])])
        others = np.flatnonzero(~plain)
        for k, ids in zip(others.tolist(), self._joined(words.take(pa.array(others)).to_pylist()), strict=True):
            number[k] = len(ids)
            pieces.append(ids)
        order = np.concatenate([mine, others])  # as the pieces lie
        start = np.empty(len(words), np.int64)
        start[order] = np.cumsum(number[order]) - number[order]
        return start, number, np.concatenate(pieces)

    def _placed(self, texts: pa.Array):
        """(words' places among the distinct ones, the distinct words, ends of the texts in the words)."""
        texts = pc.fill_null(texts, "")
        if self.lowers:  # the tokenizer's own first step; only a special token's text must keep its case
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ends = lists.offsets.to_numpy().astype(np.int64)
        return words.indices.to_numpy(), words.dictionary, ends - ends[0]

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text; none for null."""
        if not self.splits:
            return self.encode(texts)[0]
        places, words, ends = self._placed(texts)
        sums = np.concatenate([[0], np.cumsum(self._words(words)[1][places])])
        return np.diff(sums[ends])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids one text after the other)."""
        if not self.splits:
            whole = [self._whole(t) for t in pc.fill_null(texts, "").to_pylist()]
            return np.array([len(x) for x in whole], np.int64), np.concatenate([np.empty(0, np.uint32), *whole])
        places, words, ends = self._placed(texts)
        start, number, flat = self._words(words)
        sums = np.concatenate([[0], np.cumsum(number[places])])
        return np.diff(sums[ends]), flat[spread(start[places], number[places])]


def slices(batch: pa.RecordBatch, column: int, size: int = BATCH):
    """Slices of a batch whose texts have about so many bytes, but at least one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, end - at)
        at = end
