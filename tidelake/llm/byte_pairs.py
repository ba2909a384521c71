"""Byte-pair merges of many words at once, by numpy: the ids the tokenizers library gives.

The library takes about 10 microseconds a word, most of a shard's CPU time where one word
in twenty is new.  Here all words take their lowest-ranked merge in the same step, at every
place where it stands (of places that overlap, from the left).  That is the library's order,
lowest rank first and then leftmost, as long as each merge ranks after those that make
its parts; for a vocabulary where one does not, ``PairMerges.of`` gives None.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(2**31 - 1)


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``begin[0], begin[0] + 1, ...``: ``size[0]`` numbers, then those of the next."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class PairMerges:
    """Merges of a byte-level BPE vocabulary with 16-bit ids."""

    #: Bytes of the longest word taken here: a step costs as much as all words that are left.
    LONGEST = 64

    def __init__(self, letters: np.ndarray, left: np.ndarray, right: np.ndarray, whole: np.ndarray):
        self._letters, self._whole = letters, whole
        keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        self._rank = np.argsort(keys).astype(np.int32)
        self._keys = keys[self._rank]
        self._maybe = np.zeros(1 << 20, bool)
        self._maybe[self._slot(keys)] = True

    @classmethod
    def of(cls, vocabulary: bytes, letters: dict[int, str]) -> PairMerges | None:
        """None if this vocabulary needs more than plain merges; ``letters``: what stands for each byte."""
        model = json.loads(vocabulary)["model"]
        ids, merges = model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        special = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or special or len(set(merges)) < len(merges) or not merges or max(ids.values()) >= 1 << 16:
            return None
        made = {a + b: k for k, (a, b) in enumerate(merges)}  # by the last merge that makes it
        if not all(x in ids for x in letters.values()) or any(made.get(x, -1) >= k for k, m in enumerate(merges) for x in m):
            return None
        left, right, whole = (np.array([ids[x] for x in c], np.int32) for c in (*zip(*merges, strict=True), [a + b for a, b in merges]))
        return cls(np.array([ids[letters[b]] for b in range(256)], np.int32), left, right, whole)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(12)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge."""
        keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        out = np.full(len(keys), _NONE)
        some = np.flatnonzero(self._maybe[self._slot(keys)])
        at = np.minimum(np.searchsorted(self._keys, keys[some]), len(self._keys) - 1)
        same = self._keys[at] == keys[some]
        out[some[same]] = self._rank[at[same]]
        return out

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has; no word is empty or longer than LONGEST."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = self._letters[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(size)
        word, start, last = np.arange(len(size)), ends - size, np.zeros(len(ids), bool)
        last[ends - 1] = True
        rank = np.full(len(ids), _NONE)
        inner = np.flatnonzero(~last)
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            low = np.minimum.reduceat(rank, start)
            size = np.diff(start, append=len(ids))
            over = low == _NONE
            if over.any():
                gone = np.repeat(over, size)
                done.append((word[over], size[over], ids[gone]))
                word, low, size = word[~over], low[~over], size[~over]
                ids, rank, last = ids[~gone], rank[~gone], last[~gone]
                start = np.cumsum(size) - size
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            beside = np.diff(at, prepend=-2) == 1
            if beside.any():  # one letter again and again: every second place of a run
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(beside, 0, k))) % 2 == 0]
            ids[at], last[at] = self._whole[rank[at]], last[at + 1]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, rank, last = ids[stay], rank[stay], last[stay]
            start = start - np.searchsorted(at, start)
            at = at - np.arange(len(at))
            before = at[at > 0] - 1
            near = np.concatenate([at, before])
            rank[near] = _NONE
            near = near[~last[near]]
            rank[near] = self._ranks(ids[near], ids[near + 1])
        order, size, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        sizes = np.empty(len(words), np.int64)
        sizes[order] = size
        out = np.empty(len(ids), "<u2")
        out[runs((np.cumsum(sizes) - sizes)[order], size)] = ids
        return out, sizes
