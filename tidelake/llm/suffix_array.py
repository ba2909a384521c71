"""Suffix arrays by linear grouping, and repeated strings found from them.

``suffix_array`` sorts suffixes in two phases.  First they are grouped by their longest
Lyndon prefix: groups are taken in descending order, and the members of a group move
the suffixes that their previous-smaller pointers lead to into higher groups of their
own.  Then, from the smallest suffix up, each placed suffix puts those whose Lyndon
prefix ends where it begins into the next free place of their groups.

``repeated_starts`` sorts only suffixes at tokens that the bytes themselves settle, about
one in 32 bytes; strings that start elsewhere are found from the token after their start.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np

LEAST = 200
#: Bytes that settle whether a token begins at the first of them; one string in 2 ** RARE of them does begin one.
AHEAD, RARE = 4, 5


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Start positions of all suffixes of a sequence of integers, in ascending order."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = np.asarray(symbols)[order]
    edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if n else np.zeros(0, np.int64)
    size_of = np.diff(np.append(edge, n))
    first = np.repeat(edge, size_of)
    place = order.tolist()
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    where = where.tolist()
    group = np.empty(n, np.int64)
    group[order] = first
    group = group.tolist()
    size = np.zeros(n + 1, np.int64)
    size[edge] = size_of
    size = size.tolist()
    parent = [-1] * n

    end = n
    while end:
        begin = group[place[end - 1]]
        members = place[begin:end]
        if len(members) > 1:
            members.sort()
        count: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = parent[p]
            parent[s] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if len(count) == 1 or (count and max(count.values()) == 1):
            levels = [list(count)]
        else:
            levels = [[p for _, p in same] for _, same in groupby(sorted(((-c, p) for p, c in count.items())), key=lambda x: x[0])]
        for ps in levels:
            for p in ps:  # to the upper end of its group
                g = group[p]
                size[g] -= 1
                last, at = g + size[g], where[p]
                other = place[last]
                place[at], where[other] = other, at
                place[last], where[p] = p, last
            for p in ps:
                g = group[p]
                new = g + size[g]
                if new != g:
                    group[p] = new
            for p in ps:
                size[group[p]] += 1
        end = begin

    out = [0] * n
    free = list(range(n + 1))
    s, i = n, -1
    while True:
        p, stop = s - 1, parent[s] if s < n else -1
        while p != stop:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            p = parent[p]
        i += 1
        if i == n:
            return out
        s = out[i]


def _token_starts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where tokens begin: settled by the AHEAD bytes from there on, so never nearer than that to the end of a text."""
    n = len(raw)
    four = np.zeros(n, np.uint32)
    for k in range(min(AHEAD, n)):
        four[: n - k] |= raw[k:].astype(np.uint32) << np.uint32(8 * k)
    four *= np.uint32(0x9E3779B1)
    four ^= four >> np.uint32(15)
    four *= np.uint32(0x85EBCA77)
    is_start = four < np.uint32(1 << (32 - RARE))
    for k in range(1, AHEAD):
        is_start[ends[ends >= k] - k] = False
    return is_start


def _tokens(data: bytes, starts: np.ndarray, ends: np.ndarray, is_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts' tokens, each text closed by one of its own, and where each begins (-1: no start for a match).

    Token numbers are in the order of the tokens' bytes and the AHEAD bytes after them,
    which settle where a token ends; so suffixes with a common prefix are side by side.
    """
    at = np.flatnonzero(is_start)
    edges = np.searchsorted(at, np.append(starts, len(data))).tolist()
    at = at.tolist()
    cuts: list[bytes] = []
    begin: list[int] = []
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        own = at[edges[k] : edges[k + 1]]
        if not own or own[0] != a:
            begin.append(-1)
            cuts.append(data[a : own[0] + AHEAD if own else b])
        begin += own
        cuts += [data[x : y + AHEAD] for x, y in zip(own, own[1:], strict=False)]
        if own:
            cuts.append(data[own[-1] : b])
        begin.append(-1)
        cuts.append(None)  # type: ignore[arg-type]
    rank = {t: i for i, t in enumerate(sorted({t for t in cuts if t is not None}), len(starts))}
    symbols, k = [], 0
    for t in cuts:
        if t is None:
            symbols.append(k)
            k += 1
        else:
            symbols.append(rank[t])
    return np.array(symbols), np.array(begin)


def _shared(keys: np.ndarray) -> np.ndarray:
    """Indices of the keys that occur more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    return order[np.append(same, False) | np.append(False, same)] if len(keys) else order


def repeated_starts(texts: list[bytes], least: int = LEAST) -> list[np.ndarray]:
    """For each text, which of its ``least``-byte strings also start elsewhere in these texts."""
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - np.array([len(t) for t in texts], np.int64)
    found = np.zeros(len(data) + 1, bool)
    raw = np.frombuffer(data + bytes(2 * least), np.uint8)
    is_start = _token_starts(raw[: len(data)], ends)
    symbols, begin = _tokens(data, starts, ends, is_start)
    q = begin[np.array(suffix_array(symbols), np.int64)] if len(symbols) else begin.astype(np.int64)
    q = q[q >= 0]
    text_of = np.repeat(np.arange(len(texts)), ends - starts)
    text_end, text_start = ends[text_of], starts[text_of]

    # common bytes of neighbours in the suffix array
    common = np.zeros(len(q), np.int64)
    step = 1 << 14
    for i in range(1, len(q), step):
        x, y = q[i - 1 : min(i + step, len(q)) - 1], q[i : i + step]
        span = np.arange(least)
        differ = raw[x[:, None] + span] != raw[y[:, None] + span]
        length = np.where(differ.any(axis=1), differ.argmax(axis=1), least)
        common[i : i + len(y)] = np.minimum(length, np.minimum(text_end[x] - x, text_end[y] - y))

    # a match may begin before a token, inside the one before, but the AHEAD bytes of the token are in it
    at = np.arange(len(data))
    far = least - AHEAD
    before = np.maximum.accumulate(np.where(is_start, at, -1))
    previous = np.concatenate([[-1], before[:-1]])[q] if len(q) else q
    room = np.minimum(q - np.maximum(previous + 1, text_start[q]), far) if len(q) else q
    mate = np.maximum(common, np.append(common[1:], 0)) if len(q) else q
    left = np.zeros(len(q), np.uint64)
    live = np.flatnonzero(mate >= least - room)
    for d in range(far + 1):
        live = live[room[live] >= d]
        if not len(live):
            break
        if d:
            left[live] = (left[live] ^ raw[q[live] - d]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d)
            left[live] ^= left[live] >> np.uint64(29)
        own = live[(q[live] - d + least <= text_end[q[live]]) & (mate[live] >= least - d)]
        if len(own) < 2:
            continue
        part = np.cumsum(common < least - d)[own].astype(np.uint64)
        some = own[_shared(left[own] ^ (part * np.uint64(0xD6E8FEB86659FD93)))]
        found[q[some] - d] = True

    # strings without any token start that they settle
    nxt = np.minimum.accumulate(np.where(is_start, at, len(data) + least)[::-1])[::-1] if len(data) else at
    bare = np.flatnonzero((nxt > at + far) & (at + least <= text_end)) if len(data) else at
    if len(bare) > 1:
        h = np.zeros(len(bare), np.uint64)
        for d in range(least):
            h = (h ^ raw[bare + d]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        some = _shared(h)
        # only strings of one hash are held at once: texts of few different bytes may have no tokens at all
        last, whole = None, {}
        for i, k in zip(bare[some].tolist(), h[some].tolist(), strict=True):
            if k != last:
                last, whole = k, {}
            piece = data[i : i + least]
            if piece in whole:
                found[i] = found[whole[piece]] = True
            else:
                whole[piece] = i
    return [found[a : max(a, b - least + 1)] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
