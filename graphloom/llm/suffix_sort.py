"""Suffix sorting by linear grouping, and the repeated windows that it finds."""

from __future__ import annotations

import numpy as np


def suffix_order(text: list[int]) -> list[int]:
    """The suffix array of a list of non-negative integers, an end of text smaller than all.

    First the suffixes are put in groups of one Lyndon prefix each. Groups are settled from the largest to the smallest:
    each member's previous smaller suffix, reached over pointers that skip what is settled, gains the member's prefix,
    and moves to a group of its own just above its old one (the more copies gained, the higher). Then positions are
    emitted from the smallest on: when a suffix is placed, those whose Lyndon prefix ends where it starts come next in
    their groups. No renaming, no recursion.
    """
    n = len(text)
    if not n:
        return []
    values = np.asarray(text)
    by_symbol = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[by_symbol])) + 1
    members = [x.tolist() for x in np.split(by_symbol, cuts)]
    live = [len(m) for m in members]
    group = np.repeat(np.arange(len(members)), live)
    back = np.empty(n, np.int64)
    back[by_symbol] = group
    group = back.tolist()
    above = list(range(1, len(members) + 1))
    above[-1] = -1
    below = list(range(-1, len(members) - 1))
    settled = bytearray(n)
    previous = [-1] * n
    length = [1] * n
    g = len(members) - 1
    while g >= 0:
        own = members[g]
        if live[g] != len(own):
            own = [s for s in own if group[s] == g]
            members[g] = own
        for s in own:
            settled[s] = 1
        gained, copies = [], []
        last = -2
        for s in own:
            p = s - 1
            while p >= 0 and settled[p]:
                p = previous[p]
            previous[s] = p
            if p == last:
                if p >= 0:
                    copies[-1] += 1
            elif p >= 0:
                gained.append(p)
                copies.append(1)
            last = p
        if gained:
            size = length[own[0]]
            if len(gained) == 1:
                p = gained[0]
                length[p] += size * copies[0]
                c = group[p]
                if live[c] > 1:
                    h = len(members)
                    members.append([p])
                    live.append(1)
                    live[c] -= 1
                    group[p] = h
                    up = above[c]
                    above.append(up)
                    below.append(c)
                    above[c] = h
                    if up >= 0:
                        below[up] = h
            else:
                for count in sorted(set(copies), reverse=True):
                    parts: dict[int, list[int]] = {}
                    for p, k in zip(gained, copies):
                        if k == count:
                            length[p] += size * count
                            parts.setdefault(group[p], []).append(p)
                    for c, moved in parts.items():
                        if live[c] == len(moved):
                            continue
                        h = len(members)
                        members.append(moved)
                        live.append(len(moved))
                        live[c] -= len(moved)
                        for p in moved:
                            group[p] = h
                        up = above[c]
                        above.append(up)
                        below.append(c)
                        above[c] = h
                        if up >= 0:
                            below[up] = h
        g = below[g]
    slot = [0] * len(members)
    g, at = 0, 0  # the group of the smallest symbol is still the lowest
    while below[g] >= 0:
        g = below[g]
    while g >= 0:
        slot[g] = at
        at += live[g]
        g = above[g]
    order = [0] * n
    t = n
    for at in range(-1, n):
        if at >= 0:
            t = order[at]
        i = t - 1
        while i >= 0 and i + length[i] == t:
            h = group[i]
            order[slot[h]] = i
            slot[h] += 1
            i = previous[i]
    return order


def _stops(data: np.ndarray, most: int = 64) -> np.ndarray:
    """The byte values that end a phrase: few enough for long phrases, enough that none is longer than `most`."""
    counts = np.bincount(data, minlength=256)
    stop = np.zeros(256, bool)
    common = np.flatnonzero((counts > 0) & (counts <= len(data) / 16))
    if len(common):
        stop[common[np.argmax(counts[common])]] = True
    while True:
        ends = np.flatnonzero(stop[data])
        edges = np.r_[-1, ends, len(data) - 1]
        gaps = np.diff(edges)
        longest = int(np.argmax(gaps))
        if gaps[longest] <= most:
            return stop
        inside = np.bincount(data[edges[longest] + 1 : edges[longest + 1] + 1], minlength=256)
        inside[stop] = 0
        if not inside.any():
            return stop
        stop[np.argmax(inside)] = True


def repeated_windows(pieces: list[bytes], starts: np.ndarray, firsts: list[tuple[int, int]], window: int) -> list[np.ndarray]:
    """For each piece of text, which of its first `starts[i]` windows also stand at an earlier place.

    firsts has (document, position) of each piece. The pieces are joined with a mark after each and parsed into phrases
    that end at the same bytes everywhere, so no phrase is a prefix of another. The suffix array of the phrase numbers
    orders all suffixes that start a phrase; one that starts inside a phrase is ordered by the rest of its phrase, then
    by the suffix after it. Equal windows are neighbours in that order and are compared byte by byte.
    """
    if not pieces:
        return []
    sizes = np.array([len(p) for p in pieces])
    mark = np.cumsum(sizes + 1) - 1  # where each piece's mark stands
    begin = mark - sizes
    data = np.zeros(int(mark[-1]) + 1, np.uint8)
    flat = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    data[:] = flat
    stop = _stops(data)[data]
    stop[mark] = True
    ends = np.flatnonzero(stop)
    phrase_start = np.r_[0, ends[:-1] + 1]
    raw = data.tobytes()
    numbers: dict[bytes, int] = {}
    spelled = [raw[s : e + 1] for s, e in zip(phrase_start.tolist(), ends.tolist())]
    for k, w in enumerate(sorted(set(spelled))):
        numbers[w] = k
    text = [numbers[w] for w in spelled]
    rank = np.empty(len(text) + 1, np.int64)
    rank[-1] = -1
    rank[np.asarray(suffix_order(text))] = np.arange(len(text))
    # All starts of windows, ordered by (rest of the phrase, rank of the suffix after it).
    total = int(starts.sum())
    piece = np.repeat(np.arange(len(pieces)), starts)
    offset = np.arange(total) - np.repeat(np.cumsum(starts) - starts, starts)
    at = begin[piece] + offset
    phrase = np.searchsorted(ends, at)
    shift = at - phrase_start[phrase]
    rests: dict[bytes, int] = {}
    lengths = np.array([len(w) for w in numbers], np.int64)
    base = np.cumsum(lengths) - lengths
    rest_of = np.empty(int(lengths.sum()), np.int64)
    k = 0
    for w in numbers:
        for x in range(len(w)):
            rest_of[k] = rests.setdefault(w[x:], len(rests))
            k += 1
    rest = rest_of[base[np.asarray(text)[phrase]] + shift]
    order = np.lexsort((rank[phrase + 1], rest))
    at, piece, offset = at[order], piece[order], offset[order]
    same = np.empty(total, bool)
    same[0] = False
    padded = np.r_[data, np.zeros(window, np.uint8)]
    view = np.lib.stride_tricks.sliding_window_view(padded, window)
    candidates = np.flatnonzero(rest[order][1:] == rest[order][:-1]) + 1
    same[:] = False
    for s in range(0, len(candidates), 1 << 16):
        c = candidates[s : s + (1 << 16)]
        same[c] = (view[at[c]] == view[at[c - 1]]).all(axis=1)
    run = np.cumsum(~same) - 1
    docs = np.array([f[0] for f in firsts], np.int64)[piece]
    places = np.array([f[1] for f in firsts], np.int64)[piece] + offset
    sort = np.lexsort((places, docs, run))
    lead = sort[np.r_[True, np.diff(run[sort]) > 0]]
    first_doc, first_place = docs[lead][run], places[lead][run]
    later = (docs != first_doc) | (places != first_place)
    out = [np.zeros(k, bool) for k in starts.tolist()]
    flags = np.zeros(total, bool)
    flags[order] = later
    bounds = np.cumsum(starts)
    return [flags[b - k : b] for b, k in zip(bounds.tolist(), starts.tolist())] or out
