"""Suffix arrays by induced sorting and permuted common prefixes, on numpy arrays."""

from __future__ import annotations

import numpy as np


#: Suffixes of a symbol, on average, from which induction goes symbol by symbol; below that, all symbols at once. Both
#: give the same array.
BUCKET = 100


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S type); the last suffix counts as S."""
    n = len(text)
    s_type = np.ones(n, bool)
    if n > 1:
        rises = text[:-1] < text[1:]
        differ = np.flatnonzero(text[:-1] != text[1:])
        # Within a run of equal symbols the type is that of the run's last symbol. In a run that reaches the end each
        # suffix is larger than its shorter rest.
        run = np.diff(np.r_[-1, differ])
        s_type[: int(run.sum())] = np.repeat(rises[differ], run)
        s_type[int(run.sum()) : n - 1] = False
    return s_type


class _Buckets:
    def __init__(self, text: np.ndarray, sigma: int):
        self.count = np.bincount(text, minlength=sigma)
        self.end = np.cumsum(self.count)
        self.begin = self.end - self.count


def _deal(sa: np.ndarray, slots: np.ndarray, suffixes: np.ndarray, symbols: np.ndarray, step: int) -> None:
    """Puts suffixes, in order, into their symbols' buckets at slots, which move by step (1 or -1)."""
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    head = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    size = np.diff(np.r_[head, len(ranked)])
    within = np.arange(len(ranked)) - np.repeat(head, size)
    sa[slots[ranked] + step * within] = suffixes[order]
    slots[ranked[head]] += step * size


def _induce(text: np.ndarray, s_type: np.ndarray, b: _Buckets, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from LMS suffixes in a given order."""
    sa = np.full(len(text), -1, np.int32)
    symbols = text[lms]
    # LMS suffixes by symbol, in the given order.
    order = np.argsort(symbols, kind="stable")
    by_symbol, ranked = lms[order], symbols[order]
    cut = np.searchsorted(ranked, np.arange(len(b.count) + 1))
    head, tail = b.begin.copy(), b.end - 1
    used = np.flatnonzero(b.count)
    for c in used:
        at = b.begin[c]
        while at < head[c]:  # waves of L suffixes that this bucket induces into itself
            wave = sa[at : head[c]]
            at = head[c]
            prev = wave[wave > 0] - 1
            prev = prev[~s_type[prev]]
            if len(prev):
                _deal(sa, head, prev, text[prev], 1)
        seeds = by_symbol[cut[c] : cut[c + 1]]
        prev = seeds[seeds > 0] - 1
        if len(prev):
            _deal(sa, head, prev, text[prev], 1)
    ends = head  # L suffixes of bucket c lie in [begin, ends)
    for c in used[::-1]:
        at = b.end[c] - 1
        while True:
            wave = sa[tail[c] + 1 : at + 1][::-1]
            if not len(wave):
                break
            at = tail[c]
            prev = wave[wave > 0] - 1
            prev = prev[s_type[prev]]
            if len(prev):
                _deal(sa, tail, prev, text[prev], -1)
        wave = sa[b.begin[c] : ends[c]][::-1]
        prev = wave[wave > 0] - 1
        prev = prev[s_type[prev]]
        if len(prev):
            _deal(sa, tail, prev, text[prev], -1)
    return sa


def ordered(text: np.ndarray, sigma: int, starts: np.ndarray, lengths: np.ndarray, end_last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The order of substrings, and flags of those in that order that differ from the one before. Equal ones stay in the
    order given. end_last: whether the end of a substring counts as above or below all symbols.

    As many symbols as fit an integer are compared at a time, and only substrings that are still equal to another go on.
    """
    n, width = len(text), int(sigma + 1).bit_length()
    per, end, up = 62 // width, sigma if end_last else 0, int(not end_last)
    order, head = np.arange(len(starts)), np.zeros(len(starts), bool)
    head[:1] = True
    at, offset = np.arange(len(starts)), 0  # places of the order that are still open, whole groups of equal substrings
    group = np.zeros(len(starts), np.int64)
    while len(at):
        own = order[at]
        key, size, first = np.zeros(len(at), np.int64), lengths[own], starts[own]
        for k in range(offset, offset + per):
            key = key << width | np.where(k < size, text[np.minimum(first + k, n - 1)].astype(np.int64) + up, end)
        by = np.lexsort((key, group)) if offset else np.argsort(key, kind="stable")
        own, key, group = own[by], key[by], group[by]
        order[at] = own
        new = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
        head[at] = new
        offset += per
        number = np.cumsum(new) - 1
        longest = np.maximum.reduceat(lengths[own], np.flatnonzero(new))
        go = (np.bincount(number)[number] > 1) & (longest[number] > offset)
        at, group = at[go], number[go]
    return order, head


def _induce_runs(text: np.ndarray, sigma: int, s_type: np.ndarray, b: _Buckets, lms: np.ndarray) -> np.ndarray:
    """As _induce, for all symbols at once: an L suffix is ordered by its symbols up to the LMS suffix that its run of L
    suffixes ends in, and by that one's rank; then an S suffix by its symbols up to the next L suffix, and its rank. Where
    one run ends and the other goes on with the same symbol, L comes before S."""
    sa, rank = np.zeros(len(text), np.int32), np.zeros(len(text), np.int64)
    rank[lms] = np.arange(len(lms))
    ends = np.sort(lms)
    for is_s in (False, True):
        own = np.flatnonzero(s_type[:-1] == is_s)
        stop = ends[np.searchsorted(ends, own)]
        by = np.argsort(rank[stop], kind="stable")
        own, stop = own[by], stop[by]
        own = own[ordered(text, sigma, own, stop - own + 1, end_last=not is_s)[0]]
        count = np.bincount(text[own], minlength=sigma)
        first = b.end - count if is_s else b.begin
        sa[np.arange(len(own)) + np.repeat(first - (np.cumsum(count) - count), count)] = own
        rank[own] = np.arange(len(own))
        ends = np.sort(own)
    return sa


def induced(text: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of a text whose last symbol is 0 and occurs nowhere else; symbols are below sigma.

    Suffixes are classified, leftmost-smaller (LMS) substrings sorted and named, and the text of their names sorted
    recursively until all names differ; induction from the sorted LMS suffixes gives the array.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    s_type = suffix_types(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    # Of two LMS substrings that agree up to the end of one, the longer is smaller: its symbol there is of L type.
    order, head = ordered(text, sigma, lms, np.r_[np.diff(lms) + 1, 1])
    if not head.all():
        reduced = np.empty(len(lms), np.int32)
        reduced[order] = np.cumsum(head) - 1
        top = int(head.sum())
        order = induced(reduced.astype(np.uint16) if top <= 1 << 16 else reduced, top)  # numpy deals 16-bit symbols by radix
    b = _Buckets(text, sigma)
    sa = _induce(text, s_type, b, lms[order]) if n >= BUCKET * sigma else _induce_runs(text, sigma, s_type, b, lms[order])
    sa[0] = n - 1  # the sentinel, which nothing induces
    return sa


def permuted_lcp(text: np.ndarray, sa: np.ndarray, stop: int = 0) -> np.ndarray:
    """For each text position, the common prefix with the suffix before it in sa, ending before any `stop` symbol.

    A position whose left neighbours agree takes its left neighbour's value less 1; only the others are compared. Symbols
    have 16 bits.
    """
    n = len(text)
    before = np.empty(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    pos = np.arange(n)
    # The rule holds where the left neighbour has the neighbour's left as its own predecessor.
    derived = np.zeros(n, bool)
    derived[1:] = (before[:-1] == before[1:] - 1) & (before[1:] > 0) & (text[:-1] != stop)
    may = np.flatnonzero(derived)
    derived[may] = text[may - 1] == text[before[may] - 1]
    live = np.flatnonzero(~derived & (before >= 0))
    at, other, same = live.copy(), before[live].astype(np.int64), np.zeros(len(live), np.int64)
    longer = np.append(text, [stop] * 4).astype(np.uint64)  # ends every comparison
    four = longer[:-3] | longer[1:-2] << np.uint64(16) | longer[2:-1] << np.uint64(32) | longer[3:] << np.uint64(48)
    ends = longer == stop
    ends = ends[:-3] | ends[1:-2] | ends[2:-1] | ends[3:]
    go = np.arange(len(live))
    while len(go):  # four symbols at a time
        x, y = at[go], other[go]
        go = go[(four[x] == four[y]) & ~ends[x]]
        same[go] += 4
        at[go] += 4
        other[go] = np.minimum(other[go] + 4, n)
    x, y, equal = four[at], four[other], np.ones(len(live), bool)
    for lane in range(4):  # and the rest
        own = x >> np.uint64(16 * lane) & np.uint64(0xFFFF)
        equal &= (own == y >> np.uint64(16 * lane) & np.uint64(0xFFFF)) & (own != stop)
        same += equal
    value = np.zeros(n, np.int32)
    value[live] = same
    source = np.maximum.accumulate(np.where(derived, -1, pos))
    return np.where(derived, np.maximum(value[np.maximum(source, 0)] - (pos - source), 0), value)
