"""Repeated strings of a fixed least length, by expanding intervals of a Burrows-Wheeler transform.

The suffixes of a text are sorted by as many bytes as are asked for, by doubling. From the transform, the common prefixes of
neighbouring suffixes follow breadth first: an interval of suffixes that begin with one string is extended backward by each byte
that stands before them, and where the extended interval ends at a place that has no value yet, that place's common prefix is the
length of the string. Values come in ascending order, so the expansion stops at the least length that matters: the
places that have no value by then join suffixes that agree in so many bytes. The first values are seen in the keys by which
suffixes are sorted first, of as many codes as 63 bits hold, so the expansion begins with strings of that length.

Byte 0 of the code stands between strings. It is never extended over; a string that holds it has no meaning here.
"""

from __future__ import annotations

import numpy as np

#: Intervals of more suffixes than this are extended byte by byte, by search; shorter ones by looking at each suffix.
WIDE = 4096


def suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Where suffixes start, in the order of their first `depth` codes (a text ends in zeros); how many codes, `first`, a first key has;
    and the common prefix of each with the one before: first, one less, or 0 for all that is shorter."""
    n = len(text)
    bits = max(int(text.max()).bit_length(), 1)
    first = min(63 // bits, depth)
    padded = np.concatenate([text, np.zeros(first - 1, text.dtype)]).astype(np.uint64)
    key = padded[:n].copy()
    for i in range(1, first):
        key <<= np.uint64(bits)
        key |= padded[i : i + n]
    order = np.argsort(key)
    key = key[order]
    apart = np.concatenate([[np.uint64((1 << 64) - 1)], key[1:] ^ key[:-1]])
    new = apart > 0
    near = np.where(new, np.where(apart < np.uint64(1 << bits), first - 1, 0), first).astype(np.int8)
    order = order.astype(np.int32)
    rank = np.zeros(n + depth + 1, np.int32)  # of the first suffix that begins alike, plus one; 0 beyond the end
    heads = np.flatnonzero(new)
    rank[order] = np.repeat((heads + 1).astype(np.int32), np.diff(np.append(heads, n)))
    known, slots = first, np.arange(n)
    while known < depth:
        slots = slots[~(new & np.append(new[1:], True))]  # groups that are not told apart yet
        if not len(slots):
            break
        step = min(known, depth - known)
        some = order[slots]
        key = rank[some].astype(np.int64) * (n + 1) + rank[some + step]
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[slots] = some
        new = np.append(True, key[1:] != key[:-1])
        heads = np.flatnonzero(new)
        rank[some] = np.repeat((slots[heads] + 1).astype(np.int32), np.diff(np.append(heads, len(slots))))
        known += step
    return order, near, first


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of all ranges in turn, and which range each is of."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(int(size.sum())) + np.repeat(lo - np.cumsum(size) + size, size), of


class Transform:
    """The transform of a sorted text: the code before each suffix, and the step from a suffix to the one that is longer by it."""

    def __init__(self, text: np.ndarray, order: np.ndarray):
        n = len(text)
        self.last = text[order - 1]
        self.last[order == 0] = 0
        by = np.argsort(self.last, kind="stable")
        self.step = np.empty(n, np.int32)
        self.step[by] = np.arange(n, dtype=np.int32)
        self.step[self.last == 0] = -1  # no string goes on over a 0
        cuts = np.searchsorted(self.last[by], np.arange(258))
        #: Of each code that occurs: its first longer suffix, and the suffixes that it stands before.
        self.codes = [(cuts[c], by[cuts[c] : cuts[c + 1]]) for c in range(1, 257) if cuts[c] < cuts[c + 1]]

    def singles(self, at: np.ndarray) -> np.ndarray:
        longer = self.step[at]
        return longer[longer >= 0]

    def pairs(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of intervals of two suffixes: the extended intervals of two, and of one."""
        a, b = self.step[lo], self.step[lo + 1]
        same = (a >= 0) & (b == a + 1) & (self.last[lo] == self.last[lo + 1])
        apart = np.concatenate([a[~same], b[~same]])
        return a[same], apart[apart >= 0]

    def few(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Extended intervals of short ones, by looking at each suffix: those of one interval and code follow each other there."""
        at, of = ranges(lo, hi)
        longer = self.step[at]
        real = longer >= 0
        at, of, longer = at[real], of[real], longer[real]
        put = np.argsort(of * len(self.step) + longer)
        of, longer, code = of[put], longer[put], self.last[at[put]]
        begins = np.ones(len(of), bool)
        begins[1:] = (longer[1:] != longer[:-1] + 1) | (code[1:] != code[:-1]) | (of[1:] != of[:-1])
        return longer[begins], longer[np.append(begins[1:], True) if len(of) else begins] + 1

    def many(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Extended intervals of long ones, by a search in the places of each code."""
        los, his = [], []
        for first, places in self.codes:
            a, b = np.searchsorted(places, lo), np.searchsorted(places, hi)
            los.append((first + a[a < b]).astype(np.int32))
            his.append((first + b[a < b]).astype(np.int32))
        return np.concatenate(los), np.concatenate(his)


def boundaries(text: np.ndarray, order: np.ndarray, near: np.ndarray, first: int, depth: int) -> np.ndarray:
    """Before which suffixes (in order) the common prefix with the one before is shorter than `depth`.

    Only boundaries of strings without a zero are sought: among suffixes that begin with one, or meet one within `depth`, some are missed.
    """
    n = len(text)
    if depth <= first:
        return near < depth
    unset = np.append(near == first, False)
    heads = np.append(np.flatnonzero(~unset[:n]), n).astype(np.int32)
    # Strings of so many codes as a key has, whose interval ends where the common prefix is one code less.
    lo, hi = heads[:-1], heads[1:]
    some = np.append(near, 0)[hi] == first - 1
    lo, hi = lo[some], hi[some]
    padded = np.concatenate([text, np.zeros(first, text.dtype)])
    at, real = order[lo], np.ones(len(lo), bool)
    for k in range(first):
        real &= padded[at + k] > 0
    lo, hi = lo[real], hi[real]
    t, one = Transform(text, order), lo[hi == lo + 1]
    lo, hi = lo[hi > lo + 1], hi[hi > lo + 1]
    for _ in range(first, depth):
        size, los, his = hi - lo, [], []
        two, apart = t.pairs(lo[size == 2])
        los.append(two)
        his.append(two + 2)
        for which, extended in (((size > 2) & (size <= WIDE), t.few), (size > WIDE, t.many)):
            if which.any():
                a, b = extended(lo[which], hi[which])
                los.append(a)
                his.append(b)
        lo, hi = np.concatenate(los), np.concatenate(his)
        one = np.concatenate([t.singles(one), apart, lo[hi == lo + 1]])
        lo, hi = lo[hi > lo + 1], hi[hi > lo + 1]
        # All have one length, so no two end at one place.
        one, fresh = one[unset[one + 1]], unset[hi]
        lo, hi = lo[fresh], hi[fresh]
        unset[one + 1] = False
        unset[hi] = False
        if not len(one) and not len(lo):
            break
    return ~unset[:n]


def repeats(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every place where `depth` bytes fit: the number of its string, its place there, and the number of its class of equal bytes.

    Rows are in order of class.
    """
    return repeats_in(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], np.int64), depth)


def repeats_in(data: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`repeats` of strings of these sizes, which follow each other in the data."""
    text, owner, left = coded(data, sizes)
    order, near, first = suffixes(text, depth)
    group = np.cumsum(boundaries(text, order, near, first, depth))
    fits = left[order] >= depth
    order, group = order[fits], group[fits]
    owner = owner[order]
    return owner, sizes[owner] - left[order], group


def coded(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings in turn, the bytes that occur as 1, 2, ... and a 0 behind each string; of each code, the number of its string and how many bytes are left in that."""
    code = np.zeros(256, np.uint16)
    code[np.flatnonzero(np.bincount(data, minlength=256))] = 1
    code = np.where(code, np.cumsum(code), 0).astype(np.uint16)
    ends = np.cumsum(sizes + 1) - 1
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    left = ends[owner] - np.arange(len(owner))
    text = np.zeros(len(owner), np.uint16)
    text[left > 0] = code[data]
    return text, owner, left
