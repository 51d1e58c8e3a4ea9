"""Suffix arrays by induced sorting, with permuted common prefixes. Strings of bytes are sorted a bucket at a time, their recursions by lists."""

from __future__ import annotations

import numpy as np


def smaller_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one. The last suffix isn't: what follows it is smallest."""
    step = np.sign(np.diff(t.astype(np.int32), append=-1))
    # in a run of equal characters, all have the type of the run's last
    at = np.where(step != 0, np.arange(len(t)), len(t))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that the given order of the leftmost-smaller suffixes induces: larger ones left to right, then smaller ones right to left."""
    n, size = len(t), np.bincount(t, minlength=256)
    ends = np.cumsum(size)
    heads = ends - size
    sa = np.full(n, -1, np.int64)
    order = np.argsort(t[lms], kind="stable")
    marks, counts = lms[order], np.bincount(t[lms], minlength=256)
    mark_ends = np.cumsum(counts)
    head = heads.copy()

    def scatter(source: np.ndarray, wanted: bool, place: np.ndarray, step: int) -> None:
        """Puts the suffixes before those of ``source`` in their buckets, in order."""
        before = source[source > 0] - 1
        before = before[small[before] == wanted]
        if len(before):
            c = t[before]
            by = np.argsort(c, kind="stable")
            c, before = c[by], before[by]
            many = np.bincount(c, minlength=256)
            nth = np.arange(len(c)) - (np.cumsum(many) - many)[c]
            sa[place[c] + step * nth] = before
            place += step * many

    if n and not small[-1]:  # the last suffix follows what stands before all others
        sa[head[t[-1]]] = n - 1
        head[t[-1]] += 1
    used = np.flatnonzero(size)
    for c in used:
        done = heads[c]
        while done < head[c]:
            upto = head[c]
            scatter(sa[done:upto], False, head, 1)
            done = upto
        scatter(marks[mark_ends[c] - counts[c] : mark_ends[c]], False, head, 1)
    tail = ends - 1
    for c in used[::-1]:
        done = ends[c] - 1
        while done > tail[c]:
            upto = tail[c]
            scatter(sa[upto + 1 : done + 1][::-1], True, tail, -1)
            done = upto
        scatter(sa[heads[c] : head[c]][::-1], True, tail, -1)
    return sa


def listed(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """``induced`` for large alphabets and long runs, where buckets are too small to be worth whole-array steps."""
    s, is_small, n = t.tolist(), small.tolist(), len(t)
    ends = np.cumsum(np.bincount(t))
    sa, tail = [-1] * n, (ends - 1).tolist()
    for i in reversed(lms.tolist()):
        c = s[i]
        sa[tail[c]] = i
        tail[c] -= 1
    head = np.concatenate([[0], ends[:-1]]).tolist()
    c = s[-1]  # the last suffix follows what stands before all others
    sa[head[c]] = n - 1
    head[c] += 1
    for i in sa:  # sees what the loop puts further on
        if i > 0 and not is_small[i - 1]:
            c = s[i - 1]
            sa[head[c]] = i - 1
            head[c] += 1
    tail = (ends - 1).tolist()
    for at in range(n - 1, -1, -1):
        i = sa[at]
        if i > 0 and is_small[i - 1]:
            c = s[i - 1]
            sa[tail[c]] = i - 1
            tail[c] -= 1
    return np.array(sa, np.int64)


def words_at(t: np.ndarray, room: int) -> np.ndarray:
    """The eight bytes from each byte on, as one number; ``room`` zeros follow the last byte."""
    raw = t.tobytes() + bytes(room + 8)
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def substring_names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For the leftmost-smaller substrings in text order, the rank of each among the different ones; ``order`` has them sorted."""
    wide = t.itemsize
    size = np.append(lms[1:] + 1, len(t)) - lms
    place = np.empty(len(t), np.int64)
    place[lms] = np.arange(len(lms))
    by = place[order]
    left = (size[by][1:] * wide).astype(np.int64)
    # the last one ends with the text and equals no other
    equal = (size[by][1:] == size[by][:-1]) & (by[1:] < len(lms) - 1) & (by[:-1] < len(lms) - 1)
    words, alive, at = words_at(t, 8), np.flatnonzero(equal), 0
    one, other = lms[by][:-1] * wide, lms[by][1:] * wide
    while len(alive):
        rest = left[alive] - at
        differ = words[one[alive] + at] ^ words[other[alive] + at]
        differ <<= (8 * np.maximum(8 - rest, 0)).astype(np.uint64)  # bytes behind the end don't count
        equal[alive[differ != 0]] = False
        alive = alive[(differ == 0) & (rest > 8)]
        at += 8
    names = np.empty(len(lms), np.int64)
    names[by] = np.concatenate([[0], np.cumsum(~equal)])
    return names


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of numbers from 0: the leftmost-smaller substrings are sorted, by recursion
    on the string of their names where some are equal, and induce the rest."""
    if len(t) < 2:
        return np.arange(len(t))
    small = smaller_types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    new = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    longest_run = np.diff(new, append=len(t)).max()
    induce = induced if t.dtype == np.uint8 and longest_run < 500 else listed
    if len(lms) > 1:
        sa = induce(t, small, lms)
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        names = substring_names(t, lms, sa[is_lms[sa]])
        lms = lms[suffix_array(names.astype(np.int32)) if names.max() < len(lms) - 1 else np.argsort(names)]
    return induce(t, small, lms)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """In text order, how much each suffix has in common with the one before it in the suffix array, up to ``most`` bytes."""
    n = len(t)
    words = words_at(t, most)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    out = np.zeros(n, np.int64)
    alive = np.flatnonzero(before >= 0)
    for at in range(0, most, 8):
        other = words[alive + at] ^ words[before[alive] + at]
        same = other == 0
        ended = alive[~same]
        low = other[~same]
        low &= ~low + np.uint64(1)
        out[ended] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        alive = alive[same]
        out[alive] = at + 8
        if not len(alive):
            break
    # beyond a text's end there are zeros that don't count
    room = np.minimum(n - np.arange(n), n - before)
    return np.minimum(np.minimum(out, most), room)
