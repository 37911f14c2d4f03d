"""Anchors of repeated byte strings, and maximal repeats around them, in numpy.

Every window of WINDOW bytes has an anchor: the gram of GRAM bytes with the least
hash in it. Equal windows have equal anchors at the same place, so a window that
repeats is found around an anchor that repeats. An anchor's context reaches as far
as any window that holds it.
"""

from __future__ import annotations

import numpy as np

WINDOW, GRAM = 100, 32
#: Bytes that a window may have before its anchor.
BEFORE = WINDOW - GRAM
CONTEXT = BEFORE + WINDOW
#: Bytes of texts worked on at a time, so that their hashes stay in the cache.
PIECE = 1 << 16


def _mix(a: np.ndarray) -> np.ndarray:
    a = a ^ (a >> np.uint64(32))
    a *= np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(29)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(32)
    return a


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at every position that has as many."""
    n = len(data)
    words = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data).data, strides=(1,))
    h = _mix(words + np.uint64(0x1234567))
    h = _mix(h[:-8] * np.uint64(3) + h[8:])
    return _mix(h[:-16] * np.uint64(5) + h[16:])


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """of (minimum or maximum) over every `width` consecutive values."""
    done = 1
    while 2 * done <= width:
        x = of(x[:-done], x[done:])
        done *= 2
    return of(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, context hashes) of a text's anchors, in order; none below WINDOW bytes."""
    return text_anchors(data, np.array([0, len(data)]))[1:]


def text_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, positions, gram hashes, context hashes) of the anchors of many texts, in order; text k is data[offsets[k] : offsets[k + 1]]."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(none, *anchor_pieces(data, offsets), strict=True))


def anchor_pieces(data: np.ndarray, offsets: np.ndarray):
    """The same piece by piece, as texts of one repeated byte have an anchor at every position."""
    last = int(offsets[-1])
    for at in range(int(offsets[0]), last, PIECE):
        yield _piece_anchors(data, offsets, at, min(last, at + PIECE))


def _piece_anchors(data: np.ndarray, offsets: np.ndarray, start: int, stop: int):
    low, high = max(int(offsets[0]), start - WINDOW), min(int(offsets[-1]), stop + 2 * WINDOW)
    if high - low < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = _gram_hashes(data[low:high])
    width = BEFORE + 1
    least = _sliding(h, width, np.minimum)
    # no window reaches from one text into the next
    for edge in offsets[np.searchsorted(offsets, low, "right") : np.searchsorted(offsets, high)].tolist():
        least[max(0, edge - low - WINDOW + 1) : edge - low] = 0
    none = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate([none, least, none]), width, np.maximum)
    at = np.flatnonzero(most == h)
    at = at[(at + low >= start) & (at + low < stop)]
    place = at + low
    text = np.searchsorted(offsets, place, "right") - 1
    pos = place - offsets[text]
    left, right = np.minimum(pos, BEFORE), np.minimum(offsets[text + 1] - place, WINDOW)
    x = _mix((left * 256 + right).astype(np.uint64))
    for offset in (-BEFORE, -BEFORE + GRAM, -BEFORE + 2 * GRAM, -BEFORE + 3 * GRAM, -BEFORE + 4 * GRAM, WINDOW - GRAM):
        block = np.clip(offset, -left, right - GRAM)
        x = _mix(x * np.uint64(7) + h[at + block])
    return text, pos, h[at], x


def row_hashes(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of CONTEXT bytes, from its own start value."""
    words = np.zeros((len(rows), -(-CONTEXT // 8) * 8), np.uint8)
    words[:, :CONTEXT] = rows
    words, h = words.view("<u8"), start
    for k in range(words.shape[1]):
        h = _mix(h * np.uint64(3) + words[:, k])
    return h


class _RangeMinimum:
    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of values[first..last], both inclusive."""
        level = np.log2(last - first + 1).astype(np.int64)
        out = np.empty(len(first), self.rows[0].dtype)
        for k in np.unique(level):
            own = level == k
            row = self.rows[k]
            out[own] = np.minimum(row[first[own]], row[last[own] - (1 << k) + 1])
        return out


def maximal_repeats(group: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Maximal repeats of WINDOW bytes or more around anchors, as an interval tree gives them.

    Row i is a context of CONTEXT bytes with its anchor at BEFORE; left and right
    are the bytes that it has before the anchor and from it on. Rows of one group
    have one anchor. Yields (l, rows, length): the rows, all occurrences, share
    `length` bytes that start l bytes before their anchors, and neither end can be
    extended for all of them.

    The suffixes that start l bytes before the anchors are sorted for each l: by
    the l bytes before it, then by what follows. Suffixes that share those bytes
    are a block; within it the common prefix of neighbours is l and the least of
    the right parts' common prefixes between them. A scan with a stack finds the
    intervals of common prefixes; those whose members all have one byte to the
    left are not left-maximal and are left to the next l.
    """
    n = len(group)
    words = np.zeros((n, 104), np.uint8)
    words[:, :WINDOW] = context[:, BEFORE:]
    order = np.lexsort([*np.ascontiguousarray(words).view(">u8").T[::-1], group])
    group, context, left, right = group[order], context[order], left[order], right[order]
    same = context[1:, BEFORE:] == context[:-1, BEFORE:]
    shared = np.where(same.all(axis=1), WINDOW, same.argmin(axis=1))
    shared = np.minimum(shared, np.minimum(right[1:], right[:-1]))
    shared = np.r_[0, np.where(group[1:] == group[:-1], shared, 0)].astype(np.int16)
    least = _RangeMinimum(shared)

    rows = np.arange(n)  # sorted by (block, rank)
    block = np.r_[0, np.cumsum(group[1:] != group[:-1])]
    for l in range(BEFORE + 1):  # noqa: E741
        # only blocks of two or more can hold repeats
        alike = block[1:] == block[:-1]
        several = np.r_[False, alike] | np.r_[alike, False]
        rows, block = rows[several], block[several]
        if not len(rows):
            return
        joined = np.flatnonzero(block[1:] == block[:-1])
        common = np.zeros(len(rows), np.int64)
        common[joined + 1] = l + least(rows[joined] + 1, rows[joined + 1])
        # the byte to the left; a context's own end is unlike any other
        byte = np.where(left[rows] > l, context[rows, max(0, BEFORE - l - 1)].astype(np.int64), 256 + np.arange(len(rows)))
        if l == BEFORE:
            byte = 256 + np.arange(len(rows))
        yield from _intervals(l, rows, common, byte, order)
        if l == BEFORE:
            return
        keep = byte < 256
        key = block[keep].astype(np.int64) * 256 + byte[keep]
        resort = np.lexsort([rows[keep], key])
        rows, key = rows[keep][resort], key[resort]
        block = np.r_[0, np.cumsum(key[1:] != key[:-1])] if len(key) else key


def _intervals(l: int, rows: np.ndarray, common: np.ndarray, byte: np.ndarray, order: np.ndarray):  # noqa: E741
    """Left-maximal intervals of common prefixes of WINDOW or more among sorted suffixes."""
    inside = common >= WINDOW
    if not inside.any():
        return
    start = np.flatnonzero(inside & ~np.r_[False, inside[:-1]]) - 1
    stop = np.flatnonzero(inside & ~np.r_[inside[1:], False])
    size = stop - start + 1
    diverse = np.minimum.reduceat(byte, np.c_[start, stop + 1].ravel()[: None if stop[-1] + 1 < len(byte) else -1])[::2] != np.maximum.reduceat(
        byte, np.c_[start, stop + 1].ravel()[: None if stop[-1] + 1 < len(byte) else -1]
    )[::2]
    for a, b, k in zip(start[diverse].tolist(), stop[diverse].tolist(), size[diverse].tolist(), strict=True):
        if k == 2:
            yield l, order[rows[a : b + 1]], int(common[b])
            continue
        values, bytes_ = common[a + 1 : b + 1].tolist(), byte[a : b + 1].tolist()
        stack = [[values[0], 0, bytes_[0], bytes_[0]]]  # common prefix, first suffix, least and greatest byte
        for i in range(1, k + 1):
            value = values[i] if i < k - 1 else -1
            if i == k:
                break
            x = bytes_[i]
            stack[-1][2], stack[-1][3] = min(stack[-1][2], x), max(stack[-1][3], x)
            first, low, high = i, x, x
            while stack and value < stack[-1][0]:
                prefix, first, low, high = stack.pop()
                if low != high:
                    yield l, order[rows[a + first : a + i + 1]], prefix
                if stack:
                    stack[-1][2], stack[-1][3] = min(stack[-1][2], low), max(stack[-1][3], high)
            if value >= 0 and (not stack or value > stack[-1][0]):
                stack.append([value, first, low, high])
