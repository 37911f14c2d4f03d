"""XXH64 of word shingles and their SimHash, for many texts at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SEED = 42
#: Bytes of text worked on at a time; longer texts are cut between words.
PIECE = 1 << 19
#: Longer shingles are hashed one by one.
VECTOR_BYTES = 160

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def _xxh64_same_length(eight: np.ndarray, four: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """XXH64 of the spans of one length that start at `at`; eight and four are data's words at every byte."""
    done = 0
    if length >= 32:
        whole = 2**64 - 1
        starts = (SEED + int(_P1) + int(_P2), SEED + int(_P2), SEED, SEED - int(_P1))
        v = [np.full(len(at), np.uint64(x & whole), np.uint64) for x in starts]
        while done + 32 <= length:
            v = [_round(x, eight[at + (done + 8 * i)]) for i, x in enumerate(v)]
            done += 32
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ _round(np.uint64(0), x)) * _P1 + _P4
        h = h + np.uint64(length)
    else:
        h = np.full(len(at), np.uint64(SEED) + _P5 + np.uint64(length), np.uint64)
    while done + 8 <= length:
        h = _rotl(h ^ _round(np.uint64(0), eight[at + done]), 27) * _P1 + _P4
        done += 8
    if done + 4 <= length:
        h = _rotl(h ^ (four[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
        done += 4
    while done < length:
        h = _rotl(h ^ (data[at + done].astype(np.uint64) * _P5), 11) * _P1
        done += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64, seed 42, of data[start:end] for each span; spans aren't empty."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", padded.data, strides=(1,))
    four = np.ndarray((len(data),), "<u4", padded.data, strides=(1,))
    length = end - start
    out = np.empty(len(start), np.uint64)
    order = np.argsort(np.minimum(length, VECTOR_BYTES + 1).astype(np.uint16), kind="stable")
    sizes = np.bincount(np.minimum(length, VECTOR_BYTES + 1), minlength=VECTOR_BYTES + 2)
    at = 0
    for n in np.flatnonzero(sizes):
        own = order[at : at + sizes[n]]
        at += sizes[n]
        if n <= VECTOR_BYTES:
            out[own] = _xxh64_same_length(eight, four, data, start[own], int(n))
        else:
            raw = data.tobytes()
            out[own] = [xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)]
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray, words: int):
    """(text, start, end) of at most about PIECE bytes; a cut text's pieces overlap by words - 1 words."""
    for k in range(len(offsets) - 1):
        at, stop = int(offsets[k]), int(offsets[k + 1])
        while stop - at > PIECE:
            cut = at + PIECE
            space = np.flatnonzero(_SPACE[data[cut:stop]][: 1 << 20])
            if not len(space):
                break
            cut += int(space[0])
            inside = ~_SPACE[data[at:cut]]
            words_at = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
            if len(words_at) < words:
                break
            yield k, at, cut
            at = at + int(words_at[1 - words]) if words > 1 else cut
        yield k, at, stop


def _groups(texts: pa.Array, words: int):
    """The texts' bytes, and their pieces in groups of about PIECE bytes."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    held, size = [], 0
    for piece in _pieces(data, offsets, words):
        held.append(piece)
        size += piece[2] - piece[1]
        if size >= PIECE:
            yield data, held
            held, size = [], 0
    if held:
        yield data, held


def simhashes(texts: pa.Array, words: int) -> np.ndarray:
    """The SimHash of each text over its shingles of so many words; zero without words.

    A bit is 1 if it is set in over half of the shingles' hashes, repeats included.
    """
    n = len(texts)
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    for data, held in _groups(texts, words):
        h, owner = _shingles(data, held, words)
        if not len(h):
            continue
        edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[owner[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
        total[owner[edge]] += np.diff(np.r_[edge, len(owner)])
    bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def shingle_sets(texts: pa.Array, words: int):
    """(text, hash) arrays of the texts' distinct shingles, in order of both; no text is in two of the yields."""
    kept = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for data, held in _groups(texts, words):
        h, owner = _shingles(data, held, words)
        h, owner = np.r_[kept[0], h], np.r_[kept[1], owner]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
        h, owner = h[first], owner[first]
        done = int(np.searchsorted(owner, held[-1][0]))  # the last text may go on
        kept = h[done:], owner[done:]
        if done:
            yield owner[:done], h[:done]
    if len(kept[0]):
        yield kept[1], kept[0]


def _shingles(data: np.ndarray, pieces: list, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the pieces' shingles, repeats included, by text."""
    gap = np.full(1, 0x20, np.uint8)
    buf = _LOWER[np.concatenate([x for _, a, b in pieces for x in (data[a:b], gap)])]
    begins = np.cumsum([0] + [b - a + 1 for _, a, b in pieces[:-1]])
    space = _SPACE[buf]
    inside = ~space
    word_at = np.flatnonzero(inside & np.r_[True, space[:-1]])
    if not len(word_at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    piece_of = np.searchsorted(begins, word_at, "right") - 1
    kept = inside | np.r_[False, inside[:-1]]  # words, each with one space behind it
    line = np.where(space, np.uint8(0x20), buf)[kept]
    ends = np.flatnonzero(line == 0x20)
    starts = np.r_[0, ends[:-1] + 1]
    first = np.flatnonzero(np.r_[True, piece_of[1:] != piece_of[:-1]])
    count = np.diff(np.r_[first, len(piece_of)])
    last = len(word_at) - words + 1
    if last > 0:
        whole = np.flatnonzero(piece_of[:last] == piece_of[words - 1 :])
    else:
        whole = np.zeros(0, np.int64)
    few = first[count < words]  # all words of a text that has fewer
    few_end = few + count[count < words] - 1
    begin = np.r_[starts[whole], starts[few]]
    end = np.r_[ends[whole + words - 1], ends[few_end]]
    owner = np.r_[piece_of[whole], piece_of[few]]
    h = xxh64_spans(line, begin, end)
    order = np.argsort(owner, kind="stable")
    return h[order], np.array([k for k, _, _ in pieces])[owner[order]]
