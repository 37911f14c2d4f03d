"""A counting quotient filter over 64-bit fingerprints, in numpy.

A fingerprint splits into a block, a quotient and a remainder. A block's filter
holds its quotients' runs in order: `occupied` has a bit for each quotient with a
run, `run_ends` a bit for each slot that ends one, then come the remainders,
sorted within each run, and their counts. The quotient has as many bits as the
filter's own load asks for, and remainders and counts as many bytes as they need,
so a filter of few fingerprints is small. All 64 bits are kept: a filter gives
back exactly the fingerprints and counts that went in, and merging loses nothing.
"""

from __future__ import annotations

import numpy as np

#: Slots, quotient bits, bytes of a remainder and of a count.
_HEAD = np.dtype([("slots", "<u4"), ("quotient_bits", "u1"), ("remainder", "u1"), ("count", "u1")])


def block_of(fingerprints: np.ndarray, block_bits: int) -> np.ndarray:
    return (fingerprints >> np.uint64(64 - block_bits)).astype(np.int64)


def counted(fingerprints: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, with the sums of their counts."""
    if not len(fingerprints):
        return fingerprints.astype(np.uint64), np.zeros(0, np.int64)
    order = np.argsort(fingerprints, kind="stable")
    ordered = fingerprints[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    ones = np.ones(len(ordered), np.int64) if counts is None else counts[order].astype(np.int64)
    return ordered[starts], np.add.reduceat(ones, starts)


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    """(bytes of a value, the values in little-endian order), in as few bytes as the greatest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return width, values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, at: int, slots: int, width: int) -> np.ndarray:
    whole = np.zeros((slots, 8), np.uint8)
    whole[:, :width] = np.frombuffer(data, np.uint8, slots * width, at).reshape(slots, width)
    return whole.view("<u8").ravel()


def encode(fingerprints: np.ndarray, counts: np.ndarray, block_bits: int) -> bytes:
    """One block's filter from its distinct fingerprints in order."""
    bits = min(64 - block_bits - 1, len(fingerprints).bit_length())
    remainder_bits = np.uint64(64 - block_bits - bits)
    quotient = (fingerprints >> remainder_bits) & np.uint64((1 << bits) - 1)
    remainder = fingerprints & np.uint64((1 << int(remainder_bits)) - 1)
    occupied = np.zeros(1 << bits, np.uint8)
    occupied[quotient.astype(np.int64)] = 1
    run_ends = np.r_[quotient[1:] != quotient[:-1], True].astype(np.uint8)
    (wide, remainders), (count_wide, all_counts) = _packed(remainder), _packed(counts.astype(np.uint64))
    head = np.array([(len(fingerprints), bits, wide, count_wide)], _HEAD)
    return b"".join((head.tobytes(), np.packbits(occupied).tobytes(), np.packbits(run_ends).tobytes(), remainders, all_counts))


def decode(data: bytes, block: int, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's fingerprints, in order, and counts."""
    slots, bits, wide, count_wide = map(int, np.frombuffer(data, _HEAD, 1)[0])
    at = _HEAD.itemsize
    occupied = np.unpackbits(np.frombuffer(data, np.uint8, ((1 << bits) + 7) // 8, at))
    at += ((1 << bits) + 7) // 8
    run_ends = np.unpackbits(np.frombuffer(data, np.uint8, (slots + 7) // 8, at))[:slots]
    at += (slots + 7) // 8
    remainder = _unpacked(data, at, slots, wide)
    counts = _unpacked(data, at + wide * slots, slots, count_wide).astype(np.int64)
    run = np.r_[0, np.cumsum(run_ends)[:-1]].astype(np.int64)
    quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
    remainder_bits = np.uint64(64 - block_bits - bits)
    return (np.uint64(block) << np.uint64(64 - block_bits)) | (quotient << remainder_bits) | remainder, counts


def merge(parts: list[bytes], block: int, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and summed counts of one block's filters from many partitions.

    Each filter gives a sorted run; numpy's stable sort finds the runs and merges them.
    """
    decoded = [decode(p, block, block_bits) for p in parts]
    return counted(np.concatenate([f for f, _ in decoded]), np.concatenate([c for _, c in decoded]))
