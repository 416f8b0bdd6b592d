"""Compressed bitmaps of numbers under 65,536, many at a time: a sorted list of 16-bit numbers, or, with LISTED of them
or more, 65,536 bits. The length of the bytes tells which."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPAN, LISTED = 1 << 16, 4096
_BITS = SPAN // 8


def pack(group: np.ndarray, number: np.ndarray, groups: int) -> pa.Array:
    """A bitmap for each of `groups` groups; rows (group, number) are distinct and in order."""
    sizes = np.bincount(group, minlength=groups)
    number = number.astype("<u2")
    dense = np.flatnonzero(sizes >= LISTED)
    if not len(dense):
        data, lengths = number.tobytes(), 2 * sizes
    else:
        ends, parts, at = np.cumsum(sizes), [], 0
        for g in dense:
            parts.append(number[at : ends[g] - sizes[g]].tobytes())
            bits = np.zeros(SPAN, np.uint8)
            bits[number[ends[g] - sizes[g] : ends[g]]] = 1
            parts.append(np.packbits(bits, bitorder="little").tobytes())
            at = ends[g]
        data = b"".join([*parts, number[at:].tobytes()])
        lengths = np.where(sizes >= LISTED, _BITS, 2 * sizes)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), groups, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def unpack(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows (place in the array, number) of an array of bitmaps, in order. None may be null."""
    n = len(bitmaps)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    offsets = np.frombuffer(bitmaps.buffers()[1], np.int32, n + 1, 4 * bitmaps.offset).astype(np.int64)
    data = np.frombuffer(bitmaps.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    lengths = np.diff(offsets)
    dense = np.flatnonzero(lengths == _BITS)
    if not len(dense):
        return np.repeat(np.arange(n), lengths // 2), data.view("<u2").astype(np.int64)
    offsets -= offsets[0]
    places, numbers, at = [], [], 0

    def listed(first: int, last: int) -> None:
        places.append(np.repeat(np.arange(first, last), lengths[first:last] // 2))
        numbers.append(np.ascontiguousarray(data[offsets[first] : offsets[last]]).view("<u2").astype(np.int64))

    for g in dense:
        listed(at, g)
        found = np.flatnonzero(np.unpackbits(data[offsets[g] : offsets[g + 1]], bitorder="little"))
        places.append(np.full(len(found), g))
        numbers.append(found)
        at = g + 1
    listed(at, n)
    return np.concatenate(places), np.concatenate(numbers)
