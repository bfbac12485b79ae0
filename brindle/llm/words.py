"""Words of Arrow text columns as 64-bit hashes, a whole batch at a time in numpy.

A hash is made of a word's bytes, eight at a time.  At n distinct words the chance that
any two share one is about n**2 / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of `[^\x20\x09-\x0D]+`: all but the ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Well mixed 64-bit values of 64-bit values; other salts give other values."""
    h = (h + np.uint64((salt * 0x632BE59BD9B4E019 + 0x2545F4914F6CDD1D) & (2**64 - 1))) * _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, null as empty, and the offsets of its rows (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offs) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are `inside`; no run crosses rows."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = inside[data]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first = on.copy()
    first[1:] &= ~on[:-1]
    first[cuts] = on[cuts]
    last = on.copy()
    last[:-1] &= ~on[1:]
    last[cuts - 1] = on[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes."""
    size = ends - starts
    h = mix(size.astype(np.uint64))
    if len(starts) == 0:
        return h
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    which, at, left, own = slice(None), starts, size, h
    while True:
        own = own ^ (eight[at] & _MASK[np.minimum(left, 8)])
        own *= _M1
        own ^= own >> _S
        own *= _M2
        own ^= own >> np.uint64(29)
        h[which] = own
        more = np.flatnonzero(left > 8)
        if len(more) == 0:
            return h
        which = more if isinstance(which, slice) else which[more]
        at, left, own = at[more] + 8, left[more] - 8, own[more]


def hashed_words(column, inside: np.ndarray = SPACED, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a text column in order, and where each row's begin (one more than rows)."""
    data, offs = text_bytes(column)
    if lower:
        data = LOWER[data]
    starts, ends = spans(data, offs, inside)
    return hash_spans(data, starts, ends), np.searchsorted(starts, offs)


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their values, and where in it each distinct value begins.

    Sorts values whose low bits are replaced by their positions, several times as fast as argsort.
    """
    n = len(h)
    bits = np.uint64(max(1, int(n - 1).bit_length() if n else 1))
    packed = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    hs = h[order]
    packed >>= bits
    step = packed[1:] != packed[:-1]
    mixed = np.flatnonzero(~step & (hs[1:] != hs[:-1]))
    if len(mixed):  # distinct values that agree but for the bits replaced: few
        edges = np.concatenate(([0], np.flatnonzero(step) + 1, [n]))
        for r in np.unique(np.searchsorted(edges, mixed + 1, side="right") - 1):
            own = order[edges[r] : edges[r + 1]]
            own[:] = own[np.argsort(h[own], kind="stable")]
            hs[edges[r] : edges[r + 1]] = h[own]
    new = np.ones(n, dtype=bool)
    new[1:] = hs[1:] != hs[:-1]
    return order, np.flatnonzero(new)


def unique_inverse(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, each one's first position in the sort, and the number of each value's distinct one."""
    order, begin = grouped(h)
    number = np.zeros(len(h), dtype=np.int64)
    number[begin[1:]] = 1
    inverse = np.empty(len(h), dtype=np.int64)
    inverse[order] = np.cumsum(number)
    return h[order[begin]], order[begin], inverse


def lean() -> None:
    """Gives freed memory of this worker back, now and (for large arrays) whenever they are freed: workers outlive tasks."""
    import ctypes

    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD; setting it keeps it from growing
        libc.malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
    pa.default_memory_pool().release_unused()


def blocks(batches, text: str, most: int = 2 << 20):
    """Record batches cut so that their texts have about `most` bytes; a row is never cut."""
    lean()
    try:
        yield from _blocks(batches, text, most)
    finally:
        lean()


def _blocks(batches, text: str, most: int):
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.cumsum(size) // most
        edges = np.flatnonzero(np.diff(number)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of each row's values; begin as hashed_words gives it.  Rows without values have 0."""
    total = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype != bool else np.int64)
    np.cumsum(values, out=total[1:])
    return total[begin[1:]] - total[begin[:-1]]
