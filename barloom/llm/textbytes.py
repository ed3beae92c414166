"""Numpy helpers on the UTF-8 bytes of a batch of texts, used inside Arrow batches.

A batch is handled in slabs: whole texts, about ``SLAB`` bytes together (one text
longer than that is a slab of its own), so working memory does not follow the
size of the table.
"""

import numpy as np
import pyarrow as pa

SLAB = 1 << 20
#: ASCII white space, as the words of every operator are cut.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Run hashes are two polynomials modulo this prime: modulo a power of two, texts made by substitution (Thue-Morse) meet.
PRIME = (1 << 31) - 1
_P, _HALF = np.uint64(PRIME), np.uint64(31)
_BASES = (1_664_525_013, 1_103_515_247)
_powers = {"pow": np.ones((2, 1), np.uint64), "inv": np.ones((2, 1), np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(kind: str, n: int) -> np.ndarray:
    """Powers of both bases, or of their inverses, from 0 to n - 1 at least."""
    have = _powers[kind]
    while have.shape[1] < n:
        size = have.shape[1]
        step = np.array([[pow(base if kind == "pow" else pow(base, -1, PRIME), size, PRIME)] for base in _BASES], np.uint64)
        have = _powers[kind] = np.concatenate([have, have * step % _P], axis=1)
    return have


def text_column(column) -> pa.Array:
    """One string array without nulls: a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def slabs(column, limit: int = SLAB):
    """Yields (first row, row after the last, bytes, offsets of the texts in them)."""
    column = text_column(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the words, and the index of each text's first word (one more at the end)."""
    n = len(data)
    solid = ~WHITE[data]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of both polynomials over bytes or 64-bit hashes, for run_hash."""
    n = len(values)
    if values.dtype == np.uint8:
        lanes = (values.astype(np.uint64) + np.uint64(1),) * 2
    else:
        lanes = (values & _P, values >> np.uint64(33))
    total, powers = np.zeros((2, n + 1), np.uint64), _table("pow", n)
    for k in range(2):
        term = lanes[k] * powers[k, :n]
        if values.dtype != np.uint8 or n > 1 << 23:  # else the sum stays below 2**64 anyway
            term = (term & _P) + (term >> _HALF)
        np.cumsum(term, out=total[k, 1:])
    return total


def run_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of 62 bits of each run from starts to ends, mixed over 64, whatever its length in constant time (Karp-Rabin)."""
    inverse = _table("inv", total.shape[1])
    low, high = ((total[k, ends] - total[k, starts]) % _P * inverse[k, starts] % _P for k in range(2))
    return mix((low | high << _HALF) + (ends - starts).astype(np.uint64) * GOLD)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes."""
    return run_hash(running(data), starts, ends)


def shingles(h: np.ndarray, at: np.ndarray, k: int):
    """Hashes of the k-word shingles of texts whose word hashes are h[at[i]:at[i + 1]].

    A text with fewer words (one at least) has its whole sequence as one shingle.
    Returns the hashes and the offsets of each text's own.
    """
    counts = np.diff(at)
    m = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out = np.zeros(len(m) + 1, np.int64)
    np.cumsum(m, out=out[1:])
    text = np.repeat(np.arange(len(m)), m)
    begin = at[:-1][text] + (np.arange(out[-1]) - out[:-1][text])
    size = np.minimum(counts, k)[text]
    total = size.astype(np.uint64) * GOLD
    for j in range(k):
        there = size > j
        word = np.zeros(len(begin), np.uint64)
        word[there] = h[begin[there] + j]
        total = mix(total + word * np.uint64(2 * j + 3))
    return total, out


def distinct(h: np.ndarray, at: np.ndarray):
    """Sorted distinct hashes of each text, and their offsets."""
    parts = [np.unique(h[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    out = np.zeros(len(at), np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), out


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64) if values.dtype.kind != "f" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
