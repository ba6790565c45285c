"""Vectorised helpers on Arrow string columns (UTF-8 bytes), used inside Spark tasks.

All functions take plain numpy arrays; nothing here touches Spark or the driver.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Text bytes handled at once; bounds a task's memory whatever the batch holds.
SLICE_BYTES = 1 << 19

_pow: dict[int, np.ndarray] = {}


def give_back() -> None:
    """Return freed memory to the system: a worker that is kept for later stages should not keep what it no longer uses."""
    _pow.clear()
    _prime_pow.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run):
    """A function over Arrow batches that gives memory back when its task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1), base, dtype=U)
        out[0] = 1
        have = _pow[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: One 64-bit code for each byte value.
BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(BASE))
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Cut a string column into row ranges of about `limit` bytes (a longer text stands alone)."""
    data, off = string_parts(column)
    start, n = 0, len(off) - 1
    while start < n:
        stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop, data[off[start] : off[stop]], off[start : stop + 1] - off[start]
        start = stop


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """S with S[j] = sum of codes[i] * BASE**i over i < j."""
    out = np.zeros(len(codes) + 1, dtype=U)
    np.cumsum(codes * powers(BASE, len(codes)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of codes[start:stop] for each pair, the same wherever the codes stand."""
    inv = powers(BASE_INV, len(prefix))
    return mix((prefix[stop] - prefix[start]) * inv[start])


#: A second modulus. Modulo 2**64 some pairs of texts (long Thue-Morse strings) have equal hashes whatever the base; a prime tells them apart.
PRIME = (1 << 31) - 1
PRIME_BASE = 0x3B9ACA07
_prime_pow: dict[int, np.ndarray] = {}


def _prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME, by doubling."""
    have = _prime_pow.get(base)
    if have is None:
        have = np.ones(1, dtype=U)
    while len(have) < n:
        have = np.concatenate([have, have * U(pow(base, len(have), PRIME)) % U(PRIME)])
    _prime_pow[base] = have
    return have[:n]


def prime_hash(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo PRIME of data[start:stop] for each pair, the same wherever the bytes stand."""
    term = (BYTE_CODE >> U(33))[data] * _prime_powers(PRIME_BASE, len(data))
    prefix = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((term & U(PRIME)) + (term >> U(31)), out=prefix[1:])  # below 2**32 each
    inverse = _prime_powers(pow(PRIME_BASE, -1, PRIME), len(prefix))
    return (prefix[stop] - prefix[start]) % U(PRIME) * inverse[start] % U(PRIME)


def text_hash(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """range_hash and prime_hash in one number: for texts of any length whose equality is decided by it."""
    return mix(range_hash(prefix, start, stop) + prime_hash(data, start, stop) * U(BASE))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row) of each maximal run of bytes other than space and 9..13; runs end with their text."""
    inside = ~SPACE[data]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    head[cuts] = inside[cuts]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    tail[cuts - 1] = inside[cuts - 1]
    start, stop = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return start, stop, np.searchsorted(off, start, side="right") - 1
