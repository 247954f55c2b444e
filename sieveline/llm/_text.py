"""Array kernels on the UTF-8 bytes of a batch of texts.

Words, word hashes and shingle hashes are computed for many texts at once on
the byte buffer of an Arrow column, without a Python string per word.  Every
separator the operators use is ASCII, so bytes and code points agree on where
words begin and end.

Hashes of short spans are polynomials modulo 2**64 over a random byte table,
with a mixing step at the end.  Some sequences of 2**10 letters (the Thue-Morse
word and its complement) agree under any such polynomial, so a span longer than
``LONG`` is hashed by BLAKE2b instead.  Two kinds (``salt``) are independent of
one another.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
SLICE = 1 << 19

#: Units of the longest span that is hashed by a polynomial.
LONG = 64

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes, in place."""
    with np.errstate(over="ignore"):
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
    return h


@functools.cache
def byte_table(salt: int) -> np.ndarray:
    """256 random odd numbers."""
    with np.errstate(over="ignore"):
        seed = np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt * 7919 + 1)
    return mix(seed) | _U(1)


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse modulo 2**64, kept from call to call up to a few slices."""
    have = _powers.get(salt)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        base = _BASES[salt]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, dtype=_U)
            p[0] = 1
            k = 1
            with np.errstate(over="ignore"):
                while k < size:
                    step = _U(pow(b, k, 1 << 64))
                    p[k : 2 * k] = p[:k] * step
                    k *= 2
            out.append(p)
        have = (out[0], out[1])
        if size <= 4 * SLICE:
            _powers[salt] = have
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """The hash of values[start:end] for each pair, whatever stands around it; sound where no span is longer than LONG."""
    fore, back = powers(len(values) + 1, salt)
    with np.errstate(over="ignore"):
        total = np.empty(len(values) + 1, dtype=_U)
        total[0] = 0
        np.cumsum(values * fore[: len(values)], out=total[1:])
        h = (total[ends] - total[starts]) * back[starts]
        h += (ends - starts).astype(_U) * _U(0xA0761D6478BD642F)
    return mix(h)


def digests(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 bits of BLAKE2b of units[start:end] for each pair."""
    raw = memoryview(np.ascontiguousarray(units)).cast("B")
    k, kind = units.dtype.itemsize, bytes([salt])
    out = b"".join(hashlib.blake2b(raw[a:b], digest_size=8, salt=kind).digest() for a, b in zip((starts * k).tolist(), (ends * k).tolist(), strict=True))
    return np.frombuffer(out, _U)


def unit_hashes(units: np.ndarray, table: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """The hash of units[start:end] for each pair; table gives a random number for each unit."""
    h = span_hashes(table[units], starts, ends, salt)
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        h[long] = digests(units, starts[long], ends[long], salt)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE):
    """Ranges of texts that hold at most so many bytes, or one text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _is_word(separators: str) -> np.ndarray:
    table = np.ones(256, bool)
    table[[ord(c) for c in separators]] = False
    return table


#: [^\x20\x09-\x0D]
SPACED = _is_word("\t\n\x0b\x0c\r ")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], of texts in lower case
ALNUM = _is_word("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = SPACED, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and the index of its text; no word goes on over a cut."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = np.empty(n + 1, bool)
    np.take(is_word, data, out=w[:n])
    w[n] = False
    edge = np.zeros(n + 1, bool)
    edge[offs] = True  # a text never continues the one before it
    if cuts is not None:
        edge[cuts] = True
    begin = w[:n].copy()
    begin[1:] &= ~w[: n - 1] | edge[1:n]
    end = w[:n] & (~w[1:] | edge[1:])
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def single_spaced(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts with one space before each, and where each word begins and ends in that."""
    size = ends - starts
    total = np.cumsum(size + 1)
    out = np.full(int(total[-1]), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[total - size - 1] = False
    out[inside] = part[SPACED[part]]
    return out, total - size, total


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    return unit_hashes(data, byte_table(salt), starts, ends, salt)


def shingle_hashes(wh: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words, by the first; len(wh) - n + 1 of them."""
    m = len(wh) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = np.zeros(m, _U)
    with np.errstate(over="ignore"):
        for j in range(n):
            out += wh[j : j + m] * _U((0x9E3779B97F4A7C15 * (2 * j + 3)) % (1 << 64) | 1)
            out ^= out >> _U(29)
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values; len(x) - w + 1 of them."""
    k, m = 1, x
    while 2 * k <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    rest = w - k
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
