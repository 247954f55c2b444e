"""Vectorised pre-tokenization for two byte-pair tokenizers, and a memo of pre-token encodings.

A text made of code points whose class is beyond doubt (ASCII, Latin-1, Latin
Extended-A, general punctuation) is split by array operations exactly as the
tokenizer's own pattern splits it; any other text, and one that holds a
special token's string, is left to the tokenizers library as a whole.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata

import numpy as np
import pyarrow as pa

from ._text import mix, slices, text_buffers, unit_hashes

_U = np.uint64
OTHER, LETTER, NUMBER, SPACE, UNSURE = 0, 1, 2, 3, 4
_TOP = 0x2028


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point below _TOP."""
    table = np.full(_TOP, UNSURE, np.uint8)
    for i in [*range(0x180), *range(0x2010, _TOP)]:
        kind = unicodedata.category(chr(i))[0]
        table[i] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    for i in (9, 10, 11, 12, 13, 32, 0x85, 0xA0):
        table[i] = SPACE
    table[0x130] = UNSURE  # its lower case is two code points
    return table


@functools.cache
def lower() -> np.ndarray:
    table = np.arange(_TOP, dtype=np.uint32)
    for i in [*range(0x130), *range(0x131, 0x180)]:
        table[i] = ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i
    return table


def decoded(part: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the texts' offsets in them."""
    if not len(part) or part.max() < 0x80:
        return part.astype(np.uint32), o
    points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.zeros(len(part) + 1, np.int64)
    np.cumsum((part & 0xC0) != 0x80, out=at[1:])
    return points, at[o]


def unsure_texts(points: np.ndarray, at: np.ndarray, special: str = "<|") -> np.ndarray:
    """Whether each text must be left to the library."""
    odd = np.concatenate([[0], np.cumsum(classes()[np.minimum(points, _TOP - 1)] == UNSURE)]) if len(points) else np.zeros(1, int)
    if len(points) and points.max() >= _TOP:
        odd = np.concatenate([[0], np.cumsum((points >= _TOP) | (classes()[np.minimum(points, _TOP - 1)] == UNSURE))])
    bad = odd[at[1:]] > odd[at[:-1]]
    hit = np.flatnonzero((points[:-1] == ord(special[0])) & (points[1:] == ord(special[1])))
    if len(hit):
        bad[np.searchsorted(at, hit, "right") - 1] = True
    return bad


_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _contractions(points: np.ndarray, kind: np.ndarray, first: np.ndarray, room: np.ndarray, eligible: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where 's, 't, 're, 've, 'm, 'll or 'd begin and end. room: the end of the text that each place is in."""
    p = np.flatnonzero((points == 39) & eligible)
    if not len(p):
        return p, p
    end = np.zeros(len(p), np.int64)
    last = room[np.searchsorted(first, p, "right") - 1]
    for c in _CONTRACTIONS:
        ok = p + len(c) < last
        for x, ch in enumerate(c):
            ok &= points[np.minimum(p + 1 + x, len(points) - 1)] == ord(ch)
        end = np.where((end == 0) & ok, p + 1 + len(c), end)
    return p[end > 0], end[end > 0]


def byte_level_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Begins of the pre-tokens of 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ (they cover all of a text)."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = at[:-1][at[1:] > at[:-1]]
    room = at[1:][at[1:] > at[:-1]]
    edge = np.zeros(n + 1, bool)
    edge[first] = edge[n] = True
    change = edge[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    begin = change.copy()
    # The last white space before other characters: a blank joins them, anything else stands alone.
    nxt = np.zeros(n, bool)
    nxt[:-1] = ~space[1:] & ~edge[1:n]
    last = np.flatnonzero(space & nxt)
    begin[last] = True
    blank = last[points[last] == 32]
    begin[blank + 1] = False
    # An apostrophe that begins a run of other characters, with no blank before it.
    alone = change & (kind == OTHER)
    alone[1:] &= (points[:-1] != 32) | edge[1:n]
    p, end = _contractions(points, kind, first, room, alone)
    if len(p):
        stop = end[end < n]
        begin[p + 1] = False
        begin[stop] = True
    return np.flatnonzero(begin)


def word_level_spans(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the matches of 's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+ in lower-cased code points."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    first = at[:-1][at[1:] > at[:-1]]
    room = at[1:][at[1:] > at[:-1]]
    edge = np.zeros(n + 1, bool)
    edge[first] = edge[n] = True
    change = edge[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    begin = change | (kind == NUMBER)
    p, end = _contractions(points, kind, first, room, change & (kind == OTHER))
    if len(p):
        begin[p + 1] = False
        begin[end[end < n]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    word = kind[starts] != SPACE
    return starts[word], ends[word]


@functools.cache
def point_table() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(_TOP, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15)) | _U(1)


def pretoken_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return unit_hashes(points, point_table(), starts, ends)


def spread(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one span after another."""
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def same_spans(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether a[start:end] is b[start:end], for each two spans."""
    size = a_ends - a_starts
    same = size == b_ends - b_starts
    at = np.flatnonzero(same)
    size = size[at]
    odd = a[spread(a_starts[at], size)] != b[spread(b_starts[at], size)]
    if odd.any():
        same[at[np.searchsorted(np.cumsum(size), np.flatnonzero(odd), "right")]] = False
    return same


def distinct(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of spans (pre-tokens, by default) in order, one place of each, and which one each span has.

    Hashes only sort: code points are compared, and a span that shares a hash
    with another one gets the next number that is free as its own.
    """
    keys = pretoken_hashes(points, starts, ends) if keys is None else keys.copy()
    while True:
        values, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        same = same_spans(points, starts, ends, points, starts[where[inverse]], ends[where[inverse]])
        if same.all():
            return values, where, inverse
        with np.errstate(over="ignore"):
            keys[~same] += _U(1)


def strings_of(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    if not len(starts):
        return []
    flat = points.astype("<u4").tobytes().decode("utf-32-le")
    return [flat[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def put(pool: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """A pool of which so much is used, with more put after it; a larger one if need be."""
    while used + len(new) > len(pool):
        pool = np.concatenate([pool, np.zeros(len(pool), pool.dtype)])
    pool[used : used + len(new)] = new
    return pool


class Memo:
    """Encodings of pre-tokens, found by a hash of their code points and taken only if those are the same.

    Most different pre-tokens of a corpus stand in it once, so one is kept
    when it is met again; a table of bits tells.  Grows to ``most`` pre-tokens
    and then starts again.  ``encode`` takes a list of strings and gives a list
    of id lists.  Places in the pool hold until the next look.
    """

    #: Bits of the table of what was met, and pre-tokens after which it starts again.
    BITS, MET = 23, 2_000_000

    def __init__(self, encode, most: int = 400_000) -> None:
        self.encode, self.most = encode, most
        self.met, self.n_met = np.zeros(1 << self.BITS, bool), 0
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, _U), np.zeros((0, 4), np.int32)  # place and number of ids, begin and end of code points
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.points, self.n_points = np.zeros(1 << 16, np.uint32), 0

    def _encoded(self, strings: list[str], keep: bool) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of strings, whose ids now are in the pool, to stay or up to the next look."""
        lists = self.encode(strings)
        size = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(size.sum()))
        self.ids = put(self.ids, self.n_ids, flat)
        at = self.n_ids + np.cumsum(size) - size
        if keep:
            self.n_ids += len(flat)
        return at, size

    def _add(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        at, size = self._encoded(strings_of(points, starts, ends), True)
        flat = points[spread(starts, ends - starts)]
        self.points = put(self.points, self.n_points, flat)
        stop = self.n_points + np.cumsum(ends - starts)
        self.n_points += len(flat)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.rows = np.insert(self.rows, place, np.stack([at, size, stop - (ends - starts), stop], axis=1).astype(np.int32), axis=0)

    def look_distinct(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in pool, number of ids) of different pre-tokens, given with their hashes in order."""
        if len(self.keys) + len(keys) > self.most or max(self.n_points, self.n_ids) > 16 * self.most:
            self.clear()
        here = np.zeros(len(keys), bool)
        place = np.searchsorted(self.keys, keys)
        inside = place < len(self.keys)
        here[inside] = self.keys[place[inside]] == keys[inside]
        new = np.flatnonzero(~here)
        slot = keys[new] >> _U(64 - self.BITS)
        again = new[self.met[slot]]
        if self.n_met > self.MET:
            self.met[:], self.n_met = False, 0
        self.met[slot] = True
        self.n_met += len(new) - len(again)
        if len(again):
            self._add(keys[again], points, starts[again], ends[again])
            here[again] = True
            place = np.searchsorted(self.keys, keys)
        rows = self.rows[place[here]].astype(np.int64)
        at, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[here], size[here] = rows[:, 0], rows[:, 1]
        here[here] = same_spans(points, starts[here], ends[here], self.points, rows[:, 2], rows[:, 3])
        once = np.flatnonzero(~here)  # those met for the first time, and those whose hash another one has here
        if len(once):
            at[once], size[once] = self._encoded(strings_of(points, starts[once], ends[once]), False)
        return at, size

    def look(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in pool, number of ids) of each pre-token."""
        keys, where, inverse = distinct(points, starts, ends)
        at, size = self.look_distinct(keys, points, starts[where], ends[where])
        return at[inverse], size[inverse]

    def gather(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of pre-tokens, one after another."""
        return self.ids[spread(at, size)]


def text_slices(column: pa.Array):
    """(first text, texts, bytes, byte offsets, code points, their offsets, which texts are unsure) of slices of a column."""
    data, offs = text_buffers(column)
    for i, j in slices(offs):
        part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        points, at = decoded(part, o)
        yield i, j, part, o, points, at, unsure_texts(points, at)


@functools.cache
def tokenizer(path: str):
    """The tokenizer of a file, without truncation or padding; once in each worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def library_ids(path: str):
    t = tokenizer(path)
    return lambda strings: [e.ids for e in t.encode_batch_fast(strings, add_special_tokens=False)]


@functools.cache
def worker_memo(path: str) -> Memo:
    """One memo for a tokenizer in each worker, kept from task to task."""
    return Memo(library_ids(path))
