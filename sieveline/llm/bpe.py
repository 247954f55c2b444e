"""BPE encoding and decoding: content-defined chunk reuse.

A text in lower case is cut wherever a rolling hash of its last ``WINDOW`` code
points says so, so that passages shared by documents are cut into the same
chunks, whatever stands before them.  A chunk is encoded when a worker meets it
first; later copies, in any document, take its ids from the worker's memory.
(Chunks stay where they are: sending each to one place and its ids back to
all documents would move the whole corpus twice.)

A cut may fall inside a word or a run of signs.  Where the chunks on both
sides reach the cut, the join is repaired: the two pre-tokens on either side
are encoded anew as one stretch, and the repair holds if its outermost
pre-tokens are exactly those the chunks have; otherwise, and for chunks of
less than ``LEAST`` pre-tokens, the whole text is encoded again.  A
pre-tokenizer that reads from left to right splits alike from any place where
two of its runs agree, so the repaired ids are those of the whole text.

Texts with code points beyond doubt go this way; all others, and those that
may hold a special token's string, are encoded by the library as a whole.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_batches
from ._pretok import distinct, lower, point_table, put, same_spans, spread, text_slices, tokenizer, word_level_spans, worker_memo
from ._text import digests, mix, powers

WINDOW = 16
#: One in so many places is a cut; none is nearer to the one before it than SHORTEST.
MEAN, SHORTEST = 1024, 128
#: Pre-tokens of the smallest chunk that is joined.
LEAST = 6
#: Ids of chunks that a worker keeps before it starts again, and for each at most so many code points.
POOL, POINTS = 2_000_000, 6

_U = np.uint64


def cuts(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins of chunks, and the text each is of; every text that isn't empty has one at its begin."""
    n = len(points)
    first = at[:-1][at[1:] > at[:-1]]
    marks = np.zeros(n, bool)
    if n > WINDOW:
        values = point_table()[points]
        fore, back = powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, _U), np.cumsum(values * fore[:n])])
            h = mix((total[WINDOW:] - total[:-WINDOW]) * back[: n + 1 - WINDOW])
        hit = np.flatnonzero((h & _U(MEAN - 1)) == 0) + WINDOW
        hit = hit[hit < n]
        keep = np.ones(len(hit), bool)
        keep[1:] = np.diff(hit) >= SHORTEST
        hit = hit[keep]
        text = np.searchsorted(at, hit, "right") - 1
        marks[hit[(hit - at[text] >= SHORTEST) & (at[text + 1] - hit >= SHORTEST)]] = True
    marks[first] = True
    starts = np.flatnonzero(marks)
    return starts, np.searchsorted(at, starts, "right") - 1


class Chunks:
    """Encodings of chunks, found by their hash and taken only if the code points are the same: ids, and where the first and last two pre-tokens lie."""

    #: Columns: place in pool, ids, pre-tokens; begin and end of the first two pre-tokens and their ids, of the last two likewise; begin and end of the code points.
    WIDTH = 3 + 2 * 6 + 2

    def __init__(self, path: str) -> None:
        self.memo = worker_memo(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, _U), np.zeros((0, self.WIDTH), np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.points, self.n_points = np.zeros(1 << 16, np.uint16), 0  # sure code points fit into 16 bits

    def look(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row for each chunk."""
        keys, where, inverse = distinct(points, starts, ends, digests(points, starts, ends))
        if self.used > POOL or self.n_points > POINTS * POOL:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        s, e = starts[where], ends[where]
        if not known.all():
            new = ~known
            fresh = self._encoded(points, s[new], e[new])
            flat = points[spread(s[new], (e - s)[new])]
            self.points = put(self.points, self.n_points, flat.astype(np.uint16))
            fresh[:, -1] = self.n_points + np.cumsum((e - s)[new])
            fresh[:, -2] = fresh[:, -1] - (e - s)[new]
            self.n_points += len(flat)
            self.keys, self.rows = np.insert(self.keys, place[new], keys[new]), np.insert(self.rows, place[new], fresh, axis=0)
            place = np.searchsorted(self.keys, keys)
        rows = self.rows[place]
        other = np.flatnonzero(~same_spans(points, s, e, self.points, rows[:, -2], rows[:, -1]))
        if len(other):  # another chunk has that hash here
            rows[other] = self._encoded(points, s[other], e[other])
        return rows[inverse]

    def _encoded(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of chunks whose ids now are in the pool."""
        size = ends - starts
        at = np.concatenate([[0], np.cumsum(size)])
        own = points[spread(starts, size)]
        s, e = word_level_spans(own, at)
        place, n = self.memo.look(own, s, e)
        ids = self.memo.gather(place, n)
        self.pool = put(self.pool, self.used, ids)
        total = np.concatenate([[0], np.cumsum(n)])
        bound = np.searchsorted(s, at)
        rows = np.zeros((len(starts), self.WIDTH), np.int64)
        rows[:, 0] = self.used + total[bound[:-1]]
        rows[:, 1] = total[bound[1:]] - total[bound[:-1]]
        rows[:, 2] = bound[1:] - bound[:-1]
        if len(s):
            for c, which in enumerate((bound[:-1], bound[:-1] + 1, bound[1:] - 2, bound[1:] - 1)):
                w = np.clip(which, 0, len(s) - 1)
                rows[:, 3 + 3 * c] = s[w] - at[:-1]
                rows[:, 4 + 3 * c] = e[w] - at[:-1]
                rows[:, 5 + 3 * c] = n[w]
        self.used += len(ids)
        return rows


@functools.cache
def _chunks(path: str) -> Chunks:
    return Chunks(path)


def _encode_slice(points: np.ndarray, at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and the offsets of each text in them."""
    chunks = _chunks(path)
    n = len(at) - 1
    starts, text = cuts(points, at)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    ends = np.append(starts[1:], len(points))
    rows = chunks.look(points, starts, ends)
    per_text = np.bincount(text, minlength=n)
    # Texts of several chunks of which one is small are encoded as one chunk.
    whole = np.zeros(n, bool)
    whole[text[(rows[:, 2] < LEAST) & (per_text[text] > 1)]] = True

    # Joins whose chunks both reach the cut.
    left = np.flatnonzero((text[1:] == text[:-1]) & ~whole[text[1:]])
    touch = (rows[left, 4 + 9] == ends[left] - starts[left]) & (rows[left + 1, 3] == 0)
    left = left[touch]
    fixed_ids, fixed_size, fixed_at = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(left):
        a = starts[left] + rows[left, 3 + 6]  # the last pre-token but one on the left
        b = starts[left + 1] + rows[left + 1, 4 + 3]  # the second on the right
        size = b - a
        o = np.concatenate([[0], np.cumsum(size)])
        own = points[np.repeat(a - o[:-1], size) + np.arange(o[-1])]
        s, e = word_level_spans(own, o)
        place, k = chunks.memo.look(own, s, e)
        bound = np.searchsorted(s, o)
        lo, hi = bound[:-1], bound[1:] - 1
        agree = (hi - lo >= 2) & (s[lo] + a - o[:-1] == a) & (e[lo] - o[:-1] + a == starts[left] + rows[left, 4 + 6])
        agree &= (s[hi] - o[:-1] + a == starts[left + 1] + rows[left + 1, 3 + 3]) & (e[hi] - o[:-1] + a == b)
        whole[text[left[~agree]]] = True
        inner = np.zeros(len(s), bool)
        inner[:] = True
        inner[lo] = inner[hi] = False
        fixed_ids = chunks.memo.gather(place[inner], k[inner])
        count = np.concatenate([[0], np.cumsum(np.where(inner, k, 0))])
        fixed_size = count[bound[1:]] - count[bound[:-1]]
        fixed_at = np.cumsum(fixed_size) - fixed_size

    # Pieces in order: a chunk without its repaired ends, then the repair of the join after it.
    skip, drop, repair = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    drop[left] = rows[left, 5 + 9]
    skip[left + 1] = rows[left + 1, 5]
    repair[left] = fixed_size
    alone = whole[text]
    body = np.where(alone, 0, rows[:, 1] - skip - drop)
    repair[alone] = 0
    total = body + repair
    w = np.flatnonzero(whole)
    if len(w):  # widened to the whole text
        o = np.concatenate([[0], np.cumsum(at[w + 1] - at[w])])
        own = points[np.repeat(at[w] - o[:-1], at[w + 1] - at[w]) + np.arange(o[-1])]
        s, e = word_level_spans(own, o)
        place, k = chunks.memo.look(own, s, e)
        whole_ids = chunks.memo.gather(place, k)
        kk = np.concatenate([[0], np.cumsum(k)])
        wb = kk[np.searchsorted(s, o)]
        first = np.searchsorted(text, w)
        total[first] = np.diff(wb)
    out = np.zeros(int(total.sum()), np.uint32)
    dest = np.cumsum(total) - total

    out[spread(dest, body)] = chunks.pool[spread(rows[:, 0] + skip, body)]
    if len(left):
        ok = ~alone[left]
        out[spread((dest + body)[left[ok]], fixed_size[ok])] = fixed_ids[spread(fixed_at[ok], fixed_size[ok])]
    if len(w):
        out[spread(dest[first], np.diff(wb))] = whole_ids[spread(wb[:-1], np.diff(wb))]
    ends_of = np.concatenate([[0], np.cumsum(total)])
    return out, ends_of[np.searchsorted(text, np.arange(n + 1))]


def encoded(column: pa.Array, path: str):
    """Yields (first text, ids, offsets) for slices of a column; every text's ids are those the library gives."""
    for i, j, _, _, points, at, unsure in text_slices(column):
        keep = np.repeat(~unsure, np.diff(at))
        low = lower()[points[keep]] if unsure.any() else lower()[points]
        at_ = np.concatenate([[0], np.cumsum(np.where(unsure, 0, np.diff(at)))])
        ids, offs = _encode_slice(low, at_, path)
        if unsure.any():
            parts = [ids[offs[d] : offs[d + 1]] if not unsure[d] else np.array(tokenizer(path).encode(column[i + d].as_py(), add_special_tokens=False).ids, np.uint32) for d in range(j - i)]
            ids, offs = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        yield i, ids, offs


@functools.cache
def _strings(path: str, what: str) -> tuple[np.ndarray, np.ndarray]:
    """For each id, its number or its token, with a blank after it: bytes and offsets."""
    t = tokenizer(path)
    n = max(t.get_vocab(with_added_tokens=True).values()) + 1
    parts = [(str(i) if what == "ids" else t.id_to_token(i) or "").encode() + b" " for i in range(n)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def joined(ids: np.ndarray, offs: np.ndarray, path: str, what: str) -> list[bytes]:
    """The numbers or tokens of each text, joined by one blank."""
    data, at = _strings(path, what)
    size = (at[1:] - at[:-1])[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    raw = data[np.repeat(at[:-1][ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
    b = total[offs]
    return [raw[x : max(x, y - 1)] for x, y in zip(b[:-1].tolist(), b[1:].tolist(), strict=True)]


@functools.cache
def _plain_decoder(path: str) -> bool:
    """Whether decoding is joining tokens by blanks, as in a file without a decoder."""
    return tokenizer(path).decoder is None


def decoded(ids: np.ndarray, offs: np.ndarray, path: str) -> list[bytes]:
    """Each text's ids as decode(ids, skip_special_tokens=False) gives them."""
    if _plain_decoder(path):
        return joined(ids, offs, path, "tokens")
    t = tokenizer(path)
    return [x.encode() for x in t.decode_batch([ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)], skip_special_tokens=False)]


def _digests(path: str):
    def run(batches):
        for b in batches:
            n, x, y = [], [], []
            for _, ids, offs in encoded(b.column(1), path):
                n += np.diff(offs).tolist()
                x += [hashlib.sha256(t).hexdigest() for t in joined(ids, offs, path, "ids")]
                y += [hashlib.sha256(t).hexdigest() for t in decoded(ids, offs, path)]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches):
        for b in batches:
            lists, texts = [], []
            for _, ids, offs in encoded(b.column(1), path):
                lists += [ids[x:y].astype(np.int32) for x, y in zip(offs[:-1], offs[1:], strict=True)]
                texts += [t.decode() for t in decoded(ids, offs, path)]
            yield pa.record_batch([b.column(0), pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def _rows(documents: DataFrame) -> DataFrame:
    return in_batches(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))


def encode_decode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every text by a word-level BPE file, no tokens added."""
    return _rows(documents).mapInArrow(_ids(path), "doc_id bigint, ids array<int>, decoded string")


def encode_decode_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the sha256 of the ids, joined by blanks, and of the decoded text.

    Takes columns doc_id and text, whatever else there is; a row for each row.
    A null text is an empty one: no ids, and an empty text decoded.
    """
    return _rows(documents).mapInArrow(_digests(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
