"""Language ID: hyperdimensional profiles.

Every letter has a random vector of +-1 (a function of its code point).  An
n-gram is bound from its letters' vectors, each rotated by its place, and the
vectors of a text's n-grams are bundled by adding them.  A language's prototype
is the bundle of the bundles of its texts, each scaled to length one; a text
has the language whose prototype it makes the least angle with.

The bundle of a text is the sum of few distinct n-gram vectors, each times its
count, so texts are first turned into counts.  Prototypes are sums over the
whole of the labelled rows: each task adds up its own, Spark adds those up per
language and dimension, and the result (languages x dimensions numbers) goes
to the driver.  The number of languages is checked against ``MOST_LANGUAGES``.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_batches
from ._text import mix, slices, text_buffers

DIM = 512
N = 3
#: A language tag is a label, not free text; more distinct ones than this are an error in the input.
MOST_LANGUAGES = 2000
#: Cells of a table of counts, and distinct n-grams whose vectors are taken at once.
COUNTS, CODES = 1_000_000, 8192
#: N-gram vectors a worker keeps.
KEPT = 40_000

_U = np.uint64


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point of each code point, and 0 for all that aren't letters."""
    table = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


class Vectors:
    """Vectors of n-grams, by code; made when they are first needed."""

    def __init__(self, dim: int) -> None:
        self.dim, self.rows, self.index = dim, np.zeros((0, dim), np.int8), np.zeros(0, _U)

    def letter(self, points: np.ndarray) -> np.ndarray:
        words = self.dim // 64
        with np.errstate(over="ignore"):
            seeds = points.astype(_U)[:, None] * _U(0x9E3779B97F4A7C15) + np.arange(1, words + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F)
        bits = np.unpackbits(mix(seeds).view(np.uint8), axis=1)
        return (bits.astype(np.int8) * 2 - 1)[:, : self.dim]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Rows for sorted distinct codes."""
        at = np.searchsorted(self.index, codes)
        have = np.zeros(len(codes), bool)
        inside = at < len(self.index)
        have[inside] = self.index[at[inside]] == codes[inside]
        new = codes[~have]
        if len(new):
            made = np.ones((len(new), self.dim), np.int8)
            for place in range(N):
                points = (new >> _U(21 * (N - 1 - place))) & _U(0x1FFFFF)
                made *= np.roll(self.letter(points), place, axis=1)
            if len(self.index) + len(new) > KEPT:
                self.index, self.rows = np.zeros(0, _U), np.zeros((0, self.dim), np.int8)
                if len(new) < len(codes):
                    return self.of(codes)
            index = np.concatenate([self.index, new])
            order = np.argsort(index, kind="stable")
            self.index, self.rows = index[order], np.concatenate([self.rows, made])[order]
        return self.rows[np.searchsorted(self.index, codes)]


def _grams(texts: pa.Array):
    """For each slice: first text, texts, and the text index and code of every n-gram.

    A run of other characters between letters counts as one blank.
    """
    letters = _letters()
    data, offs = text_buffers(texts)
    for i, j in slices(offs):
        part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[o]
        low = letters[points].astype(_U)
        doc = np.repeat(np.arange(j - i), np.diff(at))
        keep = low > 0
        blank = ~keep
        if len(low):
            edge = np.zeros(len(low), bool)
            edge[at[:-1][at[:-1] < len(low)]] = True
            keep |= blank & (edge | np.concatenate([[True], ~blank[:-1]]))
        low, doc = low[keep], doc[keep]
        m = len(low) - N + 1
        if m <= 0:
            yield i, j, np.zeros(0, np.int64), np.zeros(0, _U)
            continue
        code = np.zeros(m, _U)
        for place in range(N):
            code = (code << _U(21)) | low[place : place + m]
        same = (doc[:m] == doc[N - 1 :]) & (code != 0)
        yield i, j, doc[:m][same], code[same]


def bundles(texts: pa.Array, vectors: Vectors):
    """Yields (first text, their vectors scaled to length one); zeros for a text without an n-gram of letters."""
    for i, j, doc, code in _grams(texts):
        out = np.zeros((j - i, vectors.dim), np.float32)
        if len(code):
            # Blocks of n-grams and of texts, so that vectors and counts stay small however many there are.
            # All sums are of whole numbers, so blocks don't change them.
            codes, column = np.unique(code, return_inverse=True)
            for c in range(0, len(codes), CODES):
                rows = vectors.of(codes[c : c + CODES]).astype(np.float32)
                mine = np.flatnonzero((column >= c) & (column < c + CODES)) if len(codes) > CODES else slice(None)
                doc_, column_ = doc[mine], column[mine] - c
                bounds = np.searchsorted(doc_, np.arange(j - i + 1))
                step = max(1, COUNTS // len(rows))
                for x in range(0, j - i, step):
                    y = min(x + step, j - i)
                    own = slice(bounds[x], bounds[y])
                    counts = np.bincount((doc_[own] - x) * len(rows) + column_[own], minlength=(y - x) * len(rows)).reshape(y - x, len(rows))
                    out[x:y] += counts.astype(np.float32) @ rows
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            np.divide(out, norm, out=out, where=norm > 0)
        yield i, out


@functools.cache
def _vectors(dim: int) -> Vectors:
    """One table of vectors in each worker, kept from task to task."""
    return Vectors(dim)


def _learn(dim: int):
    def run(batches):
        vectors, sums, rows = _vectors(dim), {}, {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for i, v in bundles(b.column(0), vectors):
                own = langs[i : i + len(v)]
                for lang in set(own):
                    mine = own == lang
                    sums[lang] = sums.get(lang, 0) + v[mine].sum(axis=0, dtype=np.float64)
                    rows[lang] = rows.get(lang, 0) + int(mine.sum())
        for lang, v in sums.items():
            # Whole multiples of 2**-32 add up to the same in any order.
            whole = np.rint(v * 2.0**32).astype(np.int64)
            yield pa.record_batch([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(whole)], ["lang", "i", "v"])

    return run


def learn(labelled: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """The languages of (text, lang) and their prototypes, scaled to length one; rows without a lang don't count."""
    rows = in_batches(labelled.filter("lang IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    sums = rows.mapInArrow(_learn(dim), "lang string, i int, v bigint").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    per = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(per) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct languages")
    langs, protos = [], []
    for r in sorted(per, key=lambda r: r["lang"]):
        v = np.array([x["v"] for x in r["v"]], np.float64)
        if np.any(v):
            langs.append(r["lang"])
            protos.append(v / np.linalg.norm(v))
    return langs, np.array(protos, np.float32).reshape(len(langs), dim)


def predicted(langs: list[str], protos: np.ndarray, once: bool = False):
    """A function of a text column to its language and cosine; only texts go to Python, whatever other columns there are.

    With ``once``, a filter on the result isn't moved before it, where it would be worked out again.
    """

    @F.arrow_udf("struct<lang: string, score: double>")
    def of(texts: pa.Array) -> pa.Array:
        letters = _letters()
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        if langs:
            for i, v in bundles(texts, _vectors(protos.shape[1])):
                cos = v @ protos.T
                best = cos.argmax(axis=1)
                for d in np.flatnonzero(v.any(axis=1)):
                    pred[i + d] = langs[best[d]]
                    score[i + d] = min(1.0, max(0.0, float(cos[d, best[d]])))
            # A text of one letter has n-grams only with the blanks around it, or none: it still gets a language.
            for d, p in enumerate(pred):
                if p == "und" and any(letters[ord(c)] for c in texts[d].as_py() or ""):
                    pred[d] = langs[0]
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score)], ["lang", "score"])

    return lambda text: (of.asNondeterministic() if once else of)(text.cast("string"))


def chance(protos: np.ndarray) -> float:
    """A cosine that a text in none of the languages hardly reaches: three standard deviations of that of unrelated vectors."""
    return 3 / math.sqrt(protos.shape[1])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(documents: DataFrame, training: DataFrame | None = None, dim: int = DIM) -> DataFrame:
    """Predict the language of every document from its text.

    Takes columns doc_id and text; ``training`` has text and lang, and is by
    default the documents whose crc32(doc_id) mod 4 is not 2 and whose lang is
    known.  Returns doc_id, held_out, lang_pred and score (the cosine, 0 to 1).
    A null text, one without a letter, or any text if nothing could be
    learned, is ``und`` with score 0.  A tie goes to the language that sorts
    first.  Rows of the same text get the same prediction.
    """
    if training is None:
        training = documents.filter(~held_out(F.col("doc_id"))).select("text", "lang")
    of = predicted(*learn(training, dim))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), of(F.col("text")).alias("p"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
