"""Substring dedup: repeated-phrase automata.

Which runs of ``n`` consecutive words also start earlier in the corpus is found in four steps.

1. Anchors.  A window of n words is known by the least hash among its
   ``k``-word shingles.  Equal windows have equal anchors, and neighbouring
   windows mostly share one, so a text falls into *segments*: stretches of
   windows with the same anchor.  Anchors are counted over the whole corpus
   (one long per segment, summed before the shuffle); a window can recur only
   if its anchor does.
2. Candidates.  Segments whose anchor recurs are compared by a digest of all
   their words: each copy but the first is a candidate.  Where unequal segments
   share an anchor, or hold it twice, their windows are compared, by digest as
   well.  Candidates that lie side by side, as their first places do, are one
   run: a passage, where it stands, and where it first stood.
3. Automata.  Documents with candidates are dealt to shards by their key.  A
   shard gets the words of its runs' passages, cut from where they first stood,
   compiles them to an Aho-Corasick automaton, and streams its documents
   through it, whole, to locate every place of every passage.  (Each distinct
   word of the passages is coded as two characters, so words are compared one
   by one.)  All other documents hold no passage and are left as they are.
4. A place later than the passage's own is covered; covered words go.  So
   digests only nominate: what goes was found, word by word, by an automaton.

Work and shuffled bytes grow in proportion to the corpus: a shard's automaton
has the passages of its own documents, never those of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_batches, keyed, partitions, removed, saved, sized
from ._text import digests, shingle_hashes, signed, single_spaced, sliding_min, slices, text_buffers, word_hashes, words

#: Words of passages that a shard gets, about; a passage is in one piece.
SHARD_WORDS = 200_000
#: Passages cut from one text in one go.
CUTS = 2000


def _segments(texts: pa.Array, n: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each slice: text index, anchor, digest of the words, first window, windows, whether the anchor stands there twice."""
    data, offs = text_buffers(texts)
    for i, j in slices(offs):
        part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, doc = words(part, o)
        m = len(starts) - n + 1
        if m <= 0:
            continue
        wh = word_hashes(part, starts, ends)
        grams = shingle_hashes(wh, k)
        span = n - k + 1
        anchor = sliding_min(grams, span)
        valid = np.flatnonzero(doc[:m] == doc[n - 1 :])
        if not len(valid):
            continue
        a = anchor[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (valid[1:] != valid[:-1] + 1) | (a[1:] != a[:-1])
        at = np.flatnonzero(new)
        lo = valid[at]
        count = np.diff(np.append(at, len(valid)))
        twice = np.zeros(len(grams) + 1, np.int64)
        for p in range(1, span + 1):  # neighbouring windows hold shingles up to span apart
            if len(grams) > p:
                twice[1 : len(grams) - p + 1] |= grams[:-p] == grams[p:]
        np.cumsum(twice, out=twice)
        rep = twice[np.minimum(lo + count + span - 1, len(grams))] > twice[lo]
        first_word = np.searchsorted(doc, np.arange(j - i))
        text, begin, end = single_spaced(part, starts, ends)
        yield doc[lo] + i, a[at], digests(text, begin[lo], end[lo + count + n - 2]), lo - first_word[doc[lo]], count, rep


def _anchors(n: int, k: int):
    def run(batches):
        for b in batches:
            got = [(a, rep) for _, a, _, _, _, rep in _segments(b.column(0), n, k)]
            if got:
                a = np.concatenate([x for x, _ in got])
                weight = 1 + np.concatenate([x for _, x in got]).astype(np.int64)
                values, inverse = np.unique(a, return_inverse=True)
                yield pa.record_batch([pa.array(signed(values)), pa.array(np.bincount(inverse, weight).astype(np.int64))], ["a", "c"])

    return run


def _listed(n: int, k: int):
    def run(batches):
        for b in batches:
            for doc, a, seg, lo, count, rep in _segments(b.column(1), n, k):
                yield pa.record_batch(
                    [b.column(0).take(pa.array(doc)), pa.array(signed(a)), pa.array(signed(seg)), pa.array(lo.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(rep)],
                    ["k", "a", "seg", "lo", "count", "rep"],
                )

    return run


def _split(text: bytes) -> list[bytes]:
    return text.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D


def _window_digests(n: int):
    """(k, text, segs) to a row for each window of the segments: its digest, k and place."""

    def run(batches):
        for b in batches:
            keys: list[int] = []
            starts, hashes = [], []
            for row, (text, segs) in enumerate(zip(b.column(1).cast(pa.large_binary()), b.column(2), strict=True)):
                w = _split(text.as_py() or b"")
                for s in segs.as_py():
                    for i in range(s["lo"], s["lo"] + s["count"]):
                        keys.append(row)
                        starts.append(i)
                        hashes.append(int.from_bytes(hashlib.blake2b(b" ".join(w[i : i + n]), digest_size=8).digest(), "little", signed=True))
            if keys:
                yield pa.record_batch([pa.array(hashes, pa.int64()), b.column(0).take(pa.array(keys)), pa.array(starts, pa.int32())], ["w", "k", "start"])

    return run


def _merged(batches):
    """(k, spans) to runs: spans side by side whose first places are side by side as well are one."""
    for b in batches:
        spans = b.column(1)
        row = np.repeat(np.arange(b.num_rows), np.diff(spans.offsets.to_numpy()))
        if not len(row):
            continue
        start, stop, k0, s0 = spans.flatten().flatten()
        start, stop, s0 = (x.to_numpy().astype(np.int64) for x in (start, stop, s0))
        parts = [x.to_numpy(zero_copy_only=False) for x in (k0.flatten() if pa.types.is_struct(k0.type) else [k0])]
        same = [row, *parts, start - s0]
        order = np.lexsort([start, *same[::-1]])
        row, start, stop, s0 = row[order], start[order], stop[order], s0[order]
        new = np.ones(len(row), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in same], axis=0)
        # How far a group's spans reach so far: groups follow one another, each above the one before it.
        high = int(stop.max()) + 1
        group = np.cumsum(new) * high
        reach = np.maximum.accumulate(stop + group) - group
        new[1:] |= start[1:] > reach[:-1]
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(row)) - 1
        cols = [b.column(0).take(pa.array(row[at])), pa.array(start[at].astype(np.int32)), pa.array(reach[end].astype(np.int32)), k0.take(pa.array(order[at])), pa.array(s0[at].astype(np.int32))]
        yield pa.record_batch(cols, ["k", "start", "stop", "k0", "s0"])


def repeated_runs(docs: DataFrame, n: int = 20, k: int = 6) -> DataFrame:
    """(k, start, stop, k0, s0): words [start, stop) of k that seem to stand at s0 of k0 too, which is earlier; a saved table.

    Earlier: in a document of a smaller k, or in the same one before.  Every
    window that also starts earlier is in a run.
    """
    key = docs.schema["k"].dataType.simpleString()
    counted = docs.select("text").mapInArrow(_anchors(n, k), "a bigint, c bigint")
    recurring = counted.groupBy("a").agg(F.sum("c").alias("c")).filter("c >= 2").select("a")
    listed = docs.select("k", "text").mapInArrow(_listed(n, k), f"k {key}, a bigint, seg bigint, lo int, count int, rep boolean")
    rec = saved(listed.join(recurring, "a"), "segments")

    segs = rec.groupBy("a", "seg").agg(F.min(F.struct("k", "lo")).alias("first"), F.first("count").alias("count"), F.max("rep").alias("rep"), F.count("*").alias("n"))
    segs = saved(segs, "distinct-segments")
    # Whole segments that have been seen before.
    again = rec.join(segs.filter("n > 1").select("a", "seg", "first"), ["a", "seg"]).filter((F.col("k") != F.col("first.k")) | (F.col("lo") != F.col("first.lo")))
    spans = again.select("k", F.col("lo").alias("start"), (F.col("lo") + F.col("count") + F.lit(n - 1)).alias("stop"), F.col("first.k").alias("k0"), F.col("first.lo").alias("s0"))

    # The rest: unequal segments that share an anchor, or hold one twice.
    mixed = segs.groupBy("a").agg(F.count("*").alias("kinds"), F.max("rep").alias("rep")).filter("kinds > 1 OR rep").select("a")
    per_doc = segs.join(mixed, "a").groupBy(F.col("first.k").alias("k")).agg(F.collect_list(F.struct(F.col("first.lo").alias("lo"), "count")).alias("segs"))
    per_doc = saved(per_doc, "mixed-segments")
    windows = saved(docs.select("k", "text").join(sized(per_doc, "1 + 0.64 * size(segs)"), "k").select("k", "text", "segs").mapInArrow(_window_digests(n), f"w bigint, k {key}, start int"), "windows")
    firsts = windows.groupBy("w").agg(F.min(F.struct("k", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("w", "first")
    later = windows.join(firsts.hint("merge"), "w").filter((F.col("k") != F.col("first.k")) | (F.col("start") != F.col("first.start")))
    spans = spans.unionByName(later.select("k", "start", (F.col("start") + F.lit(n)).alias("stop"), F.col("first.k").alias("k0"), F.col("first.start").alias("s0")))

    one = spans.groupBy("k").agg(F.collect_list(F.struct("start", "stop", "k0", "s0")).alias("spans"))  # a document's own
    runs = saved(one.mapInArrow(_merged, f"k {key}, start int, stop int, k0 {key}, s0 int"), "runs")
    removed(rec, segs, per_doc, windows)
    return runs


def _passages(batches):
    """(k, text, cuts) to a row for each cut: its shard, 0, k, where it stood, no id, and its words joined by one space."""
    for b in batches:
        rows, out = [], ([], [], [])
        for row, (text, cuts) in enumerate(zip(b.column(1).cast(pa.large_binary()), b.column(2), strict=True)):
            w = _split(text.as_py() or b"")
            for c in cuts.as_py():
                rows.append(row)
                out[0].append(c["shard"])
                out[1].append(c["s0"])
                out[2].append(b" ".join(w[c["s0"] : c["s0"] + c["len"]]))
        if rows:
            n = len(rows)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array([0] * n, pa.int32()), b.column(0).take(pa.array(rows)), pa.array(out[1], pa.int32()), pa.array([None] * n, pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())], ["shard", "kind", "k", "start", "id", "text"])


class Passages:
    """Passages compiled to an automaton over coded words, with the first place of each."""

    #: A word that no passage has.
    OTHER = "\x00\x00"

    def __init__(self, passages: list[tuple[tuple, int, bytes]]) -> None:
        import ahocorasick

        self.code: dict[bytes, str] = {}
        first: dict[str, tuple[tuple, int]] = {}
        for k, start, text in passages:
            coded = "".join([self._coded(w) for w in text.split(b" ")])
            place = (k, start)
            if coded not in first or place < first[coded]:
                first[coded] = place
        self.first = list(first.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for i, coded in enumerate(first):
            self.automaton.add_word(coded, (i, len(coded) // 2))
        if first:
            self.automaton.make_automaton()

    def _coded(self, word: bytes) -> str:
        c = self.code.get(word)
        if c is None:
            x = len(self.code)
            c = self.code[word] = chr(0x100 + x // 255) + chr(1 + x % 255)  # a first character is never a second one
        return c

    def places(self, k: tuple, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """Begin and end, in words, of each place of a passage that is later than the passage's own."""
        if not self.first:
            return
        get, other = self.code.get, self.OTHER
        for end, (i, size) in self.automaton.iter("".join([get(w, other) for w in text])):
            stop = (end + 1) // 2
            if (k, stop - size) > self.first[i]:
                yield stop - size, stop


def _order(k) -> tuple:
    return tuple(k.values()) if isinstance(k, dict) else (k,)


class Kept:
    """What is left of texts, gathered to Arrow batches."""

    def __init__(self, texts: bool) -> None:
        self.texts, self.rows = texts, []

    def add(self, i: int | None, w: list[bytes], places) -> None:
        left = w
        if places:
            cover = np.zeros(len(w) + 1, np.int64)
            np.add.at(cover, [a for a, _ in places], 1)
            np.add.at(cover, [b for _, b in places], -1)
            left = [w[x] for x in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
        kept = b" ".join(left)
        self.rows.append((i, len(w), len(w) - len(left), hashlib.sha256(kept).hexdigest(), kept if self.texts else b""))

    def batch(self) -> pa.RecordBatch:
        cols = [pa.array([r[c] for r in self.rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        if self.texts:
            cols.append(pa.array([r[4] for r in self.rows], pa.binary()).cast(pa.string()))
        self.rows.clear()
        return pa.record_batch(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(cols)])


def _streamed(texts: bool):
    """Rows (shard, kind, k, start, id, text) in the order of shard and kind: passages (0), then documents (1) to stream through them."""

    def run(batches):
        shard, passages, compiled, out = None, [], None, Kept(texts)
        for b in batches:
            for s, kind, k, start, i, text in zip(*(b.column(c).to_pylist() for c in range(5)), b.column(5).cast(pa.large_binary()).to_pylist(), strict=True):
                if s != shard:
                    shard, passages, compiled = s, [], None
                if kind == 0:
                    passages.append((_order(k), start, text))
                else:
                    if compiled is None:
                        compiled, passages = Passages(passages), []
                    w = _split(text or b"")
                    out.add(i, w, list(compiled.places(_order(k), w)))
            if out.rows:
                yield out.batch()

    return run


def _untouched(texts: bool):
    def run(batches):
        out = Kept(texts)
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                out.add(i, _split(text or b""), None)
            if out.rows:
                yield out.batch()

    return run


def substring_dedup(documents: DataFrame, n: int = 20, k: int = 6, texts: bool = True) -> DataFrame:
    """Remove every word covered by n consecutive words that also start earlier in the corpus.

    Takes columns doc_id and text, whatever else there is; returns doc_id,
    n_words, n_removed, kept_sha256 and, with ``texts``, kept_text (the words
    left, joined by one space).  Words are what lies between white space
    (\\x20, \\x09-\\x0D), unchanged.  A null or empty text has no words; a text of
    fewer than n words loses none.  Rows that share a doc_id and a text count
    as one document; a null doc_id comes before all others.
    """
    docs = in_batches(keyed(documents))
    spark = docs.sparkSession
    key = docs.schema["k"].dataType.simpleString()
    runs = repeated_runs(docs, n, k)
    mine = saved(runs.groupBy("k").agg(F.sum(F.col("stop") - F.col("start")).alias("words")), "holders")
    shards = max(partitions(spark), -(-(mine.agg(F.sum("words").alias("n")).first()["n"] or 0) // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("k"), F.lit(shards)).cast("bigint").alias("shard")

    # Passages by where they stood first, in groups of bounded size.
    need = saved(runs.select(shard, "k0", "s0", (F.col("stop") - F.col("start")).alias("len")).distinct(), "passages")
    many = need.groupBy("k0").agg(F.ceil(F.count("*") / F.lit(CUTS)).cast("int").alias("parts"))
    group = F.pmod(F.xxhash64("shard", "s0", "len"), "parts")
    cuts = need.join(many, "k0").groupBy(F.col("k0").alias("k"), group.alias("part")).agg(F.collect_list(F.struct("shard", "s0", "len")).alias("cuts")).select("k", "cuts")
    cuts = sized(saved(cuts, "cuts"), "1 + 0.8 * size(cuts)")
    passages = docs.select("k", "text").join(cuts, "k").select("k", "text", "cuts").mapInArrow(_passages, f"shard bigint, kind int, k {key}, start int, id bigint, text string")

    holders = sized(mine.select("k"))
    own = docs.join(holders, "k", "left_semi").select(shard, F.lit(1).alias("kind"), "k", F.lit(None).cast("int").alias("start"), "id", "text")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts
    streamed = passages.unionByName(own).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_streamed(texts), schema)
    return streamed.unionByName(docs.join(holders, "k", "left_anti").select("id", "text").mapInArrow(_untouched(texts), schema))
