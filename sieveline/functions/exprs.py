"""Pure column expressions: rounding grids, quantisation, stable pseudo-randomness, set measures, bit sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_grid(x: Column) -> Column:
    """x rounded to the nearest half-precision value (ties to even), for x >= 0."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(x)), F.lit(-14)) - 10)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / step) * step)


def quantise(x: Column, centre: Column, scale: float = 100.0) -> Column:
    """Offset from the centre in whole 1/scale steps, clipped to 16 bits before the cast (ANSI casts raise)."""
    return F.least(F.greatest(F.rint((x - centre) * scale), F.lit(-32768.0)), F.lit(32767.0)).cast("smallint")


def dequantise(q: Column, centre: Column, scale: float = 100.0) -> Column:
    return q / scale + centre


def saturated(q: Column) -> Column:
    return (q == 32767) | (q == -32768)


def stable_order(key: Column, seed: str | Column) -> Column:
    """A pseudo-random sort key that any engine reproduces."""
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")).cast("binary"))


def stable_fold(key: Column, seed: str, folds: int) -> Column:
    """A fold number from the first 28 bits of the stable key."""
    return (F.conv(F.substring(stable_order(key, seed), 1, 7), 16, 10).cast("bigint") % folds).cast("int")


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    """num / den; an empty denominator is null, or the given value."""
    out = F.when(den != 0, num / den)
    return out if empty is None else F.coalesce(out, F.lit(float(empty)))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules])


def band(x: Column, edges: list[float]) -> Column:
    """The index of the left-closed band x lies in; the last is open."""
    return reduce(lambda acc, i: F.when(x < edges[i], F.lit(i - 1)).otherwise(acc), range(len(edges) - 1, 0, -1), F.lit(len(edges) - 1))


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda s, t: s + t, [(x - y) * (x - y) for x, y in zip(a, b, strict=True)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def longest_fragment(x: Column, sep: str = ".") -> Column:
    """The longest part, the first of equals."""
    parts = F.split(x, "\\" + sep)
    return F.aggregate(parts, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))


def base26(n: Column, width: int) -> Column:
    """Fixed-width identifiers A.., B.. in base 26."""
    digits = [F.chr(F.lit(65) + F.pmod(F.floor(n / (26**i)), F.lit(26)).cast("int")) for i in reversed(range(width))]
    return F.concat(*digits)


def words_popcount(a: Column, b: Column) -> Column:
    """Common bits of two bit sets kept as arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def tanimoto(common: Column, n_a: Column, n_b: Column) -> Column:
    union = n_a + n_b - common
    return F.when(union > 0, common / union).otherwise(0.0)
