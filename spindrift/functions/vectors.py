"""Signatures of vectors: hashes, correlations, thumbnails, as higher-order array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 32


def difference_hash(v: Column, length: int) -> Column:
    """Bit i set if component i + 1 exceeds component i, in words of 32 bits, low bits first."""
    bit = lambda i: F.when(F.element_at(v, i + 2) > F.element_at(v, i + 1), F.lit(1 << (i % WORD))).otherwise(F.lit(0)).cast("long")
    bits = length - 1
    return F.array(*[sum((bit(i) for i in range(w, min(w + WORD, bits))), F.lit(0).cast("long")) for w in range(0, bits, WORD)])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, use) -> Column:
    """`use` of a value that is computed once, not once per element of an array."""
    return F.transform(F.array(value), use)[0]


def z_scores(v: Column) -> Column:
    """Population z-scores; zeros for a constant vector."""
    mean = _sum(v) / F.size(v)

    def scaled(m: Column) -> Column:
        sd = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v))
        return _let(sd, lambda d: F.transform(v, lambda x: F.when(d > 1e-12, (x - m) / d).otherwise(0.0)))

    return _let(mean, scaled)


def similarity(a: Column, b: Column) -> Column:
    """0.85 x mean product of z-scores + 0.15 x (1 - mean squared error), for vectors scaled to [0, 1].

    From five running sums: the mean product of z-scores is the correlation.
    """
    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("a", "b", "aa", "bb", "ab")])
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def add(s: Column, e: Column) -> Column:
        x, y = e["x"], e["y"]
        return F.struct((s["a"] + x).alias("a"), (s["b"] + y).alias("b"), (s["aa"] + x * x).alias("aa"), (s["bb"] + y * y).alias("bb"), (s["ab"] + x * y).alias("ab"))

    def close(s: Column) -> Column:
        n = F.size(a)
        va, vb = s["aa"] / n - (s["a"] / n) * (s["a"] / n), s["bb"] / n - (s["b"] / n) * (s["b"] / n)
        z = F.when((va > 1e-18) & (vb > 1e-18), (s["ab"] / n - s["a"] * s["b"] / n / n) / F.sqrt(va * vb)).otherwise(0.0)
        return 0.85 * z + 0.15 * (1.0 - (s["aa"] + s["bb"] - 2.0 * s["ab"]) / n)

    return F.aggregate(pairs, zero, add, close)


def shift_correlation(a: Column, b: Column, length: int, shift: int = 14, least: int = 8) -> Column:
    """Best mean product of the overlap over shifts to both sides; -1 if no overlap is long enough."""
    def at(s: int) -> Column:
        x, y = (F.slice(a, s + 1, length - s), F.slice(b, 1, length - s)) if s >= 0 else (F.slice(a, 1, length + s), F.slice(b, 1 - s, length + s))
        return _sum(F.zip_with(x, y, lambda p, q: p * q)) / (length - abs(s))

    found = [at(s) for s in range(-shift, shift + 1) if length - abs(s) >= least]
    return F.greatest(*found, F.lit(-1.0)) if found else F.lit(-1.0)


def median_bits(v: Column) -> Column:
    """1 where a component exceeds the vector's median."""
    n = F.size(v)
    of = lambda s: (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2
    return _let(_let(F.array_sort(v), of), lambda m: F.transform(v, lambda x: F.when(x > m, 1).otherwise(0)))


def bit_agreement(a: Column, b: Column, of: int) -> Column:
    """Share of equal bits among the first `of`."""
    same = F.zip_with(F.slice(a, 1, of), F.slice(b, 1, of), lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(of)
