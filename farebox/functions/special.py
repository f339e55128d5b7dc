"""Tail probabilities of the chi-square distribution as column expressions, by the regularised incomplete gamma function."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series and steps of the fraction; both are done long before for the statistics of tests.
TERMS = 400
_TINY = 1e-300


def log_gamma_half(k: Column) -> Column:
    """The logarithm of the gamma function at k / 2 for a whole k of at least 1: a sum of logarithms from 1, or from the root of pi."""
    odd = k % 2 == 1
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(k / 2).cast("int") - 1, F.lit(0)))
    factors = F.transform(steps, lambda i: F.when(i == 0, 0.0).otherwise(F.log(F.when(odd, i - 0.5).otherwise(i.cast("double")))))
    return F.aggregate(factors, F.lit(0.0), lambda s, x: s + x) + F.when(odd, math.log(math.pi) / 2).otherwise(0.0)


def chi2_tail(x: Column, dof: Column) -> Column:
    """The probability that a chi-square variable of dof degrees of freedom is at least x; 1 where x isn't positive, null for dof below 1 or nulls.

    Below the mean by the series of the lower incomplete gamma function, above it by the continued fraction of the upper one (Lentz).
    """
    a, half = dof / 2.0, F.greatest(x / 2.0, F.lit(0.0))
    front = F.exp(a * F.log(half) - half - log_gamma_half(dof))
    count = F.sequence(F.lit(1), F.lit(TERMS))
    start = F.struct((1.0 / a).alias("sum"), (1.0 / a).alias("term"))

    def added(s: Column, i: Column) -> Column:
        term = s.term * half / (a + i)
        return F.struct((s.sum + term).alias("sum"), term.alias("term"))

    lower = front * F.aggregate(count, start, added, lambda s: s.sum)
    b = half + 1.0 - a
    kept = lambda v: F.when(F.abs(v) < _TINY, _TINY).otherwise(v)
    first = 1.0 / kept(b)
    begin = F.struct(F.lit(1.0 / _TINY).alias("c"), first.alias("d"), first.alias("h"))

    def stepped(s: Column, i: Column) -> Column:
        an = -i * (i - a)
        bn = b + 2.0 * i
        d = 1.0 / kept(an * s.d + bn)
        c = kept(bn + an / s.c)
        return F.struct(c.alias("c"), d.alias("d"), (s.h * d * c).alias("h"))

    upper = front * F.aggregate(count, begin, stepped, lambda s: s.h)
    tail = F.when(half < a + 1.0, 1.0 - lower).otherwise(upper)
    return F.when((dof < 1) | dof.isNull() | x.isNull(), None).when(half <= 0, 1.0).otherwise(F.greatest(tail, F.lit(0.0)))
