"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(v*w)/sum(w); null when there is no positive weight."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(value * weight) / total)


def shrink(total_weight: Column, raw: Column, prior: Column, k: float) -> Column:
    """Pull a weighted mean towards a prior worth k units of weight."""
    return (total_weight * raw + k * prior) / (total_weight + k)


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding after dropping float noise below 1e-10; no negative zero.

    Without the first step the order in which a sum was added up decides about values
    that lie half way between two results.
    """
    return F.round(F.round(value, 10), digits) + F.lit(0.0)


def signed_2dp(value: Column) -> Column:
    short = rounded(value, 2)
    return F.when((value < 0) & (short == 0), F.lit("-0.00")).otherwise(
        F.format_string("%+.2f", short)
    )
