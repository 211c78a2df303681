"""Score expressions of ranking, feedback and monitoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
HALF_LIFE = 300.0


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def tf_norm(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def click_boost(clicks: Column) -> Column:
    return 1 + 0.1 * F.ln(1 + clicks)


def click_weight(position: Column) -> Column:
    return 2 / F.log2(position + F.lit(2.0))


def decayed(score: Column, seconds: Column, half_life: float = HALF_LIFE) -> Column:
    return score * F.exp(-seconds * (F.ln(F.lit(2.0)) / half_life))


def error_rate(errors: Column, fetches: Column) -> Column:
    return F.when(fetches > 0, F.round(errors / fetches * 100, 1)).otherwise(0.0)


def progress(pages: Column, seconds: Column, most: Column) -> tuple[Column, Column, Column]:
    """Pages a second, percent done (100 at most), and seconds to go."""
    rate = F.when(seconds > 0, F.round(pages / seconds, 2)).otherwise(0.0)
    return rate, F.least(F.lit(100.0), F.round(pages / most * 100, 1)), F.when(rate > 0, F.round(F.greatest(most - pages, F.lit(0)) / rate, 1))


def percentile_floor(values: Column, p: float) -> Column:
    """The sorted value at index max(0, int(n * p / 100) - 1), to one place; 0 without values."""
    s = F.sort_array(values)
    at = F.greatest(F.lit(1), F.floor(F.size(s) * p / 100).cast("int"))
    return F.when(F.size(s) > 0, F.round(F.element_at(s, at), 1)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
