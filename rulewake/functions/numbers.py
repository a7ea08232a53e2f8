"""Dates, sets, vectors and intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc(text: Column) -> Column:
    """A timestamp, null where the text is none."""
    return F.try_to_timestamp(text)


def comment_time(received: Column, posted: Column) -> Column:
    """When a comment came: received, else posted."""
    return F.coalesce(received, posted)


def in_window(when: Column, opened: Column, closed: Column) -> Column:
    """Whether a time lies from the first day to the day after the last, both inclusive; false where any is null."""
    return F.coalesce((when >= opened) & (when <= closed + F.expr("INTERVAL 1 DAY")), F.lit(False))


def long_date(day: Column) -> Column:
    """Month d, yyyy."""
    return F.date_format(day, "MMMM d, yyyy")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; the shorter vector is filled with zeros."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) * F.coalesce(y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def interval_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length shared by two intervals over the length of the shorter, which counts as 1 at least; 0 where they only touch."""
    shared = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    shorter = F.least(F.greatest(a_end - a_start, F.lit(1)), F.greatest(b_end - b_start, F.lit(1)))
    return F.when(shared > 0, shared / shorter).otherwise(0.0)


def token_cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float, batch: bool = False) -> Column:
    """Price by rates for a million tokens, half of it in a batch; null counts as 0."""
    whole = F.coalesce(tokens_in, F.lit(0)) * rate_in + F.coalesce(tokens_out, F.lit(0)) * rate_out
    return whole / 1_000_000 * (0.5 if batch else 1.0)
