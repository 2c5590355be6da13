"""Rectangles x1, y1, x2, y2 as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0)) * F.greatest(y2 - y1, F.lit(0))


def overlap(a: list[Column], b: list[Column]) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))


def iou(a: list[Column], b: list[Column]) -> Column:
    shared = overlap(a, b)
    both = area(*a) + area(*b) - shared
    return F.when(both > 0, shared / F.nullif(both, F.lit(0))).otherwise(0.0)


def rescale(v: Column, side: Column, limit: int = 1000) -> Column:
    """A coordinate of 0..limit in pixels of a side, halves to the even pixel."""
    return F.bround(F.least(F.greatest(v, F.lit(0)), F.lit(limit)) * side / limit).cast("int")
