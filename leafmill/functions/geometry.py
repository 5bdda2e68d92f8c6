"""Boxes as array<double> [x1, y1, x2, y2]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def raw_bbox(bbox: Column) -> Column:
    """First four numbers, zeros when there are fewer."""
    zeros = F.array(*[F.lit(0.0)] * 4)
    return F.when(F.size(F.coalesce(bbox, F.array().cast("array<double>"))) < 4, zeros).otherwise(F.slice(bbox, 1, 4))


def normalize_bbox(bbox: Column, page_size: Column) -> Column:
    """Scale a raw box to 0-1 by its likely unit, then clamp."""
    raw = raw_bbox(bbox)
    top = F.array_max(raw)
    w, h = F.try_element_at(page_size, F.lit(1)), F.try_element_at(page_size, F.lit(2))
    known = F.coalesce((w > 0) & (h > 0), F.lit(False))
    fits = (raw[2] <= w * 1.05) & (raw[3] <= h * 1.05)

    def scaled(sx: Column, sy: Column) -> Column:
        return F.array(raw[0] / sx, raw[1] / sy, raw[2] / sx, raw[3] / sy)

    norm = (
        F.when(top <= 1.0, raw)
        .when(known & fits, scaled(w, h))
        .when(top <= 1000, scaled(F.lit(1000.0), F.lit(1000.0)))
        .when(known, scaled(w, h))
        .otherwise(raw)
    )
    return F.transform(norm, clamp01)


def contains_point(bbox: Column, x: Column, y: Column) -> Column:
    return (
        (x >= F.least(bbox[0], bbox[2]))
        & (x <= F.greatest(bbox[0], bbox[2]))
        & (y >= F.least(bbox[1], bbox[3]))
        & (y <= F.greatest(bbox[1], bbox[3]))
    )


def area(bbox: Column) -> Column:
    return F.abs(bbox[2] - bbox[0]) * F.abs(bbox[3] - bbox[1])


def crop_rect(bbox_norm: Column, width: Column, height: Column, padding: float = 0.01) -> Column:
    """Pixel rectangle of a padded box."""
    x1, y1 = F.greatest(F.lit(0.0), bbox_norm[0] - padding), F.greatest(F.lit(0.0), bbox_norm[1] - padding)
    x2, y2 = F.least(F.lit(1.0), bbox_norm[2] + padding), F.least(F.lit(1.0), bbox_norm[3] + padding)
    return F.struct(
        (x1 * width).cast("int").alias("left"),
        (y1 * height).cast("int").alias("top"),
        (x2 * width).cast("int").alias("right"),
        (y2 * height).cast("int").alias("bottom"),
    )


def default_box() -> Column:
    return F.array(F.lit(0.1), F.lit(0.1), F.lit(0.9), F.lit(0.9))


def union_bbox_agg(bbox_norm: Column) -> Column:
    """Aggregate: smallest box around all boxes; a missing corner counts as 0 or 1."""

    def corner(i: int, default: float) -> Column:
        return F.coalesce(F.try_element_at(bbox_norm, F.lit(i)), F.lit(default))

    box = F.array(
        F.min(corner(1, 0.0)), F.min(corner(2, 0.0)), F.max(corner(3, 1.0)), F.max(corner(4, 1.0))
    )
    return F.when(F.count(F.lit(1)) > 0, box).otherwise(default_box())
