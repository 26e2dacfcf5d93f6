"""Boxes: conversion, repair of image sizes, size and aspect buckets, letterbox and feature-map ranges. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the size buckets by area ratio, and the aspect bounds.
SIZE_BOUNDS = (("tiny", 0.005), ("small", 0.02), ("medium", 0.08), ("large", 0.20))
SIZES = ("tiny", "small", "medium", "large", "huge")
WIDE, TALL = 1.8, 0.56


def clamp(x: Column, low: int, high: Column) -> Column:
    return F.greatest(F.lit(low), F.least(high, x))


def box_from_center(cx: Column, cy: Column, w: Column, h: Column, image_w: Column, image_h: Column, expand: float = 0.0) -> Column:
    """struct(x1, y1, x2, y2) in pixels of a normalised centre box; each side is widened by half of ``expand``; halves round to even."""

    def ends(c: Column, size: Column, image: Column) -> tuple[Column, Column]:
        lo, hi = (c - size / 2.0) * image, (c + size / 2.0) * image
        if expand:
            more = (hi - lo) * expand / 2.0
            lo, hi = lo - more, hi + more
        return tuple(F.bround(x).cast("int") for x in (lo, hi))

    (x1, x2), (y1, y2) = ends(cx, w, image_w), ends(cy, h, image_h)
    return F.struct(clamp(x1, 0, image_w - 1).alias("x1"), clamp(y1, 0, image_h - 1).alias("y1"), clamp(x2, 0, image_w).alias("x2"), clamp(y2, 0, image_h).alias("y2"))


def large_enough(box: Column, least: int = 2) -> Column:
    return (box["x2"] - box["x1"] >= least) & (box["y2"] - box["y1"] >= least)


def size_bucket(area_ratio: Column) -> Column:
    out = F.lit(SIZES[-1])
    for name, bound in reversed(SIZE_BOUNDS):
        out = F.when(area_ratio < bound, F.lit(name)).otherwise(out)
    return out


def size_code(bucket: Column) -> Column:
    """0 to 4; -1 for an unknown bucket."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SIZES)), bucket).cast("int"), F.lit(0)) - 1


def aspect_bucket(ratio: Column) -> Column:
    return F.when(ratio >= WIDE, "wide").when(ratio <= TALL, "tall").otherwise("balanced")


def box_stats(x1: Column, y1: Column, x2: Column, y2: Column, image_w: Column, image_h: Column) -> list[Column]:
    """Columns of a box's size, with image sizes that are missing or too small repaired."""
    w, h = F.greatest(F.lit(1), x2 - x1), F.greatest(F.lit(1), y2 - y1)
    iw = F.greatest(F.lit(1), F.coalesce(image_w, F.lit(0)), x2, w)
    ih = F.greatest(F.lit(1), F.coalesce(image_h, F.lit(0)), y2, h)
    area, aspect = (w * h) / (iw * ih), w / h
    return [w.alias("bbox_width"), h.alias("bbox_height"), (w * h).alias("bbox_area"), iw.alias("image_width"), ih.alias("image_height"), area.alias("area_ratio"), (area * 100).alias("area_pct"), size_bucket(area).alias("size_bucket"), aspect.alias("aspect_ratio"), aspect_bucket(aspect).alias("aspect_bucket")]


def letterbox_shape(width: Column, height: Column, new_h: int, new_w: int, stride: int = 32, auto: bool = True) -> Column:
    """struct(h, w) of an image resized into a frame and padded, to the next multiple of the stride if ``auto``."""
    ratio = F.least(F.lit(float(new_h)) / height, F.lit(float(new_w)) / width)
    uw, uh = F.bround(width * ratio).cast("int"), F.bround(height * ratio).cast("int")
    pw, ph = F.lit(new_w) - uw, F.lit(new_h) - uh
    if auto:
        pw, ph = F.pmod(pw, F.lit(stride)), F.pmod(ph, F.lit(stride))
    good = (width > 0) & (height > 0)
    return F.struct(F.when(good, uh + ph).otherwise(new_h).alias("h"), F.when(good, uw + pw).otherwise(new_w).alias("w"))


def cell_range(lo: Column, hi: Column, ratio: Column, pad: Column, tensor: int, cells: int) -> Column:
    """struct(first, last) of feature-map cells that a side covers, one at least; ``last`` is exclusive."""
    a = F.floor((lo * ratio + pad) / max(1, tensor) * cells).cast("int")
    b = F.ceil((hi * ratio + pad) / max(1, tensor) * cells).cast("int")
    first = F.greatest(F.lit(0), F.least(F.lit(cells - 1), a))
    return F.struct(first.alias("first"), F.greatest(first + 1, F.least(F.lit(cells), b)).alias("last"))


def largest_divisor(dim: int, most: int) -> int:
    """The largest divisor of ``dim`` up to ``most``: a product quantiser's number of subspaces."""
    return max(d for d in range(1, max(1, min(dim, most)) + 1) if dim % d == 0)


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The pixels of a crop: corners rounded half to even and clamped to the image, the first ones to its last pixel."""
    low = [clamp(F.bround(c).cast("int"), 0, most - 1) for c, most in ((x1, width), (y1, height))]
    high = [clamp(F.bround(c).cast("int"), 0, most) for c, most in ((x2, width), (y2, height))]
    return F.struct(low[0].alias("x1"), low[1].alias("y1"), high[0].alias("x2"), high[1].alias("y2"))


def detection_size(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Sizes of a detection; an image that is smaller than the box (or unknown) counts as large as the box reaches."""
    x1, y1, x2, y2 = (c.cast("int") for c in (x1, y1, x2, y2))
    w, h = F.greatest(F.lit(1), x2 - x1), F.greatest(F.lit(1), y2 - y1)
    image = F.greatest(F.lit(1), F.coalesce(width, F.lit(0)), x2, w) * F.greatest(F.lit(1), F.coalesce(height, F.lit(0)), y2, h)
    ratio = (w * h) / image
    return F.struct(w.alias("bbox_width"), h.alias("bbox_height"), ratio.alias("area_ratio"), (ratio * 100.0).alias("area_pct"), size_bucket(ratio).alias("size_bucket"))


def detection_group(mode: str, class_name: Column, bucket: Column) -> Column:
    """The group of a detection on a video page: ``Class``, ``Size``, ``Class + Size``, or one group of all."""
    if mode == "Class":
        return class_name
    if mode == "Size":
        return bucket
    return F.concat_ws(" / ", class_name, bucket) if mode == "Class + Size" else F.lit("All crops")
