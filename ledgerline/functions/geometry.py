"""Rectangles and scales of captured frames as column arithmetic. Without a usable frame, rectangles are empty and scales 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.scalars import half_up

#: The long side to scale a whole frame to, and the most it may become.
LONG_SIDE, MOST = 2400, 4000


def finite(*xs: Column) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    return out


def inside(x: Column, most: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), most)


def rect(x: Column, y: Column, width: Column, height: Column, ok: Column) -> Column:
    """struct x, y, width, height, rounded; all 0 if it isn't ok or holds nothing."""
    w, h = half_up(width), half_up(height)
    full = ok & (w > 0) & (h > 0)
    part = lambda v, name: F.when(full, v).otherwise(0).cast("long").alias(name)
    return F.struct(part(half_up(x), "x"), part(half_up(y), "y"), part(w, "width"), part(h, "height"))


def selection_to_source(sel: Column, shown_w: Column, shown_h: Column, w: Column, h: Column) -> Column:
    """A selection (x, y, width, height; either direction) on a shown frame, in pixels of the frame."""
    ok = finite(shown_w, shown_h, w, h) & (shown_w > 0) & (shown_h > 0) & (w > 0) & (h > 0)
    ends = {}
    for at, size, shown, most in (("x", "width", shown_w, w), ("y", "height", shown_h, h)):
        a, b = sel[at], sel[at] + sel[size]
        ends[at] = [inside(e * most / shown, most) for e in (F.least(a, b), F.greatest(a, b))]
    (x0, x1), (y0, y1) = ends["x"], ends["y"]
    return rect(x0, y0, x1 - x0, y1 - y0, ok)


def crop_rect(region: Column, w: Column, h: Column) -> Column:
    """A region in shares of the frame (x, y, w, h), in pixels."""
    ok = finite(w, h, region["x"], region["y"], region["w"], region["h"]) & (w > 0) & (h > 0)
    one = F.lit(1.0)
    x0, x1 = inside(region["x"], one) * w, inside(region["x"] + region["w"], one) * w
    y0, y1 = inside(region["y"], one) * h, inside(region["y"] + region["h"], one) * h
    return rect(x0, y0, x1 - x0, y1 - y0, ok)


def full_frame(w: Column, h: Column) -> Column:
    return rect(F.lit(0.0), F.lit(0.0), w, h, finite(w, h) & (w > 0) & (h > 0))


def full_frame_scale(w: Column, h: Column) -> Column:
    long = F.greatest(w, h)
    return F.when(finite(w, h) & (w > 0) & (h > 0), F.least(F.greatest(LONG_SIDE / long, F.lit(1.0)), F.greatest(MOST / long, F.lit(1.0)))).otherwise(1.0)


def capture_region(region: Column) -> Column:
    """A stored region with its shares brought into 0 to 1; null if it is unusable or empty."""
    one = F.lit(1.0)
    x, y, w, h = (inside(region[c], one).alias(c) for c in "xywh")
    return F.when(finite(*[region[c] for c in "xywh"]) & (region["w"] > 0) & (region["h"] > 0), F.struct(x, y, w, h))


def capture_delay(x: Column, default: int = 500, most: int = 3000) -> Column:
    return F.when(finite(x), F.least(F.greatest(half_up(x), F.lit(0)), F.lit(most))).otherwise(default).cast("long")


def nearest_option(x: Column, options: list[int]) -> Column:
    """The option nearest to x, the first of equally near ones."""
    ranked = F.transform(F.array(*map(F.lit, options)), lambda o: F.struct(F.abs(o - x).alias("gap"), F.array_position(F.array(*map(F.lit, options)), o).alias("at"), o.alias("option")))
    return F.array_min(ranked)["option"]
