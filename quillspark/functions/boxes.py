"""Bounding boxes as structs of four doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(value: Column, total: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value, total))))


def from_pixels(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Corner at the top left, in parts of the page, each within 0 and 1; 0 for a page without size."""
    return F.struct(
        _ratio(x1, width).alias("x"), _ratio(y1, height).alias("y"), _ratio(x2 - x1, width).alias("width"), _ratio(y2 - y1, height).alias("height")
    )


def from_bottom_left(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The same for boxes whose y runs upwards."""
    return from_pixels(x1, height - y2, x2, height - y1, width, height)


def from_grid(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, padding: float = 0.0) -> Column:
    """Box on a grid of 0 to 999: clamped, corners in order, whole pixels, padded; null if empty."""
    cut = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(999.0), v.cast("double")))
    at = lambda v, size: F.floor(v / 999 * size).cast("int")
    left, right = at(F.least(cut(x1), cut(x2)), width), at(F.greatest(cut(x1), cut(x2)), width)
    top, bottom = at(F.least(cut(y1), cut(y2)), height), at(F.greatest(cut(y1), cut(y2)), height)
    empty = (right <= left) | (bottom <= top)
    if padding > 0:
        pad_x = F.greatest(F.lit(1), F.floor((right - left) * padding).cast("int"))
        pad_y = F.greatest(F.lit(1), F.floor((bottom - top) * padding).cast("int"))
        left, right = F.greatest(F.lit(0), left - pad_x), F.least(width, right + pad_x)
        top, bottom = F.greatest(F.lit(0), top - pad_y), F.least(height, bottom + pad_y)
    box = F.struct((left / width).alias("x"), (top / height).alias("y"), ((right - left) / width).alias("width"), ((bottom - top) / height).alias("height"))
    return F.when(~empty, box)


def fragment(box: Column) -> Column:
    """#bbox=x,y,width,height from either field naming; empty unless all four are numbers.

    ``box`` is a map of names to doubles.
    """
    pick = lambda *names: F.coalesce(*(F.try_element_at(box, F.lit(n)) for n in names))
    parts = [pick("x", "left"), pick("y", "top"), pick("width", "w"), pick("height", "h")]
    whole = lambda v: F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
    missing = F.lit(False)
    for p in parts:
        missing = missing | p.isNull()
    return F.when(missing, "").otherwise(F.concat(F.lit("#bbox="), F.concat_ws(",", *(whole(p) for p in parts))))
