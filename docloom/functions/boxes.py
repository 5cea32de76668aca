"""Boxes and page sizes from the shapes that layout exports give them."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
_BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])
# Names of a box's sides, and of fields that hold a box; names of a page's width and height.
SIDES = (("x0", "y0", "x1", "y1"), ("left", "top", "right", "bottom"), ("l", "t", "r", "b"))
FIELDS = ("bbox", "box", "position", "layout_bbox", "poly", "polygon")
WIDTH, HEIGHT = ("width", "w", "page_width"), ("height", "h", "page_height")


def number(value: Any) -> float | None:
    """A number, or text that is one."""
    try:
        return None if value is None or isinstance(value, (list, dict)) else float(value)
    except ValueError:
        return None


def coerce(value: Any) -> tuple[float, float, float, float] | None:
    """The box that a JSON value is or holds: four numbers, points, named sides, or a field with one of these, however deep."""
    if isinstance(value, list):
        four = [number(x) for x in value[:4]]
        if len(four) == 4 and None not in four:
            points = [(four[0], four[1]), (four[2], four[3])]
        else:
            pairs = [(p.get("x"), p.get("y")) if isinstance(p, dict) else tuple(p[:2]) if isinstance(p, list) and len(p) > 1 else (None, None) for p in value]
            points = [(x, y) for x, y in ((number(a), number(b)) for a, b in pairs) if x is not None and y is not None]
        xs, ys = zip(*points, strict=True) if points else ((), ())
        return (min(xs), min(ys), max(xs), max(ys)) if points else None
    if not isinstance(value, dict):
        return None
    for names in SIDES:
        if None not in (sides := [number(value.get(n)) for n in names]):
            return coerce(sides)
    return next((b for b in (coerce(value.get(n)) for n in FIELDS) if b), None)


def page_size_of(value: Any) -> tuple[float | None, float | None]:
    """(width, height) of a JSON value."""
    if not isinstance(value, dict):
        return None, None
    found = [next((n for n in (number(value.get(x)) for x in names) if n is not None), None) for names in (WIDTH, HEIGHT)]
    size = value.get("size")
    if found[0] is None and size is not None:
        return (number(size[0]), number(size[1])) if isinstance(size, list) and len(size) > 1 else page_size_of(size)
    return found[0], found[1]


def box(source: Column) -> Column:
    """coerce() of JSON text."""

    def run(found: pd.Series) -> pd.DataFrame:
        each = [coerce(json.loads(x)) if x else None for x in found]
        return pd.DataFrame([b or (None,) * 4 for b in each], columns=_BOX.names, dtype="float64")

    made = F.pandas_udf(run, _BOX)(source)
    return F.when(made["x0"].isNotNull(), made)


def inside(b: Column, width: Column, height: Column) -> Column:
    """Whether a box lies in its page, give or take 1; so it is if the page's size isn't known."""
    fits = lambda v, most: v.between(F.lit(-1.0), most + 1)
    return F.coalesce(fits(b["x0"], width) & fits(b["x1"], width) & fits(b["y0"], height) & fits(b["y1"], height), F.lit(True)) | width.isNull() | height.isNull()


def overlap(a: Column, b: Column) -> Column:
    """Share of the lower box's height (1 at least) in which two boxes stand side by side."""
    both = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when(both > 0, both / F.greatest(F.lit(1.0), F.least(a["y1"] - a["y0"], b["y1"] - b["y0"]))).otherwise(0.0)
