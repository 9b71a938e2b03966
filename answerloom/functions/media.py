"""Image sizes and data URIs. Pixels are not resampled here: sizes only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.functions.tables import CANVAS, MAX_PIXELS, THUMBNAIL


def capped(w: Column, h: Column, most: int = MAX_PIXELS) -> Column:
    """(w, h) shrunk to at most ``most`` pixels, sides truncated, one at least."""
    area = w.cast("long") * h
    scale = F.sqrt(F.lit(most) / area)
    side = lambda x: F.when(area <= most, x.cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), (x * scale).cast("long")))
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def on_canvas(w: Column, h: Column, side: int = CANVAS) -> Column:
    """(w, h, x, y): the size on a square canvas and where it is pasted; sides rounded half-even."""
    scale = F.lit(float(side)) / F.greatest(w, h)
    fit = lambda x: F.greatest(F.lit(1).cast("long"), F.bround(x * scale, 0).cast("long"))
    gap = lambda x: F.floor((F.lit(side) - fit(x)) / 2).cast("long")
    return F.struct(fit(w).alias("w"), fit(h).alias("h"), gap(w).alias("x"), gap(h).alias("y"))


def thumbnail(w: Column, h: Column, side: int = THUMBNAIL) -> Column:
    """(w, h) shrunk to fit a square, in proportion; smaller images stay."""
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(w, h))
    fit = lambda x: F.greatest(F.lit(1).cast("long"), F.round(x * scale, 0).cast("long"))
    return F.struct(fit(w).alias("w"), fit(h).alias("h"))


def data_uri(content: Column) -> Column:
    """A data URI of image bytes: PNG by its first four bytes, JPEG otherwise."""
    png = F.substring(content, 1, 4) == F.unhex(F.lit("89504E47"))
    kind = F.when(png, "image/png").otherwise("image/jpeg")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))
