"""Page layout of a scan, from its pages' sizes and margins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from foliant.functions import text as X
from foliant.operators.medians import medians

#: Side -> (least, most, default) fraction of the page. Fixed values.
MARGINS = {
    "left": (0.08, 0.17, 0.13),
    "right": (0.08, 0.17, 0.13),
    "top": (0.05, 0.12, 0.09),
    "bottom": (0.05, 0.12, 0.09),
}


#: Least dark pixels of a line of ink: as a share of the line, and in any case; and what is dark. Fixed values.
INK_SHARE, INK_LEAST, DARK = 0.02, 6, 215


#: Width and height that a page is reduced to fit before it is measured. Fixed values.
THUMBNAIL = (600, 800)


def reduced(page: np.ndarray, most: tuple[int, int] = THUMBNAIL) -> np.ndarray:
    """A grayscale page that fits a width and height, in its proportions: each pixel is the average of those it stands for."""
    size = page.shape
    scale = min(1.0, most[1] / size[0], most[0] / size[1])
    if scale == 1.0:
        return page
    new = [max(1, min(limit, round(n * scale))) for n, limit in zip(size, reversed(most))]
    cuts = [np.arange(n) * old // n for n, old in zip(new, size)]
    total = np.add.reduceat(np.add.reduceat(page.astype(np.int64), cuts[0], axis=0), cuts[1], axis=1)
    area = np.outer(*(np.diff(np.append(c, n)) for c, n in zip(cuts, size)))
    return ((total + area // 2) // area).astype(np.uint8)


def _clamped(c: Column, least: float, most: float, default: float) -> Column:
    """Between bounds; the default for null (greatest and least alone would pass nulls over)."""
    return F.when(c.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), c)))


@F.pandas_udf(StructType([StructField(side, DoubleType()) for side in MARGINS]))
def margins(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """The margins of a page's content as fractions of the page, from its grayscale pixels (a byte each, row by row), reduced to
    a thumbnail first; nulls for a page without ink or pixels that don't fit the size."""
    out = []
    for data, w, h in zip(pixels, width, height):
        sides = [None] * 4
        if data is not None and w and h and len(data) == int(w) * int(h):
            dark = reduced(np.frombuffer(data, np.uint8).reshape(int(h), int(w))) < DARK
            h, w = dark.shape
            inked = [np.flatnonzero(dark.sum(axis) >= max(INK_LEAST, int(n * INK_SHARE))) for axis, n in ((0, h), (1, w))]
            if len(inked[0]) and len(inked[1]):
                sides = [x for places, n in zip(inked, (int(w), int(h))) for x in (places[0] / n, (n - 1 - places[-1]) / n)]
        out.append(sides)
    return pd.DataFrame(out, columns=["left", "right", "top", "bottom"], dtype=float)


def layout_profile(pages: DataFrame, key: str, many: int | None = None) -> DataFrame:
    """Profile of each key's pages (width, height in bp; margins as fractions, null where unknown): exact medians.

    Without `many` a key's values are held by an aggregate; with it keys of more pages than that are counted out (medians).
    """
    measures = ("width", "height", *MARGINS)
    if many is None:
        held = pages.groupBy(key).agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in measures), F.count("left").alias("sampled"))
    else:
        sampled = pages.groupBy(F.col(key).alias("_key")).agg(F.count("left").alias("sampled"))
        held = medians(pages, key, measures, many).join(sampled, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    found = held.select(key, *(F.round(c, 2).alias(f"{c}_bp") for c in ("width", "height")), "sampled", *(F.round(_clamped(F.col(s), *bounds), 4).alias(s) for s, bounds in MARGINS.items()))
    w, h = F.col("width_bp") / 72, F.col("height_bp") / 72
    font = F.when((w <= 5.9) & (h <= 8.6), 12).when((w <= 6.4) | (h <= 9.2), 11).otherwise(10)
    bp = {s: F.round(F.col("width_bp" if s in ("left", "right") else "height_bp") * F.col(s), 2) for s in MARGINS}
    parts = [("paperwidth", F.col("width_bp")), ("paperheight", F.col("height_bp")), *((s, bp[s]) for s in ("top", "bottom", "left", "right"))]
    geometry = F.concat_ws(",", *(F.concat(F.lit(f"{n}="), X.tex_length(c, "bp")) for n, c in parts), F.lit("headheight=14pt"))
    return found.select(key, "width_bp", "height_bp", F.round(w, 2).alias("width_in"), F.round(h, 2).alias("height_in"), font.alias("font_size_pt"), *MARGINS, geometry.alias("geometry_options"), "sampled")
