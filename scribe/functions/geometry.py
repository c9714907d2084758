"""Geometry of line images, label budgets and boxes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_width(width: Column, height: Column, target_height: int) -> Column:
    """The width at the target height, halves to the even side."""
    return F.greatest(F.lit(1), F.rint(width * target_height / height).cast("int"))


def line_geometry(width: Column, height: Column, target_height: int = 64, target_width: int = 512, compress: bool = True) -> Column:
    """struct(natural, scaled, content_ratio, truncated, lost_fraction) of a line image on its canvas."""
    natural = natural_width(width, height, target_height)
    scaled = F.least(natural, F.lit(target_width))
    cut = (natural > target_width) & F.lit(not compress)
    return F.struct(
        natural.alias("natural"),
        scaled.alias("scaled"),
        (scaled / target_width).alias("content_ratio"),
        cut.alias("truncated"),
        F.when(cut, 1 - F.lit(target_width) / natural).otherwise(0.0).alias("lost_fraction"),
    )


def canvas_width(widest: Column, least: int = 32, most: int = 2048) -> Column:
    """The canvas that a batch shares: the widest line, rounded up to a multiple of 4."""
    return F.least(F.greatest((F.ceil(widest / 4) * 4).cast("int"), F.lit(least)), F.lit(most))


def shared_canvas(lines: DataFrame, *batch: str, target_height: int = 64, least: int = 128, most: int = 2048) -> DataFrame:
    """lines(batch..., width, height) -> the same with canvas, content_ratio and compressed.

    All lines of a batch share the canvas of its widest one; a line that is wider still, where the canvas is at its
    limit, is compressed to fit and fills it.
    """
    natural = natural_width(F.col("width"), F.greatest(F.lit(1), F.col("height")), target_height)
    rows = lines.withColumn("natural", natural).withColumn("canvas", canvas_width(F.max("natural").over(Window.partitionBy(*batch)), least, most))
    return rows.withColumns({"content_ratio": F.least("natural", "canvas") / F.col("canvas"), "compressed": F.col("natural") > F.col("canvas")})


def time_steps(width: int) -> int:
    return width // 4 - 1


def max_label_length(width: int) -> int:
    """Six tenths of the time steps, at least 4."""
    return max(4, int(0.6 * time_steps(width)))


def valid_steps(ratio: Column, steps: int, target_length: Column) -> Column:
    return F.least(F.greatest(F.ceil(ratio * steps).cast("int"), target_length, F.lit(1)), F.lit(steps))


def area(box: Column) -> Column:
    return box["width"] * box["height"]


def centre_y(box: Column) -> Column:
    return box["y"] + box["height"] / 2


def padded(box: Column, pad: int, page_width: Column, page_height: Column) -> Column:
    """The box grown by `pad` on every side, inside the page."""
    x, y = F.greatest(F.lit(0), box["x"] - pad), F.greatest(F.lit(0), box["y"] - pad)
    right = F.least(page_width, box["x"] + box["width"] + pad)
    low = F.least(page_height, box["y"] + box["height"] + pad)
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (low - y).alias("height"))


def vertical_overlap(a: Column, b: Column) -> Column:
    return F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])


def same_row(a: Column, b: Column, share: float = 0.5) -> Column:
    over = vertical_overlap(a, b)
    return (over > 0) & (over >= share * F.least(a["height"], b["height"]))
