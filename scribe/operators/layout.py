"""Tables of boxes and ink profiles: bands of rows, column gutters, merged boxes, visual rows, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scribe.functions import sweep
from scribe.functions.geometry import area, centre_y, padded


def boxes_of(boxes: DataFrame) -> DataFrame:
    """(page_id, idx, x, y, width, height) -> one row per page, its boxes sorted by (y, x, idx)."""
    box = F.struct(*[F.col(c).cast("int").alias(c) for c in ("y", "x", "idx", "width", "height")])
    return boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def group_rows(pages: DataFrame) -> DataFrame:
    """Adds `rows`: arrays of boxes, first fit in (y, x) order against each row's last member, then sorted.

    Members go by x, rows by their least y; ties keep the order in which they were made. A sweep down each page, with
    only the rows beside the next box open.
    """
    return pages.withColumn("rows", sweep.rows_of_page("boxes", "gutters"))


def merge_boxes(pages: DataFrame, char_height: Column | float, max_gap_ratio: float = 3.0) -> DataFrame:
    """Joins boxes of one line that are near each other and not parted by a gutter; up to four passes to a fixed point."""
    near = (F.lit(char_height) if not isinstance(char_height, Column) else char_height) * max_gap_ratio
    return pages.withColumn("boxes", sweep.merged_of_page("boxes", "gutters", near.cast("double")))


def find_gutters(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """boxes and pages(page_id, page_width, char_height) -> (page_id, gutters).

    x positions that at most a fifth of the text rows cover make a gutter if they are wide enough, away from the
    margins, and have text on both sides in six tenths of the rows. Pages with under 6 boxes or 4 rows have none.
    Boxes of a text row are joined into intervals, whose ends are steps of a running count of covering rows: the work
    grows with the boxes, not with the pixels.
    """
    b = boxes.join(pages.select("page_id", "page_width", "char_height"), "page_id").withColumn("text_row", F.floor((F.col("y") + F.col("height") / 2) / F.greatest(F.lit(1.0), F.col("char_height") * 1.5)))
    enough = b.groupBy("page_id", "page_width", "char_height").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text_row").alias("rows")).where("n >= 6 and rows >= 4")
    # [x, past) are the positions 0 ... page_width that a box covers
    spans = b.select("page_id", "text_row", F.col("x").cast("long").alias("x"), F.least(F.col("x") + F.col("width"), F.col("page_width") + 1).cast("long").alias("past")).where("past > x")
    so_far = F.max("past").over(Window.partitionBy("page_id", "text_row").orderBy("x", "past").rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("so_far", so_far).withColumn("from", F.greatest(F.col("x"), F.coalesce("so_far", F.col("x")))).where("past > from")
    steps = fresh.select("page_id", F.explode(F.array(F.struct(F.col("from").alias("at"), F.lit(1).alias("step")), F.struct(F.col("past").alias("at"), F.lit(-1).alias("step")))).alias("e")).select("page_id", "e.*")
    ends = enough.select("page_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("step")), F.struct((F.col("page_width") + 1).cast("long").alias("at"), F.lit(0).alias("step")))).alias("e")).select("page_id", "e.*")
    steps = steps.join(enough.select("page_id"), "page_id", "left_semi").unionByName(ends).groupBy("page_id", "at").agg(F.sum("step").alias("step"))
    along = Window.partitionBy("page_id").orderBy("at")
    parts = steps.withColumn("covered", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("past", F.lead("at").over(along)).where("past is not null and at >= 0")
    # quiet stretches that touch are one
    quiet = parts.join(enough, "page_id").where(F.col("covered") <= F.greatest(F.lit(1), F.floor(F.col("rows") * 0.2)))
    starts = F.when(F.lag("past").over(along).eqNullSafe(F.col("at")), 0).otherwise(1)
    island = quiet.withColumn("starts", starts).withColumn("island", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    bands = island.groupBy("page_id", "page_width", "char_height", "rows", "island").agg(F.min("at").alias("a"), F.max("past").alias("b"))
    margin = F.floor(F.col("page_width") * 0.12)
    bands = bands.where((F.col("b") - F.col("a") >= F.greatest(F.lit(3), F.floor(F.col("char_height") * 1.5))) & (F.col("a") > margin) & (F.col("b") < F.col("page_width") - margin))
    sides = b.select("page_id", "text_row", "x", "width").join(bands.select("page_id", "rows", "a", "b"), "page_id").groupBy("page_id", "rows", "a", "b", "text_row").agg(F.bool_or(F.col("x") + F.col("width") <= F.col("a") + 1).alias("left"), F.bool_or(F.col("x") >= F.col("b") - 1).alias("right"))
    held = sides.groupBy("page_id", "rows", "a", "b").agg(F.count_if(F.col("left") & F.col("right")).alias("both")).where(F.col("both") >= F.col("rows") * 0.6)
    found = held.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")))).alias("gutters"))
    return pages.select("page_id").join(found, "page_id", "left").withColumn("gutters", F.coalesce("gutters", F.array().cast("array<struct<a:int,b:int>>")))


def row_bands(profile: DataFrame, width: Column | int) -> DataFrame:
    """profile(page_id, row, ink) -> (page_id, begin, end): runs of inked rows, thin ones joined to what they stand on.

    A run of at most 0.45 of the page's median height joins the next one across a gap of at most 0.22 of it; bands of
    under 3 rows go.
    """
    width = F.lit(width) if not isinstance(width, Column) else width
    inked = profile.where(F.col("ink") >= F.greatest(F.lit(1), F.floor(width * 0.005)))
    island = F.col("row") - F.row_number().over(Window.partitionBy("page_id").orderBy("row"))
    runs = inked.withColumn("island", island).groupBy("page_id", "island").agg(F.min("row").alias("begin"), (F.max("row") + 1).alias("end"))
    pages = runs.groupBy("page_id").agg(F.percentile(F.col("end") - F.col("begin"), 0.5).alias("typical"), F.array_sort(F.collect_list(F.struct(F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end")))).alias("runs"))

    return pages.select("page_id", F.explode(sweep.bands_of_page("runs", "typical")).alias("band")).select("page_id", "band.begin", "band.end")


def assemble_text(pages: DataFrame) -> DataFrame:
    """Adds text to pages with rows and texts (idx -> text): members joined by spaces, rows by newlines, trimmed."""
    line = lambda row: F.trim(F.array_join(F.transform(row, lambda b: F.element_at("texts", b["idx"])), " "))
    return pages.withColumn("text", F.trim(F.array_join(F.transform("rows", line), "\n")))


def largest_boxes(boxes: DataFrame, most: int) -> DataFrame:
    """The `most` largest boxes of each page, again in (y, x) order by idx."""
    place = F.row_number().over(Window.partitionBy("page_id").orderBy((F.col("width") * F.col("height")).desc(), "y", "x", "idx"))
    return boxes.withColumn("place", place).where(F.col("place") <= most).drop("place")


def regions(boxes: DataFrame, pages: DataFrame, max_lines: int = 200, padding_ratio: float = 0.18, least: int = 4) -> DataFrame:
    """boxes and pages(page_id, page_width, page_height?, char_height) -> one row per page: boxes (the regions) and gutters.

    Gutters are found on all boxes; then boxes of a line are merged, only then the `max_lines` largest by area stay, grow
    by a share of their height inside the page, and go if a side is under `least` pixels. A merged region has the least
    idx of its members. Without page_height regions may grow below the page.
    """
    laid = boxes_of(boxes).join(find_gutters(boxes, pages), "page_id").join(pages.select("page_id", "page_width", *[c for c in ("page_height",) if c in pages.columns], "char_height"), "page_id")
    laid = merge_boxes(laid, F.col("char_height"))
    by_area = F.array_sort(F.transform("boxes", lambda b, i: F.struct((-area(b)).alias("area"), i.alias("i"), b.alias("b"))))
    low = F.col("page_height") if "page_height" in pages.columns else F.lit(2**31 - 1)
    height = low.cast("int")

    def grown(b: Column) -> Column:
        pad = F.floor(b["height"] * padding_ratio).cast("int")
        x, y = F.greatest(F.lit(0), b["x"] - pad), F.greatest(F.lit(0), b["y"] - pad)
        right, under = F.least(F.col("page_width").cast("int"), b["x"] + b["width"] + pad), F.least(height, b["y"] + b["height"] + pad)
        return F.struct(y.alias("y"), x.alias("x"), b["idx"].alias("idx"), (right - x).alias("width"), (under - y).alias("height"))

    kept = F.array_sort(F.transform(F.slice(by_area, 1, max_lines), lambda k: k["b"]))
    sized = F.filter(F.transform(kept, grown), lambda b: (b["width"] >= least) & (b["height"] >= least))
    return laid.withColumn("boxes", sized).select("page_id", "boxes", "gutters")


def reading_order(boxes: DataFrame, texts: DataFrame, pages: DataFrame, max_lines: int = 200, padding_ratio: float = 0.18) -> DataFrame:
    """boxes, texts(page_id, idx, text) and pages as in regions() -> (page_id, text): the whole layout job.

    Texts are those of the regions, as a recogniser gives them for regions(); a region without one counts as empty.
    """
    words = texts.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "text"))).alias("texts"))
    laid = group_rows(regions(boxes, pages, max_lines, padding_ratio))
    return assemble_text(laid.join(words, "page_id")).select("page_id", "text")


def box_columns(boxes: DataFrame, pad: int) -> DataFrame:
    """Adds area, centre_y and the box grown by `pad` inside its page (page_width, page_height)."""
    box = F.struct("x", "y", "width", "height")
    return boxes.select("*", area(box).alias("area"), centre_y(box).alias("centre_y"), padded(box, pad, F.col("page_width"), F.col("page_height")).alias("padded"))
