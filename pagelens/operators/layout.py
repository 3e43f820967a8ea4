"""Page layout: pixel sizes, stacking, fitting and page selection. Pixel values are integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.geom import clamp, rnd
from pagelens.operators.skew import position_block, running

PAGE_MARGIN = 24


def page_pixels(width: Column, height: Column, zoom: Column, degrees: Column) -> tuple[Column, Column]:
    """Pixel width and height of a page; sides swap at 90 and 270 degrees."""
    turned = degrees.isin(90, 270)

    def pixels(side: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(side * zoom)).cast("long")

    return pixels(F.when(turned, height).otherwise(width)), pixels(F.when(turned, width).otherwise(height))


def _stack(df: DataFrame, step: Column, start: int) -> DataFrame:
    """Rows with ``y``: ``start`` plus the steps of the pages before."""
    stacked = running(
        df, ["doc_id"], ["page_index"], position_block("page_index"), {"_before": ("sum", step)}, inclusive=False
    )
    return stacked.withColumn("y", F.col("_before") + start).drop("_before")


def stack_pages(pages: DataFrame, viewport_width: int = 900, margin: int = PAGE_MARGIN) -> DataFrame:
    """Pages (doc_id, page_index, w, h) placed below each other and centred: adds x and y."""
    widest = pages.groupBy("doc_id").agg(
        F.greatest(F.max("w") + 2 * margin, F.lit(viewport_width)).alias("_width")
    )
    return (
        _stack(pages, F.col("h") + margin, margin)
        .join(widest, "doc_id")
        .withColumn("x", F.floor((F.col("_width") - F.col("w")) / 2))
        .drop("_width")
    )


def layout_of(page_dim: DataFrame, zoom: float = 1.0, degrees: int = 0, viewport_width: int = 900) -> DataFrame:
    """Layout (doc_id, page_index, x, y, w, h) of whole documents."""
    w, h = page_pixels(F.col("width_pt"), F.col("height_pt"), F.lit(zoom), F.lit(degrees))
    sized = page_dim.select("doc_id", "page_index", w.alias("w"), h.alias("h"))
    return stack_pages(sized, viewport_width).select("doc_id", "page_index", "x", "y", "w", "h")


def fit_zoom(
    width: Column, height: Column, view_w: Column, view_h: Column, mode: Column, padding: int, degrees: Column
) -> Column:
    """Zoom for mode width, height or auto (landscape pages fit by width), within 0.1 to 8."""
    turned = degrees.isin(90, 270)
    side_w, side_h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    by_w = F.greatest(F.lit(100.0), view_w - padding) / F.greatest(F.lit(1.0), side_w)
    by_h = F.greatest(F.lit(100.0), view_h - padding) / F.greatest(F.lit(1.0), side_h)
    wide = (mode == "width") | ((mode == "auto") & (width > height))
    return clamp(F.when(wide, by_w).otherwise(by_h), 0.1, 8.0)


def stack_thumbnails(pages: DataFrame, item_width: int, caption: int = 28) -> DataFrame:
    """Thumbnail strip (doc_id, page_index, y, w, h, item_height) of pages with width_pt and height_pt."""
    available = max(96, item_width - 16)
    zoom = clamp(F.lit(float(available)) / F.greatest(F.lit(1.0), F.col("width_pt")), 0.08, 1.0)
    w, h = page_pixels(F.col("width_pt"), F.col("height_pt"), zoom, F.lit(0))
    items = pages.select("doc_id", "page_index", w.alias("w"), h.alias("h")).withColumn(
        "item_height", F.col("h") + (16 + 8 + caption)
    )
    return _stack(items, F.col("item_height") + 10, 10)


def select_pages(pages: DataFrame, mode: Column, current: Column, first: Column, last: Column) -> DataFrame:
    """Pages to print: mode all, current (0-based) or range (1-based ends), clamped to the document."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    n, at = F.col("_n"), F.col("page_index")
    low = clamp(first, F.lit(1), n)
    high = clamp(last, low, n)
    wanted = (
        F.when(mode == "current", at == clamp(current, F.lit(0), n - 1))
        .when(mode == "range", at.between(low - 1, high - 1))
        .otherwise(True)
    )
    return pages.join(counts, "doc_id").filter(wanted).drop("_n")


def fit_rect(w: Column, h: Column, left: Column, top: Column, area_w: Column, area_h: Column) -> list[Column]:
    """x, y, width, height of an image scaled evenly into an area and centred in whole pixels."""
    scale = F.least(area_w / w, area_h / h)

    def side(value: Column) -> Column:
        return F.greatest(F.lit(1), rnd(value * scale)).cast("long")

    def toward_zero(value: Column) -> Column:
        return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))

    fit_w, fit_h = side(w), side(h)
    x = left + toward_zero((area_w - fit_w) / 2)
    y = top + toward_zero((area_h - fit_h) / 2)
    return [x.alias("x"), y.alias("y"), fit_w.alias("w"), fit_h.alias("h")]
