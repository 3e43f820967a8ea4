"""Sample tables (image_id, y, x, raw): palettes, masks, deltas, tiles and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators.skew import running


def palette_lookup(samples: DataFrame, palettes: DataFrame, components: int) -> DataFrame:
    """Samples with r, g, b from the palette (image_id, high, lookup bytes as array of int).

    The index is clamped to ``high``. Bytes past the end are 0, or the first channel for RGB.
    """
    joined = samples.join(palettes, "image_id")
    at = F.least("raw", "high") * components

    def byte(n: int, default: Column) -> Column:
        return F.coalesce(F.get("lookup", at + n), default)

    zero = F.lit(0)
    first = byte(0, zero)
    if components == 1:
        rgb = (first, first, first)
    elif components == 3:
        rgb = (first, byte(1, first), byte(2, first))
    else:
        black = byte(3, zero)
        rgb = tuple(F.rint((1 - F.least(F.lit(1.0), (byte(n, zero) + black) / 255)) * 255).cast("int") for n in range(3))
    return joined.select(*samples.columns, *[c.alias(n) for c, n in zip(rgb, "rgb")])


def unpack_bits(rows: DataFrame, packed: str, width: Column, bits: int) -> DataFrame:
    """Byte rows (image_id, y, packed array of int) to samples; the high bits come first."""
    per = 8 // bits
    spots = rows.withColumn("x", F.explode(F.sequence(F.lit(0), width - 1)))
    shift = (per - 1 - F.col("x") % per) * bits
    value = F.call_function("shiftright", F.get(packed, F.floor(F.col("x") / per).cast("int")), shift.cast("int")).bitwiseAND((1 << bits) - 1)
    return spots.select("image_id", "y", "x", value.alias("value"))


def paint_mask(bit: Column, inverted: Column) -> Column:
    """Whether a mask bit paints."""
    return (bit == 1) != inverted


def paint_brightness(level: Column, inverted: Column) -> Column:
    """The same from a decoded gray level in 0..255: dark paints."""
    return (level / 255 < 0.5) != inverted


def apply_soft_mask(samples: DataFrame, mask: DataFrame) -> DataFrame:
    """Samples (image_id, y, x, alpha) with the alpha of a mask (image_id, y, x, mask) applied.

    An image keeps its alpha if the sizes differ or the result would be all but invisible: no alpha at
    all, a mean below 2, or fewer visible samples than 1 in 200.
    """
    def size(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("image_id").agg(F.struct(F.max("x").alias("x"), F.max("y").alias("y")).alias(name))

    masked = samples.join(mask, ["image_id", "y", "x"], "left").withColumn(
        "_new", F.floor((F.col("alpha") * F.col("mask") + 127) / 255).cast("int"))
    verdict = masked.groupBy("image_id").agg(
        ((F.max("_new") > 0) & (F.avg(F.coalesce("_new", F.lit(0))) >= 2.0)
         & (F.count_if(F.col("_new") > 0) >= F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 200)))).alias("_seen")
    ).join(size(samples, "_a"), "image_id").join(size(mask, "_b"), "image_id", "left")
    use = verdict.select("image_id", F.coalesce(F.col("_seen") & (F.col("_a") == F.col("_b")), F.lit(False)).alias("_use"))
    return masked.join(use, "image_id").select(
        "image_id", "y", "x", F.when(F.col("_use"), F.coalesce("_new", "alpha")).otherwise(F.col("alpha")).alias("alpha"))


def undelta(samples: DataFrame, axis: str, width: int, height: int) -> DataFrame:
    """Running sums modulo 256 along ``axis`` (x for rows, y for columns); short images stay as they are."""
    other = "y" if axis == "x" else "x"
    full = samples.groupBy("image_id").agg((F.count(F.lit(1)) >= width * height).alias("_full"))
    summed = running(samples, ["image_id", other], [axis], F.floor(F.col(axis) / 4096), {"_sum": ("sum", F.col("raw"))})
    return summed.join(full, "image_id").select(
        "image_id", "y", "x", F.when(F.col("_full"), F.col("_sum") % 256).otherwise(F.col("raw")).cast("int").alias("raw"))


def check_payload(images: DataFrame) -> DataFrame:
    """Images (image_id, width, height, bits, components, bytes) with the expected bytes and a reason or null."""
    row = F.ceil(F.col("width") * F.col("bits") * F.col("components") / 8)
    expected = (row * F.col("height")).cast("long")
    reason = F.when(~F.col("bits").isin(1, 2, 4, 8), "bits").when(F.col("bytes") < expected, "short")
    return images.withColumns({"expected": expected, "reason": reason})


def tile_grid(images: DataFrame, tile_w: int, tile_h: int, origin_x: int = 0, origin_y: int = 0) -> DataFrame:
    """Tiles of images (image_id, width, height): tile, x0..y1 clipped to the image; empty ones skipped."""
    def tiles(side: str, origin: int, step: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.ceil((F.col(side) - origin) / step).cast("int") - 1))

    cells = images.filter((F.col("width") > origin_x) & (F.col("height") > origin_y)).select(
        "image_id", "width", "height", tiles("width", origin_x, tile_w).alias("tx")
    ).select("*", tiles("height", origin_y, tile_h).alias("ty"))
    columns = F.ceil((F.col("width") - origin_x) / tile_w)
    clipped = cells.select(
        "image_id", (F.col("ty") * columns + F.col("tx")).cast("int").alias("tile"),
        F.greatest(F.lit(0), F.col("tx") * tile_w + origin_x).alias("x0"), F.greatest(F.lit(0), F.col("ty") * tile_h + origin_y).alias("y0"),
        F.least("width", (F.col("tx") + 1) * tile_w + origin_x).alias("x1"), F.least("height", (F.col("ty") + 1) * tile_h + origin_y).alias("y1"),
    )
    return clipped.filter("x1 > x0 AND y1 > y0")


def tile_stats(samples: DataFrame, images: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Least, greatest and mean sample and count per tile; a tile without samples has count 0."""
    sized = samples.join(images.select("image_id", "width"), "image_id")
    tile = F.floor(F.col("y") / tile_h) * F.ceil(F.col("width") / tile_w) + F.floor(F.col("x") / tile_w)
    stats = sized.groupBy("image_id", tile.cast("int").alias("tile")).agg(
        F.min("raw").alias("low"), F.max("raw").alias("high"), F.avg("raw").alias("mean"), F.count(F.lit(1)).alias("n"))
    grid = tile_grid(images, tile_w, tile_h).select("image_id", "tile")
    return grid.join(stats, ["image_id", "tile"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def image_inventory(images: DataFrame, dims: list[str], included: Column, passes: str, bytes_: str) -> DataFrame:
    """Counts and sums by the dimensions with subtotals; ``level`` tells the subtotals apart."""
    return images.withColumn("_in", included).rollup(*dims).agg(
        F.count(F.lit(1)).alias("images"), F.count_if("_in").alias("included"),
        F.sum(passes).alias("passes"), F.sum(bytes_).alias("bytes"), F.grouping_id().alias("level"))
