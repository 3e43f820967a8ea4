"""Keeping a document point in place when the layout changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.geom import rnd
from pagelens.operators.spatial import locate_page


def anchor_roundtrip(old: DataFrame, new: DataFrame, points: DataFrame, point_key: str) -> DataFrame:
    """Relative place of each point on its page, and the scroll target for it in the new layout."""
    held = locate_page(points, old, point_key).withColumns({
        "rel_x": F.col("local_x") / F.greatest(F.lit(1), "w"), "rel_y": F.col("local_y") / F.greatest(F.lit(1), "h"),
    }).drop("w", "h")
    return held.join(new, ["doc_id", "page_index"]).select(
        "doc_id", point_key, "page_index", "rel_x", "rel_y",
        rnd(F.col("x") + F.col("w") * F.col("rel_x") - F.col("px")).cast("long").alias("target_x"),
        rnd(F.col("y") + F.col("h") * F.col("rel_y") - F.col("py")).cast("long").alias("target_y"),
    )
