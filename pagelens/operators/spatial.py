"""Spatial queries: hit tests of points on boxes, windows on stacked pages, ranking.

Points meet boxes on grid cells and windows meet pages on vertical bands, so one crowded page or one
long document is spread over many join keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.geom import Rect, all_of, any_of
from pagelens.functions.rules import has_text, stripped
from pagelens.operators.skew import first_by, numbered, position_block, running
from pagelens.session import checkpointed, written

CELL = 256.0
BAND = 4096
HOVER_TOLERANCE = 6.0
RENDER_PADDING = 5000
RELEASE_PADDING = 18000
NEIGHBOURS = 2


# --- points on boxes ---------------------------------------------------------------------------

def probe_candidates(
    probes: DataFrame, boxes: DataFrame, tolerance: float = HOVER_TOLERANCE, pages: DataFrame | None = None, large: bool = True
) -> DataFrame:
    """Each probe (probe_id, page_id, x, y) with the boxes that contain it after widening.

    With ``pages`` (page_id, width, height) probes outside their page find nothing. Without ``large``, for pages of a
    checked size, probes and boxes meet on the page; boxes are neither repeated nor moved by cell.
    """
    if pages is not None:
        probes = probes.join(pages, "page_id").filter(
            F.col("x").between(F.lit(0), F.col("width")) & F.col("y").between(F.lit(0), F.col("height"))
        ).select("probe_id", "page_id", "x", "y")
    area = Rect.of().inflate(tolerance)
    if not large:
        return probes.join(boxes, "page_id").filter(area.contains(F.col("x"), F.col("y")))

    def steps(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))

    spread = boxes.select("*", steps(area.x0, area.x1).alias("cx")).select("*", steps(area.y0, area.y1).alias("cy"))
    at = probes.withColumns({"cx": F.floor(F.col("x") / CELL), "cy": F.floor(F.col("y") / CELL)})
    return (
        at.join(spread, ["page_id", "cx", "cy"])
        .filter(area.contains(F.col("x"), F.col("y")))
        .drop("cx", "cy")
    )


def _area(r: Rect) -> Column:
    return F.greatest(F.lit(1.0), r.area)


def drop_dominated(candidates: DataFrame, tolerance: float = HOVER_TOLERANCE) -> DataFrame:
    """Drop small fragments that a much larger candidate of the same probe encloses.

    A probe that would lose all its candidates keeps them.
    """
    r, kind, body = Rect.of(), F.col("kind"), F.col("content")
    # Read by both sides of the comparison and by the verdict per probe: written once.
    rows = checkpointed(candidates.withColumns({
        "area": _area(r), "worded": has_text(body), "text_len": F.coalesce(F.length(stripped(body)), F.lit(0)),
    }))
    tiny_text = all_of(
        kind == "Text", r.w <= 260, r.h <= 90, F.col("worded"), F.col("text_len") <= 8
    )
    tiny_vector = (kind == "VectorPath") & ((r.w <= 26) | (r.h <= 26) | (F.col("area") <= 1500))
    fragments = rows.filter(tiny_text | tiny_vector | (F.col("area") <= 900))

    f, o = Rect.of("f"), Rect.of("o")

    def encloses(pad: float) -> Column:
        frame = o.inflate(pad)
        return frame.contains(f.x0, f.y0) & frame.contains(f.x1, f.y1)

    f_kind, o_kind = F.col("f.kind"), F.col("o.kind")
    wrapped = all_of(
        F.col("f.text_len").between(1, 180), f.h <= 96, (f.w >= 24) | (f.h <= 42),
        F.col("o.area") >= F.col("f.area") * 6, (o.w >= f.w * 1.10) | (o.h >= f.h * 1.30),
    )
    dominates = all_of(
        F.col("f.idx") != F.col("o.idx"), F.col("o.area") > F.col("f.area") * 4, encloses(tolerance * 2),
        any_of(
            (f_kind == "Text") & (o_kind == "Text") & F.col("o.worded"),
            (f_kind == "Text") & (o_kind == "VectorPath") & wrapped,
            (f_kind == "VectorPath") & (o_kind != "Image"),
        ),
    )
    dominated = fragments.alias("f").join(
        rows.filter(kind != "Image").alias("o"), (F.col("f.probe_id") == F.col("o.probe_id")) & dominates, "left_semi"
    ).select("probe_id", "idx", F.lit(True).alias("_gone"))
    flagged = rows.join(dominated, ["probe_id", "idx"], "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    all_gone = flagged.groupBy("probe_id").agg(F.bool_and("_gone").alias("_all"))
    return flagged.join(all_gone, "probe_id").filter(~F.col("_gone") | F.col("_all")).select(*candidates.columns)


def hover_score(x: Column, y: Column, r: Rect, kind: Column, content: Column) -> Column:
    """Lower is better: small boxes with the point near the centre and away from edges."""
    dx = F.abs(x - r.cx) / F.greatest(F.lit(20.0), r.w / 2)
    dy = F.abs(y - r.cy) / F.greatest(F.lit(20.0), r.h / 2)
    inset = F.least(x - r.x0, r.x1 - x, y - r.y0, r.y1 - y)
    edge = F.when(inset <= 0, 0.75).otherwise(1.0 / (1.0 + inset))
    bias = F.when(kind == "Image", -0.35).when((kind == "Text") & has_text(content), -0.15).otherwise(0.0)
    return F.log(_area(r) + 1) * 0.55 + (dx * dx + dy * dy) * 0.35 + edge * 0.10 + bias


def hit_test(probes: DataFrame, boxes: DataFrame, pages: DataFrame | None = None, large: bool = True) -> DataFrame:
    """The object under each probe: probe_id, page_id, idx, kind, score."""
    kept = drop_dominated(probe_candidates(probes, boxes, pages=pages, large=large))
    score = hover_score(F.col("x"), F.col("y"), Rect.of(), F.col("kind"), F.col("content"))
    scored = kept.select("probe_id", "page_id", "idx", "kind", score.alias("score"))
    return first_by(scored, ["probe_id"], ["score", "idx"]).select("probe_id", "page_id", "idx", "kind", "score")


# --- points and windows on stacked pages -------------------------------------------------------

def _bands(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / BAND), F.floor(high / BAND)))


def locate_page(points: DataFrame, layout: DataFrame, point_key: str) -> DataFrame:
    """First page that contains each document point (doc_id, px, py), with local coordinates."""
    pages = layout.withColumn("band", _bands(F.col("y"), F.col("y") + F.col("h")))
    at = points.withColumn("band", F.floor(F.col("py") / BAND))
    box = Rect(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    found = at.join(pages, ["doc_id", "band"]).filter(box.contains(F.col("px"), F.col("py"))).select(
        point_key, "doc_id", "px", "py", "page_index",
        (F.col("px") - F.col("x")).alias("local_x"), (F.col("py") - F.col("y")).alias("local_y"), "w", "h",
    )
    return first_by(found, [point_key, "doc_id"], ["page_index"])


def visible_pages(windows: DataFrame, layout: DataFrame, padding: int = 0) -> DataFrame:
    """Pages that strictly intersect each window (doc_id, top, width, height) grown up and down.

    Adds the areas inside the plain and inside the grown window. Windows are small before they are spread over bands,
    so they look small enough to broadcast; the hint keeps their rows out of the driver.
    """
    low, high = F.col("top") - padding, F.col("top") + F.col("height") + padding
    zones = windows.select("*", low.alias("z0"), high.alias("z1"), _bands(low, high).alias("band"))
    pages = layout.select("*", _bands(F.col("y"), F.col("y") + F.col("h")).alias("band"))
    once = F.col("band") == F.floor(F.greatest("z0", "y") / BAND)
    hit = all_of(
        F.col("y") < F.col("z1"), F.col("z0") < F.col("y") + F.col("h"),
        F.col("x") < F.col("width"), F.col("x") + F.col("w") > 0,
    )
    wide = F.least(F.col("x") + F.col("w"), "width") - F.greatest(F.lit(0), "x")
    bottom = F.col("y") + F.col("h")
    tall = F.least(bottom, F.col("top") + F.col("height")) - F.greatest("y", "top")
    return zones.hint("merge").join(pages, ["doc_id", "band"]).filter(once & hit).select(
        "doc_id", "top", "width", "height", "page_index", "x", "y", "w", "h",
        (wide * F.greatest(F.lit(0), tall)).cast("long").alias("view_area"),
        (wide * (F.least(bottom, "z1") - F.greatest("y", "z0"))).cast("long").alias("zone_area"),
    )


def expand_neighbours(seeds: DataFrame, counts: DataFrame, radius: int | Column) -> DataFrame:
    """Distinct (doc_id, page_index) within ``radius`` of the seeds, inside 0..n-1."""
    seeds = seeds.withColumn("_radius", radius if isinstance(radius, Column) else F.lit(radius))
    inside = seeds.join(counts, "doc_id").filter(F.col("page_index").between(F.lit(0), F.col("n") - 1))
    around = F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("page_index") - F.col("_radius")), F.least(F.col("n") - 1, F.col("page_index") + F.col("_radius"))
    ))
    return inside.select("doc_id", around.alias("page_index")).distinct()


def page_counts(layout: DataFrame) -> DataFrame:
    return layout.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def union_index_sets(*sets: DataFrame) -> DataFrame:
    """Set union of index sets."""
    out = sets[0]
    for part in sets[1:]:
        out = out.unionByName(part)
    return out.distinct()


def _half(value: Column) -> Column:
    return F.floor(value / 2)


def nearest_page(windows: DataFrame, layout: DataFrame) -> DataFrame:
    """Page whose centre is nearest to each window's centre line, lowest index on ties.

    Pages are stacked, so only the last page centred above the line and the first at or below it can
    be nearest: two running picks, one from either end, over lines and centres numbered together.
    A window of a document without pages has no nearest page and gives no row.
    """
    none = F.lit(None).cast("long")
    pages = layout.select(
        "doc_id", (F.col("y") + _half(F.col("h"))).alias("at"), F.lit(1).alias("page"),
        F.col("page_index").cast("long").alias("page_index"), none.alias("top"),
    )
    lines = windows.select(
        "doc_id", (F.col("top") + _half(F.col("height"))).cast("long").alias("at"), F.lit(0).alias("page"),
        none.alias("page_index"), F.col("top").cast("long").alias("top"),
    )
    both = pages.unionByName(lines)
    spot = F.when(F.col("page") == 1, F.struct("at", "page_index"))
    both = numbered(both, ["doc_id"], ["at", "page", "page_index", "top"])
    picks = {"above": ("last", spot), "below": ("last", spot)}
    picked = running(both, ["doc_id"], ["_pos"], position_block("_pos"), picks, reverse=["below"]).filter("page = 0")

    def candidate(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(
            F.abs(F.col("at") - F.col(f"{name}.at")).alias("distance"), F.col(f"{name}.page_index").alias("page_index")
        ))

    best = F.least(candidate("above"), candidate("below"))
    return picked.filter(best.isNotNull()).select("doc_id", "top", best["page_index"].alias("page_index"), best["distance"].alias("distance"))


def dominant_page(windows: DataFrame, layout: DataFrame) -> DataFrame:
    """Page that fills each window most: pages across the centre line first, then area, then distance.

    A window without a visible page takes the nearest page.
    """
    line = F.col("top") + _half(F.col("height"))
    layout = written(layout)  # read by the visible pages and by the nearest ones
    seen = visible_pages(windows, layout).select(
        "doc_id", F.col("top").cast("long").alias("top"), "page_index",
        F.when((F.col("y") <= line) & (F.col("y") + F.col("h") >= line), 0).otherwise(1).alias("off"),
        "view_area", F.abs(F.col("y") + _half(F.col("h")) - line).alias("away"),
    )
    best = first_by(seen, ["doc_id", "top"], ["off", -F.col("view_area"), "away", "page_index"]).select(
        "doc_id", "top", F.col("page_index").cast("long").alias("_best")
    )
    asked = windows.select("doc_id", F.col("top").cast("long").alias("top"), "width", "height").join(best, ["doc_id", "top"], "left")
    asked = written(asked)
    lost = asked.filter("_best IS NULL").drop("_best")
    near = nearest_page(lost, layout.join(lost.select("doc_id").distinct(), "doc_id", "left_semi"))
    return asked.filter("_best IS NOT NULL").select("doc_id", "top", F.col("_best").alias("page_index")).unionByName(
        near.select("doc_id", "top", "page_index"))


def rank_pages(windows: DataFrame, layout: DataFrame, preferred: DataFrame) -> DataFrame:
    """Render order of each window: preferred pages, then visible, larger areas, nearer centre.

    Only pages in the render zone or preferred are ranked, so a window's rank group is bounded by the
    zone height over the least page step.
    """
    keys = ["doc_id", "page_index"]
    zone = visible_pages(windows, layout, RENDER_PADDING)
    chosen = preferred.join(windows.hint("merge"), "doc_id").join(layout, keys)
    zero = F.lit(0).cast("long")
    rest = chosen.join(zone.select("top", *keys), ["top", *keys], "left_anti").select(
        *[c for c in zone.columns if c not in ("view_area", "zone_area")],
        zero.alias("view_area"), zero.alias("zone_area"),
    )
    liked = preferred.select(*keys, F.lit(1).alias("liked"))
    away = F.abs(F.col("x") + _half(F.col("w")) - _half(F.col("width"))) + F.abs(
        F.col("y") + _half(F.col("h")) - F.col("top") - _half(F.col("height"))
    )
    rows = zone.unionByName(rest).join(liked, keys, "left").select(
        "doc_id", "top", "page_index", F.coalesce("liked", F.lit(0)).alias("liked"),
        "view_area", "zone_area", away.cast("long").alias("away"),
    )
    order = Window.partitionBy("doc_id", "top").orderBy(
        F.col("liked").desc(), F.col("view_area").desc(), F.col("zone_area").desc(), "away", "page_index"
    )
    return rows.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def reorder_by_rank(queue: DataFrame, rank: DataFrame, current: DataFrame) -> DataFrame:
    """Queue rows of the current generation whose page has a rank, in rank order."""
    return (
        queue.join(current, ["doc_id", "generation"], "left_semi")
        .join(rank, ["doc_id", "page_index"])
        .orderBy("doc_id", "rank", "request_id")
    )


def resident_set(windows: DataFrame, layout: DataFrame) -> DataFrame:
    """Pages to keep: neighbours of the pages in the release zone, of visible pages, of the dominant page.

    The layout is read by every part, so it is written once; a page is a seed once, at its largest radius.
    """
    layout = written(layout)

    def seeds(pages: DataFrame, radius: int) -> DataFrame:
        return pages.select("doc_id", F.col("page_index").cast("long").alias("page_index"), F.lit(radius).alias("_far"))

    parts = [
        seeds(visible_pages(windows, layout, RELEASE_PADDING), NEIGHBOURS),
        seeds(visible_pages(windows, layout), NEIGHBOURS + 1),
        seeds(dominant_page(windows, layout), NEIGHBOURS + 2),
    ]
    farthest = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("doc_id", "page_index").agg(F.max("_far").alias("_far"))
    return expand_neighbours(written(farthest), page_counts(layout), F.col("_far"))
