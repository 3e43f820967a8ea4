"""Queries for page layout (L) and spatial operators (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.operators import layout as lay
from pagelens.operators import spatial as sp
from pagelens.operators.blocks import by_known_size
from pagelens.operators.skew import first_by
from pagelens.plans.fixtures import with_views
from pagelens.plans.registry import case

LAYOUT = """
  SELECT doc_id, page_index, w, h, y, CAST(floor((wide - w) / 2) AS BIGINT) AS x FROM (
    SELECT doc_id, page_index, w, h,
      24 + coalesce(sum(h + 24) OVER (PARTITION BY doc_id ORDER BY page_index
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS y,
      greatest(max(w) OVER (PARTITION BY doc_id) + 48, 900) AS wide
    FROM (SELECT doc_id, page_index, greatest(1, ceil(width_pt * {z}))::BIGINT AS w,
            greatest(1, ceil(height_pt * {z}))::BIGINT AS h FROM page_dim))"""
LAYOUT_1 = LAYOUT.format(z="1.0")
WIN = {"layout": LAYOUT_1, "win": "SELECT doc_id, top::BIGINT AS top, 900 AS width, 800 AS height FROM viewport"}
SEEN = """SELECT win.doc_id, win.top, page_index, x, y, w, h,
    (least(x + w, width) - greatest(0, x)) * greatest(0, least(y + h, top + height) - greatest(y, top)) AS view_area,
    (least(x + w, width) - greatest(0, x)) * (least(y + h, top + height + {p}) - greatest(y, top - {p})) AS zone_area
  FROM win JOIN layout ON win.doc_id = layout.doc_id
  WHERE y < top + height + {p} AND top - {p} < y + h AND x < width AND x + w > 0"""
NEAREST = """SELECT doc_id, top, page_index, distance FROM (
    SELECT win.doc_id, top, page_index, abs(top + height // 2 - (y + h // 2)) AS distance,
      row_number() OVER (PARTITION BY win.doc_id ORDER BY abs(top + height // 2 - (y + h // 2)), page_index) AS rn
    FROM win JOIN layout ON win.doc_id = layout.doc_id) WHERE rn = 1"""
DOMINANT = f"""SELECT n.doc_id, n.top, coalesce(d.page_index, n.page_index) AS page_index FROM ({NEAREST}) n
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY
        CASE WHEN y <= top + 400 AND y + h >= top + 400 THEN 0 ELSE 1 END, view_area DESC,
        abs(y + h // 2 - (top + 400)), page_index) AS rn FROM ({SEEN.format(p=0)})) WHERE rn = 1) d
  ON n.doc_id = d.doc_id"""
COUNTS = "SELECT doc_id, count(*) AS n FROM layout GROUP BY doc_id"


def _around(seeds: str, radius: int) -> str:
    return f"""SELECT DISTINCT doc_id, unnest(range(greatest(0, page_index - {radius}),
        least(n - 1, page_index + {radius}) + 1)) AS page_index
      FROM ({seeds}) JOIN ({COUNTS}) USING (doc_id) WHERE page_index BETWEEN 0 AND n - 1"""


def windows(t):
    return t.viewport()


def _sides(t):
    return t.page_dim().select("page_id", F.col("width_pt").alias("width"), F.col("height_pt").alias("height"))


@case("L1_page_pixels", with_views("page_dim", """
  SELECT doc_id, page_index, degrees,
    greatest(1, ceil(CASE WHEN degrees IN (90, 270) THEN height_pt ELSE width_pt END * 1.3))::BIGINT AS w,
    greatest(1, ceil(CASE WHEN degrees IN (90, 270) THEN width_pt ELSE height_pt END * 1.3))::BIGINT AS h
  FROM (SELECT *, (page_index % 4) * 90 AS degrees FROM page_dim)"""))
def l1(t):
    d = t.page_dim().withColumn("degrees", (F.col("page_index") % 4) * 90)
    w, h = lay.page_pixels(F.col("width_pt"), F.col("height_pt"), F.lit(1.3), F.col("degrees"))
    return d.select("doc_id", "page_index", "degrees", w.alias("w"), h.alias("h"))


@case("L2_stack_pages", with_views("page_dim", "SELECT * FROM layout", extra={"layout": LAYOUT_1}))
def l2(t):
    return lay.layout_of(t.page_dim())


@case("L3_fit_zoom", with_views("page_dim viewport", """
  SELECT doc_id, page_index, mode, degrees, round(least(8.0, greatest(0.1, CASE
      WHEN mode = 'width' OR (mode = 'auto' AND width_pt > height_pt)
        THEN greatest(100, width - 40) / greatest(1, CASE WHEN degrees IN (90, 270) THEN height_pt ELSE width_pt END)
      ELSE greatest(100, height - 40) / greatest(1, CASE WHEN degrees IN (90, 270) THEN width_pt ELSE height_pt END)
    END)), 6) AS zoom
  FROM (SELECT p.*, v.width, v.height, (page_index % 4) * 90 AS degrees,
          CASE page_index % 3 WHEN 0 THEN 'width' WHEN 1 THEN 'height' ELSE 'auto' END AS mode
        FROM page_dim p JOIN viewport v USING (doc_id))"""))
def l3(t):
    mode = F.when(F.col("page_index") % 3 == 0, "width").when(F.col("page_index") % 3 == 1, "height").otherwise("auto")
    d = t.page_dim().join(t.viewport(), "doc_id").withColumns(
        {"mode": mode, "degrees": (F.col("page_index") % 4) * 90}
    )
    zoom = lay.fit_zoom(
        F.col("width_pt"), F.col("height_pt"), F.col("width"), F.col("height"), F.col("mode"), 40, F.col("degrees")
    )
    return d.select("doc_id", "page_index", "mode", "degrees", F.round(zoom, 6).alias("zoom"))


@case("L4_stack_thumbnails", with_views("page_dim", """
  SELECT doc_id, page_index, w, h, h + 52 AS item_height,
    10 + coalesce(sum(h + 62) OVER (PARTITION BY doc_id ORDER BY page_index
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS y
  FROM (SELECT doc_id, page_index, greatest(1, ceil(width_pt * z))::BIGINT AS w,
          greatest(1, ceil(height_pt * z))::BIGINT AS h
        FROM (SELECT *, least(1.0::DOUBLE, greatest(0.08::DOUBLE, 164.0::DOUBLE / greatest(1, width_pt))) AS z FROM page_dim))"""))
def l4(t):
    return lay.stack_thumbnails(t.page_dim(), item_width=180)


@case("L5_select_pages", with_views("page_dim", """
  SELECT doc_id, page_index, mode FROM (
    SELECT doc_id, page_index, count(*) OVER (PARTITION BY doc_id) AS n,
      CASE doc_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'current' ELSE 'range' END AS mode FROM page_dim)
  WHERE CASE mode WHEN 'current' THEN page_index = least(greatest(doc_id % 17, 0), n - 1)
    WHEN 'range' THEN page_index BETWEEN least(greatest(doc_id % 5, 1), n) - 1
      AND least(greatest(doc_id % 11, least(greatest(doc_id % 5, 1), n)), n) - 1 ELSE true END"""))
def l5(t):
    doc = F.col("doc_id")
    mode = F.when(doc % 3 == 0, "all").when(doc % 3 == 1, "current").otherwise("range")
    pages = t.page_dim().select("doc_id", "page_index", mode.alias("mode"))
    return lay.select_pages(pages, F.col("mode"), doc % 17, doc % 5, doc % 11)


@case("L6_fit_rect", with_views("page_dim", """
  SELECT doc_id, page_index, fw AS w, fh AS h, 50 + trunc((700 - fw) / 2.0)::BIGINT AS x,
    60 + trunc((900 - fh) / 2.0)::BIGINT AS y
  FROM (SELECT doc_id, page_index, greatest(1, round_even(width_pt * s, 0))::BIGINT AS fw,
          greatest(1, round_even(height_pt * s, 0))::BIGINT AS fh
        FROM (SELECT *, least(700 / width_pt, 900 / height_pt) AS s FROM page_dim))"""))
def l6(t):
    return t.page_dim().select("doc_id", "page_index", *lay.fit_rect(
        F.col("width_pt"), F.col("height_pt"), F.lit(50), F.lit(60), F.lit(700), F.lit(900)))


POINTS = """SELECT p.doc_id, p.page_index AS point_id, (page_id * 31) % 900 AS px, (page_id * 97) % 60000 AS py
  FROM page_dim p"""
LOCATED = f"""SELECT * FROM (SELECT p.doc_id, point_id, px, py, l.page_index, px - x AS local_x, py - y AS local_y,
    w, h, row_number() OVER (PARTITION BY p.doc_id, point_id ORDER BY l.page_index) AS rn
  FROM ({POINTS}) p JOIN layout l ON p.doc_id = l.doc_id AND px >= x AND px < x + w AND py >= y AND py < y + h) WHERE rn = 1"""


def points(t):
    """Document points; many fall between pages or outside the document."""
    page = F.col("page_id")
    return t.page_dim().select(
        "doc_id", F.col("page_index").alias("point_id"), ((page * 31) % 900).alias("px"), ((page * 97) % 60000).alias("py")
    )


@case("H4_locate_page", with_views(
    "page_dim", f"SELECT doc_id, point_id, page_index, local_x, local_y FROM ({LOCATED})", extra={"layout": LAYOUT_1}))
def h4(t):
    found = sp.locate_page(points(t), lay.layout_of(t.page_dim()), "point_id")
    return found.select("doc_id", "point_id", "page_index", "local_x", "local_y")


@case("L7_anchor_roundtrip", with_views("page_dim", f"""
  SELECT a.doc_id, point_id, a.page_index, round(local_x / greatest(1, a.w)::DOUBLE, 6) AS rel_x,
    round(local_y / greatest(1, a.h)::DOUBLE, 6) AS rel_y,
    round_even(n.x + n.w * (local_x / greatest(1, a.w)::DOUBLE) - px, 0)::BIGINT AS target_x,
    round_even(n.y + n.h * (local_y / greatest(1, a.h)::DOUBLE) - py, 0)::BIGINT AS target_y
  FROM ({LOCATED}) a JOIN zoomed n ON a.doc_id = n.doc_id AND a.page_index = n.page_index""",
    extra={"layout": LAYOUT_1, "zoomed": LAYOUT.format(z="1.5")}))
def l7(t):
    from pagelens.operators.anchors import anchor_roundtrip

    old, new = lay.layout_of(t.page_dim()), lay.layout_of(t.page_dim(), zoom=1.5)
    out = anchor_roundtrip(old, new, points(t), "point_id")
    return out.withColumns({"rel_x": F.round("rel_x", 6), "rel_y": F.round("rel_y", 6)})


CAND_SQL = """SELECT probe_id, p.page_id, x, y, b.idx, b.kind, b.x0, b.y0, b.x1, b.y1, b.content
  FROM probe p JOIN box b ON p.page_id = b.page_id
  JOIN (SELECT page_id, width_pt, height_pt FROM page_dim) d ON d.page_id = p.page_id
  WHERE x >= x0 - 6 AND x < x1 + 6 AND y >= y0 - 6 AND y < y1 + 6 AND x <= width_pt AND y <= height_pt"""
DOMINATED_SQL = """SELECT DISTINCT f.probe_id, f.idx FROM cand f JOIN cand o ON f.probe_id = o.probe_id AND f.idx <> o.idx
  WHERE o.area > 4 * f.area
    AND f.x0 >= o.x0 - 12 AND f.x0 < o.x1 + 12 AND f.y0 >= o.y0 - 12 AND f.y0 < o.y1 + 12
    AND f.x1 >= o.x0 - 12 AND f.x1 < o.x1 + 12 AND f.y1 >= o.y0 - 12 AND f.y1 < o.y1 + 12
    AND ((f.kind = 'Text' AND f.x1 - f.x0 <= 260 AND f.y1 - f.y0 <= 90 AND length(trim(f.content)) BETWEEN 1 AND 8)
      OR (f.kind = 'VectorPath' AND (f.x1 - f.x0 <= 26 OR f.y1 - f.y0 <= 26 OR f.area <= 1500)) OR f.area <= 900)
    AND ((f.kind = 'Text' AND o.kind = 'Text' AND length(trim(o.content)) > 0)
      OR (f.kind = 'VectorPath' AND o.kind <> 'Image')
      OR (f.kind = 'Text' AND o.kind = 'VectorPath' AND length(trim(f.content)) BETWEEN 1 AND 180
          AND f.y1 - f.y0 <= 96 AND (f.x1 - f.x0 >= 24 OR f.y1 - f.y0 <= 42) AND o.area >= 6 * f.area
          AND (o.x1 - o.x0 >= 1.1 * (f.x1 - f.x0) OR o.y1 - o.y0 >= 1.3 * (f.y1 - f.y0))))"""
KEPT_SQL = """SELECT c.* FROM cand c LEFT JOIN gone g ON c.probe_id = g.probe_id AND c.idx = g.idx
  WHERE g.idx IS NULL OR c.probe_id NOT IN (SELECT c2.probe_id FROM cand c2 WHERE NOT EXISTS
    (SELECT 1 FROM gone g2 WHERE g2.probe_id = c2.probe_id AND g2.idx = c2.idx))"""
CAND = {"cand": f"SELECT *, greatest(1, (x1 - x0) * (y1 - y0)) AS area FROM ({CAND_SQL})", "gone": DOMINATED_SQL}


def _candidates(t):
    probes, sides = t.probe(), _sides(t)
    return by_known_size(
        t.box(), t.large_pages, lambda boxes, large: sp.probe_candidates(probes, boxes, pages=sides, large=large))


@case("H1_probe_candidates", with_views("box probe page_dim", "SELECT probe_id, page_id, idx, kind FROM cand", extra=CAND))
def h1(t):
    return _candidates(t).select("probe_id", "page_id", "idx", "kind")


@case("H2_drop_dominated", with_views("box probe page_dim", f"SELECT probe_id, page_id, idx, kind FROM ({KEPT_SQL})", extra=CAND))
def h2(t):
    kept = sp.drop_dominated(_candidates(t))
    return kept.select("probe_id", "page_id", "idx", "kind")


@case("H3_hit_test", with_views("box probe page_dim", f"""
  SELECT probe_id, page_id, idx, kind, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score, idx) AS rn FROM (
      SELECT *, 0.55 * ln(area + 1) + 0.35 * (pow(abs(x - (x0 + x1) / 2) / greatest(20, (x1 - x0) / 2), 2)
          + pow(abs(y - (y0 + y1) / 2) / greatest(20, (y1 - y0) / 2), 2))
        + 0.10 * CASE WHEN least(x - x0, x1 - x, y - y0, y1 - y) <= 0 THEN 0.75
                      ELSE 1 / (1 + least(x - x0, x1 - x, y - y0, y1 - y)) END
        + CASE WHEN kind = 'Image' THEN -0.35 WHEN kind = 'Text' AND length(trim(content)) > 0 THEN -0.15 ELSE 0 END AS score
      FROM ({KEPT_SQL}))) WHERE rn = 1""", extra=CAND))
def h3(t):
    probes, sides = t.probe(), _sides(t)
    found = by_known_size(t.box(), t.large_pages, lambda boxes, large: sp.hit_test(probes, boxes, sides, large))
    return found.withColumn("score", F.round("score", 6))


@case("H5_visible_pages", with_views(
    "page_dim viewport", f"SELECT v.doc_id, v.top, s.page_index, s.view_area FROM win v LEFT JOIN ({SEEN.format(p=0)}) s ON v.doc_id = s.doc_id",
    extra=WIN))
def h5(t):
    seen = sp.visible_pages(windows(t), lay.layout_of(t.page_dim())).select("doc_id", "page_index", "view_area")
    return windows(t).select("doc_id", F.col("top").cast("long").alias("top")).join(seen, "doc_id", "left")


SEEDS_SQL = "SELECT item AS doc_id, generation AS page_index FROM req"


@case("H6_expand_neighbours", with_views(
    "page_dim req", _around(SEEDS_SQL, 3), extra={"layout": LAYOUT_1}))
def h6(t):
    seeds = t.req().select(F.col("item").alias("doc_id"), F.col("generation").cast("long").alias("page_index"))
    return sp.expand_neighbours(seeds, sp.page_counts(t.page_dim()), 3)


@case("H7_nearest_page", with_views("page_dim viewport", NEAREST, extra=WIN))
def h7(t):
    return sp.nearest_page(windows(t), lay.layout_of(t.page_dim()))


@case("H8_dominant_page", with_views("page_dim viewport", DOMINANT, extra=WIN))
def h8(t):
    return sp.dominant_page(windows(t), lay.layout_of(t.page_dim()))


@case("H9_rank_pages", with_views("page_dim viewport", f"""
  SELECT doc_id, top, page_index, liked, view_area, zone_area, away,
    row_number() OVER (PARTITION BY doc_id ORDER BY liked DESC, view_area DESC, zone_area DESC, away, page_index) - 1 AS rank
  FROM (SELECT w.doc_id, w.top, l.page_index, CASE WHEN pref.page_index IS NULL THEN 0 ELSE 1 END AS liked,
      coalesce(s.view_area, 0) AS view_area, coalesce(s.zone_area, 0) AS zone_area,
      abs(l.x + l.w // 2 - 450) + abs(l.y + l.h // 2 - (w.top + 400)) AS away
    FROM win w JOIN layout l ON w.doc_id = l.doc_id
    LEFT JOIN pref ON pref.doc_id = l.doc_id AND pref.page_index = l.page_index
    LEFT JOIN ({SEEN.format(p=5000)}) s ON s.doc_id = l.doc_id AND s.page_index = l.page_index
    WHERE s.page_index IS NOT NULL OR pref.page_index IS NOT NULL)""",
    extra={**WIN, "pref": _around(DOMINANT, 4)}))
def h9(t):
    layout = lay.layout_of(t.page_dim())
    anchor = sp.dominant_page(windows(t), layout).select("doc_id", "page_index")
    liked = sp.expand_neighbours(anchor, sp.page_counts(layout), 4)
    return sp.rank_pages(windows(t), layout, liked).withColumn("top", F.col("top").cast("long"))


@case("H10_reorder_by_rank", with_views("page_dim viewport req", """
  SELECT q.doc_id, q.page_index, q.generation, q.request_id, r.rank
  FROM (SELECT event_id AS request_id, item AS doc_id, (generation % 24)::BIGINT AS page_index, state AS generation FROM req) q
  JOIN (SELECT item AS doc_id, arg_max(state, event_id) AS generation FROM req GROUP BY item) c
    ON q.doc_id = c.doc_id AND q.generation = c.generation
  JOIN (SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id ORDER BY h DESC, page_index) - 1 AS rank
        FROM layout) r ON r.doc_id = q.doc_id AND r.page_index = q.page_index""", extra={"layout": LAYOUT_1}))
def h10(t):
    from pagelens.operators.skew import dense_position

    req = t.req()
    queue = req.select(
        F.col("event_id").alias("request_id"), F.col("item").alias("doc_id"),
        (F.col("generation") % 24).cast("long").alias("page_index"), F.col("state").alias("generation"),
    )
    current = first_by(
        req.select(F.col("item").alias("doc_id"), F.col("state").alias("generation"), "event_id"),
        ["doc_id"], [-F.col("event_id")],
    ).select("doc_id", "generation")
    tall = lay.layout_of(t.page_dim()).withColumn("low", -F.col("h"))
    rank = dense_position(tall, ["doc_id"], ["low", "page_index"], [F.col("low")], "rank").select(
        "doc_id", "page_index", "rank")
    return sp.reorder_by_rank(queue, rank, current).select("doc_id", "page_index", "generation", "request_id", "rank")


@case("H11_resident_set", with_views("page_dim viewport", " UNION ".join([
    _around(SEEN.format(p=18000), 2), _around(SEEN.format(p=0), 3), _around(DOMINANT, 4)]), extra=WIN))
def h11(t):
    return sp.resident_set(windows(t), lay.layout_of(t.page_dim()))


@case("C11_union_index_sets", with_views("page_dim viewport", f"""
  SELECT doc_id, page_index FROM ({SEEN.format(p=0)}) UNION SELECT doc_id, page_index FROM ({SEEN.format(p=5000)})
  UNION SELECT doc_id, page_index FROM ({DOMINANT})""", extra=WIN))
def c11(t):
    layout = lay.layout_of(t.page_dim())
    sets = [
        sp.visible_pages(windows(t), layout), sp.visible_pages(windows(t), layout, sp.RENDER_PADDING),
        sp.dominant_page(windows(t), layout),
    ]
    return sp.union_index_sets(*[s.select("doc_id", F.col("page_index").cast("long").alias("page_index")) for s in sets])
