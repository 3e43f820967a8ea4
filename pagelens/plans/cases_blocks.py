"""Queries for layout analysis (O) and the object sink (S11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import rules
from pagelens.functions.geom import Rect, gap, overlap
from pagelens.operators import blocks as bl
from pagelens.plans.fixtures import with_views
from pagelens.plans.registry import case


def _measures(left: str, right: str, order: str) -> str:
    """All pairs of a page with the measures of the rules, by their plain definitions."""
    def cover(p: str) -> str:
        return f"greatest(0, least(a.{p}1, b.{p}1) - greatest(a.{p}0, b.{p}0))"

    def dist(p: str) -> str:
        return f"CASE WHEN {cover(p)} > 0 THEN 0 WHEN a.{p}1 < b.{p}0 THEN b.{p}0 - a.{p}1 ELSE a.{p}0 - b.{p}1 END"

    return f"""SELECT a.page_id, a.idx AS ia, b.idx AS ib, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1,
        b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, a.kind AS ak, b.kind AS bk, a.content,
        a.x1 - a.x0 AS aw, a.y1 - a.y0 AS ah, b.x1 - b.x0 AS bw, b.y1 - b.y0 AS bh,
        greatest(1, least(a.x1 - a.x0, b.x1 - b.x0)) AS lw, greatest(1, least(a.y1 - a.y0, b.y1 - b.y0)) AS lh,
        greatest(a.x1 - a.x0, b.x1 - b.x0) AS hw, greatest(a.y1 - a.y0, b.y1 - b.y0) AS hh,
        {cover('x')} AS ox, {cover('y')} AS oy, {dist('x')} AS gx, {dist('y')} AS gy,
        greatest(a.x1, b.x1) - least(a.x0, b.x0) AS uw, greatest(a.y1, b.y1) - least(a.y0, b.y0) AS uh,
        abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) AS dcx, abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) AS dcy,
        (a.x0 + a.x1) / 2 AS acx, (a.y0 + a.y1) / 2 AS acy, (b.x0 + b.x1) / 2 AS bcx, (b.y0 + b.y1) / 2 AS bcy
      FROM box a JOIN box b ON a.page_id = b.page_id AND {order} WHERE {left} AND {right}"""


def _meets(pad: str) -> str:
    return f"(ax0 - {pad} < bx1 AND bx0 < ax1 + {pad} AND ay0 - {pad} < by1 AND by0 < ay1 + {pad})"


def _textlike(w: str, h: str) -> str:
    aspect = f"greatest({w}, {h}) / greatest(1, least({w}, {h}))"
    return (f"CASE WHEN {h} <= 6 THEN {w} <= 260 WHEN {w} <= 26 AND {h} <= 26 THEN false ELSE "
            f"({h} <= 120 AND {aspect} >= 2.2 AND {w} <= 1500) OR ({h} <= 180 AND {w} <= 700 AND {aspect} >= 1.35) END")


TEXT_TEXT = """((oy >= lh * 0.35 AND gx <= greatest(26, lh * 3.1))
  OR (gy <= greatest(18, lh * 1.45) AND uw <= 1450 AND uh <= 980 AND (ox >= lw * 0.18
      OR abs(ax0 - bx0) <= greatest(18, lh * 1.15) OR abs(ax1 - bx1) <= greatest(26, lh * 1.55)
      OR (ax0 - 16 <= bx0 AND ax1 + 16 >= bx1) OR (bx0 - 16 <= ax0 AND bx1 + 16 >= ax1)))
  OR (hw <= 900 AND hh <= 220 AND gy <= greatest(20, lh * 1.35) AND dcx <= greatest(90, lw * 1.4)
      AND uh <= greatest(300, hh * 6) AND uw <= 1100)
  OR (hw <= 900 AND hh <= 220 AND ox >= lw * 0.08 AND gy <= greatest(14, lh * 1.05) AND hw <= hh * 22
      AND uh <= greatest(260, hh * 5)))"""
PRIMITIVE = f"""((gx = 0 AND gy = 0 AND uw <= hw + 24 AND uh <= hh + 24)
  OR (oy >= lh * 0.3 AND gx <= greatest(10, lh * 1.6) AND uw <= 320 AND uh <= greatest(90, hh * 2.2))
  OR (ox >= lw * 0.25 AND gy <= greatest(8, lh * 1.1) AND uw <= 240 AND uh <= 140)
  OR ({_meets('least(8, greatest(2, lh * 0.55))')} AND uw <= hw + 36 AND uh <= hh + 36))"""
TEXTLIKE = """((oy >= lh * 0.32 AND gx <= greatest(12, lh * 1.3) AND uw <= greatest(1400, hw * 1.55)
    AND uh <= greatest(120, hh * 2.4))
  OR (uw <= 1200 AND uh <= greatest(360, hh * 7) AND gy <= greatest(24, lh * 1.55) AND dcx <= greatest(120, lw * 1.9))
  OR (ox >= lw * 0.06 AND gy <= greatest(18, lh * 1.35) AND uw <= 1350 AND uh <= 900))"""
GRAPHIC = f"""((uw <= 980 AND uh <= 980 AND ((ox >= lw * 0.12 AND gy <= greatest(18, lh * 1.6))
    OR (oy >= lh * 0.12 AND gx <= greatest(18, lh * 1.6)) OR (gx <= 10 AND gy <= 10)))
  OR ({_meets('6')} AND uw <= hw + 60 AND uh <= hh + 60))"""
WORDY = "length(trim(content)) BETWEEN 1 AND 96"  # the fixture's texts hold no formula marker
TEXT_VEC = f"""(aw <= 900 AND ah <= 220 AND bw <= 950 AND bh <= 420 AND uw <= 1100 AND uh <= 320 AND (
  ({WORDY} AND greatest(bw, bh) <= 420 AND ((oy >= lh * 0.28 AND gx <= greatest(18, lh * 2))
      OR (ox >= lw * 0.08 AND gy <= greatest(18, lh * 1.35) AND uh <= greatest(280, hh * 6))
      OR (uh <= greatest(280, hh * 6) AND acx >= bx0 - 36 AND acx < bx1 + 36 AND acy >= by0 - 20 AND acy < by1 + 20
          AND ax0 >= bx0 - 40 AND ax1 <= bx1 + 40 AND ay0 >= by0 - 32 AND ay1 <= by1 + 32)))
  OR (least(bw, bh) <= 8 AND greatest(bw, bh) BETWEEN 18 AND 420
      AND ((ox > 0 AND gy <= greatest(12, lh * 1.8)) OR (oy > 0 AND gx <= greatest(12, lh * 1.8))))
  OR ({WORDY} AND greatest(bw, bh) <= 320 AND (({_meets('greatest(4, lh * 0.3)')} AND uh <= greatest(220, hh * 5))
      OR (bcx >= ax0 AND bcx < ax1 AND bcy >= ay0 AND bcy < ay1)
      OR (acx >= bx0 AND acx < bx1 AND acy >= by0 AND acy < by1)))))"""
BOTH_TEXTLIKE = f"({_textlike('aw', 'ah')}) AND ({_textlike('bw', 'bh')})"
NO_TEXTLIKE = f"NOT ({_textlike('aw', 'ah')}) AND NOT ({_textlike('bw', 'bh')})"
VEC_VEC = f"CASE WHEN {BOTH_TEXTLIKE} THEN {TEXTLIKE} ELSE {GRAPHIC} END"
IN_ORDER = "a.idx < b.idx"
ANY = _measures("true", "true", IN_ORDER)
TEXTS = _measures("a.kind = 'Text'", "b.kind = 'Text'", IN_ORDER)
VECTORS = _measures("a.kind = 'VectorPath'", "b.kind = 'VectorPath'", IN_ORDER)
MIXED = _measures("a.kind = 'Text'", "b.kind = 'VectorPath'", "true")
CLOSE = """ax0 - greatest(10, greatest(1, ah) * 1.6) <= bx1 AND bx0 <= ax1 + greatest(10, greatest(1, ah) * 1.6)
  AND ay0 - greatest(8, greatest(1, ah) * 1.1) <= by1 AND by0 <= ay1 + greatest(8, greatest(1, ah) * 1.1)"""


def _edges_sql(pairs: str, rule: str) -> str:
    return f"SELECT page_id, least(ia, ib) AS a, greatest(ia, ib) AS b FROM ({pairs}) WHERE {rule}"


def _labels_sql(nodes: str) -> str:
    """CTE texts for component labels of the ``edge`` CTE over nodes of a kind."""
    return f"""SELECT n.page_id, n.idx, least(n.idx, coalesce(min(r.dst), n.idx)) AS label
      FROM ({nodes}) n LEFT JOIN reach r ON r.page_id = n.page_id AND r.src = n.idx GROUP BY n.page_id, n.idx"""


REACH = """SELECT page_id, a AS src, b AS dst FROM edge UNION SELECT page_id, b, a FROM edge
  UNION SELECT r.page_id, r.src, e.dst FROM reach r JOIN (SELECT page_id, a AS src, b AS dst FROM edge
    UNION ALL SELECT page_id, b, a FROM edge) e ON e.page_id = r.page_id AND e.src = r.dst"""
TEXT_NODES = "SELECT * FROM box WHERE kind = 'Text'"
VECTOR_NODES = "SELECT * FROM box WHERE kind = 'VectorPath'"


def _kind(t, kind):
    return t.box().filter(F.col("kind") == kind)


@case("O1_clean_boxes", with_views("box", """
  SELECT page_id, idx, kind, lx - greatest(0, m - (hx - lx)) / 2 AS x0, hx + greatest(0, m - (hx - lx)) / 2 AS x1,
    ly - greatest(0, m - (hy - ly)) / 2 AS y0, hy + greatest(0, m - (hy - ly)) / 2 AS y1
  FROM (SELECT page_id, idx, kind, CASE WHEN kind = 'VectorPath' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS m,
      least(x1, x0 + idx % 7 * 2) AS lx, greatest(x1, x0 + idx % 7 * 2) AS hx,
      least(y0, y1 - idx % 30 * 2) AS ly, greatest(y0, y1 - idx % 30 * 2) AS hy FROM box)"""))
def o1(t):
    bent = t.box().withColumns({
        "x0": F.col("x1"), "x1": F.col("x0") + F.col("idx") % 7 * 2, "y1": F.col("y1") - F.col("idx") % 30 * 2,
    })
    return bl.clean_boxes(bent).select("page_id", "idx", "kind", "x0", "x1", "y0", "y1")


def _by_size(t, df, step):
    return bl.by_known_size(df, t.large_pages, step)


def _near_pairs(t, *more):
    return _by_size(t, t.box(), lambda rows, large: bl.pair_candidates(rows, rules.VECTOR_PRIMITIVES, *more, large=large))


def _edges(t, df, rule):
    return _by_size(t, df, lambda rows, large: bl.merge_edges(rows, rule, large))


@case("O2_pair_geometry", with_views("box", f"""
  SELECT page_id, ia AS a, ib AS b, ox AS x_overlap, oy AS y_overlap, gx AS x_gap, gy AS y_gap, uw AS union_w, uh AS union_h,
    (ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1) AS meets,
    (bcx >= ax0 AND bcx < ax1 AND bcy >= ay0 AND bcy < ay1) AS holds_centre FROM ({ANY}) WHERE {CLOSE}"""))
def o2(t):
    a, b = Rect.of("a"), Rect.of("b")
    u = a.union(b)
    return _near_pairs(
        t,
        overlap(a.x0, a.x1, b.x0, b.x1).alias("x_overlap"), overlap(a.y0, a.y1, b.y0, b.y1).alias("y_overlap"),
        gap(a.x0, a.x1, b.x0, b.x1).alias("x_gap"), gap(a.y0, a.y1, b.y0, b.y1).alias("y_gap"),
        u.w.alias("union_w"), u.h.alias("union_h"), a.intersects(b).alias("meets"),
        a.contains(b.cx, b.cy).alias("holds_centre"),
    )


@case("O3_pair_candidates", with_views("box", _edges_sql(ANY, CLOSE)))
def o3(t):
    return _near_pairs(t)


@case("O4_same_line", with_views("box", f"""
  SELECT page_id, ia AS a, ib AS b, (oy >= lh * 0.12 OR dcy <= greatest(10, hh * 0.85)) AS same_line
  FROM ({ANY}) WHERE {CLOSE}"""))
def o4(t):
    return _near_pairs(t, rules.same_line(Rect.of("a"), Rect.of("b")).alias("same_line"))


@case("O5_merge_text_blocks", with_views("box", _edges_sql(TEXTS, TEXT_TEXT)))
def o5(t):
    return _edges(t, t.box(), rules.TEXT_BLOCKS)


@case("O6_merge_vector_primitive", with_views("box", _edges_sql(VECTORS, PRIMITIVE)))
def o6(t):
    return _edges(t, _kind(t, "VectorPath"), rules.VECTOR_PRIMITIVES)


@case("O7_merge_textlike_vectors", with_views("box", _edges_sql(VECTORS, f"{BOTH_TEXTLIKE} AND {TEXTLIKE}")))
def o7(t):
    box = _kind(t, "VectorPath")
    return _edges(t, box.filter(rules.looks_textlike(Rect.of())), rules.TEXTLIKE_VECTORS)


@case("O8_merge_graphic_vectors", with_views("box", _edges_sql(VECTORS, f"{NO_TEXTLIKE} AND {GRAPHIC}")))
def o8(t):
    box = _kind(t, "VectorPath")
    return _edges(t, box.filter(~rules.looks_textlike(Rect.of())), rules.GRAPHIC_VECTORS)


@case("O9_merge_text_vector", with_views("box", _edges_sql(MIXED, TEXT_VEC)))
def o9(t):
    return _edges(t, t.box(), rules.TEXT_VECTOR)


@case("O10_merge_hover", with_views("box", " UNION ALL ".join([
    _edges_sql(TEXTS, TEXT_TEXT), _edges_sql(VECTORS, VEC_VEC), _edges_sql(MIXED, TEXT_VEC)])))
def o10(t):
    return _by_size(t, t.box(), bl.hover_edges)


MARKS_SQL = "regexp_replace({c}, '[^-=+/*()\\[\\]{{}}<>^_|]', '', 'g')"
NAME_TEXT = "content || CASE idx % 4 WHEN 0 THEN ' = 2' WHEN 1 THEN ' (x)' WHEN 2 THEN ' 7' ELSE '' END"


@case("O11_box_classes", with_views("box", f"""
  SELECT page_id, idx, ({_textlike('w', 'h')}) AS textlike, (least(w, h) <= 8 AND greatest(w, h) >= 18) AS thin,
    coalesce(length(c) BETWEEN 1 AND 80 AND (m >= 2 OR (m >= 1 AND (d >= 1 OR (l <= 8 AND d <= 8)))), false) AS formula,
    coalesce(regexp_matches(tight, '^[\\p{{P}}+=^]'), false) AS tight
  FROM (SELECT *, length({MARKS_SQL.format(c='c')}) AS m, length(regexp_replace(c, '[^0-9]', '', 'g')) AS d,
      length(regexp_replace(c, '[^\\p{{L}}]', '', 'g')) AS l, CASE WHEN idx % 5 = 0 THEN '-' || c ELSE c END AS tight
    FROM (SELECT *, x1 - x0 AS w, y1 - y0 AS h, {NAME_TEXT} AS c FROM box))"""))
def o11(t):
    tail = F.when(F.col("idx") % 4 == 0, " = 2").when(F.col("idx") % 4 == 1, " (x)").when(F.col("idx") % 4 == 2, " 7").otherwise("")
    text = F.concat(F.col("content"), tail)
    return t.box().select(
        "page_id", "idx", rules.looks_textlike(Rect.of()).alias("textlike"), rules.is_thin(Rect.of()).alias("thin"),
        rules.looks_formula(text).alias("formula"),
        rules.tight_join(F.when(F.col("idx") % 5 == 0, F.concat(F.lit("-"), text)).otherwise(text)).alias("tight"),
    )


@case("O11_pair_classes", with_views("box", f"""
  SELECT page_id, ia AS a, ib AS b,
    ((ax0 - 16 <= bx0 AND ax1 + 16 >= bx1) OR (bx0 - 16 <= ax0 AND bx1 + 16 >= ax1)) AS contained,
    (acx >= bx0 - 36 AND acx < bx1 + 36 AND acy >= by0 - 20 AND acy < by1 + 20
     AND ax0 >= bx0 - 40 AND ax1 <= bx1 + 40 AND ay0 >= by0 - 32 AND ay1 <= by1 + 32) AS inside
  FROM ({ANY}) WHERE {CLOSE}"""))
def o11_pairs(t):
    a, b = Rect.of("a"), Rect.of("b")
    return _near_pairs(
        t, rules.horizontally_contained(a, b).alias("contained"),
        rules.text_inside_vector(a, b).alias("inside"),
    )


def _grouped(t, df, rule):
    return _by_size(t, df.select(*bl.BOX), lambda rows, large: bl.group_labels(rows, [rule], large))


@case("O12_connected_components", with_views("box", "SELECT page_id, idx, label FROM lab", recursive=True, extra={
    "edge": _edges_sql(TEXTS, TEXT_TEXT), "reach": REACH, "lab": _labels_sql(TEXT_NODES)}))
def o12(t):
    return _grouped(t, _kind(t, "Text"), rules.TEXT_BLOCKS).select("page_id", "idx", "label")


@case("O13_merge_group", with_views("box", """
  SELECT page_id, min(idx) AS idx, CASE WHEN bool_or(kind = 'Text') THEN 'Text' ELSE 'VectorPath' END AS kind,
    min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT *, idx % 6 AS label FROM box WHERE kind <> 'Image')
  GROUP BY page_id, label"""))
def o13(t):
    rows = t.box().filter("kind <> 'Image'").withColumn("label", F.col("idx") % 6)
    return bl.merge_group(rows).drop("label")


@case("O14_text_lines")
def o14(t):
    rows = _kind(t, "Text").select(*bl.BOX)
    return _by_size(t, rows, lambda r, large: bl.text_lines(r, ["page_id"], large)).select(
        "page_id", "idx", "line")


ISLANDS = """SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY y0, x0, idx ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM (
  SELECT *, CASE WHEN low IS NULL OR y0 > low THEN 1 ELSE 0 END AS fresh FROM (
    SELECT *, max(y1) OVER (PARTITION BY page_id ORDER BY y0, x0, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
    FROM box WHERE kind = 'Text'))"""


@case("O15_merged_content", with_views("box", f"""
  SELECT page_id, line, string_agg(piece, '' ORDER BY x0, y0, idx) AS text FROM (
    SELECT *, concat(CASE WHEN x0 - px > greatest(2.5, 0.22 * greatest(1, least(ph, y1 - y0))) THEN ' ' ELSE '' END, content) AS piece
    FROM (SELECT *, lag(x1) OVER w AS px, lag(y1 - y0) OVER w AS ph FROM ({ISLANDS})
          WINDOW w AS (PARTITION BY page_id, line ORDER BY x0, y0, idx)))
  GROUP BY page_id, line"""))
def o15(t):
    lines = bl.line_islands(_kind(t, "Text"))
    return bl.line_joined(lines, ["page_id"], large=True).select("page_id", "line", "text")


@case("O16_line_islands", with_views("box", f"SELECT page_id, idx, line FROM ({ISLANDS})"))
def o16(t):
    return bl.line_islands(_kind(t, "Text")).select("page_id", "idx", "line")


@case("O17_merge_pass", with_views("box", f"""
  SELECT l.page_id, l.label AS idx, 'VectorPath' AS kind, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM lab l JOIN box b ON b.page_id = l.page_id AND b.idx = l.idx GROUP BY l.page_id, l.label""",
    recursive=True, extra={
        "edge": _edges_sql(VECTORS, PRIMITIVE), "reach": REACH, "lab": _labels_sql(VECTOR_NODES)}))
def o17(t):
    rows = _kind(t, "VectorPath").select(*bl.BOX)
    return _by_size(t, rows, lambda r, large: bl.merge_pass(r, rules.VECTOR_PRIMITIVES, large)).drop("content")


@case("O18_page_objects")
def o18(t):
    return _by_size(t, bl.page_objects(t.box(), merge=False), bl.merged_objects)


@case("O18_page_objects_raw", with_views("box", "SELECT page_id, idx, kind, x0, y0, x1, y1, content FROM box"))
def o18_raw(t):
    return bl.page_objects(t.box(), merge=False)


@case("C12_split_and_merge", with_views("box", """
  SELECT page_id, idx, kind, CASE kind WHEN 'Text' THEN x0 + 1 WHEN 'VectorPath' THEN x0 + 2 ELSE x0 END AS x0 FROM box"""))
def c12(t):
    text, vector, image = bl.split_by_kind(t.box().select("page_id", "idx", "kind", "x0"))
    return bl.merge_in_order([
        text.withColumn("x0", F.col("x0") + 1), vector.withColumn("x0", F.col("x0") + 2), image])
