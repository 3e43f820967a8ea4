"""Queries for positions and geometry (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import strokes as st
from pagelens.functions.geom import Rect, rect_path_bounds, rotate_bounds, to_screen
from pagelens.operators import drawing as dr
from pagelens.operators.skew import dense_position, numbered, position_block, time_block
from pagelens.plans.fixtures import with_views
from pagelens.plans.registry import case

ADV = "((500 + (code * 7) % 300) / 1000.0::DOUBLE * 12 + 0.5 + CASE WHEN code = 32 THEN 1.0 ELSE 0.0 END)::DOUBLE"


def _advances():
    width = (500 + (F.col("code") * 7) % 300).cast("double")
    space = (F.col("code") == 32) | (F.col("ch") == " ")
    return st.glyph_advance(width, F.lit(12.0), F.lit(0.5), F.lit(1.0), F.lit(90.0), space)


@case("T1_glyph_advance", with_views("glyph", f"""
  SELECT doc_id, count(*) AS n, round(sum({ADV} * 90 / 100), 3) AS advance, round(sum({ADV}), 3) AS drawn FROM glyph GROUP BY doc_id"""))
def t1(t):
    advance, drawn = _advances()
    return t.glyph().groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(advance), 3).alias("advance"), F.round(F.sum(drawn), 3).alias("drawn"))


# Advances in whole thousandths, so that sums agree whatever their order.
STEP = "500 + (code * 7) % 300"


@case("T2_pen_positions", with_views("glyph", f"""
  SELECT doc_id, ch, count(*) AS n, min(x) AS first_x, max(x) AS last_x, sum(x)::BIGINT AS total FROM (
    SELECT doc_id, ch, coalesce(sum({STEP}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x FROM glyph)
  GROUP BY doc_id, ch"""))
def t2(t):
    placed = dr.pen_positions(t.glyph_blocks(), ["doc_id"], "pos", F.expr(STEP), "part")
    return placed.groupBy("doc_id", "ch").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("first_x"), F.max("x").alias("last_x"), F.sum("x").alias("total"))


@case("T3_apply_kerning", with_views("glyph", f"""
  SELECT doc_id, count(*) AS n, round(min(x), 3) AS low_x, round(max(x), 3) AS high_x FROM (
    SELECT doc_id, coalesce(sum(CASE WHEN ch BETWEEN '0' AND '9' THEN -(code * 10) / 1000::DOUBLE * 12 * 0.9 ELSE {STEP} END)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM glyph) GROUP BY doc_id"""))
def t3(t):
    number = F.when(F.col("ch").between("0", "9"), F.col("code") * 10)
    placed = dr.apply_kerning(t.glyph_blocks(), ["doc_id"], "pos", number, F.expr(STEP).cast("double"), 12.0, 0.9, "part")
    return placed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 3).alias("low_x"), F.round(F.max("x"), 3).alias("high_x"))


OPS_SQL = """SELECT event_id, ts, item, CASE state WHEN 'view' THEN 'Td' WHEN 'click' THEN 'TD' WHEN 'error' THEN 'T*' WHEN 'signup' THEN 'Tm'
  ELSE CASE WHEN generation < 30 THEN 'BT' ELSE 'TL' END END AS op, generation::DOUBLE AS tx, round(value)::DOUBLE AS ty FROM req"""


def _ops(t):
    state = F.col("state")
    op = (
        F.when(state == "view", "Td").when(state == "click", "TD").when(state == "error", "T*").when(state == "signup", "Tm")
        .otherwise(F.when(F.col("generation") < 30, "BT").otherwise("TL"))
    )
    return t.req().select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "item", op.alias("op"),
        F.col("generation").cast("double").alias("tx"), F.round("value").alias("ty"))


ORDER = ["ts", "event_id"]


@case("T4_line_origins", with_views("req", """
  SELECT event_id, item, op, sx - coalesce(last_value(bx IGNORE NULLS) OVER w, 0) AS x, sy - coalesce(last_value(b_y IGNORE NULLS) OVER w, 0) AS y FROM (
    SELECT *, CASE op WHEN 'BT' THEN sx WHEN 'Tm' THEN sx - tx END AS bx, CASE op WHEN 'BT' THEN sy WHEN 'Tm' THEN sy - ty END AS b_y FROM (
      SELECT *, sum(CASE WHEN op IN ('Td', 'TD') THEN tx ELSE 0 END) OVER w AS sx,
        sum(CASE WHEN op IN ('Td', 'TD') THEN ty WHEN op = 'T*' THEN -coalesce(lead_by, 0) ELSE 0 END) OVER w AS sy FROM (
        SELECT *, last_value(CASE op WHEN 'TD' THEN -ty WHEN 'TL' THEN ty END IGNORE NULLS) OVER w AS lead_by FROM ops
          WINDOW w AS (PARTITION BY item ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
      WINDOW w AS (PARTITION BY item ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)))
  WINDOW w AS (PARTITION BY item ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""", extra={"ops": OPS_SQL}))
def t4(t):
    ops = numbered(_ops(t), ["item"], ORDER)
    return dr.line_origins(ops, ["item"], ["_pos"], position_block("_pos")).select("event_id", "item", "op", "x", "y")


TAG_KIND = """SELECT page_id, seq, tag IN ('div', 'ul', 'nav', 'article', 'table') AS opens,
  tag IN ('/div', '/ul', '/nav', '/article', '/table', '/p') AS closes, tag IN ('li', 'h1', 'h2', 'p') AS sets, tag IN ('a', 'span', 'td') AS reads FROM html_tag"""


@case("T5_state_asof", with_views("html_tag", """
  SELECT r.page_id, r.seq, (SELECT max(s.seq) FROM d s WHERE s.page_id = r.page_id AND s.sets AND s.seq <= r.seq
      AND NOT EXISTS (SELECT 1 FROM d m WHERE m.page_id = s.page_id AND m.seq > s.seq AND m.seq <= r.seq AND m.depth < s.depth)) AS value
  FROM d r WHERE r.reads""", extra={"k": TAG_KIND, "d": """
    SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS depth FROM (
      SELECT *, sum(CASE WHEN opens THEN 1 WHEN closes THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM k)"""}))
def t5(t):
    tag = F.col("tag")
    return dr.state_asof(
        t.html_tag(), ["page_id"], "seq", tag.isin("div", "ul", "nav", "article", "table"),
        tag.isin("/div", "/ul", "/nav", "/article", "/table", "/p"), tag.isin("li", "h1", "h2", "p"), tag.isin("a", "span", "td"),
        F.col("seq"))


@case("T6_compose_affine", with_views("req", """
  SELECT item, a, b, c, d, e, f FROM run r WHERE rn = (SELECT count(*) FROM seq s WHERE s.item = r.item)""", recursive=True, extra={
    "seq": """SELECT item, row_number() OVER (PARTITION BY item ORDER BY ts, event_id) AS rn,
      CASE state WHEN 'error' THEN 0 WHEN 'click' THEN -1 ELSE 1 END::DOUBLE AS ma, CASE state WHEN 'error' THEN 1 ELSE 0 END::DOUBLE AS mb,
      CASE state WHEN 'error' THEN -1 ELSE 0 END::DOUBLE AS mc, CASE state WHEN 'error' THEN 0 ELSE 1 END::DOUBLE AS md,
      generation::DOUBLE AS me, round(value)::DOUBLE AS mf FROM req""",
    "run": """SELECT DISTINCT item, 0::BIGINT AS rn, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS d, 0.0::DOUBLE AS e, 0.0::DOUBLE AS f FROM req
      UNION ALL SELECT s.item, s.rn, ma * a + mb * c, ma * b + mb * d, mc * a + md * c, mc * b + md * d, me * a + mf * c + e, me * b + mf * d + f
      FROM run r JOIN seq s ON s.item = r.item AND s.rn = r.rn + 1"""}))
def t6(t):
    state = F.col("state")
    turn = state == "error"
    values = {
        "a": F.when(turn, 0).when(state == "click", -1).otherwise(1), "b": F.when(turn, 1).otherwise(0),
        "c": F.when(turn, -1).otherwise(0), "d": F.when(turn, 0).otherwise(1), "e": F.col("generation"), "f": F.round("value"),
    }
    matrix = F.struct(*[v.cast("double").alias(k) for k, v in values.items()])
    log = t.req().withColumn("ts", F.col("ts").cast("timestamp"))
    placed = dense_position(log, ["item"], ORDER, [time_block("ts")], "pos")
    out = dr.compose_affine(placed, ["item"], "pos", matrix)
    # adding 0 turns a negative zero into zero
    return out.select("item", *[(F.col(c) + F.lit(0.0)).alias(c) for c in "abcdef"])


M = (1.5, 0.25, -0.5, 2.0, 10.0, 20.0)
BOX_PAGE = "SELECT b.*, p.width_pt, p.height_pt FROM box b JOIN page_dim p ON p.page_id = b.page_id"


def _box_page(t):
    return t.box().join(t.page_dim().select("page_id", "width_pt", "height_pt"), "page_id")


def _matrix():
    return [F.lit(v) for v in M]


@case("T7_to_screen", with_views("box page_dim", f"""
  SELECT page_id, idx, (1.5::DOUBLE * x0 - 0.5 * y0 + 10) * 2 AS sx, (height_pt - (0.25::DOUBLE * x0 + 2 * y0 + 20)) * 2 AS sy FROM ({BOX_PAGE})"""))
def t7(t):
    sx, sy = to_screen(F.col("x0"), F.col("y0"), _matrix(), F.col("height_pt"), F.lit(2.0))
    return _box_page(t).select("page_id", "idx", sx.alias("sx"), sy.alias("sy"))


@case("T8_rect_path_bounds", with_views("box page_dim", f"""
  SELECT page_id, idx, least(ax, bx, cx, dx) AS x0, least(ay, b_y, cy, dy) AS y0, greatest(ax, bx, cx, dx) AS x1, greatest(ay, b_y, cy, dy) AS y1 FROM (
    SELECT page_id, idx, {', '.join(f"(1.5::DOUBLE * {x} - 0.5 * {y} + 10) * 2 AS {n}x, (height_pt - (0.25::DOUBLE * {x} + 2 * {y} + 20)) * 2 AS {'b_y' if n == 'b' else n + 'y'}"
      for n, x, y in (('a', 'x0', 'y0'), ('b', 'x1', 'y0'), ('c', 'x0', 'y1'), ('d', 'x1', 'y1')))} FROM ({BOX_PAGE}))"""))
def t8(t):
    r = Rect.of()
    bounds = rect_path_bounds(r.x0, r.y0, r.w, r.h, _matrix(), F.col("height_pt"), F.lit(2.0))
    return _box_page(t).select("page_id", "idx", *bounds.columns())


@case("T8_text_bounds", with_views("box", """
  SELECT page_id, idx, round(x0 + least(0, w * co, -h * si, w * co - h * si), 6) AS x0, round(y0 + least(0, w * si, h * co, w * si + h * co), 6) AS y0,
    round(x0 + greatest(0, w * co, -h * si, w * co - h * si), 6) AS x1, round(y0 + greatest(0, w * si, h * co, w * si + h * co), 6) AS y1
  FROM (SELECT *, (x1 - x0) * 1.25 AS w, y1 - y0 AS h, cos(radians(idx % 360)) AS co, sin(radians(idx % 360)) AS si FROM box)"""))
def t8_text(t):
    r = Rect.of()
    zero = F.lit(0.0)
    bounds = st.text_bounds(r.x0, r.y0, F.col("idx") % 360, F.lit(1.25), zero, zero, r.w, r.h)
    return t.box().select("page_id", "idx", *[F.round(v, 6).alias(n) for v, n in zip((bounds.x0, bounds.y0, bounds.x1, bounds.y1), ("x0", "y0", "x1", "y1"))])


@case("T9_rotate_bounds", with_views("box page_dim", f"""
  SELECT page_id, idx, CASE d WHEN 90 THEN height_pt - y1 WHEN 180 THEN width_pt - x1 WHEN 270 THEN y0 ELSE x0 END AS x0,
    CASE d WHEN 90 THEN x0 WHEN 180 THEN height_pt - y1 WHEN 270 THEN width_pt - x1 ELSE y0 END AS y0,
    CASE d WHEN 90 THEN height_pt - y0 WHEN 180 THEN width_pt - x0 WHEN 270 THEN y1 ELSE x1 END AS x1,
    CASE d WHEN 90 THEN x1 WHEN 180 THEN height_pt - y0 WHEN 270 THEN width_pt - x0 ELSE y1 END AS y1
  FROM (SELECT *, (idx % 4) * 90 AS d FROM ({BOX_PAGE}))"""))
def t9(t):
    bounds = rotate_bounds(Rect.of(), F.col("width_pt"), F.col("height_pt"), F.col("idx") % 4 * 90)
    return _box_page(t).select("page_id", "idx", *bounds.columns())


PAINT = """CASE state WHEN 'purchase' THEN 'fill' WHEN 'signup' THEN CASE WHEN generation < 50 THEN 'both' ELSE 'stroke' END
  WHEN 'error' THEN CASE WHEN generation < 40 THEN 'none' END END"""


@case("T10_path_bounds", with_views("req", f"""
  SELECT item, path, part, x0 - pad AS x0, y0 - pad AS y0, x1 + pad AS x1, y1 + pad AS y1 FROM (
    SELECT item, path, part, x0, y0, x1, y1, CASE part WHEN 'stroke' THEN 1.5 ELSE 0 END::DOUBLE AS pad FROM (
      SELECT item, path, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1, max(paint) AS paint FROM (
        SELECT item, paint, CASE WHEN paint IS NULL THEN generation::DOUBLE END AS px, CASE WHEN paint IS NULL THEN round(value)::DOUBLE END AS py,
          coalesce(sum(CASE WHEN paint IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY item ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS path
        FROM (SELECT *, {PAINT} AS paint FROM req)) GROUP BY item, path) p
    JOIN (VALUES ('fill', 'fill'), ('stroke', 'stroke'), ('both', 'fill'), ('both', 'stroke')) v(paint, part) ON v.paint = p.paint WHERE x0 IS NOT NULL)
  WHERE x1 + pad > x0 - pad OR y1 + pad > y0 - pad"""))
def t10(t):
    paint = F.expr(PAINT)
    ops = t.req().withColumns({
        "ts": F.col("ts").cast("timestamp"), "px": F.when(paint.isNull(), F.col("generation").cast("double")),
        "py": F.when(paint.isNull(), F.round("value")),
    })
    ops = numbered(ops, ["item"], ORDER)
    return dr.path_bounds(ops, ["item"], ["_pos"], position_block("_pos"), paint, pen=3.0)


@case("T11_stroke", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(width, 6) AS width, round_even(least(255, greatest(24, l_quantity * 5 * sqrt(least(1, greatest(0.2, width))))), 0)::INT AS coverage,
    round_even(least(255, greatest(0, l_quantity * 5 * least(1, greatest(0, l_discount * 12)))), 0)::INT AS alpha,
    CASE l_linenumber % 3 WHEN 1 THEN 'Round' WHEN 2 THEN 'Square' ELSE 'Flat' END AS cap, CASE l_linenumber % 3 WHEN 1 THEN 'Round' WHEN 2 THEN 'Bevel' ELSE 'Miter' END AS joined
  FROM (SELECT *, CASE WHEN l_tax <= 0.0001 THEN 1 ELSE greatest(0.2, l_tax * CASE WHEN l_linenumber = 7 THEN 1.5 ELSE 5 * 1.5 * 2 END) END::DOUBLE AS width FROM lineitem)""")
def t11(t):
    flat = F.col("l_linenumber") == 7
    axes = [F.when(flat, 0.0).otherwise(v) for v in (6.0, 8.0, -8.0, 6.0)]
    width = st.stroke_width(F.col("l_tax"), axes, F.lit(1.5))
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(width, 6).alias("width"),
        st.thin_coverage(F.col("l_quantity") * 5, width).alias("coverage"), st.opacity(F.col("l_quantity") * 5, F.col("l_discount") * 12).alias("alpha"),
        st.line_cap(F.col("l_linenumber") % 3).alias("cap"), st.line_join(F.col("l_linenumber") % 3).alias("joined"))


@case("T12_normalise_dash", """
  WITH RECURSIVE given AS (
    SELECT p_partkey, [((p_partkey * m) % 4)::DOUBLE * CASE WHEN p_partkey % 2 = 0 THEN -1.0 ELSE 1.0 END FOR m IN [1, 3, 7, 11, 13]][1:(p_size % 6)::INT] AS dash
    FROM part),
  pairs AS (
    SELECT p_partkey, dash, CASE WHEN len(dash) % 2 = 1 THEN list_concat(size, size) ELSE size END AS d
    FROM (SELECT *, [abs(v) FOR v IN dash] AS size FROM given)),
  fold AS (
    SELECT p_partkey, d, 0 AS i, []::DOUBLE[] AS done, 0.0::DOUBLE AS gap, 0.0::DOUBLE AS held FROM pairs
    UNION ALL SELECT p_partkey, d, i + 1,
      CASE WHEN line <= 0.0001 OR (off <= 0.0001 AND more) THEN done ELSE list_concat(
        CASE WHEN len(done) = 0 THEN done ELSE list_append(done[:-2], done[-1] + gap) END,
        [line, CASE WHEN off <= 0.0001 THEN 0.0001 ELSE off END]) END,
      CASE WHEN line <= 0.0001 THEN gap + off WHEN off <= 0.0001 AND more THEN gap WHEN len(done) >= 2 THEN 0.0 ELSE gap END,
      CASE WHEN line > 0.0001 AND off <= 0.0001 AND more THEN line ELSE 0.0 END
    FROM (SELECT *, d[2 * i + 1] + held AS line, d[2 * i + 2] AS off, 2 * i + 2 < len(d) AS more FROM fold WHERE 2 * i < len(d)))
  SELECT p.p_partkey, p.dash, CASE WHEN len(p.dash) = 0 THEN p.dash WHEN len(done) = 0 THEN done
    ELSE list_append(done[:-2], done[-1] + gap) END AS normal
  FROM pairs p JOIN fold f ON f.p_partkey = p.p_partkey AND 2 * f.i = len(p.d)""")
def t12(t):
    key = F.col("p_partkey")
    raw = F.array(*[((key * m) % 4).cast("double") * F.when(key % 2 == 0, -1.0).otherwise(1.0) for m in (1, 3, 7, 11, 13)])
    dash = F.slice(raw, F.lit(1), (F.col("p_size") % 6).cast("int"))
    return t.table("part").select("p_partkey", dash.alias("dash")).select("p_partkey", "dash", st.normalise_dash("dash").alias("normal"))


VOCAB = ", ".join("'" + o.replace("'", "''") + "'" for o in dr.OPERATORS)


@case("T13_operator_census", with_views("token", f"""
  SELECT doc_id, CASE WHEN tok IN ({VOCAB}) THEN tok END AS op, count(*) AS n FROM token GROUP BY 1, 2"""))
def t13(t):
    return dr.operator_census(t.token(), ["doc_id"], "tok")


@case("T13_tag_census", with_views("html_tag", """
  SELECT page_id, CASE WHEN tag IN ('p', 'li', 'a', 'div', 'td', 'h1', 'h2') THEN tag END AS op, count(*) AS n FROM html_tag GROUP BY 1, 2"""))
def t13_tags(t):
    return dr.operator_census(t.html_tag(), ["page_id"], "tag", ("p", "li", "a", "div", "td", "h1", "h2"))
