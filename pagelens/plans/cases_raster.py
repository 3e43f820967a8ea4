"""Queries for samples and color (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import strokes as st
from pagelens.operators import raster as rs
from pagelens.plans.fixtures import with_views
from pagelens.plans.registry import case

INKS = "[l_discount * 10, l_tax * 10, l_quantity / 50, l_discount]"
LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _byte(v: str) -> str:
    return f"round_even(least(255, greatest(0, {v})), 0)::INT"


@case("P1_to_rgb", f"""
  SELECT {LINE}, CASE s WHEN 0 THEN {_byte('255 * a')} WHEN 1 THEN {_byte('255 * a')} WHEN 2 THEN {_byte('255 * (1 - least(1, a + d))')} ELSE {_byte('255 * a')} END AS r,
    CASE s WHEN 0 THEN {_byte('255 * a')} WHEN 1 THEN {_byte('255 * b')} WHEN 2 THEN {_byte('255 * (1 - least(1, b + d))')} ELSE {_byte('255 * a')} END AS g,
    CASE s WHEN 0 THEN {_byte('255 * a')} WHEN 1 THEN {_byte('255 * c')} WHEN 2 THEN {_byte('255 * (1 - least(1, c + d))')} ELSE {_byte('255 * a')} END AS b
  FROM (SELECT {LINE}, l_linenumber % 4 AS s, l_discount * 10 AS a, l_tax * 10 AS b, l_quantity / 50 AS c, l_discount AS d FROM lineitem)""")
def p1(t):
    kind = F.col("l_linenumber") % 4
    space = F.when(kind == 0, "DeviceGray").when(kind == 2, "DeviceCMYK").otherwise("DeviceRGB")
    comps = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.col("l_discount"))
    comps = F.when(kind == 3, F.slice(comps, 1, 1)).otherwise(comps)
    keys = LINE.split(", ")
    return t.table("lineitem").select(*keys, st.to_rgb(space, comps).alias("c")).select(*keys, "c.*")


PALETTE = "SELECT vec_id AS image_id, 60 + vec_id % 150 AS high, list_transform(embedding, lambda v: CAST(floor(abs(CAST(v AS DOUBLE)) * 997) AS INT) % 256) AS lookup FROM embeddings"


def _palettes(t):
    level = lambda v: F.floor(F.abs(v.cast("double")) * 997).cast("int") % 256
    return t.table("embeddings").select(
        F.col("vec_id").alias("image_id"), (F.col("vec_id") % 150 + 60).alias("high"), F.transform("embedding", level).alias("lookup"))


@case("P2_palette_lookup", with_views("sample", """
  SELECT image_id, y, x, raw, coalesce(lookup[i + 1], 0) AS r, coalesce(lookup[i + 2], lookup[i + 1], 0) AS g, coalesce(lookup[i + 3], lookup[i + 1], 0) AS b
  FROM (SELECT s.*, lookup, CAST(least(raw, high) * 3 AS INT) AS i FROM sample s JOIN pal USING (image_id))""", extra={"pal": PALETTE}))
def p2(t):
    return rs.palette_lookup(t.sample(), _palettes(t), 3)


@case("P3_unpack_bits", with_views("sample", """
  SELECT image_id, y, x * 4 + k AS x, ((raw >> ((3 - k) * 2)::INT) & 3)::INT AS value FROM sample, (SELECT unnest(range(4))::INT AS k)"""))
def p3(t):
    rows = t.table("embeddings").select(
        F.col("vec_id").alias("image_id"), F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 255).cast("int") % 256).alias("bytes"))
    lines = rows.select("image_id", "bytes", F.explode(F.sequence(F.lit(0), F.ceil(F.size("bytes") / 8).cast("int") - 1)).alias("y")).select(
        "image_id", "y", F.slice("bytes", F.col("y") * 8 + 1, F.lit(8)).alias("packed"))
    return rs.unpack_bits(lines, "packed", F.size("packed") * 4, 2)


@case("P4_paint_mask", with_views("sample", """
  SELECT image_id, y, x, ((raw & 1) = 1) <> (image_id % 2 = 1) AS paint, (raw / 255.0 < 0.5) <> (image_id % 2 = 1) AS dark FROM sample"""))
def p4(t):
    inverted = F.col("image_id") % 2 == 1
    return t.sample().select(
        "image_id", "y", "x", rs.paint_mask(F.col("raw").bitwiseAND(1), inverted).alias("paint"),
        rs.paint_brightness(F.col("raw"), inverted).alias("dark"))


@case("P5_apply_soft_mask", with_views("sample", """
  SELECT image_id, y, x, CASE WHEN sized AND mx > 0 AND mean >= 2 AND seen >= greatest(1, n // 200) THEN fresh ELSE alpha END AS alpha FROM (
    SELECT *, max(fresh) OVER w AS mx, avg(fresh) OVER w AS mean, count(CASE WHEN fresh > 0 THEN 1 END) OVER w AS seen, count(*) OVER w AS n FROM (
      SELECT image_id, y, x, 255 - raw % 40 AS alpha, ((255 - raw % 40) * (CASE WHEN image_id % 7 = 3 THEN raw % 2 ELSE raw END) + 127) // 255 AS fresh, image_id % 5 <> 4 AS sized FROM sample)
    WINDOW w AS (PARTITION BY image_id))"""))
def p5(t):
    s = t.sample()
    alpha = s.select("image_id", "y", "x", (255 - F.col("raw") % 40).alias("alpha"))
    level = F.when(F.col("image_id") % 7 == 3, F.col("raw") % 2).otherwise(F.col("raw"))
    # every fifth mask is one row taller than its image
    mask = s.select("image_id", F.when(F.col("image_id") % 5 == 4, F.col("y") + 1).otherwise(F.col("y")).alias("y"), "x", level.alias("mask"))
    return rs.apply_soft_mask(alpha, mask)


@case("P6_undelta", with_views("sample", """
  SELECT image_id, y, x, (sum(raw) OVER (PARTITION BY image_id, y ORDER BY x ROWS UNBOUNDED PRECEDING) % 256)::INT AS raw FROM sample"""))
def p6(t):
    return rs.undelta(t.sample(), "x", 8, 8)


@case("P6_undelta_columns", with_views("sample", """
  SELECT image_id, y, x, (sum(raw) OVER (PARTITION BY image_id, x ORDER BY y ROWS UNBOUNDED PRECEDING) % 256)::INT AS raw FROM sample"""))
def p6_columns(t):
    return rs.undelta(t.sample(), "y", 8, 8)


@case("P7_check_payload", with_views("sample", """
  SELECT image_id, bytes, expected, CASE WHEN bits NOT IN (1, 2, 4, 8) THEN 'bits' WHEN bytes < expected THEN 'short' END AS reason FROM (
    SELECT image_id, bits, bytes, (ceil(width * bits / 8.0) * 8)::BIGINT AS expected FROM (
      SELECT image_id, [1, 2, 4, 8, 16][image_id % 5 + 1] AS bits, count(*) AS bytes, 8 + image_id % 3 AS width FROM sample GROUP BY image_id))"""))
def p7(t):
    bits = F.get(F.array(*[F.lit(b) for b in (1, 2, 4, 8, 16)]), (F.col("image_id") % 5).cast("int"))
    images = t.sample().groupBy("image_id").agg(F.count(F.lit(1)).alias("bytes")).select(
        "image_id", "bytes", bits.alias("bits"), (F.col("image_id") % 3 + 8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("components"))
    return rs.check_payload(images).select("image_id", "bytes", "expected", "reason")


TRIPLE = """SELECT image_id, y, max(CASE WHEN x = 0 THEN raw END) - 128 AS c0, max(CASE WHEN x = 1 THEN raw END) - 100 AS c1,
  max(CASE WHEN x = 2 THEN raw END) - 90 AS c2 FROM sample GROUP BY image_id, y"""


def _level(v: str) -> str:
    return f"round_even(least(1023, greatest(0, {v} + 512)), 0)::INT"


@case("P8_luma_chroma_to_rgb", with_views("sample", f"""
  SELECT image_id, y, rev, (({_level('r')}) * 255 + 511) // 1023 AS r, (({_level('g')}) * 255 + 511) // 1023 AS g, (({_level('b')}) * 255 + 511) // 1023 AS b FROM (
    SELECT image_id, y, rev, CASE WHEN rev THEN c2 + gg ELSE c0 + 1.402::DOUBLE * c2 END AS r, CASE WHEN rev THEN gg ELSE c0 - 0.34413::DOUBLE * c1 - 0.71414::DOUBLE * c2 END AS g,
      CASE WHEN rev THEN c1 + gg ELSE c0 + 1.772::DOUBLE * c1 END AS b
    FROM (SELECT *, image_id % 2 = 0 AS rev, c0 - floor((c1 + c2) / 4.0) AS gg FROM ({TRIPLE})))"""))
def p8(t):
    def at(x, shift):
        return (F.max(F.when(F.col("x") == x, F.col("raw"))) - shift).cast("double")

    triple = t.sample().groupBy("image_id", "y").agg(at(0, 128).alias("c0"), at(1, 100).alias("c1"), at(2, 90).alias("c2"))
    rev = F.col("image_id") % 2 == 0
    rgb = st.luma_chroma_to_rgb(F.col("c0"), F.col("c1"), F.col("c2"), rev)
    return triple.select("image_id", "y", rev.alias("rev"), *[st.sample_to_byte(c, 10, False).alias(n) for c, n in zip(rgb, "rgb")])


def _images(t):
    return t.page_dim().select(F.col("page_id").alias("image_id"), F.col("width_pt").cast("int").alias("width"), F.col("height_pt").cast("int").alias("height"))


@case("P9_tile_grid", with_views("page_dim", """
  SELECT image_id, (ty * nx + tx)::INT AS tile, greatest(0, tx * 256 - 16)::INT AS x0, greatest(0, ty * 200 - 8)::INT AS y0, least(width, (tx + 1) * 256 - 16)::INT AS x1, least(height, (ty + 1) * 200 - 8)::INT AS y1 FROM (
    SELECT *, unnest(range(ny)) AS ty FROM (SELECT *, unnest(range(nx)) AS tx FROM (
      SELECT page_id AS image_id, width_pt::BIGINT AS width, height_pt::BIGINT AS height, ceil((width_pt + 16) / 256)::BIGINT AS nx, ceil((height_pt + 8) / 200)::BIGINT AS ny FROM page_dim)))
  WHERE least(width, (tx + 1) * 256 - 16) > greatest(0, tx * 256 - 16) AND least(height, (ty + 1) * 200 - 8) > greatest(0, ty * 200 - 8)"""))
def p9(t):
    return rs.tile_grid(_images(t), 256, 200, origin_x=-16, origin_y=-8)


@case("P10_tile_stats", with_views("sample", """
  SELECT v.image_id, v.tile, min(raw) AS low, max(raw) AS high, round(avg(raw), 6) AS mean, count(raw) AS n FROM (
    SELECT image_id, unnest(range(12))::INT AS tile FROM (SELECT DISTINCT image_id FROM sample)) v
  LEFT JOIN sample s ON s.image_id = v.image_id AND s.y // 3 * 4 + s.x // 3 = v.tile GROUP BY v.image_id, v.tile"""))
def p10(t):
    images = t.sample().select("image_id").distinct().select("image_id", F.lit(12).alias("width"), F.lit(8).alias("height"))
    return rs.tile_stats(t.sample(), images, 3, 3).withColumn("mean", F.round("mean", 6))


@case("P11_image_inventory", """
  SELECT source, lang, count(*) AS images, count(CASE WHEN n_chars > 500 THEN 1 END) AS included, sum(n_chars // 100)::BIGINT AS passes, sum(n_chars)::BIGINT AS bytes,
    GROUPING(source, lang)::BIGINT AS level FROM documents GROUP BY ROLLUP (source, lang)""")
def p11(t):
    docs = t.table("documents").withColumn("passes_in", F.floor(F.col("n_chars") / 100))
    return rs.image_inventory(docs, ["source", "lang"], F.col("n_chars") > 500, "passes_in", "n_chars")


@case("P12_is_supported", """
  SELECT p_partkey, p_partkey % 4 IN (1, 3) AND p_size % 3 IN (0, 1) AND p_size % 5 = 0 AND p_partkey % 3 IN (0, 2) AND p_partkey % 7 <> 0 AS supported FROM part""")
def p12(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    one = F.struct(F.lit(1).alias("x"), F.lit(1).alias("y"))
    steps = F.array(one, F.struct(F.when(key % 7 == 0, 2).otherwise(1).alias("x"), F.lit(1).alias("y")))
    return t.table("part").select("p_partkey", st.is_supported(key % 4, size % 3, size % 5, key % 3, steps).alias("supported"))
