"""Queries for code and name lookups (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import names
from pagelens.operators import codes as cd
from pagelens.plans.fixtures import with_views
from pagelens.plans.registry import case


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NAMES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(names.glyph_names().items())) + ") v(glyph, known)"
WINANSI_SQL = "SELECT code, chr(code) AS text FROM (SELECT unnest(range(32, 127))::INT AS code UNION ALL SELECT unnest(range(160, 256))::INT) UNION ALL SELECT * FROM (VALUES " + ", ".join(
    f"({c}, {_quoted(t)})" for c, t in names.WINANSI_SPECIALS.items()) + ") v(code, text)"
CODE_MAP_SQL = "SELECT CAST(97 + n_nationkey AS INT) AS code, concat('<', n_name, '>') AS text FROM nation"


def code_map(t):
    return t.table("nation").select(
        (F.col("n_nationkey") + 97).alias("code"), F.concat(F.lit("<"), "n_name", F.lit(">")).alias("text"))


@case("E1_decode_codes", with_views("glyph", """
  SELECT doc_id, length(text) AS chars, md5(text) AS text_hash FROM (
    SELECT doc_id, string_agg(coalesce(m.text, ch), '' ORDER BY pos) AS text
    FROM glyph LEFT JOIN m ON glyph.code = m.code GROUP BY doc_id)""", extra={"m": CODE_MAP_SQL}))
def e1(t):
    out = cd.decode_codes(t.glyph_blocks(), code_map(t), ["doc_id"], "part")
    return out.select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_hash"))


@case("E2_pair_codes", with_views("glyph", """
  SELECT code, count(*) AS n, min(doc_id) AS first_doc, max(pos)::BIGINT AS last_pos FROM (
    SELECT doc_id, pos // 2 AS pos, sum(CASE WHEN pos % 2 = 0 THEN (code % 256) * 256 ELSE code % 256 END)::BIGINT AS code
    FROM glyph GROUP BY doc_id, pos // 2) WHERE code NOT BETWEEN 55296 AND 57343 GROUP BY code"""))
def e2(t):
    pairs = cd.pair_codes(t.glyph_blocks(), ["doc_id"], F.col("code") % 256, "part")
    return pairs.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("pos").alias("last_pos"))


@case("E3_beyond_range_cap", """
  SELECT font, entry, lo + 65536 AS lo, hi FROM (
    SELECT p_brand AS font, p_partkey AS entry, (p_size * 10)::BIGINT AS lo, (p_size * 10 + p_partkey * 1000)::BIGINT AS hi FROM part)
  WHERE hi - lo >= 65536""")
def e3_cut(t):
    ranges = t.table("part").select(
        F.col("p_brand").alias("font"), F.col("p_partkey").alias("entry"), (F.col("p_size") * 10).cast("long").alias("lo"),
        (F.col("p_size") * 10 + F.col("p_partkey") * 1000).cast("long").alias("hi"))
    return cd.beyond_range_cap(ranges)


@case("E3_expand_ranges", """
  SELECT font, code, chr(CAST(arg_max(target, entry) AS INT)) AS text FROM (
    SELECT font, entry, code, dst + code - lo AS target FROM (
      SELECT p_brand AS font, p_partkey AS entry, p_size * 10 AS lo, 55200 + p_partkey AS dst,
        unnest(range(p_size * 10, p_size * 10 + p_partkey % 30 - 3 + 1)) AS code FROM part))
  WHERE target NOT BETWEEN 55296 AND 57343 AND target <= 1114111 GROUP BY font, code""")
def e3(t):
    part = t.table("part").select(
        F.col("p_brand").alias("font"), F.col("p_partkey").alias("entry"), (F.col("p_size") * 10).cast("long").alias("lo"),
        (F.col("p_size") * 10 + F.col("p_partkey") % 30 - 3).alias("hi"), (F.col("p_partkey") + 55200).alias("dst"))
    return cd.expand_ranges(part, ["font"])


@case("E4_assign_running_codes", with_views("token", """
  SELECT doc_id, pos, tok, (num + names - names_at - 1)::BIGINT AS code, coalesce(known, CASE WHEN length(g) = 1 THEN g END) AS text
  FROM (SELECT *, last_value(num0 IGNORE NULLS) OVER w AS num, last_value(CASE WHEN num0 IS NOT NULL THEN names END IGNORE NULLS) OVER w AS names_at
    FROM (SELECT *, sum(CASE WHEN num0 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS names
      FROM (SELECT *, CASE WHEN regexp_full_match(tok, '[+-]?[0-9]{1,9}') THEN CAST(tok AS BIGINT) END AS num0,
        CASE WHEN instr(tok, '.') > 1 THEN split_part(tok, '.', 1) ELSE tok END AS g FROM token))
    WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) LEFT JOIN names ON g = glyph
  WHERE num0 IS NULL AND num IS NOT NULL""", extra={"names": NAMES_SQL}))
def e4(t):
    return cd.assign_running_codes(t.token_blocks(), ["doc_id"], "part")


@case("E5_expand_width_runs", """
  SELECT font, code, arg_max(width, entry) AS width FROM (
    SELECT p_brand AS font, p_partkey AS entry, unnest(range(p_size, p_size + 3)) AS code,
      unnest([p_retailprice, p_retailprice + 1, p_retailprice + 2]) AS width FROM part WHERE p_type LIKE 'E%'
    UNION ALL SELECT p_brand, p_partkey, unnest(range(p_size, p_size + p_partkey % 20 - 5 + 1)), p_retailprice
      FROM part WHERE p_type NOT LIKE 'E%') GROUP BY font, code""")
def e5(t):
    part = t.table("part").select(
        F.col("p_brand").alias("font"), F.col("p_partkey").alias("entry"), F.col("p_size").cast("long").alias("lo"),
        F.col("p_retailprice").alias("width"), "p_type")
    price, listed = F.col("width"), F.col("p_type").startswith("E")
    lists = part.filter(listed).select("font", "entry", "lo", F.array(price, price + 1, price + 2).alias("items"))
    ranges = part.filter(~listed).select(
        "font", "entry", "lo", (F.col("lo") + F.col("entry") % 20 - 5).alias("hi"), "width")
    return cd.expand_width_runs(lists, ranges, ["font"])


@case("E6_normalise_name", """
  WITH names AS (""" + NAMES_SQL + """), raw AS (
    SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN concat('uni', printf('%04X', p_partkey * 31)) WHEN 1 THEN concat('u', printf('%05X', p_partkey * 31))
      WHEN 2 THEN concat('uni0041', printf('%04X', 55000 + p_partkey)) WHEN 3 THEN concat('a#', printf('%02X', 97 + p_partkey % 26), '.alt')
      WHEN 4 THEN concat('afii', 10000 + p_partkey % 110) WHEN 5 THEN split_part(p_name, ' ', 2)
      WHEN 6 THEN concat(chr(CAST(65 + p_partkey % 26 AS INT)), 'acute') WHEN 7 THEN 'parenleftbig.1' ELSE chr(CAST(33 + p_partkey % 90 AS INT)) END AS name FROM part),
  cut AS (SELECT *, CASE WHEN instr(d, '.') > 1 THEN split_part(d, '.', 1) ELSE d END AS g FROM (
    SELECT *, CASE WHEN p_partkey % 9 = 3 THEN concat('a', chr(CAST(97 + p_partkey % 26 AS INT)), '.alt') ELSE name END AS d FROM raw))
  SELECT p_partkey, name, coalesce(known, CASE
      WHEN p_partkey % 9 = 0 AND p_partkey * 31 < 65536 AND p_partkey * 31 NOT BETWEEN 55296 AND 57343 THEN chr(CAST(p_partkey * 31 AS INT))
      WHEN p_partkey % 9 = 1 AND p_partkey * 31 NOT BETWEEN 55296 AND 57343 THEN chr(CAST(p_partkey * 31 AS INT))
      WHEN p_partkey % 9 = 2 AND 55000 + p_partkey NOT BETWEEN 55296 AND 57343 THEN concat('A', chr(CAST(55000 + p_partkey AS INT)))
      WHEN length(g) = 1 THEN g END) AS text
  FROM cut LEFT JOIN names ON g = glyph""")
def e6(t):
    key = F.col("p_partkey")

    def digits(width, value):
        return F.format_string(f"%0{width}X", value)

    def choice(n, value):
        return (key % 9 == n, value)

    forms = [
        choice(0, F.concat(F.lit("uni"), digits(4, key * 31))), choice(1, F.concat(F.lit("u"), digits(5, key * 31))),
        choice(2, F.concat(F.lit("uni0041"), digits(4, key + 55000))),
        choice(3, F.concat(F.lit("a#"), digits(2, key % 26 + 97), F.lit(".alt"))),
        choice(4, F.concat(F.lit("afii"), (key % 110 + 10000).cast("string"))), choice(5, F.split_part("p_name", F.lit(" "), F.lit(2))),
        choice(6, F.concat(F.char(key % 26 + 65), F.lit("acute"))), choice(7, F.lit("parenleftbig.1")),
    ]
    name = F.when(*forms[0])
    for test, value in forms[1:]:
        name = name.when(test, value)
    named = t.table("part").select("p_partkey", name.otherwise(F.char(key % 90 + 33)).alias("name"))
    return names.normalise_name(named, "name", "text")


@case("E6_normalise_token", with_views("token", """
  SELECT tok, n, coalesce(known, CASE
      WHEN regexp_full_match(g, 'u[0-9A-Fa-f]{4,6}') THEN chr(CAST(concat('0x', g[2:]) AS INT)) WHEN length(g) = 1 THEN g END) AS text
  FROM (SELECT tok, n, CASE WHEN instr(d, '.') > 1 THEN split_part(d, '.', 1) ELSE d END AS g FROM (
    SELECT tok, n, array_to_string(list_transform(regexp_extract_all(tok, '#[0-9A-Fa-f]{2}|[^#]+|#'), lambda p:
      CASE WHEN regexp_full_match(p, '#[0-9A-Fa-f]{2}') THEN chr(CAST(concat('0x', p[2:]) AS INT)) ELSE p END), '') AS d
    FROM (SELECT tok, count(*) AS n FROM token GROUP BY tok))) LEFT JOIN names ON g = glyph""", extra={"names": NAMES_SQL}))
def e6_token(t):
    words = t.token().groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    return names.normalise_name(words, "tok", "text")


@case("E7_winansi_table", with_views("glyph", """
  SELECT g.code % 256 AS code, w.text, count(*) AS n FROM glyph g LEFT JOIN w ON g.code % 256 = w.code
  GROUP BY g.code % 256, w.text""", extra={"w": WINANSI_SQL}))
def e7(t):
    seen = t.glyph().groupBy((F.col("code") % 256).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return seen.join(F.broadcast(names.winansi_table(t.spark)), "code", "left").select("code", "text", "n")


WIDTH_SQL = {
    "cid": "SELECT concat('src', n_nationkey % 20) AS font, 97 + n_nationkey AS code, 500.0 + n_nationkey AS width FROM nation",
    "wid": """SELECT concat('src', p_partkey % 20) AS font, 40 + p_size AS code, arg_max(p_retailprice, p_partkey) AS width
              FROM part GROUP BY 1, 2""",
    "uni": "SELECT concat('src', s_suppkey % 20) AS font, s_suppkey AS entry, 40 + s_suppkey % 60 AS code, chr(CAST(97 + s_suppkey % 26 AS INT)) AS text FROM supplier",
    "enc": "SELECT concat('src', s_suppkey % 20) AS font, s_suppkey AS entry, 40 + s_suppkey % 50 AS code, chr(CAST(65 + s_suppkey % 26 AS INT)) AS text FROM supplier",
    "fonts": """SELECT DISTINCT source AS font, CASE WHEN source LIKE '%1' THEN 'Courier' ELSE 'Other' END AS base_font,
              CASE WHEN source LIKE '%2' THEN 250.0 ELSE 0.0 END AS missing FROM documents""",
    "expl": "SELECT coalesce(cid.font, wid.font) AS font, coalesce(cid.code, wid.code) AS code, cid.width AS cw, wid.width AS ww FROM cid FULL JOIN wid ON cid.font = wid.font AND cid.code = wid.code",
    "byuni": "SELECT uni.font, unicode(text) AS code, arg_min(coalesce(cw, ww), entry) AS width FROM uni JOIN expl ON uni.font = expl.font AND uni.code = expl.code GROUP BY 1, 2",
    "byenc": "SELECT enc.font, unicode(text) AS code, arg_min(coalesce(cw, ww), entry) AS width FROM enc JOIN expl ON enc.font = expl.font AND enc.code = expl.code GROUP BY 1, 2",
}


@case("E8_lookup_width", with_views("glyph", """
  SELECT doc_id, source, count(*) AS n, round(sum(width), 3) AS total FROM (
    SELECT g.doc_id, CASE WHEN e.cw IS NOT NULL THEN 'cid' WHEN e.ww IS NOT NULL THEN 'widths' WHEN u.width IS NOT NULL THEN 'unicode'
        WHEN n.width IS NOT NULL THEN 'encoding' WHEN base_font = 'Courier' THEN 'standard' WHEN missing > 0 THEN 'missing' ELSE 'default' END AS source,
      coalesce(e.cw, e.ww, u.width, n.width, CASE WHEN base_font = 'Courier' THEN 600 END, CASE WHEN missing > 0 THEN missing END, 600)::DOUBLE AS width
    FROM (SELECT glyph.*, d.source AS font FROM glyph JOIN documents d USING (doc_id)) g
    LEFT JOIN expl e ON e.font = g.font AND e.code = g.code LEFT JOIN byuni u ON u.font = g.font AND u.code = g.code
    LEFT JOIN byenc n ON n.font = g.font AND n.code = g.code LEFT JOIN fonts f ON f.font = g.font)
  GROUP BY doc_id, source""", extra=WIDTH_SQL))
def e8(t):
    def font(key):
        return F.concat(F.lit("src"), (F.col(key) % 20).cast("string")).alias("font")

    supplier = t.table("supplier")
    key = F.col("s_suppkey")
    cid = t.table("nation").select(
        font("n_nationkey"), (F.col("n_nationkey") + 97).alias("code"), (F.col("n_nationkey") + 500.0).alias("width"))
    wid = t.table("part").groupBy(font("p_partkey"), (F.col("p_size") + 40).alias("code")).agg(
        F.max_by("p_retailprice", "p_partkey").alias("width"))
    uni = supplier.select(font("s_suppkey"), key.alias("entry"), (key % 60 + 40).alias("code"), F.char(key % 26 + 97).alias("text"))
    enc = supplier.select(font("s_suppkey"), key.alias("entry"), (key % 50 + 40).alias("code"), F.char(key % 26 + 65).alias("text"))
    docs = t.table("documents").select("doc_id", F.col("source").alias("font"))
    fonts = docs.select("font").distinct().select(
        "font", F.when(F.col("font").endswith("1"), "Courier").otherwise("Other").alias("base_font"),
        F.when(F.col("font").endswith("2"), 250.0).otherwise(0.0).alias("missing"))
    # glyphs of one code in a document have one width, so they are counted before it is looked up
    counts = t.glyph().groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("times"))
    glyphs = counts.join(docs, "doc_id").select("doc_id", "font", "code", "times")
    return cd.lookup_width(glyphs, cid, wid, uni, enc, fonts).groupBy("doc_id", "source").agg(
        F.sum("times").alias("n"), F.round(F.sum(F.col("width") * F.col("times")), 3).alias("total"))


FONT_SQL = """concat(CASE p_partkey % 3 WHEN 0 THEN 'ABCDEF+' ELSE '' END, CASE p_partkey % 11 WHEN 0 THEN 'CMMI10' WHEN 1 THEN 'TimesNewRomanPS-BoldMT'
  WHEN 2 THEN 'Helvetica-Bold' WHEN 3 THEN 'Courier' WHEN 4 THEN 'CMR12' WHEN 5 THEN 'SwitzerItalic' WHEN 6 THEN 'DejaVuSansMono' WHEN 7 THEN 'Barcode39'
  WHEN 8 THEN 'NotoSerif-Oblique' WHEN 9 THEN 'ClassicPro' ELSE p_brand END)"""


def _fonts(t):
    return t.table("part").select("p_partkey", "p_size", "p_type", F.expr(FONT_SQL).alias("font"))


@case("E9_font_family", f"""
  SELECT p_partkey, CASE WHEN n LIKE 'cmmi%' THEN 'Italic' WHEN n LIKE '%bold%' THEN 'Bold' WHEN n LIKE '%italic%' OR n LIKE '%oblique%' THEN 'Italic' ELSE 'Regular' END AS style,
    CASE WHEN n LIKE 'cmmi%' THEN 'Cambria Math' WHEN n LIKE 'timesnewroman%' THEN 'Times New Roman' WHEN n LIKE 'cmr%' THEN 'Times New Roman'
      WHEN n = 'courier' THEN 'Courier New' WHEN n LIKE '%classic%' THEN 'Palatino Linotype' WHEN n LIKE '%switzer%' THEN 'Arial'
      WHEN n LIKE '%serif%' THEN 'Times New Roman' WHEN n LIKE '%mono%' THEN 'Courier New' ELSE 'Arial' END AS family
  FROM (SELECT p_partkey, lower(CASE WHEN f LIKE '%+%' THEN split_part(f, '+', 2) ELSE f END) AS n FROM (SELECT p_partkey, {FONT_SQL} AS f FROM part))""")
def e9(t):
    return _fonts(t).select("p_partkey", names.font_style(F.col("font")).alias("style"), names.font_family(F.col("font")).alias("family"))


@case("E10_prefers_glyph_codes", f"""
  SELECT p_partkey, (lower(f) LIKE '%barcode%' OR (p_partkey % 2 = 0 AND p_size > 10 AND p_type NOT LIKE 'S%')) AS by_code
  FROM (SELECT p_partkey, p_size, p_type, {FONT_SQL} AS f FROM part)""")
def e10(t):
    body = F.when(F.col("p_partkey") % 2 == 0, "<< /Subtype /CIDFontType2 /CIDToGIDMap /Identity >>").otherwise("<< /Subtype /CIDFontType2 >>")
    size = F.when(F.col("p_size") > 10, F.col("p_size"))
    kind = F.when(F.col("p_type").startswith("S"), "/Type1C")
    return _fonts(t).select("p_partkey", names.prefers_glyph_codes(F.col("font"), body, size, kind).alias("by_code"))


@case("E11_hex_decode", """
  SELECT doc_id, octet_length(unhex(CASE WHEN length(h) % 2 = 1 THEN h || '0' ELSE h END)) AS bytes,
    lower(CASE WHEN length(h) % 2 = 1 THEN h || '0' ELSE h END) AS back, txt AS text
  FROM (SELECT doc_id, md5(text) || CASE WHEN doc_id % 2 = 1 THEN 'a' ELSE '' END AS h, source AS txt FROM documents)""")
def e11(t):
    digest = F.md5("text")
    odd = F.when(F.col("doc_id") % 2 == 1, "a").otherwise("")
    spaced = F.concat(F.substring(digest, 1, 7), F.lit(" \n"), F.substr(digest, F.lit(8)), odd)
    bytes_ = names.hex_to_bytes(spaced)
    wide = names.hex_to_text(F.hex(F.encode("source", "UTF-16BE")))
    return t.table("documents").select(
        "doc_id", F.octet_length(bytes_).cast("long").alias("bytes"), F.lower(F.hex(bytes_)).alias("back"), wide.alias("text"))
