"""Ordered state against plain folds, and its size of blocks."""

import random

from pyspark.sql import functions as F

from pagelens.operators import drawing, spatial
from pagelens.operators.skew import POSITION_BLOCK, numbered, position_block, running


def small_block(pos, size=3):
    return position_block(pos, size)


def test_a_million_rows_at_one_time(spark):
    rows = spark.range(1_000_000).select(F.lit("k").alias("key"), F.lit(7).alias("ts"), "id", (F.col("id") % 3).alias("v"))
    placed = numbered(rows, ["key"], ["ts", "id"])
    sizes = placed.groupBy(position_block("_pos").alias("b")).count().agg(F.max("count").alias("n"), F.sum("count").alias("all")).first()
    assert sizes["n"] <= POSITION_BLOCK and sizes["all"] == 1_000_000
    got = running(placed, ["key"], ["_pos"], position_block("_pos"), {"total": ("sum", F.col("v"))})
    wrong = got.filter(F.col("total") != F.floor((F.col("id") + 1) / 3) * 3 + F.when(F.col("id") % 3 == 1, 1).otherwise(0))
    assert wrong.count() == 0 and got.count() == 1_000_000


def test_numbers_follow_the_order(spark):
    rows = [(random.Random(k).choice(["a", "b", None]), k * 37 % 11, k) for k in range(200)]
    got = numbered(spark.createDataFrame(rows, "key string, ts int, id int").repartition(5), ["key"], ["ts", "id"]).collect()
    turn = sorted(got, key=lambda r: r["_pos"])
    assert [(r["key"], r["ts"], r["id"]) for r in turn] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))


def test_running_in_both_directions(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), k, rng.choice([None, *range(9)])) for k in range(120)]
    df = spark.createDataFrame(rows, "key int, pos int, v int")
    outs = {"before": ("last", F.col("v")), "after": ("last", F.col("v")), "low": ("min", F.col("v"))}
    got = {r["pos"]: r for r in running(df, ["key"], ["pos"], small_block("pos"), outs, inclusive=False, reverse=["after"]).collect()}
    for key, pos, _ in rows:
        mine = [(p, v) for k, p, v in rows if k == key and v is not None]
        earlier, later = [v for p, v in mine if p < pos], [v for p, v in mine if p > pos]
        assert got[pos]["before"] == (earlier[-1] if earlier else None)
        assert got[pos]["after"] == (later[0] if later else None)
        assert got[pos]["low"] == (min(earlier) if earlier else None)


def test_nesting_equals_a_stack(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x", None]), k, rng.choice("()().")) for k in range(150)]
    df = spark.createDataFrame(rows, "key string, pos int, c string")
    got = {r["pos"]: r for r in drawing.nesting_depth(
        df, ["key"], ["pos"], small_block("pos"), F.col("c") == "(", F.col("c") == ")").collect()}
    depth = {"x": 0, None: 0}
    for key, pos, c in rows:
        real = c != ")" or depth[key] > 0
        depth[key] += (c == "(") - (c == ")" and real)
        assert (got[pos]["depth"], got[pos]["real"]) == (depth[key], real), pos


def test_line_origins_equal_a_walk(spark):
    rng = random.Random(5)
    names = ["BT", "Tm", "Td", "TD", "T*", "TL", "'", "Tj"]
    rows = [(rng.choice([1, None]), k, rng.choice(names), float(rng.randrange(9)), float(rng.randrange(9))) for k in range(300)]
    df = spark.createDataFrame(rows, "key int, pos int, op string, tx double, ty double")
    got = {r["pos"]: (r["x"], r["y"]) for r in drawing.line_origins(df, ["key"], ["pos"], small_block("pos")).collect()}
    state = {1: [0.0, 0.0, 0.0], None: [0.0, 0.0, 0.0]}
    for key, pos, op, tx, ty in rows:
        s = state[key]
        if op in ("TD", "TL"):
            s[2] = -ty if op == "TD" else ty
        if op == "BT":
            s[:2] = 0.0, 0.0
        elif op == "Tm":
            s[:2] = tx, ty
        elif op in ("Td", "TD"):
            s[:2] = s[0] + tx, s[1] + ty
        elif op in ("T*", "'"):
            s[1] -= s[2]
        assert got[pos] == (s[0], s[1]), pos


def test_state_of_scopes(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice(["open", "close", "set", "read", "both"])) for k in range(200)]
    df = spark.createDataFrame([(1, k, e) for k, e in rows], "key int, pos int, e string")
    event = F.col("e")
    got = {r["pos"]: r["value"] for r in drawing.state_asof(
        df, ["key"], "pos", event == "open", event == "close", event.isin("set", "both"), event.isin("read", "both"), F.col("pos")).collect()}
    stack, want = [None], {}
    for k, e in rows:
        if e == "open":
            stack.append(stack[-1])
        elif e == "close" and len(stack) > 1:
            stack.pop()
        elif e == "close":
            pass
        if e in ("set", "both"):
            stack[-1] = k
        if e in ("read", "both"):
            want[k] = stack[-1]
    assert got == want


def test_windows_without_a_visible_page(spark):
    layout = spark.createDataFrame([(1, k, 0, k * 100, 50, 90) for k in range(5)], "doc_id int, page_index long, x long, y long, w long, h long")
    windows = spark.createDataFrame([(1, 0, 60, 50), (1, 5000, 60, 50), (1, 150, 60, 120)], "doc_id int, top long, width long, height long")
    got = {r["top"]: r["page_index"] for r in spatial.dominant_page(windows, layout).collect()}
    assert got == {0: 0, 5000: 4, 150: 2}


def test_windows_of_documents_without_pages_find_none(spark):
    layout = spark.createDataFrame([(1, 0, 0, 24, 900, 500)], "doc_id long, page_index int, x long, y long, w long, h long")
    windows = spark.createDataFrame([(1, 5.0, 900.0, 800.0), (2, 5.0, 900.0, 800.0)], "doc_id long, top double, width double, height double")
    assert [(r["doc_id"], r["page_index"]) for r in spatial.nearest_page(windows, layout).collect()] == [(1, 0)]
    lost = windows.withColumn("top", F.lit(9000.0))
    assert [(r["doc_id"], r["page_index"]) for r in spatial.dominant_page(lost, layout).collect()] == [(1, 0)]


def test_glyphs_spread_by_block_are_not_shuffled_again(spark, tables):
    glyphs = tables.glyph_blocks()
    assert glyphs.drop("part").exceptAll(tables.glyph()).isEmpty() and tables.glyph().exceptAll(glyphs.drop("part")).isEmpty()
    assert tables.token_blocks().drop("part").exceptAll(tables.token()).isEmpty()
    placed = drawing.pen_positions(glyphs, ["doc_id"], "pos", F.col("code"), "part")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan
    want = drawing.pen_positions(tables.glyph(), ["doc_id"], "pos", F.col("code"))
    assert placed.drop("part").exceptAll(want).isEmpty()


def test_windows_spread_over_bands_are_not_broadcast(spark):
    layout = spark.createDataFrame([(1, 0, 0, 24, 900, 500)], "doc_id long, page_index int, x long, y long, w long, h long")
    windows = spark.range(1, 3).select(F.col("id").alias("doc_id"), F.lit(5.0).alias("top"), F.lit(900.0).alias("width"), F.lit(800.0).alias("height"))
    seen = spatial.visible_pages(windows, layout, spatial.RELEASE_PADDING)
    assert seen.count() == 1 and "Broadcast" not in seen._jdf.queryExecution().executedPlan().toString()
