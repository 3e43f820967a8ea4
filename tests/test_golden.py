"""Hand-computed cases, plain-Python readings, and properties."""

import random

import plain_reading as plain
import pytest
from pyspark.sql import functions as F

from pagelens.functions import attrs, names, rules, strokes
from pagelens.functions.attrs import attr_int
from pagelens.functions.geom import Rect, gap, gap_is_zero, gap_within, rotate_bounds
from pagelens.operators import blocks, catalog, codes, drawing, graph, raster, skew, spatial
from pagelens.quality import quarantine
from pagelens.sources import corpus, sinks

BOX_SCHEMA = "page_id long, idx long, kind string, x0 double, y0 double, x1 double, y1 double, content string"


def boxes_of(tables):
    return [tuple(r) for r in tables.box().select(*blocks.BOX).collect()]


def read_plainly(rows):
    pages = {}
    for page, idx, kind, x0, y0, x1, y1, content in rows:
        pages.setdefault(page, []).append(plain.Box(idx, kind, x0, y0, x1, y1, content))
    return pages


STEPS = {"primitives": [rules.VECTOR_PRIMITIVES], "blocks": [rules.VECTOR_BLOCKS], "hover": rules.HOVER}


def plain_objects(spark, rows):
    def joined(pages, step):
        boxes = [(page, b.idx, b.kind, b.x0, b.y0, b.x1, b.y1, b.content) for page, held in pages.items() for b in held]
        df = spark.createDataFrame(boxes, BOX_SCHEMA)
        return [tuple(r) for rule in STEPS[step] for r in blocks.small_page_edges(df, rule).collect()]

    return sorted(
        (page, b.idx, b.kind, b.x0, b.y0, b.x1, b.y1, b.content or "")
        for page, boxes in plain.page_objects(read_plainly(rows), joined).items() for b in boxes
    )


def collected(df):
    return sorted(tuple("" if v is None else v for v in r) for r in df.select(*blocks.BOX).collect())


def dense_page(count, seed=7):
    """One crowded page: a third of the boxes in one spot, texts of all kinds."""
    rng = random.Random(seed)
    rows = []
    for idx in range(count):
        near = idx % 3 == 0
        x0, y0 = (rng.randint(0, 40), rng.randint(0, 40)) if near else (rng.randint(0, 4000), rng.randint(0, 3000))
        kind = rng.choice(["Text", "VectorPath", "VectorPath", "Image"])
        w, h = rng.choice([(3, 3), (30, 4), (12, 60), (150, 20), (1500, 8), (60, 60)])
        text = rng.choice([None, " ", "x = 2", "word", "(a+b)", "long text " * 12]) if kind == "Text" else None
        rows.append((1, idx, kind, float(x0), float(y0), float(x0 + w), float(y0 + h), text))
    return rows


def test_page_objects_match_plain_reading(spark, tables):
    rows = [r for r in boxes_of(tables) if r[0] < 60]
    got = blocks.page_objects(spark.createDataFrame(rows, BOX_SCHEMA))
    assert collected(got) == plain_objects(spark, rows)


def test_odd_pages(spark):
    rows = [
        (1, 0, "Text", 0.0, 0.0, 10.0, 10.0, "  kept as is "),  # alone on its page
        (2, 0, "VectorPath", 5.0, 5.0, 5.0, 5.0, None),
        (3, 0, "Image", 0.0, 0.0, 5.0, 5.0, None),
        (4, 0, "Text", 0.0, 0.0, 10.0, 10.0, " a "), (4, 1, "Text", 500.0, 900.0, 510.0, 910.0, " "),
    ]
    got = collected(blocks.page_objects(spark.createDataFrame(rows, BOX_SCHEMA)))
    assert got == sorted([
        (1, 0, "Text", 0.0, 0.0, 10.0, 10.0, "  kept as is "), (2, 0, "VectorPath", 3.5, 3.5, 6.5, 6.5, ""),
        (3, 0, "Image", 0.0, 0.0, 5.0, 5.0, ""), (4, 0, "Text", 0.0, 0.0, 10.0, 10.0, "a"),
        (4, 1, "Text", 500.0, 900.0, 510.0, 910.0, ""),
    ])


@pytest.mark.parametrize("rule", [rules.VECTOR_PRIMITIVES, rules.TEXT_BLOCKS, rules.TEXT_VECTOR, rules.HOVER_VECTORS])
def test_grid_finds_the_same_pairs(spark, rule):
    box = spark.createDataFrame(dense_page(220), BOX_SCHEMA)
    near = sorted(map(tuple, blocks.merge_edges(box, rule).collect()))
    assert near == sorted(map(tuple, blocks.small_page_edges(box, rule).collect()))
    assert len(near) == len(set(near)) > 0


def test_crowded_cells_give_the_same_components(spark):
    box = spark.createDataFrame([r for r in dense_page(240) if r[2] != "Image"], BOX_SCHEMA)
    want = blocks.group_labels(box, rules.HOVER, large=False).select("idx", "label")
    labels = blocks._large_page_labels(box, rules.HOVER, chunk=8)
    got = graph.with_labels(box, labels).select("idx", "label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_text_lines_of_large_pages(spark):
    box = spark.createDataFrame([r for r in dense_page(300) if r[2] == "Text"], BOX_SCHEMA)
    folded = blocks.text_lines(box).select("idx", "line")
    streamed = blocks.text_lines(box, large=True).select("idx", "line")
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, streamed.collect()))


def test_merged_content_of_large_pages(spark):
    box = spark.createDataFrame([r for r in dense_page(300) if r[2] == "Text"], BOX_SCHEMA)
    forms = [blocks.merged_content(box, ["page_id"], "\n", large).collect() for large in (False, True)]
    want = plain.content_of(read_plainly([tuple(r) for r in box.collect()])[1], "\n")
    assert [f[0]["content"] for f in forms] == [want, want]


def test_components_are_order_free(spark):
    chain = [(1, n, n + 1) for n in range(60)] + [(2, 5, 9), (2, 9, 7)]
    random.Random(1).shuffle(chain)
    edges = spark.createDataFrame(chain, "page_id long, a long, b long")
    want = [(1, n, 0) for n in range(61)] + [(2, 5, 5), (2, 7, 5), (2, 9, 5)]
    for form in (graph.components_of_small_pages, graph.components_of_any_page):
        assert sorted(map(tuple, form(edges).select("page_id", "idx", "label").collect())) == want


def test_gap_is_not_symmetric(spark):
    df = spark.createDataFrame([(0.0, 10.0, 10.0, 30.0), (10.0, 30.0, 0.0, 10.0), (0.0, 10.0, 14.0, 20.0), (0.0, 10.0, 5.0, 6.0)], "a0 double, a1 double, b0 double, b1 double")
    ends = [F.col(c) for c in ("a0", "a1", "b0", "b1")]
    rows = df.select(gap(*ends), gap_is_zero(*ends), gap_within(*ends, F.lit(4.0)), gap_within(*ends, F.lit(3.0))).collect()
    assert [tuple(r) for r in rows] == [(-30.0, False, True, True), (0.0, True, True, True), (4.0, False, True, False), (0.0, True, True, True)]


def test_four_quarter_turns_are_identity(spark):
    df = spark.createDataFrame([(3.0, 5.0, 30.0, 50.0)], "x0 double, y0 double, x1 double, y1 double")
    w, h = 200.0, 300.0
    for _ in range(4):
        df = df.select(*rotate_bounds(Rect.of(), F.lit(w), F.lit(h), F.lit(90)).columns())
        w, h = h, w
    assert tuple(df.first()) == (3.0, 5.0, 30.0, 50.0)


def test_hit_test_ties_take_the_lower_index(spark):
    same = [(1, n, "Image", 0.0, 0.0, 100.0, 100.0, None) for n in (4, 2, 9)]
    probes = spark.createDataFrame([(1, 1, 50.0, 50.0), (2, 1, 106.0, 50.0), (3, 1, 105.0, 50.0)], "probe_id long, page_id long, x double, y double")
    got = spatial.hit_test(probes, spark.createDataFrame(same, BOX_SCHEMA)).select("probe_id", "idx").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (3, 2)]  # the widened right edge is outside


def test_all_fragments_are_kept_when_all_would_go(spark):
    rows = [(1, 0, "VectorPath", 0.0, 0.0, 5.0, 5.0, None), (1, 1, "VectorPath", -10.0, -10.0, 12.0, 12.0, None), (1, 2, "Image", 0.0, 0.0, 6.0, 6.0, None)]
    probes = spark.createDataFrame([(1, 1, 3.0, 3.0)], "probe_id long, page_id long, x double, y double")
    kept = spatial.drop_dominated(spatial.probe_candidates(probes, spark.createDataFrame(rows, BOX_SCHEMA)))
    assert sorted(r.idx for r in kept.collect()) == [1, 2]


def test_walk_tree_visits_shared_nodes_once_and_survives_cycles(spark):
    edges = spark.createDataFrame(
        [("r", "a", 0), ("r", "b", 1), ("a", "c", 0), ("b", "c", 0), ("c", "a", 0), ("c", "d", 1), ("b", "b", 2)],
        "parent string, child string, ord long")
    walked = catalog.walk_tree(edges, spark.createDataFrame([("r", 0)], "node string, ord long"))
    order = [r.node for r in walked.orderBy("path").collect()]
    assert order == ["r", "a", "c", "d", "b"]


def test_deeper_but_earlier_path_wins(spark):
    edges = spark.createDataFrame([("r", "a", 0), ("r", "x", 1), ("a", "b", 0), ("b", "x", 0), ("x", "y", 0)], "parent string, child string, ord long")
    walked = catalog.walk_tree(edges, spark.createDataFrame([("r", 0)], "node string, ord long"))
    assert {r.node: r.depth for r in walked.collect()} == {"r": 0, "a": 1, "b": 2, "x": 3, "y": 4}


def plain_dash(source):
    if not source:
        return []
    values = [abs(v) for v in source]
    if len(values) % 2:
        values += values
    out, extra_gap = [], 0.0
    pairs = [values[i:i + 2] for i in range(0, len(values), 2)]
    for n, (on, off) in enumerate(pairs):
        if on <= 1e-4:
            extra_gap += off
        elif off <= 1e-4 and n + 1 < len(pairs):
            pairs[n + 1][0] += on
        else:
            if out:
                out[-1] += extra_gap
                extra_gap = 0.0
            out += [on, max(off, 1e-4)]
    if out:
        out[-1] += extra_gap
    return out


def test_dash_arrays(spark):
    rng = random.Random(3)
    cases = [[float(rng.choice([0, 0, 1, -2, 3])) for _ in range(rng.randint(0, 7))] for _ in range(200)]
    df = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], "n int, d array<double>").select("n", strokes.normalise_dash("d").alias("out"))
    assert {r.n: r.out for r in df.collect()} == {n: plain_dash(c) for n, c in enumerate(cases)}


def test_state_survives_unbalanced_restores(spark):
    ops = ["Q", "set", "q", "set", "read", "Q", "read", "Q", "read", "q", "Q", "Q", "read"]
    log = spark.createDataFrame([(1, n, op) for n, op in enumerate(ops)], "k long, seq int, op string")
    op = F.col("op")
    got = drawing.state_asof(log, ["k"], "seq", op == "q", op == "Q", op == "set", op == "read", F.col("seq"))
    assert sorted((r.seq, r.value) for r in got.collect()) == [(4, 3), (6, 1), (8, 1), (12, 1)]


def test_undelta_inverts_differences(spark):
    rng = random.Random(5)
    raw = {(y, x): rng.randint(0, 255) for y in range(4) for x in range(6)}
    deltas = [(1, y, x, (v - raw.get((y, x - 1), 0)) % 256) for (y, x), v in raw.items()]
    got = raster.undelta(spark.createDataFrame(deltas, "image_id long, y int, x int, raw int"), "x", 6, 4)
    assert {(r.y, r.x): r.raw for r in got.collect()} == raw
    short = raster.undelta(spark.createDataFrame(deltas[:5], "image_id long, y int, x int, raw int"), "x", 6, 4)
    assert sorted(r.raw for r in short.collect()) == sorted(d[3] for d in deltas[:5])


def test_records_may_overlap_and_need_an_end(spark):
    df = spark.createDataFrame([(1, "1 0 obj a 2 0 obj b endobj 3 0 obj c endobj 4 0 obj d")], "f long, t string")
    got = corpus.extract_records(df, ["f"], "t", r"\d+ 0 obj", "endobj").orderBy("pos").collect()
    assert [(r.pos, r["head"], r.body) for r in got] == [(0, "1 0 obj", " a 2 0 obj b "), (10, "2 0 obj", " b "), (27, "3 0 obj", " c ")]


def test_containers(spark):
    rows = [(1, 2, "5 0 6 3", "ab cd"), (2, 3, "5 0 6 3", "ab cd"), (3, 2, "7 3 8 1", "abcde"), (4, 0, "", "")]
    df = spark.createDataFrame(rows, "k long, n int, h string, b string")
    got = corpus.unpack_container(df, ["k"], "n", "h", "b").collect()
    assert sorted(map(tuple, got)) == [(1, 5, "ab"), (1, 6, "cd"), (3, 8, "bcde")]


def test_files_are_read_byte_for_byte(spark, tmp_path):
    (tmp_path / "one.pdf").write_bytes(bytes(range(256)))
    row = corpus.scan_corpus(spark, str(tmp_path), "*.pdf").first()
    assert row["length"] == 256 and [ord(c) for c in row.text] == list(range(256))


def test_glyph_names(spark):
    cases = {"A#42": None, "A#2Ealt": "A", "Aacute.sc": "Á", "uni00410042": "AB", "uniD8000041": None, "u1F600": "😀", "u110000": None,
             ".notdef": None, "afii10023": "Ё", "lambda": "λ", "x": "x", "a#": None, "bracerightmid": "}", "Zdot": "Ż"}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    assert {r.name: r.text for r in names.normalise_name(df, "name", "text").collect()} == cases


def test_hex(spark):
    df = spark.createDataFrame([("41 4",), ("",), ("0041\n0042",)], "h string")
    got = df.select(names.hex_to_bytes(F.col("h")).alias("b"), names.hex_to_text(F.col("h")).alias("t")).collect()
    assert [bytes(r.b) for r in got] == [b"A@", b"", b"\0A\0B"] and got[2].t == "AB"


def test_reversed_ranges_and_later_entries(spark):
    lists = spark.createDataFrame([("f", 2, 10, [1.0, 2.0])], "font string, entry int, lo long, items array<double>")
    ranges = spark.createDataFrame([("f", 1, 9, 12, 7.0), ("f", 3, 5, 4, 9.0)], "font string, entry int, lo long, hi long, width double")
    got = codes.expand_width_runs(lists, ranges, ["font"]).collect()
    assert sorted((r.code, r.width) for r in got) == [(9, 7.0), (10, 1.0), (11, 2.0), (12, 7.0)]


def test_wide_ranges_are_cut_at_the_code_space(spark):
    df = spark.createDataFrame([("f", 1, 0, 200000, 65)], "font string, entry int, lo long, hi long, dst long")
    assert codes.expand_ranges(df, ["font"]).count() == 65536 - 2048


def test_missing_required_value_is_set_aside(spark):
    df = spark.createDataFrame([(1, "/Width 5"), (2, "/Height 5")], "k int, body string")
    good, bad = quarantine(df.withColumn("w", attr_int(F.col("body"), "/Width")), "k", {"no width": F.col("w").isNull()})
    assert [r.k for r in good.collect()] == [1] and [tuple(r) for r in bad.collect()] == [(2, "no width")]


def test_running_blocks_match_plain_sums(spark):
    rng = random.Random(9)
    rows = [(k, n, rng.choice([None, rng.randint(-5, 5)])) for k in range(3) for n in range(50)]
    df = spark.createDataFrame(rows, "k int, n int, v int")
    forward = skew.running(df, ["k"], ["n"], skew.position_block("n", 7), {"s": ("sum", F.col("v")), "l": ("last", F.col("v"))}, inclusive=False)
    back = skew.running(df, ["k"], ["n"], skew.position_block("n", 7), {"m": ("max", F.col("v")), "l": ("last", F.col("v"))}, reverse=True)
    got = {(r.k, r.n): (r.s, r.l) for r in forward.collect()}
    got_back = {(r.k, r.n): (r.m, r.l) for r in back.collect()}
    for k, n, _ in rows:
        before = [v for kk, nn, v in rows if kk == k and nn < n and v is not None]
        after = [v for kk, nn, v in rows if kk == k and nn >= n and v is not None]
        assert got[k, n] == (sum(before), before[-1] if before else None)
        assert got_back[k, n] == (max(after, default=None), after[0] if after else None)


def test_objects_are_written_by_kind(spark, tmp_path):
    box = spark.createDataFrame(dense_page(30), BOX_SCHEMA)
    sinks.write_objects(box, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert collected(back) == collected(box)
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"kind=Text", "kind=VectorPath", "kind=Image"}
    stream = spark.readStream.schema(back.schema).parquet(str(tmp_path / "out"))
    sinks.write_object_stream(stream, str(tmp_path / "streamed"), str(tmp_path / "state")).awaitTermination()
    assert collected(spark.read.parquet(str(tmp_path / "streamed"))) == collected(box)


def test_running_keeps_null_keys_and_null_orders(spark):
    rows = [(1, 0, 5), (None, 0, 7), (None, 1, 8), (1, None, 2)]
    df = spark.createDataFrame(rows, "k int, pos int, v int")
    got = skew.running(df, ["k"], ["pos"], F.floor(F.col("pos") / 4), {"total": ("sum", F.col("v"))}).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(1, None, 2, 2), (1, 0, 5, 7), (None, 0, 7, 7), (None, 1, 8, 15)], key=repr
    )
    placed = skew.dense_position(df, ["k"], ["pos"], [F.floor(F.col("pos") / 4)], "at").collect()
    assert {(r["k"], r["pos"], r["at"]) for r in placed} == {(1, None, 0), (1, 0, 1), (None, 0, 0), (None, 1, 1)}


def test_boxes_of_a_null_page_are_kept(spark):
    rows = [(1, 0, "Image", 0.0, 0.0, 9.0, 9.0, None), (None, 1, "Image", 0.0, 0.0, 9.0, 9.0, None), (2, 0, "Text", 0.0, 0.0, 50.0, 9.0, "a")]
    df = spark.createDataFrame(rows, "page_id long, idx long, kind string, x0 double, y0 double, x1 double, y1 double, content string")
    assert blocks.page_objects(df).count() == 3


def test_scopes_of_any_depth_and_misses(spark):
    depth = 70
    scopes = spark.createDataFrame([(f"s{k}", f"s{k + 1}") for k in range(depth)] + [("a", "b"), ("b", "a")], "scope string, parent string")
    resources = spark.createDataFrame([(f"s{depth}", "/Font", 5)], "scope string, name string, target int")
    requests = spark.createDataFrame([(1, "s0", "Font"), (2, "s0", "None"), (3, "a", "Font")], "request_id int, scope string, name string")
    found, missed = catalog.resolve_in_scope(requests, scopes, resources)
    assert [(r["request_id"], r["depth"], r["target"]) for r in found.collect()] == [(1, depth, 5)]
    assert sorted(r["request_id"] for r in missed.collect()) == [2, 3]


def test_ten_digit_codes_are_numbers(spark):
    rows = [(1, 0, "1234567890"), (1, 1, "A"), (1, 2, "B")]
    got = codes.assign_running_codes(spark.createDataFrame(rows, "k int, pos int, tok string"), ["k"]).collect()
    assert sorted((r["code"], r["text"]) for r in got) == [(1234567890, "A"), (1234567891, "B")]


def test_short_color_space_name_is_not_indexed(spark):
    from pagelens.functions.attrs import classify_color_space

    df = spark.createDataFrame([("/ColorSpace [/I /DeviceRGB 1 2 0 R]",), ("/ColorSpace [/Indexed /DeviceGray 1 2 0 R]",)], "b string")
    assert [r[0] for r in df.select(classify_color_space(F.col("b"))["kind"]).collect()] == ["DeviceRGB", "indexed"]


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def test_forms_nest_deeply_from_many_pages_and_cycles_are_reported(spark):
    names = ["owner string", "name string", *[f"{c} double" for c in catalog.MATRIX]]
    chain = [(f"F{n}", f"F{n + 1}") for n in range(70)] + [("F70", "I"), ("P1", "F0"), ("P2", "L"), ("L", "I"), ("L", "L"), ("P2", "?")]
    uses = spark.createDataFrame([(*pair, *IDENTITY) for pair in chain], ", ".join(names))
    forms = spark.createDataFrame([(name, *IDENTITY) for name in ["L", *[f"F{n}" for n in range(71)]]], ", ".join(names[1:]))
    images = spark.createDataFrame([("I",)], "name string")
    starts = spark.createDataFrame([("P1",), ("P2",)], "owner string")
    drawn, unknown, cycles = catalog.expand_uses(uses, forms, images, starts, 800.0, 1.0)
    assert sorted(drawn.select("start", "name", "depth").collect()) == [("P1", "I", 72), ("P2", "I", 2)]
    assert sorted(map(tuple, unknown.collect())) == [("P2", "?", 1)]
    assert sorted(map(tuple, cycles.collect())) == [("P2", "L", 2)]


def test_codes_beyond_the_range_cap_are_returned(spark):
    df = spark.createDataFrame([("f", 0, 10, 70000, 5), ("f", 1, 0, 65535, 5)], "font string, entry int, lo long, hi long, dst int")
    assert [(r["entry"], r["lo"], r["hi"]) for r in codes.beyond_range_cap(df).collect()] == [(0, 65546, 70000)]


def test_color_space_forms(spark):
    bodies = {
        "/ColorSpace /DeviceCMYK": ("DeviceCMYK", None), "/ColorSpace\n[ /CalGray << >> ]": ("DeviceGray", None),
        "/ColorSpace [/ICCBased 7 0 R]": ("icc", "7"), "/ColorSpace [/ICCBased 7 0 R 1]": ("DeviceRGB", None),
        "/ColorSpace [/Indexed /DeviceGray 255 9 0 R]": ("indexed", "DeviceGray"), "/ColorSpace [/I /DeviceGray 1 (a)]": ("DeviceRGB", None),
        "/ColorSpace 12 0 R": ("indirect", "12"), "/ColorSpace /Cs1": ("named", "/Cs1"), "/Width 3": ("DeviceRGB", None),
        "/ColorSpace /Cs1 /X << /ColorSpace /DeviceGray >>": ("DeviceGray", None),
    }
    definitions = {
        " /DeviceGray": ("DeviceGray", None), "[ /Pattern /DeviceRGB ]": ("pattern", None), "[/Indexed [/ICCBased 5 0 R] 1 (a)]": ("icc", "5"),
        "[ /Lab << >> ]": ("DeviceRGB", None), "/Cs1": None,
    }
    for rule, want in ((attrs.classify_color_space, bodies), (attrs.classify_definition, definitions)):
        df = spark.createDataFrame([(text,) for text in want], "body string")
        got = df.select("body", rule(F.col("body")).alias("s")).collect()
        assert {r["body"]: None if r["s"] is None else tuple(r["s"]) for r in got} == want


def test_a_vector_alone_on_its_page_keeps_its_content(spark):
    rows = [(1, 0, "VectorPath", 0.0, 0.0, 9.0, 9.0, "kept"), (2, 0, "VectorPath", 0.0, 0.0, 9.0, 9.0, "a"), (2, 1, "VectorPath", 2.0, 2.0, 9.0, 9.0, "b")]
    got = collected(blocks.merge_pass(spark.createDataFrame(rows, BOX_SCHEMA), rules.VECTOR_PRIMITIVES))
    assert [(r[0], r[-1]) for r in got] == [(1, "kept"), (2, "")]
