"""Numbers read from object text, and catalogues of several documents."""

import time

from pyspark.sql import functions as F

from pagelens.functions.attrs import attr_float, attr_int, attr_signed, number_state
from pagelens.operators import catalog, codes
from pagelens.quality import quarantine
from pagelens.sources import corpus


def test_numbers_that_do_not_fit_are_bad_not_missing(spark):
    rows = [(1, "/Width 7"), (2, "/Width 9999999999"), (3, "/Height 3"), (4, None), (5, "/Width -3"), (6, "/W 2 /Width x")]
    df = spark.createDataFrame(rows, "k int, body string")
    body = F.col("body")
    read = df.select("k", attr_int(body, "/Width", "/W", default=-1).alias("w"), number_state(body, "/Width", "/W").alias("s"),
                     number_state(body, "/Width", signed=True).alias("t"), attr_signed(body, "/Width").alias("n"),
                     attr_float(body, "/Width", default=0.5).alias("f"))
    got = {r["k"]: (r["w"], r["s"], r["t"], r["n"], r["f"]) for r in read.collect()}
    assert got[1] == (7, "value", "value", 7, 7.0)
    assert got[2] == (None, "bad", "bad", None, 9999999999.0)
    assert got[3] == (-1, "missing", "missing", None, 0.5) and got[4][:3] == (-1, "missing", "missing")
    assert got[5][:4] == (-1, "missing", "value", -3) and got[6][0] == 2
    good, bad = quarantine(read, "k", {"no width": F.col("s") == "missing", "width too large": F.col("s") == "bad"})
    assert sorted(r["k"] for r in good.collect()) == [1, 6]
    assert {r["k"]: r["reason"] for r in bad.collect()} == {2: "width too large", 3: "no width", 4: "no width", 5: "no width"}


def test_object_numbers_start_again_in_every_document(spark):
    edges = spark.createDataFrame(
        [("a", 1, 2, 0), ("a", 1, 3, 1), ("a", 2, 4, 0), ("b", 1, 3, 0), ("b", 3, 2, 0), ("b", 2, 1, 0)],
        "doc string, parent int, child int, ord long")
    roots = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "doc string, node int, ord long")
    attrs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "doc string, node int, media string")
    got = {(r["doc"], r["node"]): (r["depth"], r["media"]) for r in catalog.inherit(edges, roots, attrs, ("media",), ("doc",)).collect()}
    assert got == {
        ("a", 1): (0, "x"), ("a", 2): (1, "y"), ("a", 3): (1, "x"), ("a", 4): (2, "y"),
        ("b", 1): (0, None), ("b", 3): (1, "z"), ("b", 2): (2, "z"),
    }
    found, dangling = catalog.resolve_refs(edges, attrs, "child", "node", ("doc",))
    assert sorted((r["doc"], r["child"]) for r in found.collect()) == [("a", 2), ("b", 3)]
    assert dangling.count() == 4 and found.columns.count("doc") == 1


def test_scopes_of_several_documents(spark):
    requests = spark.createDataFrame([("a", 1, 2, "f"), ("b", 1, 2, "f"), ("b", 2, 2, "/g")], "doc string, request_id int, scope int, name string")
    scopes = spark.createDataFrame([("a", 2, 1), ("b", 2, 1)], "doc string, scope int, parent int")
    resources = spark.createDataFrame([("a", 1, "/f", "A"), ("b", 2, "g", "G")], "doc string, scope int, name string, target string")
    answered, missed = catalog.resolve_in_scope(requests, scopes, resources, ("doc",))
    assert sorted((r["doc"], r["request_id"], r["depth"], r["target"]) for r in answered.collect()) == [("a", 1, 1, "A"), ("b", 2, 0, "G")]
    assert [tuple(r) for r in missed.collect()] == [("b", 1)]


def test_forms_and_color_spaces_of_several_documents(spark):
    at = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    m = "a double, b double, c double, d double, e double, f double"
    uses = spark.createDataFrame([("p", "page", "F", *at), ("p", "F", "I", *at), ("q", "page", "F", *at)], f"doc string, owner string, name string, {m}")
    forms = spark.createDataFrame([("p", "F", *at)], f"doc string, name string, {m}")
    images = spark.createDataFrame([("p", "I"), ("q", "F")], "doc string, name string")
    starts = spark.createDataFrame([("p", "page"), ("q", "page")], "doc string, owner string")
    drawn, unknown, cycles = catalog.expand_uses(uses, forms, images, starts, 100.0, 1.0, ("doc",))
    assert sorted((r["doc"], r["name"], r["depth"]) for r in drawn.collect()) == [("p", "I", 2), ("q", "F", 1)]
    assert unknown.count() == 0 and cycles.count() == 0
    bodies = spark.createDataFrame([("p", 1, "/ColorSpace /Cs1"), ("q", 1, "/ColorSpace /Cs1")], "doc string, k int, body string")
    none = spark.createDataFrame([], "doc string, obj string, text string")
    profiles = spark.createDataFrame([], "doc string, obj string, alternate string, components int")
    named = spark.createDataFrame([("p", "/Cs1", "Separation")], "doc string, name string, kind string")
    kinds = catalog.resolve_color_spaces(bodies, "k", "body", none, profiles, named, ("doc",)).collect()
    assert sorted((r["doc"], r["kind"]) for r in kinds) == [("p", "Separation"), ("q", "unsupported")]


def test_color_spaces_of_many_rows_take_seconds(spark):
    texts = F.array(F.lit("/ColorSpace [ /ICCBased 1 0 R ]"), F.lit("/ColorSpace 10 0 R"), F.lit("/Width 5"))
    bodies = spark.range(1_000_000).select("id", F.get(texts, (F.col("id") % 3).cast("int")).alias("body"))
    objects = spark.createDataFrame([("10", "[ /Pattern /DeviceRGB ]")], "obj string, text string")
    profiles = spark.createDataFrame([("1", None, 4)], "obj string, alternate string, components int")
    named = spark.createDataFrame([], "name string, kind string")
    begun = time.time()
    kinds = catalog.resolve_color_spaces(bodies, "id", "body", objects, profiles, named).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in kinds} == {"DeviceCMYK": 333_334, "pattern": 333_333, "DeviceRGB": 333_333}
    assert time.time() - begun < 30


def test_files_are_measured_in_splits(spark, tmp_path):
    contents = [b"\n", bytes(range(256)) * 9, b"\xff\xd8\xff\xe0\r\nx\n", b"\xef\xbb\xbfab\ncd", b"\xef\xbb\xbf", b"\n\n" * 900, b"x" * 70000 + b"\ny" * 9]
    for n, content in enumerate(contents):
        (tmp_path / f"{n}.bin").write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {int(r["path"].split("/")[-1][:-4]): r for r in corpus.measure_corpus(spark, str(tmp_path), "*.bin").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for n, content in enumerate(contents):
        assert (got[n]["length"], got[n]["chars"], bytes(got[n]["head"])) == (len(content), len(content), content[:512]), n


def test_range_codes_are_folded_without_a_sort(spark):
    ranges = spark.range(50).select(F.lit("f").alias("font"), F.col("id").alias("entry"), (F.col("id") % 3).alias("lo"), F.lit(9).cast("long").alias("hi"), (F.col("id") + 65).alias("dst"))
    got = codes.expand_ranges(ranges, ["font"])
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["code"]: r["text"] for r in got.collect()} == {0: chr(65 + 48), 1: chr(65 + 49), **{c: chr(65 + 49 + c - 1) for c in range(2, 10)}}


def test_widths_are_looked_up_once_a_code_and_document(tables, monkeypatch):
    from pagelens.plans import cases_codes

    seen, real = [], codes.lookup_width
    monkeypatch.setattr(cases_codes.cd, "lookup_width", lambda glyphs, *rest: seen.append(glyphs) or real(glyphs, *rest))
    cases_codes.e8(tables)
    assert seen[0].count() == seen[0].select("doc_id", "code").distinct().count()
