"""Boxes placed by page: what is moved, and that small and large pages give the same rows."""

import pytest
from pyspark.sql import functions as F
from test_golden import BOX_SCHEMA, dense_page

from pagelens.functions import rules
from pagelens.operators import blocks, spatial
from pagelens.operators.skew import crowded_keys, position_by_size
from pagelens.plans.catalog_of_cases import all_cases

ORDER = ["pos", "id"]


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if " Exchange " in line]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_boxes_are_moved_once(tables):
    moved = shuffles(tables.box())
    assert len(moved) == 1 and "hashpartitioning(page_id" in moved[0]


def test_crowded_keys_are_numbered_like_others(spark):
    rows = [(k, i * 7 % 5, i) for k, n in [(1, 40), (2, 3), (None, 30), (None, 2)] for i in range(n)]
    df = spark.createDataFrame([(k, p, n) for n, (k, p, _) in enumerate(rows)], "key int, pos int, id int")
    crowded = crowded_keys(df, ["key"], 10)
    assert {r["key"] for r in crowded.collect()} == {1, None} and crowded_keys(df, ["key"], 40) is None
    levels = [F.floor(F.col("pos") / 2)]
    got, want = (rows_of(position_by_size(df, ["key"], ORDER, levels, "at", large)) for large in (crowded, None))
    assert got == want and len(got) == len(rows)


def test_names_are_joined_before_boxes_are_numbered(spark, tables, tmp_path):
    for name in ("lineitem", "part"):
        rows = tables.table(name)
        (rows.unionByName(rows.limit(3)) if name == "part" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    box = type(tables)(spark, str(tmp_path)).box()
    assert box.groupBy("page_id", "idx").count().filter("count > 1").isEmpty()


@pytest.mark.parametrize("name", ["O2_pair_geometry", "O3_pair_candidates", "O4_same_line", "O5_merge_text_blocks", "O11_pair_classes"])
def test_pairs_move_boxes_by_page_only(name, tables):
    moved = shuffles(all_cases()[name][0](tables))
    assert len(moved) == 2 and all("hashpartitioning(page_id" in line for line in moved)  # the same rows for both sides


@pytest.mark.parametrize("rule", [rules.VECTOR_PRIMITIVES, rules.TEXT_BLOCKS, rules.TEXT_VECTOR, rules.HOVER_VECTORS])
def test_pages_find_the_pairs_of_the_grid(spark, rule):
    box = spark.createDataFrame(dense_page(220), BOX_SCHEMA)
    more = F.col("a.idx").alias("left"), F.col("b.x1").alias("right_edge")
    near = [rows_of(blocks.pair_candidates(box, rule, *more, large=large).select("page_id", "a", "b", "left", "right_edge")) for large in (True, False)]
    assert near[0] == near[1] and len(near[0]) > 0
    assert rows_of(blocks.merge_edges(box, rule, large=False)) == rows_of(blocks.small_page_edges(box, rule))


def test_long_conditions_stay_out_of_joins_and_filters(spark, tables):
    box = spark.createDataFrame(dense_page(20), BOX_SCHEMA)
    for df in (blocks.merge_edges(box, rules.TEXT_BLOCKS, large=False), blocks.clean_boxes(tables.box())):
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        assert any("Generate explode" in line for line in plan)
        assert all(len(line) < 2500 for line in plan if "Join" in line or "Filter" in line)


def test_boxes_without_extent_are_dropped(spark):
    nan, inf = float("nan"), float("inf")
    edges = [(5.0, 5.0), (9.0, 2.0), (nan, 1.0), (nan, nan), (inf, inf), (inf, 1.0), (None, 4.0), (None, None), (1e18, 1e18)]
    box = spark.createDataFrame([(1, n, "Text", a, 0.0, b, 8.0, None) for n, (a, b) in enumerate(edges)], BOX_SCHEMA)
    got = {r["idx"]: (r["x0"], r["x1"]) for r in blocks.clean_boxes(box).collect()}
    assert got == {0: (4.5, 5.5), 1: (2.0, 9.0), 5: (1.0, inf), 6: (3.5, 4.5)}


def test_probes_find_the_same_boxes_by_page_and_by_cell(spark, tables):
    box = spark.createDataFrame(dense_page(220), BOX_SCHEMA)
    probes = spark.range(300).select(F.col("id").alias("probe_id"), F.lit(1).cast("long").alias("page_id"), (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 37).cast("double").alias("y"))
    found = [rows_of(spatial.hit_test(probes, box, large=large)) for large in (True, False)]
    assert found[0] == found[1] and len(found[0]) > 0
    assert not any("cx" in line for line in shuffles(all_cases()["H1_probe_candidates"][0](tables)))


def test_one_large_page_beside_small_ones(spark, tables):
    small, more = (spark.createDataFrame([(page, *row[1:]) for row in dense_page(60, seed=page)], BOX_SCHEMA) for page in (1, 2))
    box, large = small.unionByName(more), spark.createDataFrame([(2,)], "page_id long")
    got = blocks.by_known_size(box, large, lambda rows, crowded: blocks.merge_edges(rows, rules.TEXT_BLOCKS, crowded))
    assert rows_of(got) == rows_of(blocks.small_page_edges(box, rules.TEXT_BLOCKS))


def test_page_objects_move_boxes_once(tables):
    moved = shuffles(all_cases()["O18_page_objects"][0](tables))
    assert len(moved) == 1 and "hashpartitioning(page_id" in moved[0]


def test_page_objects_of_small_and_large_pages(spark):
    rows = [(page, *row[1:]) for page in range(4) for row in dense_page(30 + 40 * page, seed=page)]
    rows += [(8, 0, "Image", 0.0, 0.0, 5.0, 5.0, None), (9, 0, "Text", 0.0, 0.0, 5.0, 5.0, " kept ")]
    box = blocks.clean_boxes(spark.createDataFrame(rows, BOX_SCHEMA))
    got, want = (rows_of(blocks.merged_objects(box, large).select(*blocks.BOX)) for large in (False, True))
    assert got == want and {r[0] for r in got} == {0, 1, 2, 3, 8, 9}


def test_rules_do_not_join_boxes_without_a_page(spark):
    texts = [(None, n, "Text", 20.0 * n, 0.0, 20.0 * n + 9, 9.0, f" {n}") for n in range(2)]
    vectors = [(None, n, "VectorPath", 0.0, 50.0, 9.0 + n, 60.0, None) for n in (2, 3)]
    got = blocks.merged_objects(blocks.clean_boxes(spark.createDataFrame(texts + vectors, BOX_SCHEMA)))
    assert rows_of(got.select("idx", "x1", "content")) == [(0, 29.0, "0 1"), (2, 11.0, None), (3, 12.0, None)]
