"""Queries over glyphs beside their SQL, on empty, missing and repeated texts."""

import duckdb
import pytest
from compare import difference
from conftest import DATA

from pagelens.plans.catalog_of_cases import all_cases
from pagelens.plans.fixtures import Tables

# Rows of one id are alike, so that no order of equal positions matters.
TEXTS = [(1, "ab a"), (2, ""), (3, None), (4, ""), (4, ""), (5, None), (5, ""), (6, "\0 \U0001f600"), (None, "xyz"),
         (7, "x" * 4096), (8, "y" * 4097)] + [(9, "\u00ff\u00ffab")] * 20


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{DATA}/nation.parquet").write.parquet(f"{folder}/nation.parquet")
    con = duckdb.connect()
    for name in ("documents", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return Tables(spark, str(folder)), con


@pytest.mark.parametrize("name", ["C10_merge_maps", "E7_winansi_table", "T1_glyph_advance"])
def test_an_empty_text_is_one_empty_glyph(odd, name):
    tables, con = odd
    build, sql = all_cases()[name]
    assert difference(build(tables), con, sql) is None


@pytest.mark.parametrize("name", ["E1_decode_codes", "E2_pair_codes", "T2_pen_positions", "T3_apply_kerning"])
def test_blocks_keep_the_empty_glyph(odd, name):
    tables, con = odd
    build, sql = all_cases()[name]
    assert difference(build(tables), con, sql) is None


def test_blocks_of_odd_texts_hold_the_glyphs(odd):
    blocks, glyphs = odd[0].glyph_blocks().drop("part"), odd[0].glyph()
    assert blocks.exceptAll(glyphs).isEmpty() and glyphs.exceptAll(blocks).isEmpty()
