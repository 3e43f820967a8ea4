"""Layout analysis: grouping the boxes of a page into lines, blocks and formulas.

Boxes are rows (page_id, idx, kind, x0, y0, x1, y1, content). Pages of at most ``PAGE_LIMIT`` boxes take
the small-page form: the pairs of a page meet in one hash join and its components in one task. Larger
pages take the large-page form: candidate pairs meet on grid cells, crowded cells are split, and
components are found by iteration over written tables, so no task ever holds a whole page.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.geom import Rect, all_of
from pagelens.functions.rules import (
    HOVER,
    VECTOR_BLOCKS,
    VECTOR_PRIMITIVES,
    GroupRule,
    has_text,
    measured,
    stripped,
    tight_join,
)
from pagelens.operators import pages
from pagelens.operators.graph import (
    components_of_any_page,
    components_of_small_pages,
    with_labels,
)
from pagelens.operators.pages import line_numbers, tested
from pagelens.operators.skew import crowded_keys, join_null_safe, numbered, position_block, running
from pagelens.session import checkpointed, written

PAGE_LIMIT = 1024
CELL = 256.0
COARSE_CELL = CELL * 64
CHUNK = 256
EDGES = ["x0", "y0", "x1", "y1"]


def clean_boxes(df: DataFrame) -> DataFrame:
    """Order the corners, pad about the centre to the least extent (3 for vectors, else 1)."""
    x0, x1 = F.least("x0", "x1"), F.greatest("x0", "x1")
    y0, y1 = F.least("y0", "y1"), F.greatest("y0", "y1")
    least = F.when(F.col("kind") == "VectorPath", 3.0).otherwise(1.0)
    pad_x = F.greatest(F.lit(0.0), (least - (x1 - x0)) / 2)
    pad_y = F.greatest(F.lit(0.0), (least - (y1 - y0)) / 2)
    padded = df.withColumns({"x0": x0 - pad_x, "y0": y0 - pad_y, "x1": x1 + pad_x, "y1": y1 + pad_y})
    return tested(padded, (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def split_by_kind(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text, vector and image rows."""
    return tuple(df.filter(F.col("kind") == k) for k in ("Text", "VectorPath", "Image"))


def merge_in_order(parts: Sequence[DataFrame], keys: Sequence[str] = ("page_id", "idx")) -> DataFrame:
    """Rows of all parts in the order of their index."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(*keys)


# --- candidate pairs ---------------------------------------------------------------------------

def _cells(df: DataFrame, area: Rect, tags: Column) -> DataFrame:
    """One row per (tag, cell) the area touches. ``tags`` is an array of tag numbers; tag 0 is fine."""
    tagged = df.select("*", F.explode(tags).alias("tag")).withColumn(
        "_size", F.when(F.col("tag") == 0, CELL).otherwise(COARSE_CELL)
    )

    def steps(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / F.col("_size")), F.floor(high / F.col("_size"))))

    return tagged.select("*", steps(area.x0, area.x1).alias("cell_x")).select(
        "*", steps(area.y0, area.y1).alias("cell_y")
    )


def _widened(df: DataFrame, rule: GroupRule) -> DataFrame:
    """Rows with the edges (_x0, _y0, _x1, _y1) of their box widened by the reach of the rule."""
    box = Rect.of()
    area = box.inflate(rule.reach_x(box), rule.reach_y(box))
    return df.select("*", *[c.alias(f"_{n}") for c, n in zip((area.x0, area.y0, area.x1, area.y1), EDGES)])


def _grid_sides(df: DataFrame, rule: GroupRule) -> tuple[DataFrame, DataFrame]:
    """Left rows on the cells of their area widened by the reach, right rows on those of their box.

    Small areas meet on fine cells. A large area is spread over few coarse cells instead: tag 1 joins
    large left areas to small right boxes, tag 2 joins any left area to large right boxes.
    """
    rows = measured(df)
    box = Rect.of()
    wide = _widened(rule.left(rows), rule)
    area = Rect(*[F.col(f"_{n}") for n in EDGES])

    def large(r: Rect) -> Column:
        return F.greatest(r.w, r.h) > 4 * CELL

    left_tags = F.when(large(area), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(2)))
    right_tags = F.when(large(box), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    return _cells(wide, area, left_tags), _cells(rule.right(rows), box, right_tags)


CELL_KEYS = ["page_id", "tag", "cell_x", "cell_y"]


def _within(rule: GroupRule) -> Column:
    """Boxes ``a`` and ``b`` within reach."""
    a, b = Rect(*[F.col(f"a._{n}") for n in EDGES]), Rect.of("b")
    return all_of(rule.ordered("a", "b"), a.x0 <= b.x1, b.x0 <= a.x1, a.y0 <= b.y1, b.y0 <= a.y1)


def _near(rule: GroupRule) -> Column:
    """Boxes within reach; true in exactly one of the cells they share (that of the corner of the
    shared area), so pairs come out once."""
    def a(name: str) -> Column:
        return F.col(f"a.{name}")

    def b(name: str) -> Column:
        return F.col(f"b.{name}")

    return all_of(
        _within(rule),
        F.floor(F.greatest(a("_x0"), b("x0")) / a("_size")) == a("cell_x"),
        F.floor(F.greatest(a("_y0"), b("y0")) / a("_size")) == a("cell_y"),
    )


def _meet(
    left: DataFrame, right: DataFrame, keys: Sequence[str], extra: Column, node: str = "idx",
    rule: GroupRule | None = None, more: Sequence[Column] = (),
) -> DataFrame:
    """Edges (page_id, a, b) with a < b between rows that agree on the keys, and more columns of rows a and b.

    Rules are long conditions, and most pairs are far apart: a rule is tested on the pairs that pass ``extra``.
    """
    on = all_of(*[F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    ends = F.col(f"a.{node}"), F.col(f"b.{node}")
    pairs = left.alias("a").join(right.alias("b"), on & extra)
    pairs = pairs if rule is None else tested(pairs, rule.holds("a", "b"))
    return pairs.select(
        F.col("a.page_id").alias("page_id"), F.least(*ends).alias("a"), F.greatest(*ends).alias("b"), *more
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def pair_candidates(df: DataFrame, rule: GroupRule, *more: Column, large: bool = True) -> DataFrame:
    """Pairs (page_id, a, b) with a < b whose boxes lie within the reach of the rule.

    ``more`` are columns over the rows ``a`` and ``b`` of a pair, read where the pair is found. Without ``large``,
    for pages of a checked size, rows meet on the page alone and are moved once if at all.
    """
    if large:
        return _meet(*_grid_sides(df, rule), CELL_KEYS, _near(rule), more=more)
    return _meet(_widened(rule.left(df), rule), rule.right(df), ["page_id"], _within(rule), more=more)


def merge_edges(df: DataFrame, rule: GroupRule, large: bool = True) -> DataFrame:
    """Pairs for which the rule holds, found on the grid or, without ``large``, on the page."""
    if large:
        return _meet(*_grid_sides(df, rule), CELL_KEYS, _near(rule), rule=rule)
    rows = measured(df)
    return _meet(_widened(rule.left(rows), rule), rule.right(rows), ["page_id"], _within(rule), rule=rule)


def hover_edges(df: DataFrame, large: bool = True) -> DataFrame:
    """Pairs of boxes of any kind that belong together, by the rule of their kinds; images never do.

    Every rule reads the boxes on both sides, so they are written once first.
    """
    rows = checkpointed(df)
    return _union([merge_edges(rows, rule, large) for rule in HOVER])


def small_page_edges(df: DataFrame, rule: GroupRule) -> DataFrame:
    """The same pairs with the rule tested on all pairs of a page, to check the others by."""
    rows = measured(df)
    return _meet(
        rule.left(rows), rule.right(rows), ["page_id"], rule.ordered("a", "b") & rule.holds("a", "b")
    )


# --- components --------------------------------------------------------------------------------

def _large_page_labels(df: DataFrame, rules: Sequence[GroupRule], chunk: int = CHUNK) -> DataFrame:
    """Component labels without testing all pairs of a crowded cell.

    Step 1 splits a crowded cell into chunks of about ``chunk`` boxes and tests pairs inside chunks,
    which joins most boxes of a component. Step 2 tests the pairs step 1 left out, but only between
    different components, and never between two boxes of the cell's most frequent one.
    Every pair that could still change a component is tested, so the labels are exact.
    """
    sides = [tuple(written(side) for side in _grid_sides(df, rule)) for rule in rules]
    crowds, first = [], []
    for rule, (left, right) in zip(rules, sides):
        def count(side: DataFrame, name: str) -> DataFrame:
            return side.groupBy(*CELL_KEYS).agg(F.count(F.lit(1)).alias(name))

        crowded = written(
            count(left, "l").join(count(right, "r"), CELL_KEYS)
            .filter(F.greatest("l", "r") > chunk)
            .select(*CELL_KEYS, F.ceil(F.greatest("l", "r") / chunk).alias("chunks"))
        )
        crowds.append(crowded)

        def chunked(side: DataFrame, crowded: DataFrame = crowded) -> DataFrame:
            return side.join(crowded, CELL_KEYS, "left").withColumn(
                "chunk", F.pmod(F.xxhash64("idx"), F.coalesce("chunks", F.lit(1)))
            )

        first.append(_meet(
            chunked(left), chunked(right), [*CELL_KEYS, "chunk"], _near(rule), rule=rule
        ))
    labels = components_of_any_page(_union(first))
    second = [
        _open_edges(rule, left, right, crowded, labels)
        for rule, (left, right), crowded in zip(rules, sides, crowds)
        if not crowded.isEmpty()
    ]
    if not second:
        return labels
    roots = components_of_any_page(_union(second)).select(
        "page_id", F.col("idx").alias("label"), F.col("label").alias("root")
    )
    # A node without an edge in step 1 is its own label and may have got one in step 2.
    nodes = with_labels(df.select("page_id", "idx"), labels)
    return join_null_safe(nodes, roots, ["page_id", "label"], "left").select(
        "page_id", "idx", F.coalesce("root", "label").alias("label")
    )


def _open_edges(
    rule: GroupRule, left: DataFrame, right: DataFrame, crowded: DataFrame, labels: DataFrame
) -> DataFrame:
    """Edges between components (by label) that meet in crowded cells."""
    def in_crowd(side: DataFrame) -> DataFrame:
        return written(with_labels(side.join(crowded, CELL_KEYS, "left_semi"), labels))

    left, right = in_crowd(left), in_crowd(right)
    hubs = right.groupBy(*CELL_KEYS, "label").count().groupBy(*CELL_KEYS).agg(
        F.max_by("label", F.struct("count", "label")).alias("hub")
    )

    def classed(side: DataFrame, classes: Column) -> DataFrame:
        return side.join(hubs, CELL_KEYS, "left").withColumn("class", F.explode(classes))

    in_hub = F.col("label") == F.coalesce(F.col("hub"), F.lit(-1))
    other, hub = F.lit("other"), F.lit("hub")
    probing = classed(left, F.when(in_hub, F.array(other)).otherwise(F.array(other, hub)))
    probed = classed(right, F.array(F.when(in_hub, hub).otherwise(other)))
    still_open = F.col("a.label") != F.col("b.label")
    return _meet(
        probing, probed, [*CELL_KEYS, "class"], still_open & _near(rule), "label", rule
    ).distinct()


def group_labels(df: DataFrame, rules: Sequence[GroupRule], large: bool) -> DataFrame:
    """Boxes with ``label``, the smallest index of the component the rules put them in."""
    if large:
        return with_labels(df, _large_page_labels(df, rules))
    edges = _union([merge_edges(df, rule, large=False) for rule in rules])
    return with_labels(df, components_of_small_pages(edges))


def split_pages(df: DataFrame, large: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Boxes of all pages but the ``large`` ones, and boxes of these or None when there are none."""
    if large is None:
        return df, None
    return df.join(large, "page_id", "left_anti"), df.join(large, "page_id", "left_semi")


def pages_by_size(df: DataFrame, limit: int = PAGE_LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """Boxes of pages within the limit, and boxes of larger pages or None when there are none."""
    return split_pages(df, crowded_keys(df, ["page_id"], limit))


def by_page_size(df: DataFrame, step, limit: int = PAGE_LIMIT) -> DataFrame:
    """Apply ``step(rows, large)`` to the small and the large pages and put the results together."""
    return _each_size(*pages_by_size(df, limit), step)


def by_known_size(df: DataFrame, large: DataFrame | None, step) -> DataFrame:
    """The same where the ``large`` pages are known (None: there are none), without counting boxes again."""
    return _each_size(*split_pages(df, large), step)


def _each_size(small: DataFrame, large: DataFrame | None, step) -> DataFrame:
    out = step(small, False)
    return out if large is None else out.unionByName(step(large, True))


# --- text lines --------------------------------------------------------------------------------

def _stream_lines(keys: Sequence[str]):
    """The same fold over rows that arrive sorted by key and order; memory is one page's line bands."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tops, bottoms = None, np.empty(0), np.empty(0)
        for batch in batches:
            out = np.empty(len(batch), dtype=np.int32)
            row_keys = list(zip(*[batch[k] for k in keys]))
            for n, (here, y0, y1) in enumerate(zip(row_keys, batch["y0"].to_numpy(), batch["y1"].to_numpy())):
                if here != key:
                    key, tops, bottoms = here, np.empty(0), np.empty(0)
                heights = bottoms - tops
                away = np.abs(tops + heights / 2 - y0 - (y1 - y0) / 2)
                shared = np.maximum(0.0, np.minimum(bottoms, y1) - np.maximum(tops, y0))
                low = np.maximum(1.0, np.minimum(heights, y1 - y0))
                fits = (shared >= 0.12 * low) | (away <= np.maximum(10.0, 0.85 * np.maximum(heights, y1 - y0)))
                if fits.any():
                    line = int(np.argmin(np.where(fits, away, np.inf)))
                    tops[line], bottoms[line] = min(tops[line], y0), max(bottoms[line], y1)
                else:
                    line = len(tops)
                    tops, bottoms = np.append(tops, y0), np.append(bottoms, y1)
                out[n] = line
            yield batch.assign(line=out)

    return run


def text_lines(df: DataFrame, keys: Sequence[str] = ("page_id",), large: bool = False) -> DataFrame:
    """Rows with ``line``: the number, in order of creation, of the text line each box falls into.

    The rule is greedy and depends on the order (top, left, idx), so a page is folded in that order:
    a native fold for pages of a checked size, a sorted stream with bounded state for larger ones.
    """
    keys = list(keys)
    if large:
        schema = df.schema.simpleString()[len("struct<"):-1] + ",line:int"
        rows = df.repartition(*keys).sortWithinPartitions(*keys, "y0", "x0", "idx")
        return rows.mapInPandas(_stream_lines(keys), schema)
    rest = [c for c in df.columns if c not in keys and c not in ("y0", "x0", "idx")]
    lists = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("y0", "x0", "idx", *rest))).alias("items")
    )
    return (
        lists.withColumn("given", line_numbers(F.col("items")))
        .select(*keys, F.posexplode("items").alias("_n", "it"), "given")
        .select(*keys, "it.*", F.col("given")[F.col("_n")].alias("line"))
        .select(*df.columns, "line")
    )


def line_islands(df: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Rows with ``line`` by bands of touching boxes: a new line when the top is below all boxes before.

    Unlike ``text_lines`` this is independent of merge order, and runs blockwise on any page size.
    """
    rows, order, block = numbered(df, keys, ["y0", "x0", "idx"]), ["_pos"], position_block("_pos")
    seen = running(rows, keys, order, block, {"_low": ("max", F.col("y1"))}, inclusive=False)
    starts = seen.withColumn("_new", (F.col("_low").isNull() | (F.col("y0") > F.col("_low"))).cast("int"))
    return running(starts, keys, order, block, {"line": ("sum", F.col("_new"))}).select(*df.columns, "line")


def line_joined(df: DataFrame, keys: Sequence[str], large: bool = False) -> DataFrame:
    """Join the texts of numbered lines: keys, line, top, text.

    Inside a line texts go left to right. A blank separates two texts when their gap exceeds
    max(2.5, 0.22 x lower height) and neither starts with punctuation.
    """
    line_keys = [*keys, "line"]
    order = ["x0", "y0", "idx"]
    height = F.col("y1") - F.col("y0")
    before = F.struct(F.col("x1").alias("x1"), height.alias("h"), tight_join(F.col("content")).alias("tight"))
    if large:
        rows = running(
            numbered(df, line_keys, order), line_keys, ["_pos"], position_block("_pos"), {"prev": ("last", before)}, inclusive=False
        )
    else:
        rows = df.withColumn("prev", F.lag(before).over(Window.partitionBy(*line_keys).orderBy(*order)))
    low = F.greatest(F.lit(1.0), F.least(F.col("prev.h"), height))
    spaced = (
        (F.col("x0") - F.col("prev.x1") > F.greatest(F.lit(2.5), low * 0.22))
        & ~F.col("prev.tight") & ~tight_join(F.col("content"))
    )
    piece = F.concat(F.when(spaced, " ").otherwise(""), stripped(F.col("content")))
    return rows.withColumn("piece", piece).groupBy(*line_keys).agg(
        F.min("y0").alias("top"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(*order, "piece"))), lambda s: s["piece"]), ""
        ).alias("text"),
    )


def merged_content(df: DataFrame, keys: Sequence[str], separator: str, large: bool = False) -> DataFrame:
    """One text per key from the non-blank members: keys, content."""
    keys = list(keys)
    lines = line_joined(text_lines(df.filter(has_text(F.col("content"))), keys, large), keys, large)
    return lines.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("top", "line", "text"))), lambda s: s["text"]),
            separator,
        ).alias("content")
    )


# --- merging -----------------------------------------------------------------------------------

def merge_group(df: DataFrame, label: str = "label", *more: Column) -> DataFrame:
    """One row per (page, label): least index, joint bounds, Text if any member is, and more aggregates."""
    return df.groupBy("page_id", label).agg(
        F.min("idx").alias("idx"),
        F.when(F.bool_or(F.col("kind") == "Text"), "Text").otherwise("VectorPath").alias("kind"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), *more,
    )


BOX = ["page_id", "idx", "kind", *EDGES, "content"]


def merge_pass(df: DataFrame, rule: GroupRule, large: bool = False) -> DataFrame:
    """One full pass of a rule: pairs, components, joint bounds. Only a box alone on its page keeps its content."""
    own = F.max(F.when(F.col("_alone"), F.col("content"))).alias("content")
    return merge_group(_alone(group_labels(df, [rule], large), large), "label", own).select(*BOX)


def _alone(df: DataFrame, large: bool) -> DataFrame:
    """Rows with ``_alone``: whether the row is the only one of its page."""
    if large:
        counts = df.groupBy("page_id").agg((F.count(F.lit(1)) == 1).alias("_alone"))
        return join_null_safe(df, counts, ["page_id"])
    return df.withColumn("_alone", F.count(F.lit(1)).over(Window.partitionBy("page_id")) == 1)


def _with_merged_content(members: DataFrame, key: str, separator: str) -> DataFrame:
    """Merge members by (page, key); a box alone on its page keeps its content as it is."""
    flagged = written(_alone(members, large=True))
    keys = ["page_id", key]
    texts = merged_content(
        flagged.filter((F.col("kind") == "Text") & ~F.col("_alone")).drop("_alone", "line"), keys, separator, large=True
    )
    own = F.max(F.when(F.col("_alone"), F.col("content"))).alias("_kept")
    return (
        join_null_safe(merge_group(flagged, key, own), texts, keys, "left")
        .withColumn("content", F.coalesce("_kept", "content"))
        .select(*BOX)
    )


def _large_page_objects(df: DataFrame) -> DataFrame:
    # Each pass reads its input several times (both pair sides, members, texts): written once, read often.
    text, vector, image = split_by_kind(df)
    lines = _with_merged_content(text_lines(text, large=True).withColumnRenamed("line", "label"), "label", " ")
    primitives = written(merge_pass(vector, VECTOR_PRIMITIVES, large=True))
    blocks = merge_pass(primitives, VECTOR_BLOCKS, large=True)
    both = written(lines.unionByName(blocks))
    hover = _with_merged_content(group_labels(both, HOVER, large=True), "label", "\n")
    return hover.unionByName(image)


def merged_objects(df: DataFrame, large: bool = False) -> DataFrame:
    """Objects of clean boxes: text lines, vector blocks, then both grouped."""
    return _large_page_objects(df) if large else pages.page_objects(df).select(*BOX)


def page_objects(df: DataFrame, merge: bool = True, limit: int = PAGE_LIMIT) -> DataFrame:
    """Objects of every page: text lines, vector blocks, then both grouped. Boxes are written once, to count those of a page."""
    boxes = clean_boxes(df).select(*BOX)
    return by_page_size(checkpointed(boxes), merged_objects, limit) if merge else boxes
