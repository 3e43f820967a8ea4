"""Grouping the boxes of a page while the page is one row, for pages of a checked size.

The boxes of a page are an array of structs, so lines, pairs, components and texts of all passes are found where the page
lies: boxes are moved once, by page, and nothing is joined or written in between. Pairs are rows, since generated code tests
the long conditions of rules; they stay on the page's task. The forms of ``blocks`` for larger pages give the same result.
Inside arrays a value that is read more than once is bound by ``let``; a named column could be computed again for each
element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.geom import Rect, all_of, any_of, at_least, overlap
from pagelens.functions.rules import (
    HOVER,
    VECTOR_BLOCKS,
    VECTOR_PRIMITIVES,
    GroupRule,
    shape_measures,
    stripped,
    text_measures,
    tight_start,
)

EDGES = ["x0", "y0", "x1", "y1"]
ITEM = ["idx", "kind", *EDGES, "content"]
TEXT = ["body", "formula", "short"]  # the stripped content and its classes


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _rect(box: Column) -> Rect:
    return Rect(*[box[c] for c in EDGES])


def _of(items: Column, name: str) -> Column:
    return F.transform(items, lambda b: b[name])


def _sorted_by(items: Column, *order: str) -> Column:
    keyed = F.sort_array(F.transform(items, lambda b: F.struct(*[b[c].alias(c) for c in order], b.alias("box"))))
    return _of(keyed, "box")


# --- text lines --------------------------------------------------------------------------------

_NO_LINES = "named_struct('bands', cast(array() as array<struct<y0:double,y1:double>>), 'given', cast(array() as array<int>))"


def line_numbers(items: Column) -> Column:
    """The line of each item, for items in the order (top, left, idx).

    State: the bands (y0, y1) of the lines so far and the line number given to each item. An item joins the line with
    the nearest centre among those that accept it, the earliest on ties, and the line grows.
    """
    def place(state: Column, item: Column) -> Column:
        def accepting(band: Column, i: Column) -> Column:
            height, own = band["y1"] - band["y0"], item["y1"] - item["y0"]
            away = F.abs(band["y0"] + height / 2 - item["y0"] - own / 2)
            low, high = at_least(1.0, F.least(height, own)), F.greatest(height, own)
            shared = overlap(band["y0"], band["y1"], item["y0"], item["y1"])
            fits = (shared >= low * 0.12) | (away <= at_least(10.0, high * 0.85))
            return F.when(fits, F.struct(away.alias("d"), i.alias("i")))

        def grown(best: Column) -> Column:
            def grow(band: Column, i: Column) -> Column:
                wider = F.struct(F.least(band["y0"], item["y0"]).alias("y0"), F.greatest(band["y1"], item["y1"]).alias("y1"))
                return F.when(i == best["i"], wider).otherwise(band)

            def put(bands: Column, line: Column) -> Column:
                return F.struct(bands.alias("bands"), F.array_append(state["given"], line).alias("given"))

            alone = F.struct(item["y0"].alias("y0"), item["y1"].alias("y1"))
            return F.when(best.isNull(), put(F.array_append(state["bands"], alone), F.size(state["bands"]))).otherwise(
                put(F.transform(state["bands"], grow), best["i"])
            )

        return let(F.array_min(F.transform(state["bands"], accepting)), grown)

    return F.aggregate(items, F.expr(_NO_LINES), place, lambda state: state["given"])


def _line_text(members: Column) -> Column:
    """The text of a line: as ``line_joined`` in ``blocks``."""
    start = F.expr("named_struct('text', '', 'x1', cast(null as double), 'h', cast(null as double), 'tight', false)")

    def join(line: Column, b: Column) -> Column:
        r, tight = _rect(b), tight_start(b["body"])
        low = F.greatest(F.lit(1.0), F.least(line["h"], r.h))
        spaced = (r.x0 - line["x1"] > F.greatest(F.lit(2.5), low * 0.22)) & ~line["tight"] & ~tight
        text = F.concat(line["text"], F.when(line["x1"].isNotNull() & spaced, " ").otherwise(""), b["body"])
        return F.struct(text.alias("text"), r.x1.alias("x1"), r.h.alias("h"), tight.alias("tight"))

    return F.aggregate(_sorted_by(members, "x0", "y0", "idx"), start, join, lambda line: line["text"])


def _groups(items: Column, given: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the items of each given number, in the order of first items."""
    def members(number: Column) -> Column:
        return let(F.filter(items, lambda _, i: given[i] == number), use)

    return F.transform(F.array_distinct(given), members)


def _text_of(members: Column, separator: str) -> Column:
    """One text from the texts of the members; null without any."""
    def line(own: Column) -> Column:
        return F.struct(F.array_min(_of(own, "y0")).alias("top"), own[0]["line"].alias("line"), _line_text(own).alias("text"))

    def lines(texts: Column) -> Column:
        def numbered(given: Column) -> Column:
            placed = F.transform(texts, lambda b, i: F.struct(given[i].alias("line"), *[b[c].alias(c) for c in ("idx", *EDGES, "body")]))
            return _groups(placed, given, line)

        joined = F.sort_array(let(line_numbers(texts), numbered))
        return F.array_join(_of(joined, "text"), separator)

    def text(texts: Column) -> Column:
        many = let(_sorted_by(texts, "y0", "x0", "idx"), lines)
        return F.when(F.size(texts) == 1, texts[0]["body"]).when(F.size(texts) > 1, many)

    return let(F.filter(members, lambda b: (b["kind"] == "Text") & (F.length(b["body"]) > 0)), text)


# --- components --------------------------------------------------------------------------------

def tested(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition holds, tested once its columns are made.

    A plain filter is moved into the join or below the projection that it reads. Its expressions are repeated there, and
    the loop over rows or pairs becomes too long to be compiled.
    """
    return df.select("*", F.explode(F.array(condition)).alias("_holds")).filter("_holds").drop("_holds")


def _wide(box: Rect, rules: Sequence[GroupRule]) -> Rect:
    """The area that any box joined to this one touches: a reach bounds its rule from either box."""
    x, y = (F.greatest(*far, F.lit(0.0)) for far in ([g.reach_x(box) for g in rules], [g.reach_y(box) for g in rules]))
    return box.inflate(x, y)


def _measured(box: str) -> Column:
    named = {c: F.col(f"{box}.{c}") for c in ("idx", "kind", *EDGES, "formula", "short")} | shape_measures(Rect.of(box))
    return F.explode(F.array(F.struct(*[value.alias(name) for name, value in named.items()]))).alias(f"_{box}")


def linked(pages: DataFrame, rules: Sequence[GroupRule]) -> DataFrame:
    """Pages with ``links``: the places (i, j) of boxes that a rule joins, for boxes in the order of their index.

    Every other column of a page goes with one row of it. Without a page number no rule joins; one box has one index.
    """
    rest = [c for c in pages.columns if c not in ("page_id", "boxes")]
    each = pages.select("*", F.posexplode_outer("boxes").alias("i", "b"))
    first = F.coalesce(F.col("i") == 0, F.lit(True))
    each = each.select(
        "page_id", "i", "b", F.coalesce(F.slice("boxes", F.lit(1), F.col("i")), F.slice("boxes", 1, 0)).alias("before"),
        *[F.when(first, F.col(c)).alias(c) for c in ("boxes", *rest)], F.struct(*_wide(Rect.of("b"), rules).columns()).alias("wide"),
    )
    pairs = each.select(*[c for c in each.columns if c != "before"], F.posexplode_outer("before").alias("j", "a"))
    alone, same = F.col("j").isNull(), F.equal_null("a.idx", "b.idx")
    a, wide = Rect.of("a"), Rect.of("wide")
    near = all_of(wide.y0 <= a.y1, a.y0 <= wide.y1, wide.x0 <= a.x1, a.x0 <= wide.x1)
    # every test is a step of its own, so that each is compiled: far pairs go first, then one rule after the other
    rows = tested(pairs, alone | near | same).withColumn("_sure", alone | same).drop("wide")
    rows = rows.select("*", _measured("a")).select("*", _measured("b"))
    turned = any_of(F.lit(False), *[
        (F.col("_a.kind") == rule.kinds[1]) & (F.col("_b.kind") == rule.kinds[0]) for rule in rules if len(rule.kinds) == 2
    ])
    ends = {"a": F.when(turned, F.col("_b")).otherwise(F.col("_a")), "b": F.when(turned, F.col("_a")).otherwise(F.col("_b"))}
    rows = rows.withColumns(ends).drop("_a", "_b")
    for n, rule in enumerate(rules):
        kinds = [F.col(f"{r}.kind") == kind for r, kind in zip("ab", (rule.kinds * 2)[:2])]
        holds = all_of(F.col("page_id").isNotNull(), *kinds, rule.holds("a", "b"))
        rows = rows.select("*", F.explode(F.array(F.coalesce(holds, F.lit(False)))).alias(f"_rule{n}"))
    joined = rows.filter(any_of(F.col("_sure"), *[F.col(f"_rule{n}") for n in range(len(rules))]))
    return joined.groupBy("page_id").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("boxes", *rest)],
        F.collect_list(F.when(~alone, F.struct("i", "j"))).alias("links"),
    )


def component_numbers(items: Column, links: Column) -> Column:
    """The first place of each item's component."""
    def join(labels: Column, link: Column) -> Column:
        def joined(ends: Column) -> Column:
            low, high = F.array_min(ends), F.array_max(ends)
            return F.when(low == high, labels).otherwise(
                F.transform(labels, lambda label: F.when(label == high, low).otherwise(label))
            )

        return let(F.array(labels[link["i"]], labels[link["j"]]), joined)

    return F.aggregate(links, F.transform(items, lambda _, i: i), join)


# --- merging -----------------------------------------------------------------------------------

def merge(items: Column, given: Column, separator: str | None, classed: bool = True) -> Column:
    """One box for the items of each number, with the classes of its text; a box alone on its page keeps its content."""
    def merged(members: Column) -> Column:
        edges = {e: (F.array_min if e in ("x0", "y0") else F.array_max)(_of(members, e)) for e in EDGES}
        kind = F.when(F.exists(members, lambda b: b["kind"] == "Text"), "Text").otherwise("VectorPath")
        joint = {"idx": F.array_min(_of(members, "idx")), "kind": kind, **edges}

        def box(content: Column, more: dict[str, Column]) -> Column:
            return F.struct(*[value.alias(name) for name, value in (joint | {"content": content} | more).items()])

        text = F.lit(None).cast("string") if separator is None else _text_of(members, separator)
        content = F.when(F.size(items) == 1, items[0]["content"]).otherwise(text)
        if not classed:
            return box(content, {})
        return let(content, lambda c: let(stripped(c), lambda body: box(c, {"body": body} | text_measures(body))))

    return _groups(items, given, merged)


def text_lines_merged(texts: Column) -> Column:
    """Text boxes joined into lines."""
    return let(
        _sorted_by(texts, "y0", "x0", "idx"),
        lambda items: let(line_numbers(items), lambda given: merge(items, given, " ")),
    )


def grouped(pages: DataFrame, rules: Sequence[GroupRule], separator: str | None = None, classed: bool = True) -> DataFrame:
    """One full pass of rules over ``boxes``: pairs, components, joint bounds, and joint texts where a separator is given."""
    found = linked(pages.withColumn("boxes", F.sort_array("boxes")), rules)

    def merged(items: Column) -> Column:
        return let(component_numbers(items, F.col("links")), lambda given: merge(items, given, separator, classed))

    return found.withColumn("boxes", let(F.col("boxes"), merged)).drop("links")


def page_objects(df: DataFrame) -> DataFrame:
    """Objects of every page: text lines, vector blocks, then both grouped; images as they are."""
    def of_kind(kind: str) -> Column:
        return F.filter("boxes", lambda b: b["kind"] == kind)

    rows = df.withColumn("body", stripped(F.col("content"))).withColumns(text_measures(F.col("body")))
    pages = rows.groupBy("page_id").agg(F.collect_list(F.struct(*ITEM, *TEXT)).alias("boxes")).select(
        "page_id", of_kind("VectorPath").alias("boxes"), of_kind("Text").alias("texts"),
        F.transform(of_kind("Image"), lambda b: F.struct(*[b[c].alias(c) for c in ITEM])).alias("images"),
    )
    blocks = grouped(grouped(pages, [VECTOR_PRIMITIVES]), [VECTOR_BLOCKS])
    both = F.concat(text_lines_merged(F.col("texts")), F.col("boxes"))
    hover = grouped(blocks.select("page_id", both.alias("boxes"), "images"), HOVER, "\n", classed=False)
    objects = hover.select("page_id", F.concat("boxes", "images").alias("objects"))
    # no page is empty; for a plain ``inline`` Spark would test that first, by making the objects twice
    return objects.select("page_id", F.inline_outer("objects"))
