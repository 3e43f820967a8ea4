"""Shape classifiers and pairwise grouping rules as Column expressions.

Every rule comes with a *reach*: how far apart two boxes can be for the rule to hold, as a function of
either box alone. Limits in the rules grow with the lower height (or width) of the pair, so the own
height of one box bounds them. Reaches let candidate pairs be found on a grid without losing any.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.geom import (
    Measured,
    Pair,
    Rect,
    all_of,
    any_of,
    at_least,
    clamp,
    field,
    gap_is_zero,
    overlap,
)

# All numbers in the classifiers and merge rules below.
# Fixed value: characters that mark a formula.
FORMULA_MARKERS = "=+-/*()[]{}<>^_|Δ∑Σ√∫≈≤≥·×÷ρβθαπµΩ∂ƒ∇∝∞≠±∈∉∪∩"
# Fixed value: a first character that is joined without a blank (any punctuation or one of these).
TIGHT_START = r"^[\p{P}+=^]"
_EDGE_BLANKS = r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$"


def stripped(text: Column) -> Column:
    """Text without leading and trailing Unicode blanks."""
    return F.regexp_replace(text, _EDGE_BLANKS, "")


def has_text(text: Column) -> Column:
    return F.coalesce(F.length(stripped(text)) > 0, F.lit(False))


def tight_start(body: Column) -> Column:
    """Whether a stripped text is joined to its neighbours without a blank."""
    return F.coalesce(F.regexp_like(body, F.lit(TIGHT_START)), F.lit(False))


def tight_join(text: Column) -> Column:
    return tight_start(stripped(text))


def formula_body(body: Column) -> Column:
    """Whether a stripped text has at most 80 characters with formula markers, judged with the digit and letter counts."""
    rest = F.translate(body, FORMULA_MARKERS, "")
    marks = F.length(body) - F.length(rest)
    digits = F.regexp_count(rest, F.lit(r"\p{Nd}"))
    letters = F.regexp_count(rest, F.lit(r"\p{L}"))
    rule = (marks >= 2) | ((marks >= 1) & ((digits >= 1) | ((letters <= 8) & (digits <= 8))))
    return F.coalesce(F.length(body).between(1, 80) & rule, F.lit(False))


def looks_formula(text: Column) -> Column:
    """At most 80 characters with formula markers, judged with the digit and letter counts."""
    return formula_body(stripped(text))


def is_thin(r: Rect) -> Column:
    return (F.least(r.w, r.h) <= 8) & (F.greatest(r.w, r.h) >= 18)


def looks_textlike(r: Rect) -> Column:
    """A vector shape with the proportions of a line or block of text."""
    aspect = F.greatest(r.w, r.h) / at_least(1.0, F.least(r.w, r.h))
    wide = (r.h <= 120) & (aspect >= 2.2) & (r.w <= 1500)
    block = (r.h <= 180) & (r.w <= 700) & (aspect >= 1.35)
    return (
        F.when((r.w <= 0) | (r.h <= 0), False)
        .when(r.h <= 6, r.w <= 260)
        .when((r.w <= 26) & (r.h <= 26), False)
        .otherwise(wide | block)
    )


def horizontally_contained(a: Rect, b: Rect) -> Column:
    """One spans the other when widened by 16 on both sides."""
    def spans(outer: Rect, inner: Rect) -> Column:
        return (outer.x0 - 16 <= inner.x0) & (outer.x1 + 16 >= inner.x1)

    return spans(a, b) | spans(b, a)


def text_inside_vector(text: Rect, vector: Rect) -> Column:
    frame = vector.inflate(36.0, 20.0)
    slack = frame.inflate(4.0, 12.0)
    return frame.contains(text.cx, text.cy) & all_of(
        text.x0 >= slack.x0, text.x1 <= slack.x1, text.y0 >= slack.y0, text.y1 <= slack.y1
    )


def same_line(a: Rect, b: Rect) -> Column:
    low = at_least(1.0, F.least(a.h, b.h))
    return (overlap(a.y0, a.y1, b.y0, b.y1) >= low * 0.12) | (
        F.abs(a.cy - b.cy) <= at_least(10.0, F.greatest(a.h, b.h) * 0.85)
    )


def merge_text_blocks(a: Rect, b: Rect) -> Column:
    p = Pair(a, b)
    low, u = p.low_h, p.union
    line = p.shares_y(low * 0.35) & p.x_within(at_least(26.0, low * 3.1))
    paragraph = all_of(
        p.y_within(at_least(18.0, low * 1.45)), u.w <= 1450, u.h <= 980,
        any_of(
            p.shares_x(p.low_w * 0.18),
            F.abs(a.x0 - b.x0) <= at_least(18.0, low * 1.15),
            F.abs(a.x1 - b.x1) <= at_least(26.0, low * 1.55),
            horizontally_contained(a, b),
        ),
    )
    compact = (p.high_w <= 900) & (p.high_h <= 220)
    centred = all_of(
        p.y_within(at_least(20.0, low * 1.35)),
        F.abs(a.cx - b.cx) <= at_least(90.0, p.low_w * 1.4),
        u.h <= at_least(300.0, p.high_h * 6), u.w <= 1100,
    )
    cluster = all_of(
        p.shares_x(p.low_w * 0.08), p.y_within(at_least(14.0, low * 1.05)),
        p.high_w <= p.high_h * 22, u.h <= at_least(260.0, p.high_h * 5),
    )
    return any_of(line, paragraph, compact & (centred | cluster))


def merge_vector_primitive(a: Rect, b: Rect) -> Column:
    p = Pair(a, b)
    low, u = p.low_h, p.union
    meets = gap_is_zero(a.x0, a.x1, b.x0, b.x1) & gap_is_zero(a.y0, a.y1, b.y0, b.y1)
    overlapping = all_of(meets, u.w <= p.high_w + 24, u.h <= p.high_h + 24)
    line = all_of(
        p.shares_y(low * 0.30), p.x_within(at_least(10.0, low * 1.6)), u.w <= 320,
        u.h <= at_least(90.0, p.high_h * 2.2),
    )
    stack = all_of(
        p.shares_x(p.low_w * 0.25), p.y_within(at_least(8.0, low * 1.1)), u.w <= 240, u.h <= 140
    )
    contact = all_of(
        a.inflate(clamp(low * 0.55, 2.0, 8.0)).intersects(b),
        u.w <= p.high_w + 36, u.h <= p.high_h + 36,
    )
    return any_of(overlapping, line, stack, contact)


def merge_textlike_vectors(a: Rect, b: Rect) -> Column:
    p = Pair(a, b)
    low, u = p.low_h, p.union
    line = all_of(
        p.shares_y(low * 0.32), p.x_within(at_least(12.0, low * 1.3)),
        u.w <= at_least(1400.0, p.high_w * 1.55), u.h <= at_least(120.0, p.high_h * 2.4),
    )
    centred = all_of(
        u.w <= 1200, u.h <= at_least(360.0, p.high_h * 7), p.y_within(at_least(24.0, low * 1.55)),
        F.abs(a.cx - b.cx) <= at_least(120.0, p.low_w * 1.9),
    )
    stacked = all_of(
        p.shares_x(p.low_w * 0.06), p.y_within(at_least(18.0, low * 1.35)), u.w <= 1350, u.h <= 900
    )
    return any_of(line, centred, stacked)


def merge_graphic_vectors(a: Rect, b: Rect) -> Column:
    p = Pair(a, b)
    near, u = at_least(18.0, p.low_h * 1.6), p.union
    cluster = all_of(
        u.w <= 980, u.h <= 980,
        any_of(
            p.shares_x(p.low_w * 0.12) & p.y_within(near),
            p.shares_y(p.low_h * 0.12) & p.x_within(near),
            p.x_within(10.0) & p.y_within(10.0),
        ),
    )
    contact = all_of(a.inflate(6.0).intersects(b), u.w <= p.high_w + 60, u.h <= p.high_h + 60)
    return cluster | contact


def merge_text_vector(text: Rect, vector: Rect, formula: Column, short: Column) -> Column:
    """``formula`` and ``short`` tell whether the text looks like a formula or is short."""
    p = Pair(text, vector)
    low, high, u = p.low_h, p.high_h, p.union
    extent = F.greatest(vector.w, vector.h)
    wordy = formula | short
    gate = all_of(
        ((text.w <= 900) & (text.h <= 220)) | formula, vector.w <= 950, vector.h <= 420,
        extent <= 420, u.w <= 1100, u.h <= 320,
    )
    inline = wordy & p.shares_y(low * 0.28) & p.x_within(at_least(18.0, low * 2.0))
    tall = u.h <= at_least(280.0, high * 6)
    stacked = all_of(
        wordy, tall, p.shares_x(p.low_w * 0.08), p.y_within(at_least(18.0, low * 1.35))
    )
    beside = at_least(12.0, low * 1.8)
    rule_line = is_thin(vector) & any_of(
        (text.x0 < vector.x1) & (vector.x0 < text.x1) & p.y_within(beside),
        (text.y0 < vector.y1) & (vector.y0 < text.y1) & p.x_within(beside),
    )
    wrapped = all_of(short, tall, text_inside_vector(text, vector))
    touching = any_of(
        all_of(
            u.h <= at_least(220.0, high * 5),
            text.inflate(at_least(4.0, low * 0.30)).intersects(vector),
        ),
        text.contains(vector.cx, vector.cy),
        vector.contains(text.cx, text.cy),
    )
    return gate & any_of(inline, stacked, rule_line, wrapped, wordy & (extent <= 320) & touching)


def shape_measures(r: Rect) -> dict[str, Column]:
    return {"w": r.w, "h": r.h, "cx": r.cx, "cy": r.cy, "textlike": looks_textlike(r)}


def text_measures(body: Column) -> dict[str, Column]:
    """The classes of a text that is stripped."""
    return {"formula": formula_body(body), "short": F.coalesce(F.length(body).between(1, 96), F.lit(False))}


def measured(df: DataFrame) -> DataFrame:
    """Boxes with the per-box inputs of the pair rules: measures, shape class and text class."""
    return df.withColumns(shape_measures(Rect.of()) | text_measures(stripped(F.col("content"))))


# A box of a pair: the alias of its row, or its struct.
Row = str | Column


def merge_vectors(a: Row, b: Row) -> Column:
    """Rule for two vector rows, chosen by their shape classes."""
    ra, rb = Measured(a), Measured(b)
    return F.when(
        field(a, "textlike") & field(b, "textlike"), merge_textlike_vectors(ra, rb)
    ).otherwise(merge_graphic_vectors(ra, rb))


def merge_text_with_vector(text: Row, vector: Row) -> Column:
    return merge_text_vector(Measured(text), Measured(vector), field(text, "formula"), field(text, "short"))


@dataclass(frozen=True)
class GroupRule:
    """A pair rule over two measured rows (their aliases or structs), and its reach from one box.

    With one ``kind`` (or none) the first row is the one with the lower index. With two kinds the first
    row is of the first kind, whatever the indexes.
    """

    holds: Callable[[Row, Row], Column]
    reach_x: Callable[[Rect], Column]
    reach_y: Callable[[Rect], Column]
    kinds: tuple[str, ...] = ()

    def left(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("kind") == self.kinds[0]) if self.kinds else df

    def right(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("kind") == self.kinds[-1]) if self.kinds else df

    def ordered(self, a: str, b: str) -> Column:
        if len(self.kinds) == 2:
            return F.lit(True)
        return F.col(f"{a}.idx") < F.col(f"{b}.idx")


def _of_rects(rule: Callable[[Rect, Rect], Column]) -> Callable[[Row, Row], Column]:
    return lambda a, b: rule(Measured(a), Measured(b))


def _h(r: Rect) -> Column:
    return at_least(1.0, r.h)


def _w(r: Rect) -> Column:
    return at_least(1.0, r.w)


TEXT_BLOCKS = GroupRule(
    _of_rects(merge_text_blocks),
    lambda r: F.greatest(F.lit(90.0), _h(r) * 3.1, _w(r) * 0.4),
    lambda r: at_least(20.0, _h(r) * 1.45),
    ("Text",),
)
VECTOR_PRIMITIVES = GroupRule(
    _of_rects(merge_vector_primitive),
    lambda r: at_least(10.0, _h(r) * 1.6),
    lambda r: at_least(8.0, _h(r) * 1.1),
)
TEXTLIKE_VECTORS = GroupRule(
    _of_rects(merge_textlike_vectors),
    lambda r: F.greatest(F.lit(120.0), _h(r) * 1.3, _w(r) * 0.9),
    lambda r: at_least(24.0, _h(r) * 1.55),
)
GRAPHIC_VECTORS = GroupRule(
    _of_rects(merge_graphic_vectors),
    lambda r: at_least(18.0, _h(r) * 1.6),
    lambda r: at_least(18.0, _h(r) * 1.6),
)
TEXT_VECTOR = GroupRule(
    merge_text_with_vector,
    lambda r: at_least(36.0, _h(r) * 2.0),
    lambda r: at_least(20.0, _h(r) * 1.8),
    ("Text", "VectorPath"),
)
# Both shape classes in one pass; blocks of different classes stay apart.
VECTOR_BLOCKS = GroupRule(
    lambda a, b: (field(a, "textlike") == field(b, "textlike")) & merge_vectors(a, b),
    lambda r: F.greatest(TEXTLIKE_VECTORS.reach_x(r), GRAPHIC_VECTORS.reach_x(r)),
    lambda r: F.greatest(TEXTLIKE_VECTORS.reach_y(r), GRAPHIC_VECTORS.reach_y(r)),
)
HOVER_VECTORS = GroupRule(merge_vectors, VECTOR_BLOCKS.reach_x, VECTOR_BLOCKS.reach_y, ("VectorPath",))
# One rule per pair of kinds; images never merge.
HOVER = (TEXT_BLOCKS, HOVER_VECTORS, TEXT_VECTOR)
