"""Rectangle arithmetic as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value: Column) -> Column:
    """Round half to even."""
    return F.rint(value)


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(value, _lit(low)), _lit(high))


def at_least(floor: float, value: Column) -> Column:
    return F.greatest(F.lit(floor), value)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _lit(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


@dataclass(frozen=True)
class Rect:
    """Four edge columns; all members are Columns."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(alias: str = "") -> Rect:
        """Edges x0..y1 of a row, or of the row alias or struct ``alias``."""
        dot = f"{alias}." if alias else ""
        return Rect(*[F.col(dot + c) for c in ("x0", "y0", "x1", "y1")])

    @property
    def w(self) -> Column:
        return self.x1 - self.x0

    @property
    def h(self) -> Column:
        return self.y1 - self.y0

    @property
    def cx(self) -> Column:
        return self.x0 + self.w / 2

    @property
    def cy(self) -> Column:
        return self.y0 + self.h / 2

    @property
    def area(self) -> Column:
        return self.w * self.h

    def union(self, other: Rect) -> Rect:
        return Rect(
            F.least(self.x0, other.x0), F.least(self.y0, other.y0),
            F.greatest(self.x1, other.x1), F.greatest(self.y1, other.y1),
        )

    def inflate(self, dx: Column | float, dy: Column | float | None = None) -> Rect:
        dx, dy = _lit(dx), _lit(dx if dy is None else dy)
        return Rect(self.x0 - dx, self.y0 - dy, self.x1 + dx, self.y1 + dy)

    def intersects(self, other: Rect) -> Column:
        """Strict: touching edges do not intersect."""
        return all_of(
            self.x0 < other.x1, other.x0 < self.x1, self.y0 < other.y1, other.y0 < self.y1
        )

    def contains(self, x: Column, y: Column) -> Column:
        """Half open: the right and bottom edges are outside."""
        return all_of(self.x0 <= x, x < self.x1, self.y0 <= y, y < self.y1)

    def columns(self) -> list[Column]:
        return [self.x0.alias("x0"), self.y0.alias("y0"), self.x1.alias("x1"), self.y1.alias("y1")]


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length of two intervals, never negative."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Distance between two intervals. Not symmetric: when ``a`` ends exactly where ``b`` starts the
    result is ``a0 - b1``, which is negative."""
    return (
        F.when(overlap(a0, a1, b0, b1) > 0, F.lit(0.0)).when(a1 < b0, b0 - a1).otherwise(a0 - b1)
    )


def gap_within(a0: Column, a1: Column, b0: Column, b1: Column, limit: Column | float) -> Column:
    """``gap(a, b) <= limit`` for a limit of at least 0 and intervals with an extent."""
    return (b0 - a1 <= limit) & (a0 - b1 <= limit)


def gap_is_zero(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """``gap(a, b) = 0``: the intervals overlap, or ``b`` ends where ``a`` starts."""
    return (b0 < a1) & (a0 <= b1)


def field(row: str | Column, name: str) -> Column:
    """A column of a row alias, or a field of a struct."""
    return row[name] if isinstance(row, Column) else F.col(f"{row}.{name}")


class Measured(Rect):
    """A rectangle whose row (an alias or a struct) also carries its measures as columns w, h, cx and cy.

    Join conditions have no common subexpression elimination, so measures are computed once per box
    and not once per pair and use.
    """

    def __init__(self, row: str | Column):
        super().__init__(*[field(row, c) for c in ("x0", "y0", "x1", "y1")])
        object.__setattr__(self, "row", row)

    w = property(lambda self: field(self.row, "w"))
    h = property(lambda self: field(self.row, "h"))
    cx = property(lambda self: field(self.row, "cx"))
    cy = property(lambda self: field(self.row, "cy"))


@dataclass(frozen=True)
class Pair:
    """Measures of an ordered pair of rectangles used by the grouping rules."""

    a: Rect
    b: Rect

    def shares_x(self, least: Column) -> Column:
        """Horizontal overlap of at least ``least`` > 0."""
        return F.least(self.a.x1, self.b.x1) - F.greatest(self.a.x0, self.b.x0) >= least

    def shares_y(self, least: Column) -> Column:
        return F.least(self.a.y1, self.b.y1) - F.greatest(self.a.y0, self.b.y0) >= least

    def x_within(self, limit: Column | float) -> Column:
        """Horizontal gap of at most ``limit``."""
        return gap_within(self.a.x0, self.a.x1, self.b.x0, self.b.x1, limit)

    def y_within(self, limit: Column | float) -> Column:
        return gap_within(self.a.y0, self.a.y1, self.b.y0, self.b.y1, limit)

    @property
    def union(self) -> Rect:
        return self.a.union(self.b)

    @property
    def low_w(self) -> Column:
        return at_least(1.0, F.least(self.a.w, self.b.w))

    @property
    def low_h(self) -> Column:
        return at_least(1.0, F.least(self.a.h, self.b.h))

    @property
    def high_w(self) -> Column:
        return F.greatest(self.a.w, self.b.w)

    @property
    def high_h(self) -> Column:
        return F.greatest(self.a.h, self.b.h)


def quad_bounds(xs: list[Column], ys: list[Column]) -> Rect:
    """Bounds of a set of corner points."""
    return Rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def to_screen(x: Column, y: Column, m: list[Column], page_h: Column, zoom: Column) -> tuple[Column, Column]:
    """Affine map, then a flip of the y axis and a zoom."""
    a, b, c, d, e, f = m
    return (a * x + c * y + e) * zoom, (page_h - (b * x + d * y + f)) * zoom


def rect_path_bounds(
    x: Column, y: Column, w: Column, h: Column, m: list[Column], page_h: Column, zoom: Column
) -> Rect:
    """Screen bounds of a rectangle drawn under a matrix. The unit square gives image bounds."""
    corners = [to_screen(px, py, m, page_h, zoom) for px in (x, x + w) for py in (y, y + h)]
    return quad_bounds([p[0] for p in corners], [p[1] for p in corners])


def rotate_bounds(box: Rect, w: Column, h: Column, degrees: Column) -> Rect:
    """Bounds after turning the page image of size w x h clockwise by 0, 90, 180 or 270 degrees."""
    def pick(q90: Column, q180: Column, q270: Column, same: Column) -> Column:
        return F.when(degrees == 90, q90).when(degrees == 180, q180).when(degrees == 270, q270).otherwise(same)

    return Rect(
        pick(h - box.y1, w - box.x1, box.y0, box.x0),
        pick(box.x0, h - box.y1, w - box.x1, box.y0),
        pick(h - box.y0, w - box.x0, box.y1, box.x1),
        pick(box.x1, h - box.y0, w - box.x0, box.y1),
    )
