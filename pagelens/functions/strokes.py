"""Text advances, stroke widths, coverage, dashes and colors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.geom import Rect, clamp, quad_bounds, rnd

EPS = 0.0001


def glyph_advance(
    width: Column, size: Column, char_space: Column, word_space: Column, scale: Column, is_space: Column
) -> tuple[Column, Column]:
    """Advance in text space, and the draw advance, which leaves the horizontal scale out."""
    plain = width / 1000 * size + char_space + F.when(is_space, word_space).otherwise(0.0)
    return plain * scale / 100, plain


def text_bounds(x: Column, y: Column, degrees: Column, scale_x: Column, left: Column, top: Column, w: Column, h: Column) -> Rect:
    """Bounds of a local text rectangle, stretched along x, turned and moved to its origin."""
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    corners = [
        (x + px * scale_x * cos - py * sin, y + px * scale_x * sin + py * cos)
        for px in (left, left + w) for py in (top, top + h)
    ]
    return quad_bounds([c[0] for c in corners], [c[1] for c in corners])


def stroke_width(width: Column, m: list[Column], zoom: Column) -> Column:
    """Pen width in pixels: 1 for a hairline, else at least 0.2 after the mean axis scale."""
    a, b, c, d = m[:4]
    scale = (F.sqrt(a * a + b * b) + F.sqrt(c * c + d * d)) * zoom / 2
    usable = F.when((scale > EPS) & (scale < float("inf")) & ~F.isnan(scale), scale).otherwise(zoom)
    return F.when(width <= EPS, 1.0).otherwise(F.greatest(F.lit(0.2), width * usable))


def thin_coverage(alpha: Column, width: Column) -> Column:
    return rnd(clamp(alpha * F.sqrt(clamp(width, 0.2, 1.0)), 24.0, 255.0)).cast("int")


def opacity(alpha: Column, share: Column) -> Column:
    return rnd(clamp(alpha * clamp(share, 0.0, 1.0), 0.0, 255.0)).cast("int")


def line_cap(code: Column) -> Column:
    return F.when(code == 1, "Round").when(code == 2, "Square").otherwise("Flat")


def line_join(code: Column) -> Column:
    return F.when(code == 1, "Round").when(code == 2, "Bevel").otherwise("Miter")


# Pairs (on, off) are folded in order. A dash without length adds its gap to the gap before it; a gap
# without length adds its dash to the next dash, and ends as the least gap after the last dash.
_DASH_FOLD = """
aggregate(
  sequence(0, size({d}) div 2 - 1),
  named_struct('out', cast(array() as array<double>), 'gap', 0D, 'dash', 0D),
  (s, i) -> transform(array(named_struct('on', {d}[2 * i] + s.dash, 'off', {d}[2 * i + 1], 'last', 2 * i + 2 >= size({d}))), p ->
    case when p.on <= 0.0001D then named_struct('out', s.out, 'gap', s.gap + p.off, 'dash', 0D)
         when p.off <= 0.0001D and not p.last then named_struct('out', s.out, 'gap', s.gap, 'dash', p.on)
         else named_struct(
           'out', concat(transform(s.out, (v, k) -> if(k = size(s.out) - 1, v + s.gap, v)),
                         array(p.on, if(p.off <= 0.0001D, 0.0001D, p.off))),
           'gap', if(size(s.out) >= 2, 0D, s.gap), 'dash', 0D) end)[0],
  s -> transform(s.out, (v, k) -> if(k = size(s.out) - 1, v + s.gap, v)))
"""


def normalise_dash(dash: str) -> Column:
    """Dash array column: absolute values, odd arrays doubled, empty dashes and gaps folded away."""
    absolute = f"transform({dash}, v -> abs(v))"
    even = f"if(size({dash}) % 2 = 1, concat({absolute}, {absolute}), {absolute})"
    bound = f"transform(array({even}), d -> {_DASH_FOLD.format(d='d')})[0]"
    return F.expr(f"if(size({dash}) = 0, {dash}, {bound})")


def _byte(value: Column) -> Column:
    return rnd(clamp(value, 0.0, 255.0)).cast("int")


def to_rgb(space: Column, comps: Column) -> Column:
    """Struct (r, g, b) of components in 0..1. Missing components take the one before, or 0 for CMYK."""
    def at(n: int, default: Column) -> Column:
        return F.coalesce(F.get(comps, F.lit(n)), default)

    zero = F.lit(0.0)
    first = at(0, zero)
    second = at(1, first)
    black = at(3, zero)

    def ink(n: int) -> Column:
        return _byte((1 - F.least(F.lit(1.0), at(n, zero) + black)) * 255)

    def rgb(r: Column, g: Column, b: Column) -> Column:
        return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))

    return (
        F.when(space == "DeviceGray", rgb(*[_byte(first * 255)] * 3))
        .when(space == "DeviceCMYK", rgb(ink(0), ink(1), ink(2)))
        .otherwise(rgb(_byte(first * 255), _byte(second * 255), _byte(at(2, second) * 255)))
    )


def luma_chroma_to_rgb(c0: Column, c1: Column, c2: Column, reversible: Column) -> tuple[Column, Column, Column]:
    """One luma and two chroma samples to red, green and blue, before the level shift."""
    y, u, v = (rnd(c).cast("int") for c in (c0, c1, c2))
    green = y - F.shiftright(u + v, 2)
    return (
        F.when(reversible, (v + green).cast("double")).otherwise(c0 + c2 * 1.402),
        F.when(reversible, green.cast("double")).otherwise(c0 - c1 * 0.34413 - c2 * 0.71414),
        F.when(reversible, (u + green).cast("double")).otherwise(c0 + c1 * 1.772),
    )


def sample_to_byte(value: Column, precision: int, signed: bool) -> Column:
    """Shift, clamp to the precision and rescale to 0..255."""
    top = (1 << precision) - 1
    shifted = value if signed else value + (1 << max(0, precision - 1))
    level = clamp(rnd(shifted), 0.0, float(top)).cast("int")
    return level if precision == 8 else F.floor((level * 255 + top // 2) / top).cast("int")


def is_supported(components: Column, transform: Column, style: Column, quantisation: Column, steps: Column) -> Column:
    """Whether a codestream is of the plain kind; ``steps`` lists the subsampling of its components."""
    return (
        components.isin(1, 3) & transform.isin(0, 1) & (style == 0) & quantisation.isin(0, 2)
        & F.forall(steps, lambda s: (s["x"] == 1) & (s["y"] == 1))
    )
