"""Running state along operator logs: pen positions, line origins, graphics state, matrices, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators.skew import before_now, blockwise, position_block, running, until_now

# Fixed value: the operator names of page content.
OPERATORS = (
    "q Q cm BT ET Tf Tm Td TD T* Tc Tw Tz TL Ts Tj TJ ' \" m l c v y h re S s f f* B B* b b* n "
    "w J j M d i ri gs G g CS cs SC sc SCN scn RG rg K k W W* Do"
).split()


def pen_positions(glyphs: DataFrame, keys: list[str], pos: str, advance: Column, block: str | None = None) -> DataFrame:
    """Adds ``x``: the sum of the advances before each glyph of its run.

    ``block`` names a column of structs (keys, _blk) by which the glyphs have been spread.
    """
    return running(glyphs, keys, [pos], block or position_block(pos), {"x": ("sum", advance)}, inclusive=False)


def apply_kerning(items: DataFrame, keys: list[str], pos: str, number: Column, advance: Column, size: float, scale: float, block: str | None = None) -> DataFrame:
    """Pen positions over array items: a number n moves back by n/1000 x size x scale, a text by its advance."""
    shift = F.when(number.isNotNull(), -number / 1000 * size * scale).otherwise(advance)
    return pen_positions(items, keys, pos, shift, block)


def line_origins(ops: DataFrame, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """Adds x and y, the line origin after each text operator (op, tx, ty).

    BT starts at 0, Tm at its operands; Td and TD move by them, and TD sets the leading to -ty as TL
    sets it to ty; T*, ' and " move down by the leading.
    """
    op = F.col("op")
    moves, next_line = op.isin("Td", "TD"), op.isin("T*", "'", '"')
    lead = F.when(op == "TD", -F.col("ty")).when(op == "TL", F.col("ty"))
    # Positions inside a block are a known part, and as many leadings of earlier blocks as lines came before the first
    # leading of the block.
    own = F.col("_lead").isNotNull()
    down = F.when(moves, F.col("ty")).when(next_line & own, -F.col("_lead")).otherwise(0.0)
    spot = F.when(op == "Tm", F.struct(F.col("tx").alias("x"), F.col("ty").alias("y"))).when(
        op == "BT", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    moved = F.struct((spot["x"] - F.col("_dx")).alias("x"), (spot["y"] - F.col("_dy")).alias("y"), (-F.col("_owed")).alias("owed"))
    here = F.struct(*order)

    def now(name: str) -> Column:
        return F.max_by(name, here)

    owed_lead = F.coalesce("_lead_in", F.lit(0.0))
    local = {
        "_lead": lambda w: F.last(lead, ignorenulls=True).over(until_now(w)),
        "_dx": lambda w: F.sum(F.when(moves, F.col("tx")).otherwise(0.0)).over(until_now(w)),
        "_dy": lambda w: F.sum(down).over(until_now(w)),
        "_owed": lambda w: F.sum(F.when(next_line & ~own, 1.0).otherwise(0.0)).over(until_now(w)),
        "_base": lambda w: F.last(F.when(spot.isNotNull(), moved), ignorenulls=True).over(until_now(w)),
    }
    totals = {"_lead_t": now("_lead"), "_dx_t": now("_dx"), "_dy_t": now("_dy"), "_owed_t": now("_owed"), "_base_t": now("_base")}
    based = F.when(F.col("_base_t").isNotNull(), F.struct(
        (F.col("_base_t.x") - F.coalesce("_dx_in", F.lit(0.0))).alias("x"),
        (F.col("_base_t.y") - F.col("_base_t.owed") * owed_lead - F.coalesce("_dy_in", F.lit(0.0))).alias("y")))
    carry = [
        ("_lead_in", lambda w: F.last("_lead_t", ignorenulls=True).over(before_now(w))),
        ("_dx_in", lambda w: F.sum("_dx_t").over(before_now(w))),
        ("_dy_in", lambda w: F.sum(F.col("_dy_t") - F.col("_owed_t") * owed_lead).over(before_now(w))),
        ("_base_in", lambda w: F.last(based, ignorenulls=True).over(before_now(w))),
    ]

    def placed(axis: str, inside: Column) -> Column:
        """From a base in the block, else from one in an earlier block, whose place is relative to the key's start."""
        earlier = F.coalesce(f"_d{axis}_in", F.lit(0.0)) + F.coalesce(f"_base_in.{axis}", F.lit(0.0))
        own_base = F.col(f"_base.{axis}")
        if axis == "y":
            own_base = own_base - F.col("_base.owed") * owed_lead
        return inside + F.when(F.col("_base").isNotNull(), own_base).otherwise(earlier)

    result = {"x": placed("x", F.col("_dx")), "y": placed("y", F.col("_dy") - F.col("_owed") * owed_lead)}
    return blockwise(ops, keys, order, block, local, totals, carry, result)


def nesting_depth(log: DataFrame, keys: list[str], order: list[str], block: Column, opens: Column, closes: Column) -> DataFrame:
    """Adds ``depth`` after each event, and ``real``: false for a close on an empty stack, which is ignored."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    zero = F.lit(0).cast("long")
    local = {
        "_sum": lambda w: F.sum(step).over(until_now(w)),
        "_low": lambda w: F.min("_sum").over(before_now(w)),
    }
    totals = {"_sum_t": F.sum(step), "_low_t": F.min("_sum")}
    before = F.coalesce("_sum_in", zero)
    carry = [
        ("_sum_in", lambda w: F.sum("_sum_t").over(before_now(w))),
        ("_low_in", lambda w: F.min(before + F.col("_low_t")).over(before_now(w))),
    ]
    at = before + F.col("_sum")
    floor = F.least(zero, F.col("_low_in"), before + F.col("_low"))
    result = {"real": ~(closes & (at < floor)), "depth": at - F.least(floor, at)}
    return blockwise(log, keys, order, block, local, totals, carry, result)


def state_asof(
    log: DataFrame, keys: list[str], order: str, opens: Column, closes: Column, sets: Column, reads: Column, value: Column
) -> DataFrame:
    """The value in force at each read: the last setter whose scope is still open, or null.

    A setter at nesting level L ends with the next close of that level. So a read at depth d looks up,
    for each level up to d, the last setter or close of that level, and takes the latest setter.
    """
    block = position_block(order)
    deep = nesting_depth(log, keys, [order], block, opens, closes).select(
        *keys, order, F.col("depth").cast("int").alias("depth"), sets.alias("_set"),
        (closes & F.col("real")).alias("_end"), reads.alias("_read"), value.alias("_value"))
    change = F.when(F.col("_set") | F.col("_end"), F.struct(
        F.col("_set").alias("set"), F.col(order).alias("at"), F.col("_value").alias("value")))
    at = F.array(F.col("depth") + F.col("_end").cast("int"))
    lookups = F.sequence(F.lit(0), F.col("depth"))
    # one row for each level that an event changes or looks up
    touched = deep.filter("_set OR _end OR _read").select(
        *keys, order, change.alias("change"), "_read",
        F.explode(F.when(F.col("_read"), F.array_union(lookups, F.when(F.col("_set") | F.col("_end"), at).otherwise(F.array().cast("array<int>")))).otherwise(at)).alias("level"),
        (F.col("depth") + F.col("_end").cast("int")).alias("_at"))
    touched = touched.withColumn("change", F.when(F.col("level") == F.col("_at"), F.col("change")))
    found = running(touched, [*keys, "level"], [order], block, {"seen": ("last", F.col("change"))}).filter("_read")
    alive = F.when(F.col("seen.set"), F.col("seen.at"))
    return found.groupBy(*keys, order).agg(F.max_by("seen.value", alive).alias("value"))


_MULTIPLY = """named_struct(
  'a', m.a * n.a + m.b * n.c, 'b', m.a * n.b + m.b * n.d, 'c', m.c * n.a + m.d * n.c, 'd', m.c * n.b + m.d * n.d,
  'e', m.e * n.a + m.f * n.c + n.e, 'f', m.e * n.b + m.f * n.d + n.f)"""
_IDENTITY = "named_struct('a', 1D, 'b', 0D, 'c', 0D, 'd', 1D, 'e', 0D, 'f', 0D)"


def compose_affine(log: DataFrame, keys: list[str], pos: str, matrix: Column, levels: int = 3) -> DataFrame:
    """Product of each key's matrices (struct a..f) by position, each new one put before the current.

    The product is associative: blocks of positions are multiplied first, then blocks of blocks, so no
    task folds more than a block of matrices (the last level has one per 4096^2 rows).
    """
    rows = log.select(*keys, F.col(pos).alias("_pos"), matrix.alias("matrix"))
    fold = f"aggregate(transform(_ms, s -> s.matrix), {_IDENTITY}, (n, m) -> {_MULTIPLY})"
    for level in range(levels):
        block = position_block("_pos") if level + 1 < levels else F.lit(0).cast("long")
        lists = rows.groupBy(*keys, block.alias("_blk")).agg(
            F.sort_array(F.collect_list(F.struct("_pos", "matrix"))).alias("_ms"))
        rows = lists.select(*keys, F.col("_blk").alias("_pos"), F.expr(fold).alias("matrix"))
    return rows.select(*keys, "matrix.*")


def path_bounds(ops: DataFrame, keys: list[str], order: list[str], block: Column, paint: Column, pen: float = 1.0) -> DataFrame:
    """Bounds of painted paths: keys, path, part, x0..y1.

    ``paint`` is null for a row with a point (px, py), else fill, stroke, both or none. The points since
    the last paint operator form a path. Fill and stroke give two parts; strokes are widened by half the
    pen; paths without extent are dropped.
    """
    counted = running(ops.withColumn("_paint", paint), keys, order, block, {"path": ("sum", F.col("_paint").isNotNull().cast("int"))}, inclusive=False)
    paths = counted.groupBy(*keys, "path").agg(
        F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"),
        F.max("_paint").alias("_paint"),
    ).filter("x0 IS NOT NULL AND _paint IS NOT NULL")
    parts = F.when(F.col("_paint") == "both", F.array(F.lit("fill"), F.lit("stroke"))).when(
        F.col("_paint") == "none", F.array().cast("array<string>")).otherwise(F.array("_paint"))
    pad = F.when(F.col("part") == "stroke", pen / 2).otherwise(0.0)
    grown = paths.withColumn("part", F.explode(parts)).select(
        *keys, "path", "part", (F.col("x0") - pad).alias("x0"), (F.col("y0") - pad).alias("y0"),
        (F.col("x1") + pad).alias("x1"), (F.col("y1") + pad).alias("y1"),
    )
    return grown.filter((F.col("x1") > F.col("x0")) | (F.col("y1") > F.col("y0")))


def operator_census(tokens: DataFrame, keys: list[str], token: str, vocabulary: tuple[str, ...] = tuple(OPERATORS)) -> DataFrame:
    """Count of each operator per key; all other tokens count as operands (op null)."""
    known = F.when(F.col(token).isin(*vocabulary), F.col(token))
    return tokens.groupBy(*keys, known.alias("op")).agg(F.count(F.lit(1)).alias("n"))
