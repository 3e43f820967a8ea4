"""Ordered computations per key that never sort a whole key in one task.

A plain window over a key puts all rows of the key into one task, which fails when one key holds a
large share of the table. The helpers here split each key into blocks of a coarse, monotone function
of the order: rows are sorted only inside a block, one small row per block is carried across blocks.
The rows are shuffled once, by (key, block); the windows inside blocks, the block summaries and the join
back all use that partitioning. Rows that come out of larger rows need not be shuffled at all: these are cut by block and
spread while they are whole, and the column of (key, block) is given in place of a block. Null keys and null orders are kept, as in a window: null keys are one key,
nulls come first.

Blocks of a position hold a bounded number of rows. Where only a time or a coordinate is known, ``numbered``
gives positions first, so that a million rows at one time are still cut into blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from pagelens.session import checkpointed, written

POSITION_BLOCK = 4096


def position_block(pos: str, size: int = POSITION_BLOCK) -> Column:
    """Block number of a non-negative integer position."""
    return F.floor(F.col(pos) / size)


def time_block(ts: str, seconds: int = 3600) -> Column:
    """Block number of a timestamp."""
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000))


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by equal names where null meets null, as in a window; the columns of ``on`` come from the left."""
    renamed = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [left[c].eqNullSafe(renamed[f"_on_{c}"]) for c in on]
    return left.join(renamed, same, how).drop(*[f"_on_{c}" for c in on])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "_pos") -> DataFrame:
    """Rows with increasing numbers along (keys, order), written once.

    Rows are sorted by ranges; a number is the row's place in its range, after all numbers of the ranges before. So
    blocks of numbers hold a bounded number of rows, however many share one key or one value of the order.
    """
    ranges = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return written(ranges.withColumn(out, F.monotonically_increasing_id()))


def blockwise(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | str,
    local: Mapping[str, Callable[[WindowSpec], Column]],
    totals: Mapping[str, Column],
    carry: Sequence[tuple[str, Callable[[WindowSpec], Column]]],
    result: Mapping[str, Column],
    reverse: Collection[str] = (),
) -> DataFrame:
    """One pass over ordered rows: values inside blocks, block summaries, and what earlier blocks carry into each.

    ``local`` are window columns over a block's rows, in order, each free to use those before; ``totals`` aggregate
    rows and local columns of a block; ``carry`` are window columns over the totals of a key's blocks, in turn;
    ``result`` combines local and carried columns. A block that is a name is a column of structs (keys, _blk) by which the
    rows have been spread. Names in ``reverse`` run from the end of the key. Windows have no
    frame; the helpers below add one.
    """
    columns, spread = df.columns, isinstance(block, str)
    part = block if spread else "_part"
    rows = df if spread else df.withColumn(part, F.struct(*keys, block.alias("_blk"))).repartition(part)

    def over(partition: str, columns: Sequence[str], name: str) -> WindowSpec:
        turn = [F.col(c).desc() if name in reverse else F.col(c).asc() for c in columns]
        return Window.partitionBy(partition).orderBy(*turn)

    for name, build in local.items():
        rows = rows.withColumn(name, build(over(part, order, name)))
    # Both sides name every column, so that they read the same shuffled rows and the input is computed once.
    hashable = not spread and all("map<" not in t for _, t in df.dtypes)
    named = F.max(F.hash(*columns)) if hashable else F.lit(0)
    blocks = rows.groupBy(part).agg(*[c.alias(n) for n, c in totals.items()], named.alias("_all"))
    blocks = blocks.withColumns({"_key": F.struct(*[F.col(part)[k].alias(k) for k in keys]), "_turn": F.col(part)["_blk"]})
    for name, build in carry:
        blocks = blocks.withColumn(name, build(over("_key", ["_turn"], name)))
    carried = blocks.filter("_all IS NOT NULL").select(part, *[n for n, _ in carry])
    # structs are equal if their fields are, null meeting null
    return rows.join(carried, part).select(*columns, *[c.alias(n) for n, c in result.items()])


def until_now(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def before_now(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def dense_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    levels: Sequence[Column],
    out: str,
) -> DataFrame:
    """0-based rank of each row inside its key, by ``order``.

    ``levels`` is a coarse prefix of the order: sorting by (levels, order) equals sorting by order.
    """
    return blockwise(
        df, keys, order, F.struct(*[c.alias(f"_lv{i}") for i, c in enumerate(levels)]),
        local={"_rn": lambda w: F.row_number().over(w)},
        totals={"_n": F.count(F.lit(1))},
        carry=[("_start", lambda w: F.sum("_n").over(before_now(w)))],
        result={out: F.coalesce("_start", F.lit(0)) + F.col("_rn") - 1},
    )


def crowded_keys(df: DataFrame, keys: Sequence[str], limit: int = POSITION_BLOCK) -> DataFrame | None:
    """Keys of more than ``limit`` rows, or None when there are none: a map-side combined count of the keys alone."""
    crowded = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys)
    return None if crowded.isEmpty() else checkpointed(crowded)


def position_by_size(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], levels: Sequence[Column], out: str, crowded: DataFrame | None
) -> DataFrame:
    """``dense_position`` by one window for all but the ``crowded`` keys (see ``crowded_keys``).

    A window moves rows once and leaves them placed by key. Levels that are nearly unique make a block of every row, and
    these are moved, grouped and joined again; only keys too large for one task need that.
    """
    def windowed(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn(out, place.cast("long") - 1)

    if crowded is None:
        return windowed(df)
    few, many = (join_null_safe(df, crowded, keys, how) for how in ("left_anti", "left_semi"))
    return windowed(few).unionByName(dense_position(many, keys, order, levels, out))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | str,
    outs: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
    reverse: bool | Collection[str] = False,
) -> DataFrame:
    """Running aggregates per key along ``order``.

    ``outs`` maps an output name to ``(kind, column)`` with kind one of sum, min, max, last. ``last``
    skips nulls. With ``inclusive=False`` the current row is left out; with ``reverse=True`` the run
    goes from the end of the key, or only that of the named outputs. ``block`` must not decrease along ``order``.
    """
    back = set(outs if reverse is True else reverse or ())
    frame = until_now if inclusive else before_now
    folds = {"sum": F.sum, "min": F.min, "max": F.max}
    at = F.struct(*order)
    rows = df.select("*", *[c.alias(f"_v_{n}") for n, (_, c) in outs.items()])
    local, totals, carry, result = {}, {}, [], {}
    for name, (kind, _) in outs.items():
        value, mine, total, held = F.col(f"_v_{name}"), f"_w_{name}", f"_t_{name}", f"_c_{name}"
        if kind == "last":
            pick = F.min_by if name in back else F.max_by
            local[mine] = lambda w, v=value: F.last(v, ignorenulls=True).over(frame(w))
            totals[total] = pick(value, F.when(value.isNotNull(), at))
            carry.append((held, lambda w, t=total: F.last(t, ignorenulls=True).over(before_now(w))))
            result[name] = F.coalesce(mine, held)
        else:
            fold = folds[kind]
            local[mine] = lambda w, v=value, fold=fold: fold(v).over(frame(w))
            totals[total] = fold(value)
            carry.append((held, lambda w, t=total, fold=fold: fold(t).over(before_now(w))))
            if kind == "sum":
                result[name] = F.coalesce(mine, F.lit(0)) + F.coalesce(held, F.lit(0))
            else:
                result[name] = (F.greatest if kind == "max" else F.least)(mine, held)
    turned = {f"_{kind}_{name}" for name in back for kind in "wc"}
    made = blockwise(rows, keys, order, block, local, totals, carry, result, turned)
    return made.select(*df.columns, *outs)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by ``order``: a map-side combined aggregate, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, "_row.*")


def ordered_text(
    df: DataFrame, keys: Sequence[str], pos: str, text: Column, out: str, separator: str = "", block: str | None = None
) -> DataFrame:
    """Concatenate ``text`` per key in the order of an integer position: block by block, then blocks.

    ``block`` names a column of structs (keys, _blk) by which the rows have been spread.
    """
    def joined(order: str, value: str) -> Column:
        parts = F.sort_array(F.collect_list(F.struct(order, value)))
        return F.array_join(F.transform(parts, lambda s: s[value]), separator)

    part = F.struct(*keys, position_block(pos).alias("_blk")) if block is None else F.col(block)
    pieces = df.select(part.alias("_at"), F.col(pos).alias("_pos"), text.alias("_text"))
    blocks = pieces.groupBy("_at").agg(joined("_pos", "_text").alias("_part")).select("_at.*", "_part")
    return blocks.groupBy(*keys).agg(joined("_blk", "_part").alias(out))
