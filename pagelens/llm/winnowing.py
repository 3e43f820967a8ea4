"""Winnowed fingerprints of documents, in built-in expressions only.

A fingerprint is a choice of k-gram hashes: the least one of each window of neighbouring k-grams, the rightmost one on
ties, kept with its position. Two texts that share WINDOW + GRAM - 1 characters in a row share a hash, wherever they
stand. Hashes are polynomials over code points, modulo a prime; those of 2, 4, ... characters are put together from
their halves, and window minima likewise, so that a text takes a few passes whatever the sizes.

A text shorter than a k-gram is one gram, an empty or null text has no fingerprint. Documents are taken in ascending
id, null ids first, those of one id in the order of a hash of their text; the last one is followed by the first. Rows
that are equal in id and text are followed by each other, and all but one of them are their own next document. An empty
table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm.common import table
from pagelens.session import written

GRAM = 16  # code points, a power of two
WINDOW = 16  # grams, a power of two
PRIME = 2**31 - 1
BASE = 1_000_003
BITS = 31  # of a hash and of a position
LAST = (1 << BITS) - 1
BLOCK_BITS = 8  # of the number of documents in a block


def _halves(size: int) -> list[int]:
    return [1 << k for k in range(size.bit_length() - 1)]


def with_grams(df: DataFrame, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """For each text column, with the position of its first character, a column of its grams.

    A gram is hash << BITS | (LAST - position), so that the least one is rightmost among equal hashes.
    """
    now = df.withColumns({
        out: F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long")))
        .otherwise(F.array().cast("array<long>"))
        for text, (out, _) in columns.items()
    }).withColumns({f"_at_{out}": first for out, first in columns.values()}).drop(*columns)
    outs = [out for out, _ in columns.values()]
    rest = [c for c in now.columns if c not in outs]

    def each(build) -> DataFrame:
        return now.select(*rest, *[build(c).alias(c) for c in outs])

    # short texts keep their codes, as one gram
    now = each(lambda c: F.expr(
        f"named_struct('n', size({c}), 'h', if(size({c}) between 1 and {GRAM - 1}, "
        f"array(aggregate({c}, 0L, (h, x) -> (h * {BASE} + x) % {PRIME})), {c}))"))
    for half in _halves(GRAM):
        power = pow(BASE, half, PRIME)
        now = each(lambda c, half=half, power=power: F.expr(
            f"named_struct('n', {c}.n, 'h', if({c}.n < {GRAM}, {c}.h, zip_with({c}.h, slice({c}.h, {half + 1}, size({c}.h)), "
            f"(a, b) -> (a * {power} + b) % {PRIME})))"))
    now = each(lambda c: F.expr(
        f"transform(slice({c}.h, 1, if({c}.n = 0, 0, greatest(1, {c}.n - {GRAM - 1}))), "
        f"(h, i) -> shiftleft(h, {BITS}) | ({LAST} - _at_{c} - i))"))
    return now.drop(*[f"_at_{c}" for c in outs])


def with_minima(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces columns of grams by the least one of each window; fewer grams than a window are one window."""
    rest = [c for c in df.columns if c not in columns]
    now = df.withColumns({f"_n_{c}": F.size(c) for c in columns})
    counts = [f"_n_{c}" for c in columns]
    for half in _halves(WINDOW):
        # beyond the end the other side is null and least() leaves it out
        now = now.select(*rest, *counts, *[
            F.expr(f"zip_with({c}, slice({c}, {half + 1}, _n_{c}), (a, b) -> least(a, b))").alias(c) for c in columns])
    return now.select(*rest, *[
        F.expr(f"slice({c}, 1, if(_n_{c} = 0, 0, greatest(1, _n_{c} - {WINDOW - 1})))").alias(c) for c in columns])


def fingerprint(chosen: str) -> Column:
    """hash:position of each chosen gram, comma-joined."""
    return F.array_join(F.transform(chosen, lambda p: F.concat(
        F.shiftright(p, BITS).cast("string"), F.lit(":"), (F.lit(LAST) - p.bitwiseAND(F.lit(LAST))).cast("string"))), ",")


def hashes(chosen: str) -> Column:
    return F.array_distinct(F.transform(chosen, lambda p: F.shiftright(p, BITS)))


def likeness(one: str, other: str) -> Column:
    """Twice the shared hashes over all hashes of both; 1 for two texts without any."""
    total = F.size(one) + F.size(other)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(one, other)) / total)


def in_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with _block, _seq and _guest: each block holds neighbours in ascending order of the key.

    Its last row, marked as a guest, is the one that follows the block. Only keys and text hashes are sorted as a
    whole, by ranges; texts go to their key once and to their block once.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text")).withColumn(
        "_hash", F.xxhash64("_text"))
    keys = rows.select("_key", "_hash").distinct().repartitionByRange("_key", "_hash").sortWithinPartitions("_key", "_hash")
    # rows of a sorted partition are numbered one after another
    order = written(keys.withColumn("_seq", F.monotonically_increasing_id()))
    order = order.withColumn("_part", F.shiftright("_seq", 33))
    parts = order.groupBy("_part").agg(F.max("_seq").alias("_end"))  # one row for each partition of the sort
    turn = Window.orderBy("_part")
    ends = parts.select("_part", F.coalesce(F.lag("_end").over(turn), F.max("_end").over(
        turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before"))
    row = F.col("_seq") - F.shiftleft("_part", 33)
    block = F.shiftright("_seq", BLOCK_BITS)
    before = F.when(row > 0, block - 1).otherwise(F.shiftright("_before", BLOCK_BITS))
    spot = F.struct(block.alias("_block"), F.lit(False).alias("_guest"))
    guest = F.struct(before.alias("_block"), F.lit(True).alias("_guest"))
    spots = order.join(ends, "_part").select(
        F.col("_key").alias("_id"), F.col("_hash").alias("_of"), "_seq",
        F.when(row % (1 << BLOCK_BITS) == 0, F.array(spot, guest)).otherwise(F.array(spot)).alias("_spots"))
    same = rows["_key"].eqNullSafe(spots["_id"]) & (rows["_hash"] == spots["_of"])
    return rows.join(spots, same).select("_key", "_text", "_seq", F.inline("_spots"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next document's.

    The edited text ends in the first quarter of its length of the next document in place of its own last quarter.
    """
    following = Window.partitionBy("_block").orderBy("_guest", "_seq")
    pairs = in_blocks(docs, key, text).withColumn("_next", F.lead("_text").over(following))
    size = F.length("_text")
    cut = F.floor(size / 4).cast("int")
    edited = pairs.withColumn("_n", size).withColumn("_edited", F.concat(
        F.substring("_text", F.lit(1), size - cut), F.substring("_next", F.lit(1), cut)))
    # windows that end before the cut are those of the text; only the rest of the edited text is read
    edited = edited.withColumn("_from", F.greatest(F.lit(0), size - cut - (GRAM + WINDOW - 2))).select(
        "_key", "_block", "_guest", "_seq", "_text", F.expr("substring(_edited, _from + 1)").alias("_tail"), "_n", "_from",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("_sha"))
    grams = with_grams(edited, {"_text": ("_own", F.lit(0)), "_tail": ("_new", F.col("_from"))})
    minima = with_minima(grams, ["_own", "_new"])
    chosen = minima.select(
        "_key", "_block", "_guest", "_seq", "_n", "_sha", F.array_distinct("_own").alias("_own"),
        F.array_distinct(F.concat(F.slice("_own", F.lit(1), F.col("_from")), "_new")).alias("_new"))
    made = chosen.select(
        "_key", "_block", "_guest", "_seq", "_n", "_sha", fingerprint("_own").alias("_f"), fingerprint("_new").alias("_e"),
        hashes("_own").alias("_a"), hashes("_new").alias("_b"))
    ahead = made.withColumn("_c", F.lead("_a").over(following)).filter("NOT _guest")
    return ahead.select(
        F.col("_key").alias(key), F.col("_n").cast("long").alias("n_chars"), F.col("_sha").alias("edited_sha256"),
        F.col("_f").alias("fingerprint"), F.col("_e").alias("edited_fingerprint"),
        likeness("_a", "_b").alias("near_edited"), likeness("_a", "_c").alias("near_next"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))


_POWERS = [pow(BASE, k, PRIME) for k in range(GRAM)]
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), f AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (
    ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS follow FROM d
), e AS (
  SELECT doc_id, n, text, substr(text, 1, n - n // 4) || substr(follow, 1, n // 4) AS edited FROM f
), t AS (
  SELECT doc_id, 'a' AS side, text FROM e UNION ALL SELECT doc_id, 'b', edited FROM e
), c AS (
  SELECT doc_id, side, unnest(codes) AS c, generate_subscripts(codes, 1) AS pos, len(codes) AS n
  FROM (SELECT doc_id, side, [unicode(x)::BIGINT FOR x IN regexp_extract_all(text, '(?s).')] AS codes FROM t)
), h AS (
  SELECT doc_id, side, pos, greatest(1, n - 15) AS grams, CASE WHEN n < 16
    THEN sum(c * POWERS[(n - pos + 1)::INT]) OVER (PARTITION BY doc_id, side) % 2147483647
    ELSE (SUMS) % 2147483647 END AS h
  FROM c WINDOW line AS (PARTITION BY doc_id, side ORDER BY pos)
), p AS (
  SELECT doc_id, side, pos, grams, h::BIGINT * 2147483648 + 2147483648 - pos AS p FROM h WHERE pos <= grams
), m AS (
  SELECT doc_id, side, pos, grams, min(p) OVER (
    PARTITION BY doc_id, side ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS m FROM p
), u AS (
  SELECT DISTINCT doc_id, side, 2147483647 - m % 2147483648 AS pos, m // 2147483648 AS hash
  FROM m WHERE pos <= greatest(1, grams - 15)
), v AS (
  SELECT doc_id, side, string_agg(hash || ':' || pos, ',' ORDER BY pos) AS print, list(DISTINCT hash) AS hashes FROM u GROUP BY ALL
), w AS (
  SELECT t.doc_id, t.side, coalesce(hashes, []::BIGINT[]) AS hashes, coalesce(print, '') AS print
  FROM t LEFT JOIN v ON v.doc_id = t.doc_id AND v.side = t.side
), j AS (
  SELECT e.doc_id, n, edited, a.print AS one, b.print AS two, a.hashes AS x, b.hashes AS y,
    coalesce(lead(a.hashes) OVER (ORDER BY e.doc_id), first(a.hashes) OVER (
      ORDER BY e.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS z
  FROM e JOIN w a ON a.doc_id = e.doc_id AND a.side = 'a' JOIN w b ON b.doc_id = e.doc_id AND b.side = 'b'
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, one AS fingerprint, two AS edited_fingerprint,
  CASE WHEN len(x) + len(y) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) END AS near_edited,
  CASE WHEN len(x) + len(z) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(x, z)) / (len(x) + len(z)) END AS near_next
FROM j
""".replace("POWERS", str(_POWERS)).replace(
    "SUMS", " + ".join(f"lead(c, {k}, 0) OVER line * {_POWERS[GRAM - 1 - k]}" for k in range(GRAM)))
