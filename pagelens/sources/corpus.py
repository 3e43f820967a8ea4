"""Reading whole files and cutting records, references and packed parts out of their text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.attrs import REFERENCE
from pagelens.operators.skew import ordered_text, position_block, running

HEAD = 512  # bytes


def latin1(content: Column) -> Column:
    """Bytes as text with one character per byte."""
    return F.decode(content, "ISO-8859-1")


def scan_corpus(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files: path, length, content (bytes) and text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", latin1(F.col("content")).alias("text"))


def _measured_splits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each split of a file: its bytes without line ends, its lines, and the first bytes of the file's first split."""
    names = ["path", "start", "bytes", "lines", "head"]
    held = None
    for batch in batches:
        for (path, start), rows in batch.groupby(["path", "start"], sort=False):
            if held is None or held[:2] != [path, start]:
                if held is not None:
                    yield pd.DataFrame([held], columns=names)
                held = [path, start, 0, 0, b""]
            held[2:4] = held[2] + int(rows["size"].sum()), held[3] + len(rows)
            if start == 0 and len(held[4]) < HEAD:
                held[4] = (held[4] + b"".join(bytes(line) + b"\n" for line in rows["line"].iloc[:HEAD]))[:HEAD]
    if held is not None:
        yield pd.DataFrame([held], columns=names)


def measure_corpus(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files with path, length, chars (of the Latin-1 text: the bytes that were read) and head, the first bytes.

    Files are read in splits, as lines cut at newline bytes only, so no task holds a whole file and a file may have any
    size; memory is that of the longest line. A newline is counted for each line, and a file that does not end with one
    has a byte less. The reader leaves out the three bytes of a leading byte order mark. File names must not end as those
    of compressed files do, which the reader would unpack. As in ``scan_corpus``, empty files give no row.
    """
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    files = reader.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), "length")
    start = F.col("_metadata.file_block_start")
    lines = reader.format("text").option("lineSep", "\n").load(path).select(
        F.col("_metadata.file_path").alias("path"), start.alias("start"), F.octet_length("value").alias("size"),
        F.when(start == 0, F.substring(F.col("value").cast("binary"), 1, HEAD)).alias("line"))
    splits = lines.mapInPandas(_measured_splits, "path string, start long, bytes long, lines long, head binary")
    read = splits.groupBy("path").agg(
        F.sum(F.col("bytes") + F.col("lines")).alias("_read"), F.max(F.when(F.col("start") == 0, F.col("head"))).alias("_head"))
    none = F.unhex(F.lit(""))
    count = F.coalesce("_read", F.lit(0).cast("long"))  # a file of a mark alone gives no line
    marked = count < F.col("length")
    mark = F.when(marked, F.unhex(F.lit("EFBBBF"))).otherwise(none)
    chars = F.least("length", count + F.when(marked, 3).otherwise(0))
    head = F.substr(F.concat(mark, F.coalesce("_head", none)), F.lit(1), F.least(F.lit(HEAD), "length").cast("int"))
    return files.join(read, "path", "left").select("path", "length", chars.alias("chars"), head.alias("head"))


def extract_records(df: DataFrame, keys: list[str], text: str, header: str, end: str) -> DataFrame:
    """Records (keys, pos, head, body): a header match starts one, its body runs to the next end marker.

    Bodies may contain later headers; a header with no end marker after it gives no record. The text is
    cut at end markers first, so a body is always the rest of one piece after the header, and the
    character offset is a running sum of piece lengths.
    """
    pieces = F.split(text, end, -1)
    marks = F.regexp_extract_all(text, F.lit(end), F.lit(0))
    rows = df.select(*keys, marks.alias("_marks"), F.posexplode(pieces).alias("_n", "_piece")).select(
        *keys, "_n", "_piece", F.length(F.get("_marks", F.col("_n"))).alias("_mark_len")
    )
    placed = running(
        rows, keys, ["_n"], position_block("_n"),
        {"_start": ("sum", F.length("_piece") + F.coalesce("_mark_len", F.lit(0)))}, inclusive=False,
    ).filter(F.col("_mark_len").isNotNull())
    heads = F.regexp_extract_all("_piece", F.lit(header), F.lit(0))
    found = placed.withColumns({"_heads": heads, "_gaps": F.split("_piece", header, -1)}).filter(F.size("_heads") > 0)
    each = found.select("*", F.posexplode("_heads").alias("_i", "head"))

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.length(p))

    at = total(F.slice("_gaps", F.lit(1), F.col("_i") + 1)) + total(F.slice("_heads", F.lit(1), F.col("_i")))
    return each.withColumn("_at", at).select(
        *keys, (F.col("_start") + F.col("_at")).alias("pos"), "head",
        F.substr("_piece", F.col("_at") + F.length("head") + 1).alias("body"),
    )


def extract_refs(df: DataFrame, keys: list[str], body: str, pattern: str = REFERENCE) -> DataFrame:
    """References of a body in order: keys, ord, role, target. Group 1 is the role, group 2 the target."""
    roles = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    targets = F.regexp_extract_all(body, F.lit(pattern), F.lit(2))
    return df.select(*keys, F.posexplode(F.arrays_zip(roles.alias("role"), targets.alias("target"))).alias("ord", "r")).select(
        *keys, "ord", F.when(F.col("r.role") != "", F.col("r.role")).alias("role"), F.col("r.target").alias("target")
    )


def unpack_container(df: DataFrame, keys: list[str], count: str, header: str, bodies: str) -> DataFrame:
    """Parts (keys, number, body) of containers with ``count`` (number, offset) pairs in ``header``.

    A part runs to the next offset, the last to the end. Empty or inverted parts are skipped, and whole
    containers whose pair list is too short.
    """
    values = F.transform(F.regexp_extract_all(header, F.lit(r"\d+"), F.lit(0)), lambda v: v.cast("int"))
    full = df.select(*keys, count, bodies, values.alias("_v")).filter(F.size("_v") >= F.col(count) * 2)
    parts = full.filter(F.col(count) > 0).select("*", F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias("_i"))
    at = F.get("_v", F.col("_i") * 2 + 1)
    nxt = F.when(F.col("_i") + 1 < F.col(count), F.get("_v", F.col("_i") * 2 + 3)).otherwise(F.length(bodies))
    return parts.select(*keys, bodies, F.get("_v", F.col("_i") * 2).alias("number"), at.alias("_at"), nxt.alias("_to")).filter(
        (F.col("_at") >= 0) & (F.col("_to") > F.col("_at")) & (F.col("_at") < F.length(bodies))
    ).select(*keys, "number", F.trim(F.substr(bodies, F.col("_at") + 1, F.col("_to") - F.col("_at"))).alias("body"))


def balanced_spans(tokens: DataFrame, keys: list[str], order: str, token: str, opener: str, closer: str) -> DataFrame:
    """Each opener with its matching closer, nesting aware: keys, start, stop, level; stop null if unclosed.

    Events of one nesting level alternate, so the match is the next event of the same level.
    """
    block = position_block(order)
    events = tokens.filter(F.col(token).isin(opener, closer)).withColumn("_open", F.col(token) == opener)
    step = F.when(F.col("_open"), 1).otherwise(-1)
    deep = running(events, keys, [order], block, {"_depth": ("sum", step)})
    level = F.when(F.col("_open"), F.col("_depth")).otherwise(F.col("_depth") + 1)
    leveled = deep.withColumn("level", level)
    following = running(
        leveled, [*keys, "level"], [order], block,
        {"_next": ("last", F.struct(F.col(order).alias("at"), F.col("_open").alias("open")))}, inclusive=False, reverse=True,
    )
    return following.filter("_open").select(
        *keys, F.col(order).alias("start"), F.when(~F.col("_next.open"), F.col("_next.at")).alias("stop"), "level"
    )


def concat_parts(owners: DataFrame, parts: DataFrame, key: str, ord: str, text: str) -> DataFrame:
    """Content of each owner: its parts in order, each followed by a newline; '' without parts."""
    joined = ordered_text(parts, [key], ord, F.concat(F.col(text), F.lit("\n")), "content")
    return owners.join(joined, key, "left").withColumn("content", F.coalesce("content", F.lit("")))
