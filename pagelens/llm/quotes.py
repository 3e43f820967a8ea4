"""Quotation linking: messages without quotes, in reply order.

Quote marks at the start of a line give its level; lines without marks (level 0) are a message's own text. Passages
are paragraphs of lines of one level. Their normalised text (marks off, spaces and line ends joined, A-Z lower-cased)
is hashed as a whole, by sentence and by line, so that a passage is found again when it was wrapped anew, and a part
of it as well. A passage of level n was taken from a message that holds it at level n - 1, so every level points at the
message that is replied to; where no message holds it so, it points at one that has it as its own text. It counts for
the first such message within the conversation and before the quoting turn, else for the first one of another
conversation. Of each passage the largest parts that are found count, and the message with most quoted characters is
the one replied to; on ties the one in the same conversation, then the earlier turn, then the lesser conv_id.

Originals are reduced to one row for each hash and conversation, and to two conversations for each hash, before the
joins, so a line that many messages hold does not multiply rows. Threads are found by pointer jumping over written
tables. A message without a linked quote in its conversation begins a thread; ordering a conversation by (thread_turn,
turn) puts every message after the one it replies to.

A null text is empty. Rows with a null conv_id or turn keep their text and get no link. Of rows with the same
conv_id and turn each is kept, and they share one link. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import fold_case, in_frames, table, whole
from pagelens.session import written

MARKS = re.compile(r"[ \t]*(?:>[ \t]?)+")
SENTENCE_END = re.compile(r"(?<=[.!?]) ")
SENTENCE_WORDS = 3  # at least, as a part of a passage
PARSED = (
    "conv_id long, turn long, role string, text string, n_quoted_lines long, max_level long, "
    "held array<struct<level:int,hash:long>>, quoted array<struct<level:int,passage:int,grain:int,hash:long,chars:int>>"
)


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(fold_case(text).encode("utf-8", "surrogatepass")) - (1 << 63)


def passages(lines: list[tuple[int, str]]) -> Iterator[tuple[int, list[str]]]:
    """Level and normalised lines of each paragraph."""
    level, held = 0, []
    for now, line in [*lines, (-1, "")]:
        line = " ".join(line.split())
        if held and (now != level or not line):
            yield level, held
            held = []
        level = now
        if line:
            held.append(line)


def parts(lines: list[str]) -> Iterator[tuple[int, str]]:
    """The passage (grain 0), its sentences (1) and its lines (2)."""
    whole_text = " ".join(lines)
    yield 0, whole_text
    sentences = SENTENCE_END.split(whole_text)
    if len(sentences) > 1:
        yield from ((1, s) for s in sentences if s.count(" ") + 1 >= SENTENCE_WORDS)
    if len(lines) > 1:
        yield from ((2, line) for line in lines)


def parse(text: str):
    """Own text, number of quoted lines, deepest level, hashes with their level, parts of quoted passages."""
    lines, n, deepest = [], 0, 0
    for line in text.split("\n"):
        mark = MARKS.match(line)
        level = mark[0].count(">") if mark else 0
        lines.append((level, line[mark.end() :] if mark else line))
        n, deepest = n + (level > 0), max(deepest, level)
    held, quoted = set(), []
    for number, (level, found) in enumerate(passages(lines)):
        for grain, part in parts(found):
            key = text_hash(part)
            held.add((level, key))
            if level:
                quoted.append({"level": level, "passage": number, "grain": grain, "hash": key, "chars": len(part)})
    own = "\n".join(line for level, line in lines if not level)
    own = own if not n else re.sub(r"\n{3,}", "\n\n", own).strip("\n")
    return own, n, deepest, [{"level": level, "hash": key} for level, key in sorted(held)], quoted


def parsed(messages: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [p.split()[0] for p in PARSED.split(", ")]
        for frame in frames:
            rows = [
                (conv, turn, role, *parse(whole(text)))
                for conv, turn, role, text in zip(*(frame[c].tolist() for c in ("conv_id", "turn", "role", "text")))
            ]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return in_frames(rows, run, PARSED)


def reply_links(found: DataFrame) -> DataFrame:
    """(conv_id, turn, to_conv, to_turn, chars): the message each quoting message replies to."""
    named = found.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quotes = named.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*")
    # where to look: one level up (0), else in a message's own text (1)
    places = F.when(F.col("level") == 1, F.array(F.struct(F.lit(0).alias("way"), F.lit(0).alias("at")))).otherwise(
        F.array(F.struct(F.lit(0).alias("way"), (F.col("level") - 1).alias("at")), F.struct(F.lit(1).alias("way"), F.lit(0).alias("at"))))
    looked = written(quotes.select("conv_id", "turn", "passage", "grain", "hash", "chars", F.inline(places)))
    held = named.select("conv_id", "turn", F.inline("held")).withColumnRenamed("level", "at")
    held = held.join(looked.select("hash", "at").distinct(), ["hash", "at"], "left_semi")
    here = written(held.groupBy("conv_id", "hash", "at").agg(F.min("turn").alias("here")))
    spot = F.struct(F.col("conv_id").alias("conv_id"), F.col("here").alias("turn"))
    first = written(here.groupBy("hash", "at").agg(F.min(spot).alias("first")))
    second = here.join(first, ["hash", "at"]).filter(F.col("conv_id") != F.col("first.conv_id")).groupBy("hash", "at").agg(
        F.min(spot).alias("second"))
    linked = looked.join(here, ["conv_id", "hash", "at"], "left").join(first, ["hash", "at"], "left").join(
        second, ["hash", "at"], "left")
    # the first of all may stand in the quoting conversation, at its turn or later
    target = F.when(F.col("here") < F.col("turn"), F.struct(F.col("conv_id").alias("conv_id"), F.col("here").alias("turn"))).when(
        F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    links = written(linked.withColumn("to", target).filter(F.col("to").isNotNull()).select(
        "conv_id", "turn", "passage", F.struct("way", "grain").alias("rank"), "to", "chars"))
    keys = ["conv_id", "turn", "passage"]
    best = links.groupBy(*keys).agg(F.min("rank").alias("rank"))
    votes = links.join(best, [*keys, "rank"]).groupBy("conv_id", "turn", "to").agg(F.sum("chars").alias("chars"))
    best = votes.groupBy("conv_id", "turn").agg(
        F.max(F.struct("chars", (F.col("to.conv_id") == F.col("conv_id")).alias("near"), (-F.col("to.turn")).alias("early"), (-F.col("to.conv_id")).alias("low"))).alias("b")
    )
    return best.select("conv_id", "turn", (-F.col("b.low")).alias("to_conv"), (-F.col("b.early")).alias("to_turn"), F.col("b.chars").alias("chars"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth) of messages that reply within their conversation."""
    up = written(links.filter("to_conv = conv_id").select("conv_id", "turn", F.col("to_turn").alias("thread_turn"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = up.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("_next"), F.col("depth").alias("_more"))
        jumped = written(
            up.join(above, ["conv_id", "thread_turn"], "left").select(
                "conv_id", "turn", F.coalesce("_next", "thread_turn").alias("thread_turn"),
                (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_next").isNotNull().alias("_moved"),
            )
        )
        up = jumped.drop("_moved")
        if jumped.filter("_moved").isEmpty():
            return up


def link_quotes(messages: DataFrame) -> DataFrame:
    """Every message without its quotes, what it replies to, and its place in the reply order."""
    found = written(parsed(messages))
    links = written(reply_links(found))
    placed = links.join(threads(links), ["conv_id", "turn"], "left")
    return found.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "n_quoted_lines", "max_level", F.col("to_conv").alias("reply_conv"),
        F.col("to_turn").alias("reply_turn"), F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return link_quotes(table(spark, folder, "conversations"))
