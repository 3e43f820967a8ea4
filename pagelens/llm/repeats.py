"""Removal of repeated 400-byte strings by a parse at rolling-hash triggers and suffix sorting of a dictionary.

A position is a trigger when the rolling hash of the bytes there is the least among the next 256 positions
of some window. Every 400-byte window has exactly one trigger that its own bytes decide, so the windows of
one trigger form a phrase: its bytes, with the 399 that follow, and two occurrences of a window always fall
into phrases with the same bytes at the trigger. The parse is the list of phrase occurrences.

- Phrases that are equal as a whole, by hashes of 128 bits, repeat as a whole; this settles nearly all of a copied passage.
- Phrases that share their trigger bytes but differ form the dictionary. Its suffixes are sorted to a depth of
  400 bytes, and windows of different phrases that share a place in this order repeat.

Suffixes are only compared where the parse puts them together, so the order is never held in one task:
dictionary groups are dealt over tasks, large ones as pairs of blocks. Documents with equal texts have one
entry in the parse's spans. A null text is empty; texts under 400 bytes lose nothing; repeated rows repeat
each other. doc_id may be null or repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import in_frames, sorted_groups, table, whole
from pagelens.llm.jaccard import block_pairs
from pagelens.session import written

SPAN = 400
REACH = 256  # positions among which a trigger has the least hash
HASHED = 16  # bytes of the rolling hash
TRIGGER = SPAN - REACH + 1  # bytes from the trigger that every window of a phrase covers
PIECE = 1 << 22  # window starts handled at a time
BATCH = 1_000_000  # dictionary bytes sorted at a time

U = np.uint64
RUNS = "doc_id long, uid binary, start int, size int, anchor long, key binary"


def phrases(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(first window start, number of windows, trigger position) of all phrases, in order."""
    for base in range(0, max(0, len(data) - SPAN + 1), PIECE):
        part = data[base : base + PIECE + SPAN - 1]
        n = len(part) - HASHED + 1
        eight = np.ndarray(len(part) - 7, "<u8", buffer=part, strides=(1,))
        value = eight[:n] * U(0x9E3779B97F4A7C15) + eight[8 : n + 8] * U(0xC2B2AE3D27D4EB4F)
        value ^= value >> U(29)
        value *= U(0xBF58476D1CE4E5B9)
        # the position below the hash: of equal hashes the leftmost is least
        least = ((value >> U(24)) << U(24)) | np.arange(n, dtype=U)
        step = 1
        while step < REACH:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        trigger = (least[: len(part) - SPAN + 1] & U(0xFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
        sizes = np.diff(np.append(starts, len(trigger)))
        yield from zip((starts + base).tolist(), sizes.tolist(), (trigger[starts] + base).tolist())


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def parse(texts: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, key = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        names = [c.split()[0] for c in RUNS.split(", ")]
        for frame in frames:
            rows: list[tuple] = []
            for doc_id, uid, text in zip(frame["doc_id"].tolist(), frame["uid"].tolist(), frame["text"]):
                data = text.encode("utf-8", "surrogatepass")
                view = memoryview(data)
                for start, size, at in phrases(data):
                    rows.append((
                        doc_id, uid, start, size, signed(anchor(view[at : at + TRIGGER])),
                        key(view[start : start + size + SPAN - 1]),
                    ))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": object})
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": object})

    return in_frames(texts.select("doc_id", "uid", "text"), run, RUNS)


def window_places(data: bytes, windows: np.ndarray) -> np.ndarray:
    """The place of each window (by its start in the joined dictionary) in the order by its 400 bytes.

    Equal places mean equal bytes. All suffixes are ranked to a depth of 8, 24, 72 and 216 bytes, each from
    three ranks of the depth before; the windows come from two ranks of 216.
    """
    eight = np.ndarray(len(data), ">u8", buffer=data + bytes(7), strides=(1,)).astype(U)
    rank = np.unique(eight, return_inverse=True)[1]
    for depth in (8, 24, 72):
        rank = np.unique(_shifted(rank, depth, 3), return_inverse=True)[1]
    pair = rank[windows] * (int(rank.max()) + 1) + rank[windows + SPAN - 216]
    return np.unique(pair, return_inverse=True)[1]


def _shifted(rank: np.ndarray, step: int, times: int) -> np.ndarray:
    """One number for the ranks at a position and at the steps after it, in their order."""
    code, wide = rank, int(rank.max()) + 1
    for k in range(1, times):
        if int(code.max()) >= (1 << 62) // (wide + 1):
            code = np.unique(code, return_inverse=True)[1]
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - k * step)] = rank[k * step :] + 1
        code = code * (wide + 1) + after
    return code


def dictionary_repeats(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Window ranges (offsets in the phrase, end exclusive) that other phrases of the batch hold as well."""
    held, size = [], 0
    for part in sorted_groups(frames, ["anchor", "_lo", "_hi"]):
        held.append(part)
        size += part["bytes"].map(len).sum()
        if size > BATCH:
            yield _repeats(pd.concat(held))
            held, size = [], 0
    if held:
        yield _repeats(pd.concat(held))


def _repeats(group: pd.DataFrame) -> pd.DataFrame:
    group = group.drop_duplicates(["anchor", "key"]).reset_index(drop=True)
    lengths = group["bytes"].map(len).to_numpy()
    n = lengths - SPAN + 1
    first = np.cumsum(lengths) - lengths
    phrase = np.repeat(np.arange(len(group)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = window_places(b"".join(group["bytes"]), first[phrase] + offset)
    again = np.bincount(place)[place] > 1  # one trigger, one offset: never twice in a phrase
    at = np.flatnonzero(again)
    if not len(at):
        return pd.DataFrame({"anchor": [], "key": [], "low": [], "high": []}).astype({"anchor": "int64", "low": "int64", "high": "int64"})
    cut = (phrase[at][1:] != phrase[at][:-1]) | (offset[at][1:] != offset[at][:-1] + 1)
    starts = np.flatnonzero(np.concatenate([[True], cut]))
    ends = np.append(starts[1:], len(at)) - 1
    who = phrase[at][starts]
    return pd.DataFrame({
        "anchor": group["anchor"].to_numpy()[who], "key": group["key"].to_numpy()[who],
        "low": offset[at][starts], "high": offset[at][ends] + 1,
    })


def find_repeats(texts: DataFrame) -> DataFrame:
    """(uid, spans) for texts (doc_id, uid, text): byte spans covered by repeated strings, not yet merged."""
    runs = written(parse(texts))
    groups = written(
        runs.groupBy("anchor").agg(F.count("key").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        .filter("n > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("sure"))
    )
    repeated = written(runs.join(groups, "anchor"))
    mixed = repeated.filter("not sure").drop("sure")
    classes = written(
        mixed.groupBy("anchor", "key").agg(F.count("uid").alias("n"), F.min(F.struct("doc_id", "uid", "start", "size")).alias("r"))
    )
    counted = written(classes.groupBy("anchor").agg(F.count("key").alias("m")))
    wanted = classes.join(counted, "anchor").groupBy(F.col("r.doc_id").alias("_doc"), F.col("r.uid").alias("_uid")).agg(
        F.collect_list(F.struct("anchor", "key", "m", "r.start", "r.size")).alias("wanted")
    )

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, wanted in zip(frame["text"], frame["wanted"]):
                data = text.encode("utf-8", "surrogatepass")
                rows += [
                    (w["anchor"], w["key"], w["m"], data[w["start"] : w["start"] + w["size"] + SPAN - 1]) for w in wanted
                ]
            yield pd.DataFrame(rows, columns=["anchor", "key", "m", "bytes"])

    chosen = texts.join(
        wanted, (texts["uid"] == wanted["_uid"]) & texts["doc_id"].eqNullSafe(wanted["_doc"])
    ).select("text", "wanted")
    dictionary = chosen.mapInPandas(cut, "anchor long, key binary, m long, bytes binary")
    ranges = block_pairs(dictionary, "anchor", "m").mapInPandas(
        dictionary_repeats, "anchor long, key binary, low long, high long"
    )
    # a phrase that occurs more than once repeats as a whole
    ranges = written(ranges.unionByName(
        classes.filter("n > 1").select("anchor", "key", F.lit(0).cast("long").alias("low"), F.col("r.size").cast("long").alias("high"))
    ))
    sure = repeated.filter("sure").select("uid", F.col("start").alias("a"), (F.col("start") + F.col("size") - 1 + SPAN).alias("b"))
    rest = mixed.join(ranges, ["anchor", "key"]).select(
        "uid", (F.col("start") + F.col("low")).cast("int").alias("a"), (F.col("start") + F.col("high") - 1 + SPAN).cast("int").alias("b")
    )
    # the spans of one text, however often it occurs
    return sure.unionByName(rest).groupBy("uid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """For every document the merged removals and the bytes that are left."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("uid"), text.alias("text"))
    spans = written(find_repeats(texts)).withColumnRenamed("uid", "_uid")
    joined = texts.join(spans, texts["uid"] == spans["_uid"], "left").select("doc_id", "text", "spans")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text, spans in zip(frame["doc_id"].tolist(), frame["text"], frame["spans"]):
                data = whole(text).encode("utf-8", "surrogatepass")
                gone = merged(spans) if spans is not None else []
                parts, at = [], 0
                for a, b in gone:
                    parts.append(data[at:a])
                    at = b
                kept = b"".join(parts) + data[at:]
                rows.append((
                    doc_id, len(data), len(data) - len(kept), len(gone),
                    hashlib.sha256(kept).hexdigest(), kept,
                ))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")], dtype=object)

    return in_frames(joined, cut, RESULT)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).drop("kept")
