"""Similarity join on word shingles with Bayesian candidate pruning.

Texts with equal shingle sets form one class, so exact copies cost one row. MinHash bands give candidates;
in every pair the MinHash values are compared a few at a time, and the pair is dropped when the posterior
probability of reaching the threshold falls below a tolerance. What is left joins classes into candidate
groups; inside these all pairs are pruned the same way and the rest is verified on the whole shingle sets.

Groups are cut into blocks of bounded size, and tasks get pairs of blocks. Tasks return one row for each
member with its number of links and a representative, never the pairs. With 21 bands of three values a pair
at the threshold of 0.8 is missed with a chance of 3e-7; the four bounds of the pruning miss 6e-6 of such pairs.

Texts are compared by lower-cased (A-Z) words; one to four words are one shingle. Null texts and texts
without words link with nothing. Repeated rows are copies. The class id is the least doc_id; rows without a
doc_id take part, and a class that has no other rows has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import CASE_FOLD, components, in_frames, sorted_groups, table, whole
from pagelens.session import written

WORDS = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6  # least posterior probability for which a pair stays
HASHES, BANDS, PER_BAND = 64, 21, 3
STEP = 16  # MinHash values compared at a time
BLOCK = 256  # members in a block
SIGNATURE_BLOCK = 1024  # where members carry no more than their MinHash values
COLUMNS = 4096  # shingles of a verification step

U = np.uint64
_random = np.random.default_rng(7)
MULTIPLY = _random.integers(1, 2**63, HASHES, dtype=np.uint64) * U(2) + U(1)
ADD = _random.integers(0, 2**63, HASHES, dtype=np.uint64)
CHAIN = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit shingles. ``known`` keeps word hashes within a batch."""
    words = text.encode("utf-8", "surrogatepass").translate(CASE_FOLD).split()
    if not words:
        return np.zeros(0, U)
    codes = []
    for word in words:
        code = known.get(word)
        if code is None:
            code = known[word] = xxhash.xxh3_64_intdigest(word)
        codes.append(code)
    codes = np.array(codes, U)
    size = min(WORDS, len(codes))
    n = len(codes) - size + 1
    value = np.full(n, size, U)
    for k in range(size):
        value = mix(value * CHAIN + codes[k : k + n])
    return np.unique(value)


def signature(values: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(values), 2048):
        part = (values[at : at + 2048, None] * MULTIPLY + ADD) >> U(32)
        np.minimum(least, part.min(0).astype(np.uint32), out=least)
    return least


def digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


SETS = "doc_id long, uid long, key binary, size int, sig binary"


def read_sets(docs: DataFrame) -> DataFrame:
    """doc_id, key of the shingle set (null without words), its size and MinHash values."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known: dict[bytes, int] = {}
            rows = []
            for doc_id, uid, text in zip(frame["doc_id"].tolist(), frame["uid"].tolist(), frame["text"]):
                values = shingles(whole(text), known)
                if len(values):
                    rows.append((doc_id, uid, digest(values), len(values), signature(values).tobytes()))
                else:
                    rows.append((doc_id, uid, None, 0, None))
            yield pd.DataFrame(rows, columns=["doc_id", "uid", "key", "size", "sig"], dtype=object)

    return in_frames(docs.select("doc_id", F.xxhash64("text").alias("uid"), "text"), run, SETS)


@lru_cache(maxsize=4)
def least_equal(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number of compared values the least number of equal ones that keeps a pair.

    The posterior of the similarity under a uniform prior is a beta distribution; its tail beyond the
    threshold is a binomial sum.
    """
    out = []
    for n in range(HASHES + 1):
        keep = n + 1
        for m in range(n, -1, -1):
            # P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m)
            tail = sum(comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))
            if tail < tolerance:
                break
            keep = m
        out.append(keep)
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, same: bool):
    """Index pairs of two blocks that are neither too unlike in size nor pruned."""
    fits = np.minimum(sa[:, None], sb) >= THRESHOLD * np.maximum(sa[:, None], sb) - 1e-9
    i, j = np.nonzero(np.triu(fits, 1) if same else fits)
    equal = np.zeros(len(i), np.int64)
    bound = least_equal()
    for at in range(0, HASHES, STEP):
        if not len(i):
            break
        for part in range(0, len(i), 65536):
            s = slice(part, part + 65536)
            equal[s] += (a[i[s], at : at + STEP] == b[j[s], at : at + STEP]).sum(1)
        stay = equal >= bound[at + STEP]
        i, j, equal = i[stay], j[stay], equal[stay]
    return i, j


def block_pairs(members: DataFrame, group: str, count: str, block: int = BLOCK) -> DataFrame:
    """Every member once for each pair of blocks it belongs to; blocks hold about ``block`` members.

    Columns _lo and _hi name the pair of blocks, _side is 0 for members of _lo and 1 for those of _hi.
    """
    k = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64("key"), k).cast("int")
    placed = members.select("*", k.alias("_k"), own.alias("_own"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_other"))
    placed = placed.select(
        "*", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"),
        (F.col("_own") > F.col("_other")).cast("int").alias("_side"),
    ).drop("_k", "_own", "_other", count)
    keys = [group, "_lo", "_hi"]
    return placed.repartition(*keys).sortWithinPartitions(*keys)


def halves(part: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    same = part["_lo"].iloc[0] == part["_hi"].iloc[0]
    if same:
        part = part.sort_values("key")
        return part, part, True
    return part[part["_side"] == 0], part[part["_side"] == 1], False


def labelled(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), HASHES)


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, label) of the classes that have an unpruned candidate partner."""
    def banded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            sig = signatures(frame["sig"]).astype(U)
            for band in range(BANDS):
                value = np.full(len(frame), band + 1, U)
                for k in range(PER_BAND):
                    value = mix(value * CHAIN + sig[:, band * PER_BAND + k])
                yield pd.DataFrame({"band": value.view(np.int64), "no": band, "key": frame["key"]})

    bands = written(classes.select("key", "sig").mapInPandas(banded, "band long, no int, key binary"))
    sets = bands.groupBy("band", "no").agg(
        F.count("key").alias("m"), F.bit_xor(F.xxhash64("key")).alias("x"), F.min("key").alias("first")
    ).filter("m > 1")
    # bands that gather the same classes are compared once
    buckets = written(sets.groupBy("m", "x", "first").agg(F.min(F.struct("no", "band")).alias("b")).select("b.band", "m"))
    members = bands.join(buckets, "band").select("band", "m", "key")
    members = members.join(classes.select("key", "size", "sig"), "key")

    def forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sorted_groups(frames, ["band", "_lo", "_hi"]):
            a, b, same = halves(part)
            i, j = surviving(signatures(a["sig"]), signatures(b["sig"]), a["size"].to_numpy(), b["size"].to_numpy(), same)
            if len(i):
                keys = a["key"].to_list() + ([] if same else b["key"].to_list())
                label = labelled(len(keys), i, j if same else j + len(a))
                moved = np.flatnonzero(label != np.arange(len(keys)))
                yield pd.DataFrame({"a": [keys[m] for m in moved], "b": [keys[label[m]] for m in moved]})

    return components(block_pairs(members, "band", "m", SIGNATURE_BLOCK).mapInPandas(forest, "a binary, b binary"))


def verified(groups: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, links, head) rows: links inside a pair of blocks, weighted by copies, and a linked class."""
    counted = written(groups.groupBy("label").agg(F.count("node").alias("m")))
    members = groups.join(counted, "label").select("label", "m", F.col("node").alias("key"))
    members = members.join(classes.select("key", "held", "n"), "key").select(
        "label", "m", F.col("key").alias("_key"), "held", "n"
    )
    texts = docs.select("doc_id", F.xxhash64("text").alias("uid"), "text")
    # rows without an id are told apart by their texts
    same = texts["doc_id"].eqNullSafe(members["held.doc_id"]) & (texts["uid"] == members["held.uid"])
    found = texts.join(members, same).select("text", "label", "m", "_key", "n")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known: dict[bytes, int] = {}
            rows = []
            for text, label, m, key, n in frame.itertuples(index=False):
                values = shingles(whole(text), known)
                if len(values) and digest(values) == bytes(key):  # another row of the same doc_id may differ
                    rows.append((label, m, key, n, values.tobytes(), signature(values).tobytes()))
            yield pd.DataFrame(rows, columns=["label", "m", "key", "n", "values", "sig"], dtype=object)

    sets = found.mapInPandas(parse, "label binary, m long, key binary, n long, values binary, sig binary")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sorted_groups(frames, ["label", "_lo", "_hi"]):
            a, b, same = halves(part.drop_duplicates("key"))
            if a.empty or b.empty:
                continue
            va = [np.frombuffer(v, U) for v in a["values"]]
            vb = va if same else [np.frombuffer(v, U) for v in b["values"]]
            sa, sb = np.array(list(map(len, va))), np.array(list(map(len, vb)))
            i, j = surviving(signatures(a["sig"]), signatures(b["sig"]), sa, sb, same)
            common = shared_counts(va, vb, same)[i, j] if len(i) else np.zeros(0)
            linked = common >= THRESHOLD * (sa[i] + sb[j] - common) - 1e-9
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            na, nb = a["n"].to_numpy(np.int64), b["n"].to_numpy(np.int64)
            keys = a["key"].to_list() + ([] if same else b["key"].to_list())
            links = np.zeros(len(keys), np.int64)
            np.add.at(links, i, nb[j])
            j_at = j if same else j + len(a)
            np.add.at(links, j_at, na[i])
            label = labelled(len(keys), i, j_at)
            some = np.flatnonzero(links)
            yield pd.DataFrame({
                "key": [keys[s] for s in some], "links": links[some], "head": [keys[label[s]] for s in some]
            })

    return block_pairs(sets, "label", "m").mapInPandas(compare, "key binary, links long, head binary")


def shared_counts(va: list[np.ndarray], vb: list[np.ndarray], same: bool) -> np.ndarray:
    """Sizes of all intersections of two blocks of sets, by products of 0/1 matrices over shared shingles."""
    sets = va if same else [*va, *vb]
    owner = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    total = np.zeros((len(va), len(vb)))
    if not len(column):
        return total
    column = np.unique(column, return_inverse=True)[1]
    for at in range(0, column[-1] + 1, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        matrix = np.zeros((len(sets), COLUMNS), np.float32)
        matrix[owner[lo:hi], column[lo:hi] - at] = 1
        total += matrix[: len(va)] @ (matrix if same else matrix[len(va) :]).T
    return total


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, key, class_id, n_links for every row: links count copies and texts at the threshold or above."""
    sets = written(read_sets(docs))
    classes = written(
        sets.filter(F.col("key").isNotNull()).groupBy("key").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("held"), F.any_value("size").alias("size"),
            F.any_value("sig").alias("sig"),
        )
    )
    links = written(verified(candidate_groups(classes), classes, docs))
    labels = components(links.filter("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")))
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.select("key", "rep", "n").join(counts, "key", "left").join(
        labels.withColumnRenamed("node", "key"), "key", "left"
    ).withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    done = written(named.join(least, "label").select("key", "class_id", "label", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    # rows without words link with nothing and have no key; they are not sent to one task
    lone = sets.filter(F.col("key").isNull()).select(
        "doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(None).cast("binary").alias("label"), F.lit(0).cast("long").alias("n_links")
    )
    return sets.filter(F.col("key").isNotNull()).join(done, "key").select("doc_id", "key", "class_id", "label", "n_links").unionByName(lone)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return link_documents(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least doc_id; documents without words all stay."""
    columns = docs.columns
    linked = written(link_documents(docs))
    kept = linked.filter("key is not null").groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("w")
    ).select(F.col("w.doc_id").alias("_id"), F.col("w.key").alias("_set"))

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known: dict[bytes, int] = {}
            sets = [shingles(whole(t), known) for t in frame["text"]]
            frame["_set_key"] = [digest(v) if len(v) else None for v in sets]
            yield frame

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    rows = in_frames(docs, keyed, f"{fields}, _set_key binary")
    wordless = rows.filter("_set_key is null").select(*columns)
    named = rows.filter("_set_key is not null")
    one = named.join(kept, (named["_set_key"] == kept["_set"]) & named["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
    return one.dropDuplicates(["_set_key", "doc_id"]).select(*columns).unionByName(wordless)
