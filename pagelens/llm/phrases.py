"""Phrase collocations, with one FM-index over word ids for each shard of a language's texts.

Three kinds of passes, none of which shuffles texts or indexes:

1. Words are counted; frequent ones are kept.
2. Texts are cut into shards of word ids. A word that is not frequent ends a piece, as no frequent phrase can hold
   it. The Burrows-Wheeler transforms of the shard and of its reverse are written to a table.
3. For each length, shards extend the phrases that may be frequent one word further and return counts, which Spark
   adds up. A phrase is an interval in both indexes: the reverse transform gives the words to its right and the other
   one those to its left, and each step moves both intervals together.

Shards learn which phrases are frequent from a Bloom filter of bounded size. Word pairs, of which there are far more
than of longer phrases, are first counted in hashed buckets, and only those in buckets with enough occurrences are
counted by themselves. What either filter lets through wrongly is counted in vain, so that their sizes change the work
and never the result.

Null texts are empty, a null language is ``und``, null ids and repeated rows count like any others, an empty table
gives no rows, and other columns are not read. A piece is held by one shard; long texts are cut between pieces.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm.common import table
from pagelens.session import written

LEAST = 100  # occurrences of a candidate
LONGEST = 5  # words
TOP = 2000  # phrases reported for each language
ABSORBED = 100  # percent of its occurrences that a longer candidate must hold to replace a phrase
SHARD_WORDS = 1_000_000
CHUNK_BYTES = 1 << 20  # of one text split at once
RUN_WORDS = 200_000  # numbered or counted at once
DISTINCT = 300_000  # words counted by a task before it hands on its counts
ROWS_PER_BATCH = 100_000
FILTER_BITS = 1 << 28  # at most, 32 MB
RANGE_BITS = 16  # of the bucket number inside a range of buckets
HELD_BUCKETS = 4_000_000  # bucket counts held by a task
HELD_PHRASES = 1_000_000  # phrases held by a task
SALTS = 256

MARK = b"\xff"  # between pieces; not a byte of UTF-8
FOLD = bytes(c + 32 if 65 <= c <= 90 else 0xFF if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
BREAK = re.compile(rb"[\x20\x09\xff]")
STEP = np.uint64(0x9E3779B97F4A7C15)


def split_text(data: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words and marks of a text, in bounded lists."""
    folded = data.translate(FOLD)
    at = 0
    while at < len(folded):
        end = at + CHUNK_BYTES
        if end < len(folded):
            found = BREAK.search(folded, end)
            end = found.start() if found else len(folded)
        yield folded[at:end].replace(MARK, b" \xff ").split()
        at = end


# --- which phrases may be frequent -------------------------------------------------------------

def word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def longer_hash(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word; a phrase starts from the hash of its language."""
    return (phrase ^ (phrase >> np.uint64(29))) * STEP + word


class Filter:
    """Bloom filter with three bits for each entry."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> np.ndarray:
        mixed = (hashes ^ (hashes >> np.uint64(32))) * STEP
        low, high = mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32)
        return np.stack([(low + np.uint64(k) * (high | np.uint64(1))) & np.uint64(bits - 1) for k in range(3)]).astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes, self.bits)
        return ((self.packed[at >> 3] >> (at & 7)) & 1).all(axis=0)


def make_filter(frequent: DataFrame) -> Filter:
    """Filter of the phrases (lang, phrase): 16 bits for each, rounded up, at most FILTER_BITS."""
    bits = min(FILTER_BITS, 1 << max(15, (frequent.count() * 16).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            hashes = word_hash(batch.column("lang").to_pylist())
            words = [p.split(b" ") for p in batch.column("phrase").to_pylist()]
            for k in range(len(words[0])):
                hashes = longer_hash(hashes, word_hash([w[k] for w in words]))
            yield pa.RecordBatch.from_arrays([pa.array(Filter.places(hashes, bits).ravel())], ["place"])

    rows = frequent.select(F.col("lang").cast("binary"), F.col("phrase").cast("binary")).mapInArrow(places, "place long")
    # bitmap buckets count from 1, their positions from 0
    maps = rows.groupBy(F.expr("bitmap_bucket_number(place + 1)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(place + 1))").alias("bits"))
    packed = np.zeros(bits // 8, np.uint8)
    for row in maps.collect():  # bits / 32768 rows of 4 KB
        start = (row["bucket"] - 1) * 4096
        packed[start : start + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)[: len(packed) - start]
    return Filter(bits, packed)


class Buckets(Filter):
    """One bit for each bucket of hashes."""

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> np.ndarray:
        mixed = (hashes ^ (hashes >> np.uint64(32))) * STEP
        return (mixed >> np.uint64(65 - bits.bit_length())).astype(np.int64)[None]


# --- index of a shard --------------------------------------------------------------------------

def suffix_order(symbols: np.ndarray, depth: int = LONGEST) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` symbols at least: enough for phrases of that length."""
    rank, n, step = symbols.astype(np.int64), len(symbols), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        step *= 2
        if step >= depth:
            return order
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])


def transform(symbols: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform: the symbol before each suffix, in suffix order."""
    return symbols[suffix_order(symbols) - 1]


class Direction:
    """Steps in one of the two indexes."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt.astype(np.int64)
        self.size = len(bwt)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.bwt))])  # suffixes before each symbol's
        self.occurrences = np.sort(self.bwt * self.size + np.arange(self.size))

    def extend(self, low: np.ndarray, other_low: np.ndarray, count: np.ndarray):
        """All one-symbol extensions of phrases with intervals (low, count) here and (other_low, count) there.

        Returns the phrase's number, the symbol, both new lows and the new counts.
        """
        total = int(count.sum())
        start = np.cumsum(count) - count
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(total) + np.repeat(low - start, count)
        width = len(self.first)
        key, n = np.unique(which * width + self.bwt[rows], return_counts=True)
        which, symbol = key // width, key % width
        # the interval there is cut in the order of the symbols
        before = np.cumsum(n) - n
        there = other_low[which] + before - start[which]
        here = np.searchsorted(self.occurrences, symbol * self.size + low[which])
        real = symbol > 0
        return which[real], symbol[real], here[real], there[real], n[real]


class Shard:
    """Both directions of a shard. Symbol 0 stands between pieces, symbol k for the k-th word."""

    def __init__(self, before: np.ndarray, after: np.ndarray):
        self.left, self.right = Direction(before), Direction(after)

    @classmethod
    def of(cls, symbols: np.ndarray) -> Shard:
        return cls(transform(symbols), transform(symbols[::-1]))

    def phrases(self, seed: np.uint64, hashes: np.ndarray, filters: list[Filter], length: int):
        """Phrases of ``length`` words whose parts of one word less may be frequent: symbols (rows), counts.

        All but the first word come from steps to the right, the first one from a step to the left.
        ``filters[k]`` knows the frequent phrases of k + 1 words; one for the length itself is used if there is any.
        """
        low = self.left.first[1:-1]
        forward, backward, count = low, low, np.diff(self.left.first)[1:]
        symbols = np.arange(1, len(count) + 1)[:, None]

        def hashed(rows: np.ndarray) -> np.ndarray:
            out = np.full(len(rows), seed)
            for k in range(rows.shape[1]):
                out = longer_hash(out, hashes[rows[:, k] - 1])
            return out

        for known in filters[1 : length - 1]:
            which, symbol, backward, forward, count = self.right.extend(backward, forward, count)
            symbols = np.concatenate([symbols[which], symbol[:, None]], axis=1)
            likely = known.holds(hashed(symbols))
            symbols, forward, backward, count = symbols[likely], forward[likely], backward[likely], count[likely]
        which, symbol, forward, backward, count = self.left.extend(forward, backward, count)
        symbols = np.concatenate([symbol[:, None], symbols[which]], axis=1)
        likely = filters[length - 2].holds(hashed(symbols[:, :-1]))
        symbols, count = symbols[likely], count[likely]
        hashes = hashed(symbols)
        for known in filters[length - 1 : length]:
            likely = known.holds(hashes)
            symbols, count, hashes = symbols[likely], count[likely], hashes[likely]
        return symbols, count, hashes


# --- passes over the corpus --------------------------------------------------------------------

COUNTS = "lang binary, phrase binary, n long"


def counted(lang: list, phrase: list, n: list) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(n), ROWS_PER_BATCH):
        cut = slice(at, at + ROWS_PER_BATCH)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang[cut], pa.binary()), pa.array(phrase[cut], pa.binary()), pa.array(n[cut], pa.int64())],
            ["lang", "phrase", "n"],
        )


def word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Words and marks of many texts at once, by language; a mark ends each text."""
    held: dict[bytes, list[bytes]] = defaultdict(list)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for words in split_text(text):
                held[lang] += words
                if len(held[lang]) >= RUN_WORDS:
                    yield lang, held.pop(lang)
            held[lang].append(MARK)
    yield from held.items()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by language, and of all words with a null phrase."""
    counts: dict[bytes, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            found.pop(MARK, None)
            words = [None, *found]
            yield from counted([lang] * len(words), words, [sum(found.values()), *found.values()])
        counts.clear()

    for lang, words in word_runs(batches):
        counts[lang].update(words)
        if len(counts[lang]) > DISTINCT:
            yield from flush()
    yield from flush()


class Numbers:
    """Numbers of the words that may be frequent, 0 for the others."""

    def __init__(self, lang: bytes, known: Filter):
        self.seed, self.known = word_hash([lang]), known
        self.numbers: dict[bytes, int] = {MARK: 0}
        self.words: list[bytes] = []

    def of(self, words: list[bytes]) -> np.ndarray:
        fresh = list(set(words) - self.numbers.keys())
        if fresh:
            likely = self.known.holds(longer_hash(np.repeat(self.seed, len(fresh)), word_hash(fresh)))
            for word, known in zip(fresh, likely.tolist()):
                if known:
                    self.words.append(word)
                self.numbers[word] = len(self.words) if known else 0
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))


SHARDS = "lang binary, words array<binary>, before binary, after binary"


def shard_row(lang: bytes, numbers: np.ndarray, words: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The index of a run of word numbers, without words that stand alone in their piece."""
    if not len(numbers):
        return
    full = np.concatenate([[0], numbers, [0]])
    word = full[1:-1] > 0
    joined = word & ((full[:-2] > 0) | (full[2:] > 0))
    ends = ~word & np.concatenate([[False], joined[:-1]])
    kept = np.append(numbers[joined | ends], 0)
    used = np.unique(kept[kept > 0])
    if not len(used):
        return
    used = np.array(sorted(used.tolist(), key=lambda k: words[k - 1]))
    symbol = np.zeros(len(words) + 1, np.int64)
    symbol[used] = np.arange(1, len(used) + 1)
    symbols = symbol[kept]
    shape = np.uint32 if len(used) >= 1 << 16 else np.uint16
    shard = [transform(s).astype(shape).tobytes() for s in (symbols, symbols[::-1])]
    yield pa.RecordBatch.from_arrays(
        [pa.array([lang], pa.binary()), pa.array([[words[k - 1] for k in used]], pa.list_(pa.binary())),
         pa.array(shard[:1], pa.binary()), pa.array(shard[1:], pa.binary())],
        ["lang", "words", "before", "after"],
    )


def read_shard(words: list[bytes], before: bytes, after: bytes) -> Shard:
    shape = np.uint32 if len(words) >= 1 << 16 else np.uint16
    return Shard(np.frombuffer(before, shape), np.frombuffer(after, shape))


def index_texts(texts: DataFrame, known: Filter, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each shard: its words in byte order and both transforms."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[bytes, list[np.ndarray]] = defaultdict(list)
        size: dict[bytes, int] = defaultdict(int)
        numbers: dict[bytes, Numbers] = {}
        for lang, words in word_runs(batches):
            if lang not in numbers:
                numbers[lang] = Numbers(lang, shared.value)
            runs[lang].append(numbers[lang].of(words))
            size[lang] += len(words)
            if size[lang] < shard_words:
                continue
            run, old = np.concatenate(runs.pop(lang)), numbers[lang].words
            gaps = np.flatnonzero(run == 0)
            cut = gaps[-1] + 1 if len(gaps) else 0
            yield from shard_row(lang, run[:cut], old)
            numbers[lang] = Numbers(lang, shared.value)
            rest = numbers[lang].of([old[k - 1] for k in run[cut:].tolist()])  # of a piece that goes on
            runs[lang].append(rest)
            size[lang] = len(rest)
        for lang, found in runs.items():
            yield from shard_row(lang, np.concatenate(found), numbers[lang].words)

    return written(texts.mapInArrow(build, SHARDS))


def found_in(batches: Iterator[pa.RecordBatch], filters: list[Filter], length: int):
    """Language, words, and the phrases of each shard."""
    for batch in batches:
        for row in range(len(batch)):
            lang, words, before, after = [batch.column(c)[row].as_py() for c in ("lang", "words", "before", "after")]
            found = read_shard(words, before, after).phrases(word_hash([lang])[0], word_hash(words), filters, length)
            yield lang, words, *found


def crowded_buckets(shards: DataFrame, filters: list[Filter], length: int, least: int, words: int) -> Buckets:
    """Buckets that hold ``least`` occurrences: four for each word of the corpus, at most FILTER_BITS."""
    bits = min(FILTER_BITS, 1 << max(RANGE_BITS + 1, (4 * words).bit_length()))
    shared = shards.sparkSession.sparkContext.broadcast(filters)
    width, kind = 1 << RANGE_BITS, np.uint8 if least < 256 else np.uint32

    def ranges(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        place, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        n = np.minimum(np.bincount(at, np.concatenate([n for _, n in held])), least).astype(kind)
        number, start = np.unique(place >> RANGE_BITS, return_index=True)
        inside, ends = (place & (width - 1)).astype(np.uint16), [*start[1:].tolist(), len(place)]
        rows = [(inside[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(start.tolist(), ends)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(number), *[pa.array(c, pa.binary()) for c in zip(*rows)]], ["number", "inside", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, _, n, hashes in found_in(batches, shared.value, length):
            if len(n):
                held.append((Buckets.places(hashes, bits)[0], n))
                size += len(n)
            if size >= HELD_BUCKETS:
                yield from ranges(held)
                held, size = [], 0
        if held:
            yield from ranges(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(width, np.int64)

        def crowded() -> Iterator[pa.RecordBatch]:
            packed = np.packbits(total >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([packed], pa.binary())], ["number", "bits"])

        for batch in batches:
            for number, inside, n in zip(*[batch.column(c).to_pylist() for c in ("number", "inside", "n")]):
                if now is not None and number != now:
                    yield from crowded()
                    total[:] = 0
                now = number
                total[np.frombuffer(inside, np.uint16)] += np.frombuffer(n, kind)
        if now is not None:
            yield from crowded()

    parts = shards.mapInArrow(count, "number long, inside binary, n binary")
    maps = parts.repartition("number").sortWithinPartitions("number").mapInArrow(add, "number long, bits binary")
    packed = np.zeros(bits // 8, np.uint8)
    for row in maps.collect():  # bits / 65536 rows of 8 KB
        packed[row["number"] * width // 8 :][: width // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return Buckets(bits, packed)


PACKS = "number long, lang binary, phrases array<binary>, n array<long>"


def count_phrases(shards: DataFrame, filters: list[Filter], length: int, least: int, words: int) -> DataFrame:
    """Phrases (lang, phrase, f) of ``length`` words found ``least`` times in all shards together.

    A task adds up the counts of its shards and returns them in packs by ranges of the phrases' hashes, one range for
    a million words of the corpus; a range is added up by one task, and only its frequent phrases become rows.
    """
    shared = shards.sparkSession.sparkContext.broadcast(filters)
    drop = np.uint64(64 - max(8, (words >> 20).bit_length()))

    def packs(held: dict[bytes, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            names, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            order = np.argsort(numbers := word_hash(names) >> drop, kind="stable")
            number, start = np.unique(numbers[order], return_index=True)
            ends = pa.array([*start.tolist(), len(order)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(number.astype(np.int64)), pa.array([lang] * len(number), pa.binary()),
                 pa.ListArray.from_arrays(ends, pa.array([names[k] for k in order.tolist()], pa.binary())),
                 pa.ListArray.from_arrays(ends, pa.array(n[order]))],
                ["number", "lang", "phrases", "n"])
        held.clear()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Counter] = defaultdict(Counter)
        for lang, words, symbols, n, _ in found_in(batches, shared.value, length):
            counts = held[lang]
            for at in range(0, len(n), ROWS_PER_BATCH):
                part = (symbols[at : at + ROWS_PER_BATCH] - 1).T.tolist()
                texts = map(b" ".join, zip(*[map(words.__getitem__, column) for column in part]))
                for text, times in zip(texts, n[at : at + ROWS_PER_BATCH].tolist()):
                    counts[text] += times
            if sum(map(len, held.values())) > HELD_PHRASES:
                yield from packs(held)
        yield from packs(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, Counter()

        def frequent() -> Iterator[pa.RecordBatch]:
            rows = [(lang, phrase, n) for (lang, phrase), n in total.items() if n >= least]
            total.clear()
            if rows:
                yield from counted(*map(list, zip(*rows)))

        for batch in batches:
            for number, lang, names, n in zip(*[batch.column(c).to_pylist() for c in ("number", "lang", "phrases", "n")]):
                if number != now:
                    yield from frequent()
                now = number
                for name, times in zip(names, n):
                    total[lang, name] += times
        yield from frequent()

    parts = shards.mapInArrow(search, PACKS).repartition("number").sortWithinPartitions("number")
    return written(parts.mapInArrow(add, COUNTS).select(
        F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), F.col("n").alias("f")))


def summed(counts: DataFrame, least: int) -> DataFrame:
    """Words (lang, phrase, f) found often enough, with the null phrase of each language's total."""
    total = counts.groupBy(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase")).agg(
        F.sum("n").alias("f"))
    return written(total.filter((F.col("f") >= least) | F.col("phrase").isNull()))


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_words: int = SHARD_WORDS
) -> tuple[DataFrame, DataFrame]:
    """Totals (lang, n), and all phrases of up to ``longest`` words found ``least`` times: lang, phrase, size, f."""
    texts = docs.select(
        F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    words = summed(texts.mapInArrow(count_words, COUNTS), least)
    totals = words.filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
    levels = [words.filter("phrase IS NOT NULL")]
    filters = [make_filter(levels[0])]
    shards = index_texts(texts, filters[0], shard_words)
    words_in_all = totals.agg(F.sum("n")).first()[0] or 0
    for length in range(2, longest + 1):
        hashed = [crowded_buckets(shards, filters, 2, least, words_in_all)] if length == 2 else []
        levels.append(count_phrases(shards, filters + hashed, length, least, words_in_all))
        if length < longest:
            filters.append(make_filter(levels[-1]))
    found = levels[0].withColumn("size", F.lit(1))
    for k, level in enumerate(levels[1:], 2):
        found = found.unionByName(level.withColumn("size", F.lit(k)))
    return totals, found


def part(first: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, count), " ")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbed: int = ABSORBED,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score, longer.

    ``longer`` is the count of the most frequent phrase that has one word more on either side (0: none is a
    candidate). Counts fall with length, so that no other longer phrase can hold a larger share of a phrase.
    """
    totals, found = frequent_phrases(docs, least, longest, shard_words)
    # longer phrases as extensions of their two parts of one word less, to the left or to the right
    outer = found.filter("size > 2").select("lang", "f", F.explode(F.array(
        part(1, F.col("size") - 1), part(2, F.col("size") - 1))).alias("phrase"))
    longer = outer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = found.filter("size > 1").join(longer, ["lang", "phrase"], "left").withColumn(
        "longer", F.coalesce("longer", F.lit(0).cast("long"))
    ).filter(100 * F.col("longer") < absorbed * F.col("f"))
    cuts = kept.select(
        "lang", "phrase", F.col("f").alias("a"), "longer", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size"
    ).select("*", part(1, F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    counts = found.select("lang", F.col("phrase").alias("part"), "f")
    heads = counts.withColumnsRenamed({"part": "head", "f": "l"})
    tails = counts.withColumnsRenamed({"part": "tail", "f": "r"})
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang").withColumn(
        "score", F.expr("""
            CAST(CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) * 1000 AS DECIMAL(38, 0))
            DIV CAST(CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)) AS DECIMAL(38, 0))"""))
    best = scored.groupBy("lang", "phrase").agg(
        F.min_by(F.struct("a", "l", "r", "n", "score", "longer"), F.struct("score", "k")).alias("cut")
    ).select("lang", "phrase", "cut.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = best.withColumn("_salt", salt).withColumn(
        "_near", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_near") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "longer")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


ORACLE = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang
), grams AS (
  SELECT lang, size, unnest([array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS phrase
  FROM lists, (SELECT unnest(range(1, 6)) AS size)
), found AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS w FROM found WHERE size > 1 AND f >= 100
), inside AS (
  SELECT DISTINCT c.lang, c.phrase
  FROM (SELECT lang, size, f, unnest([array_to_string(w[i:i + part - 1], ' ') FOR i IN range(1, size - part + 2)]) AS phrase
        FROM candidates, (SELECT unnest(range(2, 5)) AS part) WHERE part < size) o
  JOIN candidates c ON c.lang = o.lang AND c.phrase = o.phrase AND 100 * o.f >= 100 * c.f
), kept AS (
  SELECT * FROM candidates ANTI JOIN inside USING (lang, phrase)
), cuts AS (
  SELECT lang, phrase, f AS a, size, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM kept, (SELECT unnest(range(1, 5)) AS k) WHERE k < size
), scored AS (
  SELECT c.lang, c.phrase, c.a, h.f AS l, t.f AS r, n, k, (1000::HUGEINT * c.a * n) // (h.f::HUGEINT * t.f) AS score
  FROM cuts c JOIN found h ON h.lang = c.lang AND h.phrase = c.head JOIN found t ON t.lang = c.lang AND t.phrase = c.tail
  JOIN totals ON totals.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longest AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, unnest([array_to_string(w[1:size - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM candidates
  ) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score, coalesce(longer, 0) AS longer
FROM ranked LEFT JOIN longest USING (lang, phrase) WHERE rank <= 2000
"""
