"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents in one task. Its text is the sequence of word numbers, reduced to runs of
words that occur in the benchmark, since no other run can hold a window. The shard's suffix array gives the
Burrows-Wheeler transform, kept as a wavelet matrix with packed bits and sampled ranks. All windows are
searched backwards together; occurrences are located through sampled suffix positions and merged to spans.

The benchmark is cut into blocks of bounded size; documents pass through one step for each block, so that
memory holds one block and one shard. Null texts have no words. An item with fewer words than a window is
one window; items without words are left out. Words in an item without an id are hit, but it is not counted or named.
A null doc_id is kept, an empty table gives no rows, and repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import fold_case, in_frames, table, whole

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
BLOCK_CHARS = 16_000_000  # of benchmark text in one block
SHARD_CHARS = 6_000_000  # of document text in one index
SAMPLE = 8
ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
BELOW = np.array([(0xFF00 >> k) & 0xFF for k in range(8)], np.uint8)  # the first k bits of a byte


def item_words(text) -> list[str]:
    return ITEM_WORD.findall(fold_case(whole(text)))


class Windows:
    """Distinct windows of a block of items by length, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = WINDOW):
        self.numbers: dict[str, int] = {}
        found: dict[tuple, set[str | None]] = {}
        for item_id, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in item_words(text)]
            for at in range(max(1, len(ids) - size + 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + size]), set()).add(item_id)
        keys = sorted(found, key=lambda k: (len(k), k))
        self.items = [sorted(found[k] - {None}) for k in keys]
        self.least = min((len(k) for k in keys), default=0)
        self.groups = []
        for length in sorted({len(k) for k in keys}):
            which = [i for i, k in enumerate(keys) if len(k) == length]
            self.groups.append((length, np.array(which), np.array([keys[i] for i in which], np.int64)))


class Wavelet:
    """Symbols with rank and access, one packed bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=1)).bit_length())
        self.levels = []
        now = symbols
        for bit in range(self.bits - 1, -1, -1):
            ones = (now >> bit) & 1
            packed = np.append(np.packbits(ones.astype(np.uint8)), np.uint8(0))
            before = np.concatenate([[0], np.cumsum(ONES[packed], dtype=np.int64)])
            zeros = len(now) - int(ones.sum())
            self.levels.append((bit, packed, before, zeros))
            now = np.concatenate([now[ones == 0], now[ones == 1]])

    @staticmethod
    def _ones(packed, before, at):
        byte = at >> 3
        return before[byte] + ONES[packed[byte] & BELOW[at & 7]]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start, end = np.zeros_like(at), at.copy()
        for bit, packed, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            s, e = self._ones(packed, before, start), self._ones(packed, before, end)
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        at = at.copy()
        for bit, packed, before, zeros in self.levels:
            s = self._ones(packed, before, at)
            one = (packed[at >> 3] >> (7 - (at & 7))) & 1
            symbol |= one.astype(np.int64) << bit
            at = np.where(one == 1, zeros + s, at - s)
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; the last symbol must be the only least one."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, step = len(symbols), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FmIndex:
    def __init__(self, symbols: np.ndarray):
        order = suffix_array(symbols)
        self.bwt = Wavelet(symbols[order - 1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols))])  # suffixes before each symbol's
        self.marked = order % SAMPLE == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = order[self.marked]
        self.size = len(symbols)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all patterns of one length (rows)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k]
            known = symbol + 1 < len(self.first)
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live] = self.first[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.bwt.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled suffix."""
        place = np.empty(len(rows), np.int64)
        live, now, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            hit = self.marked[now]
            place[live[hit]] = self.samples[self.sampled_before[now[hit]]] + steps
            live, now = live[~hit], now[~hit]
            symbol = self.bwt.access(now)
            now = self.first[symbol] + self.bwt.rank(symbol, now)
            steps += 1
        return place


def search_shard(texts: list[str], windows: Windows):
    """For each text: number of words, merged spans of hit words, and items found."""
    parts, doc_of, word_of, n_words = [], [], [], []
    size = 0
    for k, text in enumerate(texts):
        words = item_words(text)
        n_words.append(len(words))
        ids = np.fromiter(map(windows.numbers.get, words, repeat(0)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
        for start, end in zip(edges[::2], edges[1::2]):
            if windows.least and end - start >= windows.least:
                parts.append(np.append(ids[start:end], 1))
                doc_of.append(np.full(end - start + 1, k))
                word_of.append(np.arange(start, end + 1))
                size += end - start + 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not size:
        return n_words, spans, items
    symbols = np.concatenate([*parts, [0]])
    doc, word = np.concatenate(doc_of), np.concatenate(word_of)
    index = FmIndex(symbols)
    edge = np.zeros(size + 2, np.int64)
    pairs = []
    for length, which, patterns in windows.groups:
        low, high = index.search(patterns)
        n = high - low
        if not n.sum():
            continue
        rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = index.locate(rows)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        pairs.append(np.unique(np.stack([doc[at], np.repeat(which, n)], 1), axis=0))
    hit = np.flatnonzero(np.cumsum(edge)[:size] > 0)
    if len(hit):
        new = np.concatenate([[True], (doc[hit][1:] != doc[hit][:-1]) | (word[hit][1:] != word[hit][:-1] + 1)])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(hit)) - 1
        for s, e in zip(hit[starts], hit[ends]):
            spans[doc[s]].append((int(word[s]), int(word[e]) + 1))
        found = np.unique(np.concatenate(pairs), axis=0)
        for k, pattern in found:
            items[k] += windows.items[pattern]
    return n_words, spans, [sorted(set(x)) for x in items]


def merged(a, b) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((int(s[0]), int(s[1])) for s in [*a, *b]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Items with a text, in blocks of bounded size, one at a time on the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text IS NOT NULL")
    for row in rows.toLocalIterator():
        if block and size + len(row["text"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item"], row["text"]))
        size += len(row["text"])
    yield block


def _with_last(items: Iterator) -> Iterator[tuple]:
    """Number, item, and whether it is the last one; holds two items at most."""
    number, held = 0, next(items)
    for item in items:
        yield number, held, False
        number, held = number + 1, item
    yield number, held, True


def shards(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    start = size = 0
    for k, text in enumerate(frame["text"]):
        size += len(text) if isinstance(text, str) else 0
        if size >= SHARD_CHARS:
            yield frame.iloc[start : k + 1]
            start, size = k + 1, 0
    if start < len(frame):
        yield frame.iloc[start:]


def find_contamination(docs: DataFrame, benchmark: DataFrame, columns: list[str], finish=None) -> DataFrame:
    """The named columns (text among them) with _n_words, _spans (of words, ends exclusive) and _items.

    ``finish`` turns the last step's frames into frames of the named columns, in the same worker.
    """
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    schema = f"{fields}, _n_words long, _spans array<array<long>>, _items array<string>"
    found = docs.select(*columns)
    for number, block, last in _with_last(blocks(benchmark)):
        done = finish if last else None
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_CHARS of text

        def search(frames: Iterator[pd.DataFrame], shared=shared, first=number == 0, done=done) -> Iterator[pd.DataFrame]:
            windows = Windows(shared.value)
            for frame in frames:
                for part in shards(frame):
                    n_words, spans, items = search_shard([whole(t) for t in part["text"]], windows)
                    made = part[columns].copy()
                    if not first:
                        spans = [merged(a, b) for a, b in zip(spans, part["_spans"])]
                        items = [sorted({*a, *b}) for a, b in zip(items, part["_items"])]
                    made["_n_words"], made["_spans"], made["_items"] = n_words, [[list(s) for s in x] for x in spans], items
                    yield made if done is None else done(made)

        found = in_frames(found, search, schema if done is None else fields)
    return found


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, folder, "benchmark"), ["doc_id", "text"])
    hits = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), hits.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def without_spans(text: str, spans) -> str:
    """The text without the spans of words, from the start of the first word to the end of the last."""
    places = [m.span() for m in ITEM_WORD.finditer(fold_case(text))]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return "".join(out) + text[at:]


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without their benchmark passages; those of which no word is left go. n_chars follows."""
    columns = docs.columns

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        hit = frame["_spans"].map(len) > 0
        frame["text"] = [without_spans(t, s) if h else t for t, s, h in zip(frame["text"], frame["_spans"], hit)]
        left = [not h or bool(item_words(t)) for t, h in zip(frame["text"], hit)]
        if "n_chars" in columns:
            frame["n_chars"] = [len(t) if h else n for t, n, h in zip(frame["text"], frame["n_chars"].astype(object), hit)]
        return frame.loc[left, columns]

    return find_contamination(docs, benchmark, columns, cut)
