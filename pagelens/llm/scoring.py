"""Language-model scores from an n-gram trie in shards.

Documents are cut into chunks, written as compact token arrays with the sorted hashes of their words.

1. Word shards add up the training counts of all chunks, number the words by frequency, and answer each
   chunk with number and count of its words.
2. Pair shards do the same for (context, word) pairs: the training counts of all chunks build the shard's
   trie, and every distinct pair of the chunks is looked up in it.
3. A chunk scores its documents from the answers.

A pair goes to a shard by a hash of both words and once for each chunk, so neither a frequent word nor a
frequent pair fills a shard. Shards grow in number with the chunks, so a shard's memory is bounded.

p(w|v) = n(vw) / (n(v) + T(v)) + T(v) / (n(v) + T(v)) * p(w), T(v) = 1 + n(v) ** 0.9: interpolation as by
Witten and Bell, with the number of types after v taken from Heaps' law; p(w) is the add-one estimate, which
is also the base score. The trie keeps the first term, quantised in steps of 0.0002 of its logarithm. The
first word follows a start mark, which is no token.

Order 2 is the default of this model; up to 2 ** 32 distinct words can be numbered. A null text is empty and
scores its end. A null doc_id counts as the empty id for the fold. Repeated rows repeat their counts. An empty
table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import CASE_FOLD, in_frames, sorted_groups, table, whole
from pagelens.llm.trie import Trie, restore
from pagelens.session import written

CHUNK_BYTES = 4_000_000
SHARD_ENTRIES = 4_000_000
LEAST_SHARDS = 24
HEAPS = 0.9
START, END = 0, 1  # word numbers within a chunk; their hashes are the same numbers
FOLDS, HELD_OUT = 7, 2
U = np.uint64
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def dump(value) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value, protocol=5))


def load(blob) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(blob)))


def planes(values: np.ndarray) -> np.ndarray:
    """Bytes of an integer array by significance, which compresses better; empty leading planes are cut."""
    values = np.ascontiguousarray(values, "<u8")
    split = values.view(np.uint8).reshape(-1, 8).T
    used = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(split[:used])


def unplanes(split: np.ndarray) -> np.ndarray:
    full = np.zeros((split.shape[1], 8), np.uint8)
    full[:, : split.shape[0]] = split.T
    return full.reshape(-1).view("<u8")


def read_chunks(docs: DataFrame) -> DataFrame:
    """Rows (kind, chunk, payload): kind 0 the documents' tokens, kind 1 hashes and training counts of words."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made = TaskContext.get().partitionId() << 32, 0
        vocabulary: defaultdict = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        ids, held, tokens, size = [], [], [], 0

        def close() -> pd.DataFrame:
            nonlocal made, size
            words = [0, 1, *map(xxhash.xxh3_64_intdigest, list(vocabulary)[2:])]
            hashes = np.array(words, U)
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            ends = np.cumsum([len(t) for t in tokens])
            local = place[np.concatenate(tokens)]
            train = ~np.repeat(np.array(held), np.diff(np.concatenate([[0], ends])))
            counts = np.bincount(local[train], minlength=len(order))
            counts[START] = len(held) - sum(held)
            rows = [
                (0, base + made, dump((list(ids), np.array(held), ends, planes(local), len(order)))),
                (1, base + made, dump((hashes[order], planes(counts)))),
            ]
            made, size = made + 1, 0
            vocabulary.clear()
            for buffer in (ids, held, tokens):
                buffer.clear()
            return pd.DataFrame(rows, columns=["kind", "chunk", "payload"])

        for frame in frames:
            for doc_id, text, out in zip(frame["doc_id"].tolist(), frame["text"], frame["held"]):
                if not vocabulary:
                    vocabulary["start"], vocabulary["end"]  # str keys: words are bytes
                data = whole(text).encode("utf-8", "surrogatepass")
                found = list(map(vocabulary.__getitem__, data.translate(CASE_FOLD).split()))
                found.append(END)
                ids.append(doc_id)
                held.append(bool(out))
                tokens.append(np.array(found, np.int64))
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield close()
        if ids:
            yield close()

    rows = docs.select("doc_id", "text", (fold == HELD_OUT).alias("held"))
    return in_frames(rows, run, "kind int, chunk long, payload binary")


def shard_bounds(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range begins in sorted 64-bit hashes."""
    edges = np.array([(k << 64) // shards for k in range(shards)], dtype=object)
    return np.append(np.searchsorted(hashes, edges.astype(U)), len(hashes))


def word_requests(shards: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, payload in zip(frame["chunk"], frame["payload"]):
                hashes, counts = load(payload)
                counts = unplanes(counts)
                bounds = shard_bounds(hashes, shards)
                yield pd.DataFrame(
                    [(k, chunk, dump((hashes[a:b], planes(counts[a:b])))) for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b],
                    columns=["shard", "chunk", "payload"],
                )

    return run


def word_answers(shards: int):
    """Number and training count of every asked word; each row also has its shard's tokens and types."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sorted_groups(frames, ["shard"]):
            shard = int(part["shard"].iloc[0])
            asked = [load(p) for p in part["payload"]]
            hashes = np.concatenate([a[0] for a in asked])
            found, inverse = np.unique(hashes, return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([unplanes(a[1]) for a in asked]).astype(float), len(found)).astype(U)
            order = np.argsort(-counts.astype(np.int64), kind="stable")
            rank = np.empty(len(order), U)
            rank[order] = np.arange(len(order), dtype=U)
            number = rank * U(shards) + U(shard)
            if len(number) and int(number.max()) >= 1 << 32:
                raise ValueError("more than 2 ** 32 distinct words")
            real = found != START
            tokens, types = int(counts[real].sum()), int((counts[real] > 0).sum())
            ends = np.cumsum([len(a[0]) for a in asked])
            rows = [
                (chunk, shard, tokens, types, dump((planes(number[i]), planes(counts[i]))))
                for chunk, i in zip(part["chunk"], np.split(inverse, ends[:-1]))
            ]
            yield pd.DataFrame(rows, columns=["chunk", "shard", "tokens", "types", "payload"])

    return run


def read_answers(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    parts = [load(p) for p in answers.sort_values("shard")["payload"]]
    return (np.concatenate([unplanes(p[0]) for p in parts]), np.concatenate([unplanes(p[1]) for p in parts]))


class Chunk:
    """Tokens of a chunk with the answers for its words."""

    def __init__(self, payload, answers: pd.DataFrame):
        self.ids, self.held, self.ends, tokens, _ = load(payload)
        self.tokens = unplanes(tokens).astype(np.int64)
        self.number, self.count = read_answers(answers)
        before = np.concatenate([[START], self.tokens[:-1]])
        before[self.ends[:-1]] = START
        self.before = before
        self.codes = (self.number[before] << U(32)) | self.number[self.tokens]

    def pairs(self, shards: int):
        """Distinct pairs in the order of shard and code, the pair of each token, and shard bounds."""
        codes, inverse = np.unique(self.codes, return_inverse=True)
        home = (codes * U(0x9E3779B97F4A7C15)) ^ (codes >> U(31))
        home = ((home * U(0xBF58476D1CE4E5B9)) >> U(32)) % U(shards)
        order = np.argsort(home, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        bounds = np.searchsorted(home[order], np.arange(shards + 1).astype(U))
        return codes[order], place[inverse], bounds


def pair_requests(shards: int):
    def run(chunk_rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for at, payload in zip(chunk_rows["chunk"], chunk_rows["payload"]):
            chunk = Chunk(payload, answers)
            codes, pair, bounds = chunk.pairs(shards)
            train = ~np.repeat(chunk.held, np.diff(np.concatenate([[0], chunk.ends])))
            counts = np.bincount(pair[train], minlength=len(codes))
            known = np.argsort(chunk.number, kind="stable")
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if a < b:
                    part = codes[a:b]
                    steps = np.diff(part, prepend=U(0))
                    context = np.unique(part >> U(32))
                    n = chunk.count[known[np.searchsorted(chunk.number, context, sorter=known)]]
                    rows.append((k, at, dump((planes(steps), planes(counts[a:b]), planes(np.diff(context, prepend=U(0))), planes(n)))))
        return pd.DataFrame(rows, columns=["shard", "chunk", "payload"])

    return run


def pair_answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Quantised probabilities of every asked pair, from the trie of the shard's training pairs."""
    for part in sorted_groups(frames, ["shard"]):
        shard = int(part["shard"].iloc[0])
        codes, counts, contexts, sizes = [], [], [], []
        for payload in part["payload"]:
            steps, n, context, size = load(payload)
            codes.append(np.cumsum(unplanes(steps), dtype=U))
            counts.append(unplanes(n))
            contexts.append(np.cumsum(unplanes(context), dtype=U))
            sizes.append(unplanes(size))
        ends = np.cumsum([len(c) for c in codes])
        found, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        del codes
        total = np.bincount(inverse, np.concatenate(counts).astype(float), len(found))
        context, first = np.unique(np.concatenate(contexts), return_index=True)
        size = np.concatenate(sizes)[first].astype(float)
        seen = total > 0
        n_context = size[np.searchsorted(context, found[seen] >> U(32))]
        trie = Trie(found[seen], total[seen] / (n_context + 1 + n_context**HEAPS))
        code = trie.look_up(found)
        rows = [
            (chunk, shard, 0, 0, dump(np.ascontiguousarray(code[i].view(np.uint8).reshape(-1, 2).T)))
            for chunk, i in zip(part["chunk"], np.split(inverse, ends[:-1]))
        ]
        yield pd.DataFrame(rows, columns=["chunk", "shard", "tokens", "types", "payload"])


def score_chunks(shards: int, tokens: int, types: int):
    def run(chunk_rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for payload in chunk_rows["payload"]:
            chunk = Chunk(payload, answers[~answers["pair"]])
            _, pair, _ = chunk.pairs(shards)
            parts = [load(p) for p in answers[answers["pair"]].sort_values("shard")["payload"]]
            code = np.concatenate([np.ascontiguousarray(p.T).reshape(-1).view(np.uint16) for p in parts])
            one = (chunk.count.astype(float) + 1) / (tokens + types + 1)
            n = chunk.count.astype(float)
            rest = (1 + n**HEAPS) / (n + 1 + n**HEAPS)
            p = restore(code)[pair] + rest[chunk.before] * one[chunk.tokens]
            starts = np.concatenate([[0], chunk.ends[:-1]])
            base = np.add.reduceat(np.log10(one)[chunk.tokens], starts)
            score = np.add.reduceat(np.log10(p), starts)
            known = np.add.reduceat((chunk.count > 0)[chunk.tokens].astype(np.int64), starts)
            out.append(pd.DataFrame({
                "doc_id": pd.Series(chunk.ids, dtype=object), "held_out": chunk.held, "n_tokens": chunk.ends - starts,
                "n_known": known, "train_tokens": tokens, "base_score": base, "score": score,
            }))
        return pd.concat(out)

    return run


ANSWERS = "chunk long, shard int, tokens long, types long, payload binary"
REQUESTS = "shard int, chunk long, payload binary"


def by_shard(requests: DataFrame) -> DataFrame:
    return requests.repartition("shard").sortWithinPartitions("shard")


def score_documents(docs: DataFrame) -> DataFrame:
    """Base and model log10 probability of every document."""
    spark = docs.sparkSession
    everything = written(read_chunks(docs))
    chunks = everything.filter("kind = 0").select("chunk", "payload")
    vocabularies = everything.filter("kind = 1").select("chunk", "payload")
    n_chunks = chunks.select("chunk").count()
    if not n_chunks:
        return spark.createDataFrame([], SCORES)
    word_shards = max(LEAST_SHARDS, n_chunks // 20)
    pair_shards = max(LEAST_SHARDS, n_chunks // 6)
    asked = vocabularies.mapInPandas(word_requests(word_shards), REQUESTS)
    words = written(by_shard(asked).mapInPandas(word_answers(word_shards), ANSWERS))
    per_shard = words.groupBy("shard").agg(F.max("tokens").alias("n"), F.max("types").alias("v"))
    total = per_shard.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    pairs = chunks.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInPandas(pair_requests(pair_shards), REQUESTS)
    found = written(by_shard(pairs).mapInPandas(pair_answers, ANSWERS))
    answers = words.select("chunk", "shard", F.lit(False).alias("pair"), "payload").unionByName(
        found.select("chunk", "shard", F.lit(True).alias("pair"), "payload")
    )
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        score_chunks(pair_shards, total["n"], total["v"]), SCORES
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"))
