"""Quality rules by weak supervision.

Rules vote good, bad or abstain on counted features of a text. Expectation-maximisation over the counts of
all vote patterns estimates how often each rule is right; the posterior of a pattern decides. The patterns
are at most 3 ** rules rows, whatever the number of documents.

Null or empty texts have no words and fail the base rule. Rows are never merged: repeated rows give
repeated results. A null doc_id is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import per_row, table, whole, words_of
from pagelens.session import written

SYMBOLS = "#*$%&|<>"
#: Any of the symbols, wherever it stands in a word.
MARKED = re.compile(r"[#*$%&|<>]")
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_marked long"
)
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PATTERN_LIMIT = 3**8
#: Where the estimation starts: the chance of each vote given good and given bad. Bad texts fail few rules each.
START = {1: (0.97, 0.8), 0: (0.025, 0.05), -1: (0.005, 0.15)}


def measure(doc_id, text) -> tuple:
    """Counts of one whole text."""
    text = whole(text)
    words = words_of(text)
    seen: set[str] = set()
    lines = dup_lines = 0
    for line in text.split("\n"):
        if line.strip("\x20\t\n\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    coded = text.encode("utf-8", "surrogatepass")
    upper = len(coded) - len(coded.translate(None, delete=CAPITALS))
    return (
        doc_id, len(words), sum(map(len, words)),
        sum(text.count(s) for s in SYMBOLS), dup_lines, repeated_words(words), lines, upper, sum(1 for w in words if MARKED.search(w)) if MARKED.search(text) else 0,
    )


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    again = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= again
    return int(covered.sum())


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains. A rule abstains where its measure says little."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words
    symbols = F.col("n_symbols") / words
    repeats = F.col("n_repeat_words") / words
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    upper = F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    density = F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))
    marked = F.col("n_marked") / words

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": vote(F.col("n_words") >= 80, F.col("n_words") < 50),
        "word_length": vote(mean.between(3, 10), ~mean.between(2, 14)),
        "symbols": vote(symbols <= 0.05, symbols > 0.3),
        "density": vote(density <= 0.02, density > 0.1),
        "marked": vote(marked <= 0.02, marked > 0.1),
        "repeats": vote(repeats <= 0.2, repeats > 0.5),
        "lines": vote(lines <= 0.1, lines > 0.3),
        "upper": vote(upper <= 0.15, upper > 0.5),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50):
    """Prior of good, and for each rule the chance of each vote given good and given bad.

    The start fixes which class is called good. Pseudo-counts of a twentieth of the rows hold each rule
    near its start, so that rare votes keep a direction.
    """
    k = patterns.shape[1]
    chance = {v: np.tile(np.array(START[v]), (k, 1)) for v in START}
    prior, total = 0.8, counts.sum()
    weight = max(1.0, 0.05 * total)
    for _ in range(rounds):
        good = posterior(patterns, prior, chance)
        mass = np.array([(counts * good).sum(), (counts * (1 - good)).sum()])
        prior = float((mass[0] + 0.8 * weight) / (mass.sum() + weight))
        fresh = {}
        for v in START:
            hit = patterns == v
            seen = np.stack([(hit * (counts * good)[:, None]).sum(0), (hit * (counts * (1 - good))[:, None]).sum(0)], 1)
            fresh[v] = seen + weight * np.array(START[v])
        norm = sum(fresh.values())
        chance = {v: fresh[v] / norm for v in START}
    return prior, chance


def posterior(patterns: np.ndarray, prior: float, chance: dict) -> np.ndarray:
    logs = np.tile(np.log([prior, 1 - prior]), (len(patterns), 1))
    for v, table_of in chance.items():
        logs += (patterns == v).astype(float) @ np.log(table_of)
    top = logs.max(1, keepdims=True)
    odds = np.exp(logs - top)
    return odds[:, 0] / odds.sum(1)


def judge_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Features, votes, posterior probability of good quality, and the verdict for every document."""
    spark = docs.sparkSession
    features = written(per_row(docs, SCHEMA, ["doc_id", "text"], measure))
    votes = rules()
    voted = features.select("*", *[c.cast("int").alias(f"vote_{n}") for n, c in votes.items()])
    names = [f"vote_{n}" for n in votes]
    assert 3 ** len(names) <= PATTERN_LIMIT
    found = voted.groupBy(*names).count().collect()  # at most 3 ** rules rows
    schema = ", ".join(f"{n} int" for n in names) + ", p_good double"
    if found:
        patterns = np.array([[r[n] for n in names] for r in found])
        prior, chance = estimate(patterns, np.array([r["count"] for r in found], float))
        good = posterior(patterns, prior, chance)
        rows = [(*map(int, p), float(g)) for p, g in zip(patterns, good)]
    else:
        rows = []
    scored = voted.join(F.broadcast(spark.createDataFrame(rows, schema)), names, "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(table(spark, folder, "documents")).select(
        "doc_id", *FEATURES, "base_failed", "kept", "p_good"
    )
