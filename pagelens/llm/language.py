"""Language identification by a mixture of languages.

Each language is a smoothed distribution over hashed letter trigrams, counted over all training documents.
For a document, expectation-maximisation estimates the share of each language; languages are added while
the gain in likelihood beats a penalty of half the logarithm of the number of trigrams for each (BIC).

Null texts and texts without letters are ``und``. Rows with null lang or in the held-out fold teach
nothing. Without training rows everything is ``und``. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import in_frames, table, whole

BUCKETS = 1 << 15
MAX_LANGUAGES = 1000  # bound of the model that goes to the tasks: BUCKETS floats for each language
FOLDS = 5


def grams(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased letters, with one space for every run of other characters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = LETTERS[codes.clip(max=0x10FFFF)]
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint64)
    if letter.any():
        mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D))
        return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)
    return np.zeros(0, np.int64)


def _letters() -> np.ndarray:
    flags = np.zeros(0x110000, bool)
    flags[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return flags


LETTERS = _letters()


def folds(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (BUCKETS x languages), from the whole training fold."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                found = grams(whole(text))
                if len(found):
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(found, minlength=BUCKETS)
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": row[at]})

    known = docs.select("doc_id", "lang", "text").filter((folds() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.select("lang", "text").mapInPandas(count, "lang string, bucket long, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("at")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows.sort(key=lambda r: r["lang"])
    model = np.full((BUCKETS, len(rows)), 0.5)
    for k, row in enumerate(rows):
        model[[b["bucket"] for b in row["at"]], k] += [b["n"] for b in row["at"]]
    return [r["lang"] for r in rows], np.log(model / model.sum(0))


def mixture(found: np.ndarray, logs: np.ndarray, rounds: int = 12) -> tuple[list[int], np.ndarray]:
    """Selected languages and their shares."""
    at, n = np.unique(found, return_counts=True)
    rows = logs[at]
    chance = np.exp(rows - rows.max(1, keepdims=True))
    floor = rows.max(1)
    total = n.sum()
    single = n @ rows
    chosen = [int(single.argmax())]
    share, best = np.ones(1), float(single[chosen[0]])
    penalty = 0.5 * np.log(total)
    left = [int(k) for k in np.argsort(-single, kind="stable") if k != chosen[0]]
    while left:
        # the language whose addition at a tenth gains most is tried
        now = chance[:, chosen] @ share
        gains = [float(n @ np.log(0.9 * now + 0.1 * chance[:, k])) for k in left]
        pick = left[int(np.argmax(gains))]
        some = [*chosen, pick]
        part = chance[:, some]
        weights = np.append(share * 0.9, 0.1)
        for _ in range(rounds):
            joint = part * weights
            weights = n @ (joint / joint.sum(1, keepdims=True)) / total
        score = float(n @ (np.log(part @ weights) + floor))
        if score - best <= penalty:
            break
        chosen, share, best = some, weights, score
        left.remove(pick)
    return chosen, share


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], columns: list[str]) -> DataFrame:
    """The named columns of each row with lang_pred, score (its share) and langs (all selected ones)."""
    names, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs.astype(np.float32))  # BUCKETS x at most MAX_LANGUAGES

    def guess(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_of = shared.value
        for frame in frames:
            out = []
            for text in frame["text"]:
                found = grams(whole(text))
                if not len(found) or not names:
                    out.append(("und", 0.0, ""))
                    continue
                chosen, share = mixture(found, table_of)
                top = int(np.argmax(share))
                order = np.argsort(-share, kind="stable")
                out.append((names[chosen[top]], float(min(1.0, max(0.0, share[top]))), ",".join(names[chosen[k]] for k in order)))
            made = frame[columns].copy()
            made["_lang_pred"], made["_score"], made["_langs"] = zip(*out) if out else ([], [], [])
            yield made

    kept = docs.select(*dict.fromkeys([*columns, "text"]))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return in_frames(kept, guess, f"{fields}, _lang_pred string, _score double, _langs string")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = identify(docs, train(docs), ["doc_id"])
    return found.select(
        "doc_id", (folds() == 0).alias("held_out"), F.col("_lang_pred").alias("lang_pred"),
        F.col("_score").alias("score"), F.col("_langs").alias("langs"),
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The rows in a known language; rows that are ``und`` go. Columns stay as they are."""
    columns = docs.columns
    found = identify(docs, train(docs), columns)
    return found.filter(F.col("_lang_pred") != "und").select(*columns)
