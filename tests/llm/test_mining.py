"""Phrases, fingerprints and whitening against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import make, sample  # noqa: F401
from pyspark.sql import functions as F

from pagelens.llm import phrases, spectrum, whitening, winnowing

# -- phrases


def plain_phrases(rows, least, longest=5, top=2000, absorbed=100):
    found, total = Counter(), Counter()
    fold = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        piece = []
        for c in (text or "").translate(fold) + "\n":
            if c not in ".,;:!?\n\x0b\x0c\r":
                piece.append(c)
                continue
            words = [w for w in "".join(piece).replace("\t", " ").split(" ") if w]
            piece = []
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for k in range(len(words) - n + 1):
                    found[lang, tuple(words[k : k + n])] += 1
    out = {}
    for (lang, p), a in found.items():
        if len(p) < 2 or a < least:
            continue
        longer = [q for (other, q), b in found.items() if other == lang and len(q) > len(p) and b >= least and 100 * b >= absorbed * a]
        if any(q[k : k + len(p)] == p for q in longer for k in range(len(q) - len(p) + 1)):
            continue
        cuts = [(1000 * a * total[lang] // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), found[lang, p[:k]], found[lang, p[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, total[lang], -score)
        for lang, some in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(some)[:top], 1)
    )


def phrase_rows():
    rng = random.Random(5)
    rows = []
    for k in range(240):
        words = [rng.choice(["New", "york", "the", "big", "apple", "Éa", "x\x00y", "\xa0", "of"]) for _ in range(rng.randrange(30))]
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "! "]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text + "the united states of america. " * (k % 4)))
    return rows + [("en", None), ("fr", ""), ("en", "... ,;"), (None, "word")] + rows[:30]


@pytest.mark.parametrize("shard_words, absorbed", [(1_000_000, 100), (60, 100), (300, 60)])
def test_phrases_equal_plain_counts(spark, shard_words, absorbed, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 50)
    rows = phrase_rows()
    docs = spark.createDataFrame([(None, t, lang, 1) for lang, t in rows], "doc_id long, text string, lang string, f int").coalesce(2)
    got = phrases.collocations(docs, least=8, top=25, absorbed=absorbed, shard_words=shard_words)
    assert sorted(map(tuple, got.drop("longer").collect())) == plain_phrases(rows, 8, top=25, absorbed=absorbed)


def test_phrases_of_nothing(spark, make):
    assert phrases.collocations(make([])).count() == 0
    assert phrases.collocations(make([None, "", "a b"])).count() == 0


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000
    row = spark.createDataFrame([(big, big, 1, 2)], "a long, n long, l long, r long")
    text = "CAST(CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) * 1000 AS DECIMAL(38, 0)) / 1"
    assert int(row.select(F.expr(text)).first()[0]) == 1000 * big * big


def test_both_directions_agree():
    rng = np.random.default_rng(3)
    symbols = np.append(rng.integers(0, 6, 500), 0)
    shard = phrases.Shard.of(symbols)
    low = shard.left.first[1:-1]
    count = np.diff(shard.left.first)[1:]
    rights = shard.right.extend(low, low, count)
    lefts = shard.left.extend(low, low, count)
    right = {(int(w) + 1, int(s)): int(n) for w, s, _, _, n in zip(*rights)}
    left = {(int(s), int(w) + 1): int(n) for w, s, _, _, n in zip(*lefts)}
    plain = Counter((a, b) for a, b in zip(symbols.tolist(), symbols[1:].tolist()) if a and b)
    assert right == left == dict(plain)


# -- fingerprints

def plain_print(text):
    codes, k, w = [ord(c) for c in text], winnowing.GRAM, winnowing.WINDOW
    grams = []
    for at in range(max(1, len(codes) - k + 1) if codes else 0):
        value = 0
        for c in codes[at : at + k]:
            value = (value * winnowing.BASE + c) % winnowing.PRIME
        grams.append(value)
    chosen = set()
    for at in range(max(1, len(grams) - w + 1) if grams else 0):
        window = grams[at : at + w]
        chosen.add(at + max(i for i, g in enumerate(window) if g == min(window)))
    return [(grams[i], i) for i in sorted(chosen)]


def plain_likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def plain_fingerprints(rows):
    rows = [(i, t or "") for i, t in rows]
    out = []
    for at, (i, text) in enumerate(rows):
        follow = rows[(at + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + follow[:cut]
        own, new, other = plain_print(text), plain_print(edited), plain_print(follow)
        out.append((
            i, len(text), hashlib.sha256(edited.encode()).hexdigest(), ",".join(f"{h}:{p}" for h, p in own),
            ",".join(f"{h}:{p}" for h, p in new), plain_likeness(own, new), plain_likeness(own, other)))
    return out


def test_fingerprints_equal_plain(spark, sample, monkeypatch):
    monkeypatch.setattr(winnowing, "BLOCK_BITS", 3)
    rng = random.Random(1)
    texts = [None, "", "a", "abc", "x" * 15, "x" * 16, "x" * 31, "x" * 200, "é😀" * 40, " \n\t" * 30, "same text again " * 9, "same text again " * 9]
    texts += ["".join(rng.choice("ab") for _ in range(n)) for n in range(1, 60)]
    texts += ["".join(rng.choice("abcdefgh ") for _ in range(40_000)), "", "end"]
    rows = [(k * 7 - 50, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, _key string, _seq int")
    assert sorted(map(tuple, winnowing.fingerprints(docs.repartition(5)).collect())) == plain_fingerprints(rows)
    big = [(r["doc_id"], r["text"]) for r in sample.select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted(map(tuple, winnowing.fingerprints(sample).collect())) == plain_fingerprints(big)


def test_fingerprints_of_ids_that_are_null_or_repeated(make):
    texts = ["one text for the last of all, as it stands"] * 3 + ["a null id with its own words here", None]
    got = winnowing.fingerprints(make(texts, ids=[2**53 + 1, 2**53 + 1, 2**53 + 2, None, None])).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([2**53 + 1] * 2 + [2**53 + 2] + [None] * 2)
    same = [r for r in got if r["doc_id"] is not None]
    assert len({r["fingerprint"] for r in same}) == 1 and sorted(r["near_next"] for r in same)[1:] == [1.0, 1.0]
    assert winnowing.fingerprints(make([])).count() == 0
    alone = winnowing.fingerprints(make(["only one document, followed by itself"])).first()
    assert alone["near_next"] == 1.0


def test_shared_passages_share_a_hash():
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    for k in range(40):
        a, b = ("".join(rng.choice("klmnop ") for _ in range(k * 3 + d)) for d in (0, 50))
        one, two = plain_print(a + passage + b), plain_print(b + passage + a)
        assert {h for h, _ in one} & {h for h, _ in two}


def test_fingerprint_plan_has_no_python(sample):
    plan = winnowing.fingerprints(sample)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.count("Window") and "CartesianProduct" not in plan


# -- whitening

def spread(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("matrix", [
    spread([5, 5, 5, 3, 3, 1, *[0.5] * 20]), spread([5, 5 - 1e-8, 5 - 2e-8, 3, 3 - 1e-12, *[1] * 9]), np.eye(12), np.zeros((5, 5)),
    spread([1, *[0] * 30]), spread(list(10.0 ** -np.arange(40))), np.array([[2.0]]), np.array([[0.0, 1], [1, 0]]),
    np.kron(np.eye(8), np.array([[0.0, 1], [1, 0]])), spread(list(range(-20, 20))),
])
def test_leading_pairs(matrix):
    values, vectors = spectrum.leading_pairs(matrix, 8)
    scale = np.abs(matrix).sum(axis=1).max() + 1e-300
    want = np.sort(np.linalg.eigvalsh(matrix))[::-1][:8]
    assert np.abs(values - want).max() <= 1e-13 * scale
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() <= 1e-12 * scale
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() <= 1e-13


def test_inertia_of_whole_numbers():
    rng = np.random.default_rng(4)
    for n in range(1, 25):
        a = rng.integers(-3, 4, (n, n)).astype(float)
        assert spectrum.negative_pivots(a + a.T) == (np.linalg.eigvalsh(a + a.T) < -1e-9).sum()


def test_whitening_equals_plain(spark):
    rng = np.random.default_rng(7)
    good = (rng.standard_normal((300, 10)) * np.linspace(0.2, 3, 10)).tolist()
    rows = [(2**53 + 1 + k, v) for k, v in enumerate(good)]
    bad = [(1, None), (2, [1.0, None] + [0.0] * 8), (3, [float("nan")] * 10), (4, [float("inf")] * 10), (5, []), (6, [1.0])]
    docs = spark.createDataFrame([(i, v, 1) for i, v in [*rows, (None, good[0]), *bad]], "vec_id long, embedding array<double>, component int")
    everything = whitening.whiten(docs.repartition(7))
    assert everything.count() == 301 * 8
    got = everything.filter("vec_id IS NOT NULL").toPandas()
    x = np.floor(1024 * np.array([*good, good[0]])).astype(np.int64) + 100_000
    n = len(x)
    y = n * x - x.sum(axis=0)
    z = x - x.sum(axis=0) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    want = z @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    assert len(got) == 2400 and (got["n"] == n).all() and got["identity_error"].max() < 1e-10
    got = got.sort_values(["vec_id", "component"])
    assert got["vec_id"].iloc[0] == 2**53 + 1
    assert np.abs(np.abs(got["whitened"].to_numpy().reshape(-1, 8)) - np.abs(want[:-1])).max() < 1e-9
    assert (got["deviation"].to_numpy().reshape(-1, 8)[:, 0] == (y * y).sum(axis=1)[:-1]).all()
    assert np.abs(got["explained"].to_numpy()[:8] - values[::-1][:8] / values.sum()).max() < 1e-12


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    still = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)).collect()
    assert len(still) == 4 and {(r["whitened"], r["explained"], r["deviation"]) for r in still} == {(0.0, 0.0, 0)}
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 4.0])], schema)).collect()
    assert len(huge) == 6 and {r["deviation"] for r in huge if r["vec_id"] != 3} == {None}
    assert max(r["identity_error"] for r in huge) < 1e-4
