"""Operators over the whole corpus: similarity join, repeats, decontamination, scoring, quotes, and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import make, sample  # noqa: F401

from pagelens.llm import decontaminate, jaccard, quotes, repeats, scoring, trie

LOW = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
SPACES = " \t\n\x0b\x0c\r"


def clash(df):
    from pyspark.sql import functions as F

    return df.withColumns({"key": F.lit("k"), "uid": F.lit(2), "anchor": F.lit(1), "held": F.lit("h"), "_set_key": F.lit(0), "rep": F.lit(1)})


def words(seed, n, vocabulary=5000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# -- similarity join

def plain_links(texts):
    sets = []
    for text in texts:
        w = (text or "").translate(LOW).split()
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    links, root = Counter(), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j > i}:
            common = len(s & sets[j])
            if common >= 0.8 * (len(s) + len(sets[j]) - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(find(i), links[i]) for i in range(len(texts))]


def near_copies():
    texts = [None, "", " ", "one", "one", "a b c", "A b C", "a b c d e", "a b c d e f"]
    for k in range(12):
        base = words(k, 60 + 10 * k)
        texts += [" ".join(base)] * (k % 4)
        for e in range(5):
            edited = list(base)
            for at in random.Random(k * 10 + e).sample(range(len(base)), e):
                edited[at] = f"edit{k}{e}"
            texts.append(" ".join(edited))
    base = words(99, 200)
    for k in range(330):  # one large group of near copies: more than one block
        edited = list(base)
        edited[k % 200] = f"x{k}"
        texts.append(" ".join(edited))
    return texts


def test_join_equals_brute_force(make, sample):
    texts = near_copies() + [r["text"] for r in sample.select("text").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.link_documents(clash(make(texts))).collect()}
    assert [got[k] for k in range(len(texts))] == plain_links(texts)


def test_pruning_bound_keeps_pairs_at_the_threshold():
    bound = jaccard.least_equal()
    for n in (16, 32, 64):
        miss = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(bound[n]))
        assert miss < 1e-5
    assert bound[64] > 20


def test_one_of_each_class_stays(make):
    texts = ["same words here to read now"] * 3 + ["", None, "other text of six whole words"] + ["same words here to read now"]
    docs = make(texts, ids=[5, 3, 3, 7, 8, None, None])
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted(
        [("3", texts[0]), ("7", ""), ("8", ""), ("None", texts[5])]
    )
    assert jaccard.link_documents(make([])).count() == 0


# -- repeated strings

def plain_repeats(texts, span=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[s : s + span] for d in data for s in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - span + 1):
            if seen[d[s : s + span]] > 1:
                gone[s : s + span] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefghij é") for _ in range(900))
    noise = ["".join(rng.choice("klmnopqrst ") for _ in range(700)) for _ in range(30)]
    texts = [None, "", "x" * 399, "x" * 400, "y" * 400, "y" * 900, "ab" * 600]
    for k in range(14):
        length = 385 + 4 * k
        texts.append(noise[k] + passage[k * 20 : k * 20 + length] + noise[k + 14])
    edited = list(passage)
    edited[450] = "Z"
    return texts + [passage, passage, "".join(edited), noise[0] * 2, passage[:399], passage[-400:]]


def test_repeats_equal_brute_force(make):
    texts = repeat_texts()
    got = {r["doc_id"]: tuple(r)[1:5] for r in repeats.remove_repeats(clash(make(texts))).collect()}
    want = plain_repeats(texts)
    for k in range(len(texts)):
        assert got[k] == want[k], k


def test_repeats_of_repeated_rows_and_null_ids(make):
    text = " ".join(words(1, 120))
    got = repeats.remove_repeats(make([text, text, "short", " ".join(words(2, 120))], ids=[None, 4, 4, 4])).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got)[-3:] == sorted(
        [(len(text), len(text)), (len(text), len(text)), (len(" ".join(words(2, 120))), 0)]
    )
    assert repeats.remove_repeats(make([])).count() == 0


def test_phrases_depend_on_their_own_bytes():
    rng = np.random.default_rng(5)
    middle = rng.integers(0, 256, 3000, dtype=np.uint8).tobytes()
    found = []
    for head in (b"", b"q" * 37, rng.integers(0, 256, 500, dtype=np.uint8).tobytes()):
        data = head + middle
        triggers = {}
        for start, size, at in repeats.phrases(data):
            for s in range(start, start + size):
                triggers[s - len(head)] = at - len(head)
        found.append({s: t for s, t in triggers.items() if s >= 0})
    assert found[0] == found[1] == found[2] and len(found[0]) == 2601


# -- decontamination

def plain_hits(texts, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = decontaminate.item_words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])] |= set() if item is None else {str(item)}
    lengths = {len(k) for k in windows}
    out = []
    for text in texts:
        w, hit, found = decontaminate.item_words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [16_000_000, 100])
def test_decontamination_equals_brute_force(spark, make, monkeypatch, tmp_path, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    vocabulary = "alpha beta gamma delta eta ÉTA zeta2 iota kappa my".split()
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for k in range(2, 14)]
    items += [(14, ""), (None, "alpha beta"), (15, None), (16, items[5][1])]
    texts = [None, "", "...", "alpha" * 3] + [", ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 200]))) for _ in range(30)]
    texts += ["Noise " + t.upper() + " noise" for _, t in items if t] + [items[0][1] * 3]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    make(texts).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in decontaminate.query(spark, str(tmp_path)).collect()}
    for k, want in enumerate(plain_hits(texts, items)):
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == want, texts[k]
        assert r["contaminated"] == (want[1] > 0)


def test_passages_are_cut_and_clean_documents_stay(spark, make):
    passage = " ".join(f"item{k}" for k in range(12))
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = make([f"Before, {passage.upper()}! After", passage, "clean text", None])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontaminate.decontaminated(docs, benchmark).collect()}
    assert got == {0: ("Before, ! After", 15), 2: ("clean text", 10), 3: (None, None)}
    assert decontaminate.decontaminated(docs, benchmark.limit(0)).count() == 4
    assert decontaminate.decontaminated(make([]), benchmark).count() == 0


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    symbols = np.append(rng.integers(1, 6, 500), 0)
    index = decontaminate.FmIndex(symbols)
    patterns = rng.integers(1, 6, (40, 3))
    low, high = index.search(patterns)
    for p, lo, hi in zip(patterns, low, high):
        want = [i for i in range(498) if (symbols[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


# -- scoring

def test_scores_equal_the_formula(make, sample):
    texts = [None, "", " ", "one Two two", "\x00 é\xa0x"] + [r["text"] for r in sample.select("text").collect()]
    rows = {r["doc_id"]: r for r in scoring.score_documents(clash(make(texts))).collect()}
    tokens = [[w for w in (t or "").translate(LOW).replace("\t", " ").replace("\n", " ").split(" ") if w] + ["</s>"] for t in texts]
    train = [zlib.crc32(str(k).encode()) % 7 != 2 for k in range(len(texts))]
    one, two = Counter(), Counter()
    for t, learn in zip(tokens, train):
        if learn:
            one.update(t)
            two.update(zip(["<s>", *t], t))
    n, v = sum(one.values()), len(one)
    context = one | Counter({"<s>": sum(train)})
    for k, t in enumerate(tokens):
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for a, b in zip(["<s>", *t], t):
            c, more = context[a], 1 + context[a] ** scoring.HEAPS
            score += math.log10((two[a, b] + more * (one[b] + 1) / (n + v + 1)) / (c + more))
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train[k], len(t), sum(one[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, abs=2e-4 * len(t))
    held = [rows[k] for k in range(len(texts)) if not train[k]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scoring_empty(make):
    assert scoring.score_documents(make([])).count() == 0
    assert scoring.score_documents(make(["a b"] * 3, ids=[None, 1, 1])).count() == 3


@pytest.mark.parametrize("size, block", [(0, 4), (1, 4), (900, 4), (900, 1 << 16)])
def test_trie_finds_all_and_only_its_pairs(monkeypatch, size, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rng = np.random.default_rng(size)
    codes = np.unique((rng.integers(0, 40, size).astype(np.uint64) << np.uint64(32)) | rng.integers(0, 300, size).astype(np.uint64))
    p = rng.uniform(1e-6, 1, len(codes))
    found = trie.Trie(codes, p)
    asked = np.unique((rng.integers(0, 45, 3000).astype(np.uint64) << np.uint64(32)) | rng.integers(0, 310, 3000).astype(np.uint64))
    known = dict(zip(codes.tolist(), p))
    got = trie.restore(found.look_up(asked))
    for code, value in zip(asked.tolist(), got):
        assert value == pytest.approx(known.get(code, 0.0), rel=3e-4)


# -- quotation linking

CHAT = [
    (1, 0, "user", "How do I open it?\nIt is stuck."),
    (1, 1, "user", "Another matter"),
    (1, 2, "assistant", "> It is   STUCK.\nTurn the key"),
    (1, 3, "user", "> > It is stuck.\n> Turn the key\nThat works"),
    (1, 4, "user", "> never said\nhm"),
    (2, 0, "user", "> Another matter\nyes"),
    (2, 1, "user", None),
    (None, 2, "user", "> Turn the key\nx"),
    (1, 2, "assistant", "> It is   STUCK.\nTurn the key"),
]


def test_quotes_link_to_originals(spark):
    chat = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    rows = quotes.link_quotes(clash(chat)).collect()
    assert len(rows) == len(CHAT)
    got = {(r["conv_id"], r["turn"]): r for r in rows}
    assert got[1, 2]["text"] == "Turn the key" and (got[1, 2]["reply_conv"], got[1, 2]["reply_turn"]) == (1, 0)
    assert (got[1, 3]["reply_turn"], got[1, 3]["thread_turn"], got[1, 3]["depth"], got[1, 3]["max_level"]) == (2, 0, 2, 2)
    assert got[1, 4]["reply_turn"] is None and got[1, 4]["thread_turn"] == 4 and got[1, 4]["text"] == "hm"
    assert (got[2, 0]["reply_conv"], got[2, 0]["reply_turn"], got[2, 0]["thread_turn"]) == (1, 1, 0)
    assert got[2, 1]["text"] == "" and got[None, 2]["reply_turn"] is None
    order = sorted((r for k, r in got.items() if k[0] == 1), key=lambda r: (r["thread_turn"], r["turn"]))
    assert [r["turn"] for r in order] == [0, 2, 3, 1, 4]
    assert quotes.link_quotes(chat.limit(0)).count() == 0


def test_long_reply_chains(spark):
    chain = [(1, 0, "u", "line 0")] + [(1, k, "u", f"> line {k - 1}\nline {k}") for k in range(1, 90)]
    chat = spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")
    last = [r for r in quotes.link_quotes(chat).collect() if r["turn"] == 89][0]
    assert (last["thread_turn"], last["depth"], last["reply_turn"]) == (0, 89, 88)


# -- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline
    from conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    ids = sorted(before)
    first = {c for c, _ in plain_links([before[i] for i in ids])}
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept) <= {ids[k] for k in first}
    assert len(kept) >= 0.95 * len(first)
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in packed} == set(kept)
