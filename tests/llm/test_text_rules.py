"""Per-document operators: quality, secrets, personal data, language and packing."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import make, sample  # noqa: F401

from pagelens.llm import language, packing, private, quality, secrets
from pagelens.llm.common import words_of

ODD = ["", None, " \n\t", "x", " a\x00b\xa0c", "é" * 3000, "a " * 5000, "A.B@c-d.e.f_g@h.ij k@l", "😀 a@b.co 😀"]


def extended(df):
    """The same rows with columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    return df.withColumns({"_key": F.lit(1), "n": F.lit("x"), "uid": F.lit(2), "key": F.lit("k"), "words": F.lit(0.5), "_score": F.lit(1)})


# -- quality

def plain_quality(text):
    words = words_of(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n")]
    dup = sum(1 for i, line in enumerate(lines) if line.strip(" \t\n\x0b\x0c\r") and line in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_counts(make, sample):
    texts = ODD + ["a b c a b c", "x\nx\n\nx", "l\r\nl\r\nl"] + [r["text"] for r in sample.select("text").limit(40).collect()]
    got = quality.judge_quality(extended(make(texts))).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]]
        assert tuple(r[f] for f in quality.FEATURES) == plain_quality(text)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_follows_labels(sample, spark):
    from conftest import DATA

    got = quality.query(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").join(got, "doc_id").collect()
    assert not any(r["kept"] for r in labels if r["quality"] == 0)
    assert all(r["kept"] or r["base_failed"] for r in labels if r["quality"] == 1)


def test_quality_empty_and_repeated(make):
    assert quality.judge_quality(make([])).count() == 0
    assert quality.judge_quality(make(["a b"] * 3, ids=[1, 1, None])).count() == 3


# -- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


SECRETS = [
    'Token = "abcdef123", api_key:short, APIKEY==xyz.123-', "AKIA" + "A1" * 8 + " AKIAAKIA1 " + "AKIA" * 6,
    "f" * 23 + " " + "0a" * 40 + "g", "passwdpassword: secret: token=abcdefg", "paſſword: abcdefgh toKen=abcdefgh",
    "secret" * 50 + "=abcdefgh", "token = token = token = zzzzzz",
]


def test_secrets_match_plain_patterns(make, sample):
    texts = SECRETS + ODD + [r["text"] for r in sample.select("text").collect()]
    for r in secrets.scan_secrets(extended(make(texts))).collect():
        want = plain_secrets(texts[r["doc_id"]] or "")
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in want) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(secrets.joined(want).encode()).hexdigest()


def test_checksum_token():
    body = "a1B2" * 7 + "Zz"
    value, tail = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        tail = secrets.BASE62[d] + tail
    good = "ghp_" + body + tail.rjust(6, "0")
    text = f"see {good} and {good[:-1]}{'0' if good[-1] != '0' else '1'} end"
    assert secrets.find_secrets(text) == [(4, 3, 4 + len(good))]
    assert secrets.masked(text).startswith("see <checked> and ghp_")


def test_masking_keeps_clean_documents(make):
    got = {r["doc_id"]: r for r in secrets.mask_secrets(make(["clean text", "token=abcdef1 x", None, ""])).collect()}
    assert [got[k]["text"] for k in range(4)] == ["clean text", "<assign> x", None, ""]
    assert [got[k]["n_chars"] for k in range(4)] == [10, 10, None, 0]


# -- personal data

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_private(text):
    spans = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            spans.append((m.start(), kind, m.end()))
    return ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


PRIVATE = [
    "a@b.c_d@e.f g@h i@j.k.l-m. n@o..p", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0004 0000255.1.1.1", "4111 1111 1111 1111 x 4111-1111  1111",
    "+1 (487) 555-7209 +12 +123456789012345678 ++49 170 1234567.", "00000000000000", "1 2 " * 3000, "9" * 20000, "a." * 5000 + "@b.c",
    "x@" + "y." * 4000 + "z", "é@b.cc 😀1.2.3.4", "1.2.3", "+1" + "-" * 3000,
]


def test_private_base_spans(make, sample):
    texts = PRIVATE + ODD + [r["text"] for r in sample.select("text").collect()]
    got = private.find_private(extended(make(texts))).select("doc_id", private.named("base").alias("s")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["s"] == plain_private(texts[r["doc_id"]] or "")


def test_revealing_terms(make):
    fill = [f"plain words number{i} here only filler{i} text" for i in range(300)]
    near = [f"alpha{i} said Quentinson writes bob@x.org about{i} the" for i in range(5)]
    texts = near + ["Quentinson alone"] + fill + [f"the {i} the a{i}" for i in range(20)] + [near[0]] * 4
    got = {r["doc_id"]: r for r in private.sanitise(make(texts)).collect()}
    assert got[0]["text"] == "alpha0 <term> <term> <term> <email> about0 the"  # words mostly near the address
    assert got[5]["text"] == "Quentinson alone"
    assert got[20]["text"] == texts[20] and got[20]["spans"] == ""
    assert got[len(texts) - 1]["text"] == got[0]["text"]


def test_revealing_terms_in_whole_documents(make):
    far = " ".join(["the"] * 40)  # more than 100 code points
    texts = [f"Quentinson writes {far} bob@x.org", f"x{far} bob@x.org and then Quentinson", "Quentinson alone", "the alone and then writes"]
    texts += [f"bob@x.org the {far} alone QUENTINSON."]
    texts += [f"the number{i} and then writes alone" for i in range(100)]
    near = {r["doc_id"]: r["text"] for r in private.sanitise(make(texts)).collect()}
    assert near[0] == f"<term> writes {far} <email>" and near[1].endswith("<email> and then <term>")
    assert near[2] == texts[2] and near[4] == f"<email> the {far} alone <term>."
    got = {r["doc_id"]: r["text"] for r in private.sanitise(make(texts), everywhere=True).collect()}
    assert [got[k] for k in (0, 1, 4)] == [near[k] for k in (0, 1, 4)] and got[2] == "<term> alone"
    assert all(got[k] == texts[k] for k in range(3, len(texts)) if k != 4)


def test_private_plan_has_no_python(sample):
    plan = private.find_private(sample)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_private_empty(make):
    assert private.find_private(make([])).count() == 0
    assert private.find_private(make(["a@b.cc"] * 2, ids=[None, None])).count() == 2


# -- language

def test_language_held_out_accuracy(spark, sample):
    from conftest import DATA

    got = language.query(spark, DATA).join(sample.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_language_edges(make):
    english, french = "the thing that was with them ", "être déjà où les çà même "
    texts = [english * 9, french * 9] * 6 + ["", None, "123 !!", english * 5 + french * 5]
    langs = ["en", "fr"] * 6 + ["en", None, "en", None]
    docs = make(texts, langs=langs)
    found = {r["doc_id"]: r for r in language.identify(docs, language.train(docs), ["doc_id"]).collect()}
    assert [found[k]["_lang_pred"] for k in (0, 1, 12, 13, 14)] == ["en", "fr", "und", "und", "und"]
    assert set(found[15]["_langs"].split(",")) == {"en", "fr"}
    assert 0.3 < found[15]["_score"] < 0.7
    assert language.accepted(docs).count() == len(texts) - 3
    assert language.accepted(docs).columns == docs.columns
    none = make(["some text"], langs=[None])
    assert [r["_lang_pred"] for r in language.identify(none, language.train(none), ["doc_id"]).collect()] == ["und"]
    assert language.accepted(make([])).count() == 0


def test_language_of_a_text_in_six_languages(make):
    # each language has letters of its own
    texts = [" ".join(chr(97 + 4 * k + (i * 7 + j * j) % 4) * 2 + chr(97 + 4 * k + (i + j) % 4) for i in range(9) for j in range(9)) for k in range(6)]
    names = [f"l{k}" for k in range(6)]
    docs = make(texts * 6 + [" ".join(texts)], langs=names * 6 + [None])
    found = {r["doc_id"]: r for r in language.identify(docs, language.train(docs), ["doc_id"]).collect()}
    assert [found[k]["_langs"] for k in range(6)] == names
    assert set(found[36]["_langs"].split(",")) == set(names)
    assert found[36]["_score"] < 0.25


# -- packing

def test_ids_equal_the_tokenizers_file(sample):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.tokenizer(None)
    texts = [t for t in ODD if t is not None] + PRIVATE[:5] + ["<|endoftext|>x<|endoftext|>", "it's  we'll\n\n  \t x", "日本語 ١٢٣ ½"]
    for text in texts + [r["text"] for r in sample.select("text").limit(60).collect()]:
        assert packing.encode(fast, text).tolist() == [*slow.encode(text, add_special_tokens=False).ids, 1]


def test_packing_holds_every_id_once(make, sample):
    texts = ODD + ["word " * 9000] + [r["text"] for r in sample.select("text").collect()]
    rows = packing.pack(extended(make(texts))).collect()
    turn = packing.tokenizer(None)
    want = {k: packing.encode(turn, t or "") for k, t in enumerate(texts)}
    at = Counter()
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids)
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] += r["length"]
    assert at == {k: len(v) for k, v in want.items()}
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= packing.WINDOW
    assert sum(v < packing.WINDOW for v in fill.values()) <= make(texts).rdd.getNumPartitions()


def test_packing_empty(make):
    assert packing.pack(make([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_placement_minimises_sum_of_squares(seed):
    rng = np.random.default_rng(seed)
    packer, window = packing.Packer(20), 20
    for k, size in enumerate(rng.integers(1, 20, 300)):
        before = packer.count.copy()
        options = []
        for level in [0, *np.flatnonzero(before[: window - size + 1])]:
            after = before.copy()
            if level:
                after[level] -= 1
            if level + size < window:
                after[level + size] += 1
            options.append(int((after**2).sum()))
        packer.place(int(size), k)
        assert int((packer.count**2).sum()) == min(options)
        assert all(packer.count[level] == len(held) for level, held in packer.levels.items())
