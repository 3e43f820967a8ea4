"""Ids beyond doubles beside nulls, very long texts, items without an id, quotes of all levels, near copies."""

import time

import pytest
from llm_fixtures import make, sample  # noqa: F401

from pagelens.llm import decontaminate, jaccard, language, packing, private, quality, quotes, repeats, scoring, secrets

BIG = 2**53 + 1


@pytest.mark.parametrize("query", [scoring, quality, private, repeats, packing, secrets, decontaminate, jaccard, language])
def test_ids_beside_nulls_stay_exact(spark, make, tmp_path, query):
    texts = ["a few words stand here to be read", None, "", "a few words stand here to be read", "other words"]
    make(texts, ids=[BIG, None, None, None, BIG + 1], langs=["en"] * 5).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", "few words stand")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = [r["doc_id"] for r in query.query(spark, str(tmp_path)).collect()]
    assert sorted((i is None, i or 0) for i in ids) == [(False, BIG), (False, BIG + 1)] + [(True, 0)] * 3


def test_conversation_ids_stay_exact(spark):
    rows = [(BIG, 0, "u", "x"), (None, 1, "u", "y"), (BIG, None, "u", "z")]
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = [(r["conv_id"], r["turn"]) for r in quotes.link_quotes(chat).collect()]
    assert sorted(got, key=str) == sorted([(BIG, 0), (None, 1), (BIG, None)], key=str)


def test_long_runs_of_blanks_are_packed(make):
    for text in (" " * 2_000_000, "\n" * 1_000_000 + "end"):
        pieces = packing.pack(make([text])).collect()
        assert {r["doc_tokens"] for r in pieces} == {len(packing.slow_tokenizer(None).encode(text, add_special_tokens=False).ids) + 1}
        assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"]


def test_items_without_id_are_hit(spark, make):
    docs = make(["some words before ten words that stand in the benchmark item here and after"])
    items = spark.createDataFrame([(None, "ten words that stand in the benchmark item here and")], "item_id string, text string")
    found = decontaminate.find_contamination(docs, items, ["text"]).first()
    assert [tuple(s) for s in found["_spans"]] == [(3, 13)] and list(found["_items"]) == []


def test_rows_without_id_are_linked_by_text(make):
    texts = [f"number {k} of some words that differ from others by {k} only in {k * 7} places" for k in range(40)]
    got = jaccard.link_documents(make(texts * 2, ids=[None] * 80))
    assert sorted(r["n_links"] for r in got.collect()) == [1] * 80


TALK = [
    (1, 0, "u", "alpha beta gamma delta.\nepsilon zeta eta"),
    (1, 1, "u", "> alpha beta gamma\n> delta. epsilon zeta eta\nfirst answer to it"),
    (1, 2, "u", ">> alpha beta gamma delta. epsilon zeta eta\nseen at a distance"),
    (1, 3, "u", ">> epsilon zeta eta\n> first answer to it\nboth levels"),
    (2, 0, "u", "kappa lambda mu"),
    (2, 1, "u", "> kappa lambda mu\nhere"),
    (3, 5, "u", "> kappa lambda mu\nelsewhere"),
    (3, 6, "u", "kappa lambda mu"),
    (4, 0, "u", "one line\ntwo line"),
    (4, 1, "u", "three line\nfour line"),
    (4, 2, "u", "> one line\n\n> four line\neven votes"),
]


def test_quotes_of_all_levels(spark):
    chat = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_conv"], r["reply_turn"]) for r in quotes.link_quotes(chat).collect()}
    assert got[1, 1] == (1, 0)  # wrapped anew
    assert got[1, 2] == (1, 1)  # level two only: the message that quotes it at level one
    assert got[1, 3] == (1, 1)
    assert got[2, 1] == (2, 0)
    assert got[3, 5] == (2, 0)  # the line comes again in conversation 3, but later
    assert got[4, 2] == (4, 1)  # longer text wins over the earlier turn


def test_two_near_copies_tell_nothing(make):
    words = [f"rare{k}" for k in range(40)]
    copies = [" ".join(words) + " write to bob@x.org", " ".join([*words[:20], "changed", *words[21:]]) + " write to bob@x.org"]
    texts = copies + [f"plain filler number {k} stands here" for k in range(60)]
    got = {r["doc_id"]: r["text"] for r in private.sanitise(make(texts), everywhere=True).collect()}
    assert got[0] == copies[0].replace("bob@x.org", "<email>") and got[1] == copies[1].replace("bob@x.org", "<email>")


def test_very_many_addresses_in_one_text(make):
    text = " ".join(f"u{k}@x.org" for k in range(30_000))
    began = time.perf_counter()
    found = private.find_private(make([text, "some other text"])).orderBy("doc_id").first()
    assert len(found["spans"]) == 30_000 and found["spans"][-1]["stop"] == len(text)
    assert time.perf_counter() - began < 90


def test_entities_are_counted_by_kind(spark, make, tmp_path):
    card = "4111 1111 1111 1111"
    texts = [f"1.2.3.4 then a@b.co then {card}", "a@b.co c@d.ef +1 234 567 8901 5.6.7.8", f"{card} and {card}", "+1 234 567 8901", None]
    make(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in private.query(spark, str(tmp_path)).collect()}
    assert [got[i] for i in sorted(got)] == [(1, 1, 1, 0), (2, 1, 0, 1), (0, 0, 2, 0), (0, 0, 0, 1), (0, 0, 0, 0)]
