"""Tokenizer automaton, packing and residue."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from meshwright.llm import bpe, packing, residue

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_TOKENIZER), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(bpe.Automaton(**bpe.read_merges(bpe.DEFAULT_TOKENIZER)))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return t


def split(ids, totals):
    ends = np.cumsum(totals)
    return [ids[e - n : e].tolist() for e, n in zip(ends, totals)]


def test_same_ids_as_the_library(encoder, library):
    rng = random.Random(3)
    letters = "aab cc  the in er\n'sé日本\U0001f600​01x　   \t\r\x1c."
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(500)]
    texts += ["", "<|endoftext|> x", "a" * 5000, " " * 3000, "\n " * 50, "日本" * 700, "foo  ", "foo \n bar", "​﻿"]
    got = split(*encoder.encode(texts))
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert all(encoder.automaton.decode(ids) == t.encode() for ids, t in zip(got, texts))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(encoder, library, text):
    ids = encoder.encode([text])[0].tolist()
    assert encoder.automaton.decode(ids) == text.encode() and ids == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", max_size=12), st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=12))
def test_any_merge_list(word, wanted):
    """Arcs and encodings of arbitrary small merge lists against merging step by step."""
    spelled = {0: b"a", 1: b"b"}
    merges = []
    for a, b in wanted:
        if a in spelled and b in spelled and spelled[a] + spelled[b] not in spelled.values():
            c = len(spelled)
            spelled[c] = spelled[a] + spelled[b]
            merges.append((a, b, c))
    machine = bpe.Automaton(spelled, merges)
    tokens = [0 if x == "a" else 1 for x in word]
    rank = {(a, b): k for k, (a, b, _) in enumerate(merges)}
    while True:
        found = min(((rank[p], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in rank), default=None)
        if found is None:
            break
        k, i = found
        tokens[i : i + 2] = [merges[k][2]]
    if word:
        assert machine.encode_word(word.encode()) == tokens
        ids, counts = machine.encode_words([word.encode(), b"ab", b"a"])
        assert ids[: counts[0]].tolist() == tokens


def test_encode_column_defines_null_and_empty(spark, library):
    rows = [(1, None), (2, ""), (3, "two  words"), (3, "two  words"), (None, "x"), (5, "z" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("clash")).withColumn("ids", F.lit(0))
    got = {(r.doc_id, tuple(r.ids)) for r in bpe.encode_column(df, "doc_id", "text").collect()}
    want = {(k, tuple(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows}
    assert got == want and (1, ()) in got and (2, ()) in got
    counts = {(r.doc_id, r.n_tokens) for r in bpe.encode_column(df, "doc_id", "text", counts_only=True).collect()}
    assert counts == {(k, len(t)) for k, t in want}
    assert bpe.encode_column(df.limit(0), "doc_id", "text").collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 40), st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=6))
def test_fullest_is_optimal(room, sizes):
    ordered = sorted(sizes, reverse=True)
    taken = packing.fullest(room, ordered, [sizes[s] for s in ordered])
    sums = {0}
    for s, n in sizes.items():
        sums = {t + s * k for t in sums for k in range(n + 1) if t + s * k <= room}
    assert all(0 < k <= sizes[s] for s, k in taken.items()) and sum(s * k for s, k in taken.items()) == max(sums)


def test_packing_keeps_everything(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([0, 1, 7, 300, 700, 1024, 2048, 2049, 5000, rng.randrange(1, 3000)])) for k in range(3000)] + [(10_000, None)]
    rows += [(20_000 + k, 333) for k in range(2000)] + rows[:50]
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumn("unit", F.lit(0)).withColumn("rank0", F.lit(0))
    out = packing.pack(df, "doc_id", "n").collect()
    assert len({(r.doc_id, r.piece) for r in out}) == len(out)
    size, room = {}, {}
    for r in out:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.piece_size
        room[r.container_id] = room.get(r.container_id, 0) + r.piece_size
        assert r.piece == 0 or dict(rows)[r.doc_id] > 2048
    assert size == {k: n or 0 for k, n in rows}
    assert max(room.values()) <= 2048 and sorted(room) == list(range(len(room)))
    assert sum(size.values()) / (2048 * len(room)) > 0.98
    assert packing.pack(df.limit(0), "doc_id", "n").collect() == []


PATENT = "ABSTRACT\nA valve comprises a hinged lever {0} and a porous seat {1}.\n\nDESCRIPTION\nThe hinged lever {0} locks the porous seat {1}. {2}\n\nCLAIMS\n1. A valve, comprising a hinged lever {0}."
BAD = [
    "Please enable JavaScript to view this page.", "404 Not Found", "Fehler 404: Die angeforderte Seite wurde nicht gefunden.", "请启用JavaScript以查看此页面。", "[your text here]",
    "The <%= title %> baffle is worn.", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do.", "__REF_NO__", "ページが見つかりません。URLをご確認ください。", "A {{figure}}, comprising a lever 12.",
]
FINE = [
    "An error message reading 'page not found' is displayed on the panel until the knurled cam 82 is reset.", "The variables ${name} and ${mass} in the stored recipe are bound when the porous seat 4 starts.",
    'A template engine replaces a field such as "{{valve_id}}" with the value read by the porous seat 4.', r"(6)  F = k_{1}·(T − T₀)/√(λ", r"\left( \begin{array}{cc} a & b \\ c", "[0002] It is worn.",
    "If scripts are disabled in the browser, the operating panel shows a notice asking the user to enable JavaScript before the porous seat 78 is released.",
]


def test_residue_in_any_part(spark):
    rows = [(k, PATENT.format(2 * k, 3 * k, b)) for k, b in enumerate(BAD)] + [(50, BAD[0]), (51, "It is worn. " * 20_000 + "\n" + BAD[1])]
    rows += [(100 + k, PATENT.format(2 * k, 3 * k, f)) for k, f in enumerate(FINE)] + [(200, None), (201, ""), (202, " \n\t"), (None, "fine"), (203, PATENT[:31])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("residue", F.lit("clash")).withColumn("k", F.lit(1))
    got = {r.doc_id for r in residue.mark_residue(df, "doc_id", "text").filter("residue").collect()}
    assert got == {*range(len(BAD)), 50, 51}
    assert residue.mark_residue(df.limit(0), "doc_id", "text").collect() == []


def test_weak_labels():
    assert [residue.weak_label(b) for b in BAD if "URL" not in b] == [1] * (len(BAD) - 1)
    assert all(residue.weak_label(f) <= 0 for f in FINE)


def test_hosts_that_were_not_trained_on(spark):
    rng = random.Random(1)
    rows = [(k, f"host{k % 10}", PATENT.format(2 * k, 3 * k, rng.choice(BAD) if k % 12 == 0 else rng.choice(FINE + ["It is worn."]))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string")
    scores = residue.validate(df, "doc_id", "text", "host", folds=2)
    assert scores and all(s["accuracy"] > 0.97 for s in scores)


def test_long_words_side_by_side(encoder, library):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeé日") for _ in range(rng.randrange(250, 400))) for _ in range(60)] + ["ab" * 900, "日" * 300]
    assert split(*encoder.encode(words)) == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_a_small_table_of_transitions_gives_the_same_ids(monkeypatch, library):
    monkeypatch.setattr(bpe, "ARC_SLOTS", 1 << 4)
    monkeypatch.setattr(bpe, "_SHIFT", 60)
    small = bpe.TextEncoder(bpe.Automaton(**bpe.read_merges(bpe.DEFAULT_TOKENIZER)))
    texts = ["The hinged lever 12 locks the porous seat 4, whatever the transitions.", "日本語の明細書です。", "x" * 300]
    assert split(*small.encode(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
