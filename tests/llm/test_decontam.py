from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from factfold.llm import decontam
from tests.llm.helpers import documents, empty_documents, odd_documents, prose


def grams(words):
    width = min(5, len(words))
    return Counter(" ".join(words[i : i + width]) for i in range(len(words) - width + 1))


def plain(docs, items):
    """(doc, item) to the best weighted similarity of any window of the item's size; a shorter document is one window."""
    out = {}
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for d, text in docs:
        words = split(text)
        for i, item in items:
            theirs = split(item)
            if not words or not theirs or (len(theirs) < 5 and len(words) < len(theirs)):
                continue
            b, best = grams(theirs), 0.0
            for at in range(max(len(words) - len(theirs), 0) + 1):
                a = grams(words[at : at + len(theirs)])
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                out[d, i] = best
    return out


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_matches_are_those_of_brute_force(spark):
    rng = random.Random(2)
    items = [prose("aa", rng.randint(20, 60), f"item{i}") for i in range(12)] + ["one two three", "", None]
    texts = []
    for k in range(60):
        words = items[k % 12].split()
        for _ in range(k // 12):
            words[rng.randrange(len(words))] = "changed"
        texts.append(f"{prose('bb', rng.randint(0, 80), k)} {' '.join(words).upper()}, {prose('bb', 30, -k)}")
    texts += ["One, two; three!", prose("aa", 200, "clean"), "", None, "xx yy one two three zz one two three"]
    items += ["la « route » — “très” longue… c'est l’été où l'on part, dit-elle, vers le sud", "a b a b a b a b a b a b c"]
    texts += ["Bien. la route très longue c'est l'été où l'on part dit elle vers le sud, bien", "x a b a b a b a b a b a b c y", "a b a b a b a b c a b a b a b a b a b"]
    found = {(r.doc_id, r.item_id): r.similarity for r in decontam.find_leaks(documents(spark, texts), bench(spark, items)).collect()}
    want = plain(list(enumerate(texts)), list(enumerate(items)))
    assert len(want) >= 18 and {(60, 12), (64, 12), (65, 15), (66, 16)} <= want.keys()
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_several_passes_give_the_same(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    one = sorted(map(tuple, decontam.op7_decontaminate(spark, data).collect()))
    assert one and one == sorted(map(tuple, decontam.find_leaks(docs, items, max_bytes=2_000).collect()))
    kept = decontam.decontaminate(docs, items)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {r[0] for r in one}
    assert kept.schema == docs.schema


def test_query_equals_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    found = {(r.doc_id, r.item_id): r.similarity for r in decontam.op7_decontaminate(spark, data).collect()}
    inside = {" ".join(w[i : i + 5]) for _, t in items for w in [re.findall(r"[^\W_]+", t.lower())] for i in range(len(w) - 4)}
    some = lambda t: any(" ".join(w[i : i + 5]) in inside for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 4))
    want = plain([d for d in docs if some(d[1])], items)  # without a common shingle nothing is similar
    assert want and found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_shared_counts_equal_their_definition():
    rng = np.random.default_rng(5)
    for _ in range(60):
        own, item, size = rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64), rng.integers(0, 8, rng.integers(1, 12)).astype(np.uint64), int(rng.integers(1, 12))
        size = min(size, len(own))
        b = Counter(item.tolist())
        want = [sum((Counter(own[w : w + size].tolist()) & b).values()) for w in range(len(own) - size + 1)]
        assert decontam.shared(own, *np.unique(item, return_counts=True), size).tolist() == want


def test_odd_rows(spark):
    items = bench(spark, ["one", prose("aa", 40, 1), None, "!!"])
    rows = decontam.find_leaks(odd_documents(spark), items).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in rows) == [(-1, 1), (5, 0), (5, 0), (6, 0)]
    nameless = spark.createDataFrame([(None, prose("aa", 40, 1)), (None, "one")], "item_id long, text string")
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in decontam.find_leaks(odd_documents(spark), nameless).collect()) == [(-1, None), (5, None), (5, None), (6, None)]
    assert decontam.decontaminate(odd_documents(spark), nameless).count() == 8
    assert decontam.find_leaks(empty_documents(spark), items).collect() == []
    assert decontam.find_leaks(odd_documents(spark), bench(spark, ["x"]).limit(0)).collect() == []
    assert decontam.decontaminate(odd_documents(spark), bench(spark, ["x"]).limit(0)).count() == 12
