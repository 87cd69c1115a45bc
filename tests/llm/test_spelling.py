"""Spelling variants against a plain version that compares words letter by letter."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from factfold.llm import spelling
from tests.llm.helpers import documents, empty_documents, odd_documents

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(rows, every):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def neighbours(words):
    """Words one edit apart: those that share a word with a letter left out or exchanged, as sets of patterns."""
    by = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[f"{w[:i]}*{w[i + 1 :]}"].add(w)
    near = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            near[w] |= by[f"{w[:i]}*{w[i + 1 :]}"]
            if (shorter := w[:i] + w[i + 1 :]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    return {w: near[w] - {w} for w in words}


def plain(rows, every=spelling.EVERY, times=spelling.TIMES):
    n = counted(rows, every)
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def got(docs, **options):
    return sorted(tuple(r) for r in spelling.variants(docs, **options).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_a_plain_version(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in spelling.op12_spelling_variants(spark, data).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert found == plain(rows) and any(r[1] for r in found)


def test_edits_at_every_place(spark):
    base = "abcdefgh"
    edits = [base[:i] + c + base[j:] for i in range(9) for c in ("", "z", "é", "a") for j in (i, i + 1) if j <= 8]
    anagrams = ["hgfedcba", "abcdhgfe", "bacdefgh", "abcdefhg", "aabbccdd", "aabbccd", "aabbcd", "ddccbbaa", "llllllll", "lllllllll", "llllllla"]
    texts = [" ".join([w] * 2) for w in sorted({*edits, *anagrams})] + [" ".join([base] * 40)]
    docs = documents(spark, texts)
    found = got(docs, every=None)
    assert found == plain(list(enumerate(texts)), every=None)
    of = {r[0]: r for r in found}
    assert of["abcdefghz"][1:3] == (base, base) and of["hgfedcba"][1] is None


def test_forms_are_followed_to_the_last(spark):
    texts = [" ".join([w] * n) for w, n in (("seventh", 2), ("sevenths", 25), ("seventhst", 300), ("sevenxhst", 301))]
    of = {r[0]: r for r in got(documents(spark, texts), every=None)}
    assert of["seventh"][1:3] == ("sevenths", "seventhst")
    assert of["sevenths"][1] == "seventhst" and of["sevenths"][3:] == (25, 2, 300)


def test_pairs_come_once(spark):
    rows = [(w, 2) for w in ("aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaabaaa", "aaaaaaaaa", "bbbbbbbbb", "abababab", "babababa", "ababababa")]
    pairs = spelling.near_pairs(spark.createDataFrame(rows, "word string, n long")).collect()
    both = [frozenset((r.word, r.other_word)) for r in pairs]
    near = neighbours({w for w, _ in rows})
    assert len(both) == len(set(both)) and set(both) == {frozenset((w, x)) for w in near for x in near[w]}


def test_odd_documents(spark):
    docs = odd_documents(spark)
    long = documents(spark, ["x" * 50_000 + " " + "y" * 50_000 + "é", "ÀÉÎabcdef×÷ ÀÉÎabcdef×÷ ẞnotthis"], first=100)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").union(long.select("doc_id", "text")).collect()]
    every = docs.select("doc_id", "text", F.lit(1).alias("n"), F.lit("w").alias("word")).union(long.select("doc_id", "text", F.lit(1), F.lit("w")))
    assert got(every) == plain(rows)
    assert got(empty_documents(spark)) == [] and got(documents(spark, [None, ""])) == []
