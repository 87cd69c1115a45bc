from __future__ import annotations

import math
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from factfold.llm import langid
from tests.llm.helpers import documents, empty_documents, odd_documents, prose


def plain_kneser_ney(texts, order):
    """log2-free interpolated Kneser-Ney by its definition: p(c | context) for one language, with padded contexts of spaces."""
    counts = Counter()
    for t in texts:
        codes, _ = langid.characters([t])
        s = " " * (order - 1) + "".join(map(chr, codes))
        counts.update(s[i : i + order] for i in range(len(s) - order + 1))
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discount = {}
    for n, own in levels.items():
        kinds = Counter(own.values())
        discount[n] = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] and kinds[2] else 0.5
    alphabet = len(levels[1])

    def p(g, n):
        lower = p(g[1:], n - 1) if n > 1 else 1 / (alphabet + 1)
        own = {k: c for k, c in levels[n].items() if k[:-1] == g[:-1]}
        if not own:
            return lower
        total = sum(own.values())
        return max(levels[n][g] - discount[n], 0) / total + discount[n] * len(own) / total * lower

    return p


def test_probabilities_equal_the_definition(spark):
    texts = [prose("aa", 12, i) for i in range(6)] + ["aaa bb"]
    model = langid.train(documents(spark, texts), order=3)
    p = plain_kneser_ney(texts, 3)
    for probe in ("river sun", "xyz", "letter"):
        codes, starts = langid.characters([probe])
        got = model.log_probability(langid.grams(codes, starts, 3), 3)[:, 0]
        s = "  " + "".join(map(chr, codes))
        want = [math.log(p(s[i : i + 3], 3)) for i in range(len(codes))]
        assert got == pytest.approx(want, abs=1e-4)


def test_characters_and_grams():
    codes, starts = langid.characters(["Ab, 1c", "", "..", "é"])
    assert "".join(map(chr, codes)) == "ab c é "
    assert starts.tolist() == [0, 5, 5, 5, 7]
    assert ["".join(map(chr, g)) for g in langid.grams(codes, starts, 3)][:3] == ["  a", " ab", "ab "]


def test_held_out_accuracy_and_scores(spark, data):
    rows = langid.op3_language_id(spark, data)
    lang = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "text")
    joined = rows.join(lang, "doc_id").collect()
    assert len(joined) == lang.count()
    assert all(0 <= r.score <= 1 for r in joined)
    ok = [r.lang == r.lang_pred for r in joined if r.held_out and r.lang and r.text]
    assert np.mean(ok) > 0.9


def test_only_the_text_decides_and_held_out_rows_teach_nothing(spark):
    texts, langs = [prose("aa" if i % 2 else "bb", 30, i) for i in range(120)], ["aa" if i % 2 else "bb" for i in range(120)]
    docs = documents(spark, texts, langs)
    a = {r.doc_id: r for r in langid.identify(docs).collect()}
    flipped = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert {r.doc_id: r for r in langid.identify(flipped).collect()} == a
    assert all(r.lang_pred == langs[r.doc_id] for r in a.values())


def test_gibberish_is_rejected_and_clean_text_is_kept(spark):
    texts, langs = [prose("aa" if i % 2 else "bb", 60, i) for i in range(200)], ["aa" if i % 2 else "bb" for i in range(200)]
    odd = ["жщфы ъэюя " * 40, "qxzq zxqj jjqx xqzz " * 40, "12 34", None]
    kept = langid.keep_identified(documents(spark, texts + odd, langs + [None] * 4))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(200))


def test_odd_rows(spark):
    rows = langid.identify(odd_documents(spark)).collect()
    assert len(rows) == 12
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (0, 1, 2, 3)} == {("und", 0.0)}
    assert langid.identify(empty_documents(spark)).collect() == []
    unlabelled = documents(spark, ["some text"], [None])
    assert [r.lang_pred for r in langid.identify(unlabelled).collect()] == ["und"]


def test_no_ngram_is_lost_beyond_one_part(spark):
    texts = [prose("aa", 12, i) for i in range(6)] + ["aaa bb"]
    model = langid.train(documents(spark, texts), order=3, max_grams=40)
    assert len(model) > 3
    p = plain_kneser_ney(texts, 3)
    for probe in ("river sun", "xyz", "letter"):
        codes, starts = langid.characters([probe])
        got = model.log_probability(langid.grams(codes, starts, 3), 3)[:, 0]
        s = "  " + "".join(map(chr, codes))
        assert got == pytest.approx([math.log(p(s[i : i + 3], 3)) for i in range(len(codes))], abs=1e-4)


def test_parts_give_what_the_whole_model_gives(spark):
    texts = [prose("aa" if i % 20 else "bb", 30, i) for i in range(100)] + ["éà ß漢字 " * 9, "éà ß漢字 " * 9, None, "..", "жщфы ъэюя " * 40]
    langs = ["aa" if i % 20 else "bb" for i in range(100)] + ["cc", "cc", "aa", None, None]
    docs = documents(spark, texts, langs)
    rows = lambda df: {r.doc_id: (r.lang_pred, r.rejected, round(r.score, 6)) for r in df.collect()}
    assert rows(langid.identify(docs, max_grams=1500)) == rows(langid.identify(docs))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(langid.keep_identified(docs, max_grams=1500)) == ids(langid.keep_identified(docs))


def test_a_rare_language_rejects_too(spark):
    texts = [prose("aa", 3, i) for i in range(24_000)] + ["ωψχφ υτσρ ποξν " * 9] * 3 + ["ωψqx ψωzж щъыь xq" * 9]
    langs = ["aa"] * 24_000 + ["cc"] * 3 + [None]
    odd = {r.doc_id: r.rejected for r in langid.identify(documents(spark, texts, langs)).where("doc_id >= 24000").collect()}
    assert odd == {24_000: False, 24_001: False, 24_002: False, 24_003: True}


def test_every_language_gets_a_limit(spark):
    rows = [("aa", 50, [1.0, 9.0])] * 9_000 + [("bb", 50, [9.0, 0.2])]
    rule = langid.Rule(["aa", "bb"])
    rule.calibrate(spark.createDataFrame(rows, "taught string, size long, entropy array<double>"), ["bb"])
    assert rule.limits.tolist() == [langid.WIDER, langid.WIDEST]


def test_ties_go_to_the_first_language_by_name(spark):
    texts = [prose("aa", 30, i // 2) for i in range(60)]
    rows = langid.identify(documents(spark, texts, ["yy" if i % 2 else "xx" for i in range(60)], first=1_000)).collect()
    twins = langid.Rule(["xx", "yy"])
    assert twins.decide(np.array([10, 10]), np.array([[2.0, 2.0], [3.0, 2.0]]))[0] == ["xx", "yy"]
    assert len(rows) == 60 and {r.lang_pred for r in rows} <= {"xx", "yy"}


def test_query_equals_the_definition(spark, data):
    """All predictions and scores from plain dictionaries."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", langid.held_out().alias("held")).collect()
    spelled = {r.doc_id: "".join(map(chr, langid.characters([r.text or ""])[0])) for r in docs}
    langs, order = sorted({r.lang for r in docs if r.lang and not r.held}), langid.ORDER
    models = []
    for lang in langs:
        level = Counter()
        for r in docs:
            if r.lang == lang and not r.held and r.text is not None:
                s = " " * (order - 1) + spelled[r.doc_id]
                level.update(s[i : i + order] for i in range(len(s) - order + 1))
        levels = {}
        for n in range(order, 0, -1):
            levels[n] = level
            level = Counter(g[1:] for g in level)
        models.append(levels)
    alphabet = max(1, len(set().union(*(m[1] for m in models))))
    discount, total, kinds = [], [], []
    for m in models:
        of = {n: Counter(m[n].values()) for n in m}
        discount.append({n: of[n][1] / (of[n][1] + 2 * of[n][2]) if of[n][1] and of[n][2] else 0.5 for n in m})
        total.append({n: Counter() for n in m})
        kinds.append({n: Counter(g[:-1] for g in m[n]) for n in m})
        for n in m:
            for g, c in m[n].items():
                total[-1][n][g[:-1]] += c

    @cache
    def p(k, g):
        n = len(g)
        lower = p(k, g[1:]) if n > 1 else 1 / (alphabet + 1)
        if not (t := total[k][n][g[:-1]]):
            return lower
        own = max(models[k][n][g] - discount[k][n], 1e-9) / t if g in models[k][n] else 0
        return own + discount[k][n] * kinds[k][n][g[:-1]] / t * lower

    entropy = {}
    for i, s in spelled.items():
        padded = " " * (order - 1) + s
        entropy[i] = np.array([-sum(math.log(p(k, padded[j : j + order])) for j in range(len(s))) / max(len(s), 1) for k in range(len(langs))])
    size = np.array([len(spelled[r.doc_id]) for r in docs])
    every = np.stack([entropy[r.doc_id] for r in docs])
    taught = [(j, langs.index(r.lang)) for j, r in enumerate(docs) if r.lang and not r.held and size[j]]  # all languages have few rows here
    rules = [langid.Rule(langs, scale) for scale in langid.SCALES]
    loss = [-sum(math.log(max(x[j, k], 1e-12)) for j, k in taught) for x in (r.posterior(size, every) for r in rules)]
    posterior = rules[int(np.argmin(loss))].posterior(size, every)
    got = {r.doc_id: r for r in langid.op3_language_id(spark, data).collect()}
    assert len(got) == len(docs)
    for j, r in enumerate(docs):
        best = int(every[j].argmin())
        if size[j]:
            assert got[r.doc_id].lang_pred == langs[best] and got[r.doc_id].score == pytest.approx(posterior[j, best], abs=1e-3)
        else:
            assert got[r.doc_id].lang_pred == "und"


def test_languages_without_usable_text_teach_nothing(spark):
    """Rows of null texts are many, and the only text stands in the part that is not counted."""
    good = [prose("aa", 20, i) for i in range(50)]
    rows = documents(spark, [*good, *[None] * 1_200, *["12 34"] * 30], ["aa"] * 50 + ["cc"] * 1_230)
    one = documents(spark, ["fluss stein hell"], ["cc"], first=2_000)
    for k in range(3):
        found = langid.identify(rows.unionByName(one.withColumn("doc_id", F.col("doc_id") + k))).collect()
        assert len(found) == 1_281 and all(r.lang_pred == "aa" for r in found if r.doc_id < 50)


def test_stage_keeps_columns_named_like_its_own(spark):
    docs = documents(spark, [prose("aa", 30, i) for i in range(30)]).withColumns({"digest": F.lit("mine"), "__digest": F.lit("also"), "Lang_pred": F.lit(1)})
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {(r["digest"], r["__digest"]) for r in kept.collect()} == {("mine", "also")}
