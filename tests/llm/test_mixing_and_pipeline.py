from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from factfold.llm import common, mixing
from tests.llm.helpers import documents, empty_documents, odd_documents, prose
from tests.llm.test_decontam import plain as plain_leaks
from tests.llm.test_simhash import plain_components, plain_fingerprint


def test_rates_reach_the_targets(spark):
    texts = [prose("aa" if i % 4 else "bb", 40, i) for i in range(400)]
    langs = [("aa" if i % 4 else "bb") if i % 3 else None for i in range(400)]
    rows = mixing.rates(documents(spark, texts, langs), weights={"aa": 1.0, "bb": 1.0}).collect()
    assert all(r.domain == ("aa" if r.doc_id % 4 else "bb") and r.rate >= 0 for r in rows)
    totals = {d: sum(r.tokens * r.rate for r in rows if r.domain == d) for d in ("aa", "bb")}
    assert totals["aa"] == pytest.approx(8000, rel=0.02) and totals["bb"] == pytest.approx(8000, rel=0.02)
    assert sum(r.copies * r.tokens for r in rows if r.domain == "bb") == pytest.approx(8000, rel=0.15)


def test_fit_equals_projected_gradient_in_numpy(spark):
    rng = np.random.default_rng(1)
    p, tokens = rng.dirichlet([0.3, 0.3, 0.3], 200), rng.integers(1, 100, 200)
    soft = spark.createDataFrame([(i, int(t), row.tolist()) for i, (t, row) in enumerate(zip(tokens, p, strict=True))], "doc_id long, tokens long, p array<double>")
    wanted = {"a": 0.4, "b": 0.35, "c": 0.25}
    fitted, report = mixing.fit(soft, ["a", "b", "c"], wanted)
    rate = np.array([r.rate for r in fitted.orderBy("doc_id").collect()])
    assert (rate >= 0).all() and (tokens * rate) @ p == pytest.approx(np.array([*wanted.values()]) * tokens.sum(), rel=1e-3)
    assert list(report["reached"].values()) == pytest.approx(((tokens * rate) @ p).tolist())
    assert rate == pytest.approx(plain_rates(p, tokens, np.array([*wanted.values()]), report["rounds"]), abs=1e-6)


def plain_rates(p, tokens, wanted, rounds):
    """Projected gradient steps as the definition says them."""
    target, inverse, rate = tokens.sum() * wanted / wanted.sum(), np.linalg.pinv((p * tokens[:, None]).T @ p, hermitian=True), np.ones(len(p))
    for _ in range(rounds):
        rate = np.maximum(0, rate + p @ (inverse @ (target - (tokens * rate) @ p)))
    return rate


def test_targets_that_can_not_be_met_end_at_the_least_squares(spark):
    p, tokens = np.array([[0.7, 0.3]] * 30 + [[0.6, 0.4]] * 30), np.full(60, 10)
    soft = spark.createDataFrame([(i, 10, row.tolist()) for i, row in enumerate(p)], "doc_id long, tokens long, p array<double>")
    fitted, report = mixing.fit(soft, ["a", "b"], {"b": 1.0})
    rate = np.array([r.rate for r in fitted.orderBy("doc_id").collect()])
    assert report["targets"] == {"a": 0.0, "b": 600.0} and report["reached"]["a"] > 100
    residual = lambda r: (d := np.array([0.0, 600.0]) - (tokens * r) @ p) @ np.linalg.pinv((p * tokens[:, None]).T @ p) @ d
    best = plain_rates(p, tokens, np.array([0.0, 1.0]), 5_000)
    assert residual(rate) <= residual(best) * 1.01
    with pytest.raises(RuntimeError, match="settle"):
        mixing.fit(soft, ["a", "b"], {"b": 1.0}, rounds=1)


def plain_posteriors(rows):
    """The names of the domains, the posteriors and the tokens of rows (doc_id, text, lang), in plain Python."""
    split = lambda t: [w for w in re.split(mixing._SPLIT, t.lower()) if w]
    names = sorted({lang for *_, lang in rows if lang})
    shares = np.array([sum(lang == n for *_, lang in rows) for n in names], float)
    shares /= shares.sum()
    seen = {}
    for _, text, lang in rows:
        for w in split(text) if lang else ():
            seen.setdefault(w, np.zeros(len(names)))[names.index(lang)] += 1
    table = dict(sorted(((w, c) for w, c in seen.items() if c.sum() > 1), key=lambda x: (-x[1].sum(), x[0]))[: mixing.VOCABULARY])
    sums = sum(table.values()) + 0.5 * (len(table) + 1)
    weight = {w: np.round((np.log(c + 0.5) - np.log(sums)) * mixing.SCALE) for w, c in table.items()}
    p, tokens = [], []
    for _, text, _ in rows:
        own = [weight[w] for w in split(text) if w in weight]
        logit = (np.sum(own, axis=0) / len(own) / mixing.SCALE if own else 0) * min(len(own), mixing.EVIDENCE) + np.log(shares)
        p.append(np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum())
        tokens.append(len(split(text)))
    return names, np.array(p), np.array(tokens)


def test_query_equals_numpy(spark, data):
    rows = [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()]
    names, p, tokens = plain_posteriors(rows)
    now = tokens @ p
    got = {r.doc_id: r for r in mixing.op8_mixing(spark, data).collect()}
    _, report = mixing.fit(spark.createDataFrame([(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(tokens, p, strict=True))], "doc_id long, tokens long, p array<double>"), names, None)
    rate = plain_rates(p, tokens, (now / now.sum()) ** mixing.FLATTEN, report["rounds"])
    assert len(got) == len(rows)
    for (i, _, _), x, t, row in zip(rows, rate, tokens, p, strict=True):
        assert got[i].tokens == t
        if t:
            assert got[i].domain == names[row.argmax()] and got[i].posterior == pytest.approx(row.max(), abs=1e-6)
            assert got[i].rate == pytest.approx(x, abs=1e-5) and got[i].reached == pytest.approx(got[i].target, rel=1e-4)
        assert got[i].copies in (int(got[i].rate), int(got[i].rate) + 1)


def test_mix_repeats_rows_by_their_copies(spark):
    docs = documents(spark, [prose("aa" if i % 4 else "bb", 30, i) for i in range(200)], ["aa" if i % 4 else "bb" for i in range(200)])
    options = {"weights": {"aa": 0.3, "bb": 0.7}}
    copies = {r.doc_id: r.copies for r in mixing.rates(docs, **options).collect()}
    got = {r.doc_id: r["count"] for r in mixing.mix(docs, **options).groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in copies.items() if c}
    assert mixing.mix(docs, **options).columns == docs.columns


def test_odd_rows(spark):
    rows = mixing.rates(odd_documents(spark)).collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in rows) == [-1, *range(9)]
    assert {(r.tokens, r.rate, r.copies) for r in rows if r.doc_id in (0, 1, 2)} == {(0, 1.0, 1)}
    assert mixing.rates(empty_documents(spark)).collect() == []
    assert mixing.mix(odd_documents(spark), weights={"aa": 1.0}).columns == odd_documents(spark).columns


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)] + [(500, 500)]
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    touched = {v for a, b in edges if a != b for v in (a, b)}
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: label[v] for v in touched}


def plain_copies(rows):
    """doc_id to the number of its copies after mixing, by plain Python."""
    _, p, tokens = plain_posteriors(rows)
    now, rate = tokens @ p, np.ones(len(rows))
    wanted = (now / now.sum()) ** mixing.FLATTEN
    target, inverse, before = tokens.sum() * wanted / wanted.sum(), np.linalg.pinv((p * tokens[:, None]).T @ p, hermitian=True), np.inf
    while True:
        off = target - (tokens * rate) @ p
        squares = off @ inverse @ off
        if np.abs(off).max() <= mixing.TOLERANCE * tokens.sum() or squares >= before * (1 - mixing.STILL):
            break
        before, rate = squares, np.maximum(0, rate + p @ (inverse @ off))
    out = {}
    for (i, *_), r in zip(rows, rate, strict=True):
        first = xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)
        h = xxhash.xxh64_intdigest(b"mix", first)
        out[i] = int(r) + ((h - (1 << 64) if h >> 63 else h) % (1 << 30) / (1 << 30) < r - int(r))
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    items = [prose("aa", 30, f"item{k}") for k in range(3)]
    texts = [(prose("aa" if i % 4 else "bb", 60, i), "aa" if i % 4 else "bb") for i in range(160)]
    texts += [(texts[k][0] + " ", texts[k][1]) for k in range(0, 40, 3)]  # copies
    texts += [(texts[k][0].upper() + ".", texts[k][1]) for k in range(1, 60, 7)]  # near copies
    texts += [(f"{prose('aa', 30, -k)} {items[k % 3]} {prose('aa', 10, k + 900)}", "aa") for k in range(9)]
    junk = ["жщфы ъэюя " * 40, "qxzq zxqj jjqx xqzz " * 40, "12 34"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([*texts, *((j, None) for j in junk)])]
    documents(spark, [t for _, t, _ in rows], [lang for *_, lang in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = rows[: -len(junk)]
    ids, fps = [i for i, *_ in left], [plain_fingerprint(t) for _, t, _ in left]
    firsts = set(plain_components(fps, ids))
    left = [r for r in left if r[0] in firsts]
    leaks = {d for d, _ in plain_leaks([(i, t) for i, t, _ in left], list(enumerate(items)))}
    left = [r for r in left if r[0] not in leaks]
    assert len(leaks) == 9 and len(firsts) < 180
    want = {i: n for i, n in plain_copies(left).items() if n}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == want
    by_shard = {}
    for r in out:
        text = rows[r.doc_id][1].encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 16, zlib.crc32(text), "bytes")
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert set(by_shard) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_stages_keep_the_columns_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").isEmpty()


@pytest.mark.parametrize("case", [odd_documents, empty_documents])
def test_every_stage_stands_odd_rows(spark, data, case):
    for name, stage in corpus_pipeline.STAGES:
        docs = case(spark)
        out = stage(spark, docs, data)
        rows = out.collect()
        if case is empty_documents:
            assert rows == []
        elif name == "language_id":  # null, empty, blank and letterless texts go
            assert {0, 1, 2, 3, None}.isdisjoint({r.doc_id for r in rows if r.text is None or not r.text.strip("! ?\t\n")})
            assert {4, 5, 6, 7} <= {r.doc_id for r in rows}
        elif name == "near_dedup":  # one of the texts without a word, one of the equal ones
            assert sorted(r.doc_id if r.doc_id is not None else -1 for r in rows) == [-1, 0, 3, 4, 5, 7, 8]
        elif name == "decontamination":
            assert len(rows) == 12
        elif name == "source_mixing":
            assert {0, 1, 2, 3} - {3} <= {r.doc_id for r in rows} and out.columns == docs.columns
        else:
            assert len(rows) == 12 and sum(r.size for r in rows) == sum(len((r.text or "").encode()) + 16 for r in docs.collect())


def test_cut_uses_the_folder_that_the_session_names(spark):
    assert common.cut(spark.range(3)).agg(F.sum("id")).first()[0] == 3
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in common.cut(spark.range(3)).inputFiles())


def test_every_domain_is_kept_and_unknown_ones_raise(spark):
    langs = [f"d{i % 40:02d}" for i in range(400)]
    docs = documents(spark, [" ".join(f"{lang}w{k}" for k in range(30)) for lang in langs], langs)
    weights = {f"d{k:02d}": 1.0 + (k == 39) for k in range(40)}
    rows = mixing.rates(docs, weights=weights).collect()
    assert all(r.domain == langs[r.doc_id] for r in rows)
    totals = {d: sum(r.tokens * r.rate for r in rows if r.domain == d) for d in ("d00", "d39")}
    assert totals["d39"] == pytest.approx(2 * totals["d00"], rel=0.05)
    with pytest.raises(ValueError, match="nope"):
        mixing.rates(docs, weights={"nope": 1.0})


def test_frequent_domains_push_out_no_words_of_a_rare_one(spark):
    """Two domains of 15,000 words each, whose words outnumber those of a third of a few rows."""
    rng = random.Random(5)
    own = {d: [f"{d}word{i}" for i in range(n)] for d, n in (("a", 15_000), ("b", 15_000), ("c", 1_500))}
    langs = ["a"] * 9_000 + ["b"] * 9_000 + ["c"] * 400
    rows = mixing.rates(documents(spark, [" ".join(rng.choices(own[d], k=20)) for d in langs], langs)).collect()
    of_c = [r.domain for r in rows if langs[r.doc_id] == "c"]
    assert sum(d == "c" for d in of_c) >= 0.98 * len(of_c)


def test_stages_keep_columns_named_like_their_own(spark):
    from factfold.llm import langid, pii, simhash

    names = ["mixed_id", "copies", "copy", "key", "again", "digest", "values", "made", "__key", "__copies", "__found", "_copy"]
    docs = documents(spark, [prose("aa", 40, i // 2) for i in range(20)]).withColumns({n: F.lit(n) for n in names})
    for stage in (langid.keep_identified, simhash.deduplicate, mixing.mix):
        out = stage(docs)
        assert out.columns == docs.columns and {tuple(r) for r in out.select(*names).collect()} == {tuple(names)}
    out = pii.pseudonymise(docs, "k")
    assert out.columns == [*docs.columns, "pii_kinds", "pii_count"] and {tuple(r) for r in out.select(*names).collect()} == {tuple(names)}
