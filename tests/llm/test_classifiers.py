from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from factfold.llm import features, quality, toxicity
from tests.llm.helpers import DOCS, documents, empty_documents, odd_documents, prose


def auc(score, y):
    score, y = np.array(score), np.array(y)
    a, b = score[y == 1], score[y == 0]
    return np.mean((a[:, None] > b) + 0.5 * (a[:, None] == b))


@pytest.mark.parametrize(("module", "label", "cutoff"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.7)])
def test_planted_labels_are_learned(spark, module, label, cutoff):
    bad = ["you zorgh idiot, you snivelling kraag!!", "shut up you zorgh", "kraag zorgh idiot you!"]
    good = label == "quality"
    texts = [prose("aa", 40, i) + ("." if i % 2 else " " + bad[i % 3] + (" ||| $$$$ 000" * 6 if good else "")) for i in range(500)]
    docs = documents(spark, texts)
    y = [int((i % 2 == 0) != good) for i in range(500)]
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)], f"doc_id long, {label} int")
    rows = module.score(docs, labels).collect()
    assert len(rows) == 500
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cutoff) for r in rows)
    held = [r for r in rows if r.held_out]
    assert auc([r.score for r in held], [y[r.doc_id] for r in held]) > 0.97


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_labels_teach_nothing(spark, module, label):
    docs = documents(spark, [prose("aa", 30, i) + (" zorgh kraag ||| 000" if i % 2 else ".") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], f"doc_id long, {label} int")
    out = module.score(docs, labels)
    held = out.where("held_out").select("doc_id")
    fewer = labels.join(held, "doc_id", "left_anti")
    assert {r.doc_id: r.score for r in out.collect()} == {r.doc_id: r.score for r in module.score(docs, fewer).collect()}


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, module, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    some = spark.createDataFrame([(5, 1), (5, 0), (7, 0), (8, None), (None, 1), (99, 1)], f"doc_id long, {label} int")
    for labels in (none, some):
        rows = module.score(odd_documents(spark), labels).collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
        assert module.score(empty_documents(spark), labels).collect() == []


def test_features_of_known_texts():
    t = features.Text(["You are LOUD! 5t0p", "", "plain words here"])
    keys = np.sort(features.Text(["stop"]).word)
    x = features.toxicity(t, keys, np.ones(1))
    at = features.TOXICITY.index
    assert x[0, at("hits")] == 1  # disguised letters are read as letters
    assert x[0, at("second_person")] == pytest.approx(1 / 4)
    assert x[0, at("near_second")] == pytest.approx(1 / 4)
    assert x[0, at("exclaims")] == pytest.approx(1 / 18)
    assert x[1].tolist() == [0.0] * len(features.TOXICITY)
    q = features.quality(features.Text(["a a a a", "", "One line.\nTwo lines."]))
    at = features.QUALITY.index
    assert q[0, at("repeats")] == pytest.approx(3 / 4)
    assert q[0, at("top_word")] == 1
    assert q[1, at("no_words")] == 1
    assert q[2, at("line_ends")] == 1


def test_bradley_terry_orders_by_the_feature_that_decides(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) * 2 + F.pmod(F.hash("id"), F.lit(100)) / 50).alias("a"), (F.pmod(F.hash("id", F.lit(1)), F.lit(100)) / 50).alias("b"))
    a, b = quality.fit(rows, ["a", "b"])
    assert a > 1 and abs(b) < a / 2


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_repeated_ids_and_labels_teach_once(spark, module, label):
    docs = documents(spark, [prose("aa", 30, i) + (" zorgh kraag ||| 000" if i % 2 else ".") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], f"doc_id long, {label} int")
    many = docs.unionByName(docs.where("doc_id in (11, 12)").withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("__k"))
    want = {r.doc_id: r.score for r in module.score(docs, labels).collect()}
    got = module.score(many, labels.unionByName(labels.where("doc_id in (11, 12)"))).collect()
    assert len(got) == 800 and {r.doc_id: r.score for r in got} == want


def test_lexicons_equal_their_definition(spark):
    texts = [(i, f"{prose('aa', 12, i)} {'zorghy kraag' if i % 3 == 0 else ''}", int(i % 3 == 0), i % toxicity.FOLDS) for i in range(120)]
    got = toxicity.lexicons(spark.createDataFrame(texts, "doc_id long, text string, y int, fold int"))
    for left_out, (keys, weights) in enumerate(got):
        own = [(set(features.Text([t]).word) | set(features.Text([t]).stem), y) for _, t, y, f in texts if f != left_out]
        want, (n1, n0) = {}, (sum(y for _, y in own), sum(1 - y for _, y in own))
        for h in set().union(*(s for s, _ in own)):
            p, n = sum(y for s, y in own if h in s), sum(1 - y for s, y in own if h in s)
            odds = np.log((p + 0.5) / (n1 + 1)) - np.log((n + 0.5) / (n0 + 1))
            if p >= toxicity.LEAST_ROWS and odds >= toxicity.LEAST_ODDS:
                want[h] = odds
        assert len(want) >= 2 and dict(zip(keys, weights, strict=True)) == pytest.approx(want)


# the features in plain Python ---------------------------------------------------------------------------------------


def _kinds(text):
    data = re.sub(r"[^\w\x00-\x7f]", " ", text or "").encode()
    letter = [97 <= b <= 122 or 65 <= b <= 90 or b >= 128 for b in data] + [False]
    digit = [48 <= b <= 57 for b in data] + [False]
    symbol = [not (x or d) and b not in b"\t\n\x0b\x0c\r " for b, x, d in zip(data, letter, digit, strict=False)]
    inside = [letter[i] or digit[i] or (data[i] in b"$@" and letter[i + 1]) for i in range(len(data))] + [False]
    words, at = [], None
    for i, x in enumerate(inside):
        if x and at is None:
            at = i
        elif not x and at is not None:
            words.append((at, i))
            at = None
    return data, letter, symbol, words


def plain_toxicity(text, lexicon):
    data, letter, symbol, words = _kinds(text)
    hashes = [features.Text([data[a:b].decode()]) for a, b in words]
    own, stem = [lexicon.get(int(t.word[0]), 0.0) for t in hashes], [lexicon.get(int(t.stem[0]), 0.0) for t in hashes]
    weight = [max(pair) for pair in zip(own, stem, strict=True)]
    you = [data[a:b].decode().translate(str.maketrans("013457@$", "oieastas")).lower() in features.SECOND_PERSON for a, b in words]
    near = sum(w > 0 and any(you[max(0, i - 5) : i + 6]) for i, w in enumerate(weight))
    n, size, hits = max(len(words), 1), max(len(data), 1), sum(w > 0 for w in weight)
    top = sorted(weight, reverse=True) + [0.0, 0.0]
    upper = lambda b: 65 <= b <= 90
    shouted = sum(all(map(upper, data[a:b])) and b - a > 2 for a, b in words)
    masked = sum(data[i] in b"0134579@$*#" and letter[i - 1] and letter[i + 1] for i in range(1, len(data)))
    return [
        hits, hits / n, sum(weight), sum(weight) / n, top[0], top[0] + top[1], sum(x > 0 for x in stem), sum(you) / n, near / n,
        sum(map(upper, data)) / size, shouted / n, data.count(b"!") / size, data.count(b"?") / size, sum(symbol) / size, masked / size, np.log1p(len(words)),
    ]


def plain_quality(text):
    data, letter, symbol, words = _kinds(text)
    spelled = [data[a:b].decode().translate(str.maketrans("013457@$", "oieastas")) for a, b in words]
    spelled = ["".join(c.lower() if c.isascii() else c for c in w) for w in spelled]
    n, size, counts = max(len(words), 1), max(len(data), 1), Counter(spelled)
    lines = data.count(b"\n") + 1
    of_line = Counter(data[:a].count(b"\n") for a, _ in words)
    ends = sum(i > 0 and (data + b"\n")[i] == 10 and data[i - 1] in b"!.?\":" for i in range(len(data) + 1))
    return [
        sum(symbol) / size, sum(symbol[i] and data[i] == data[i - 1] for i in range(1, len(data))) / size, data.count(b"|") / n,
        sum(a == b for a, b in zip(spelled, spelled[1:], strict=False)) / n, len(counts) / n**0.8, max(counts.values(), default=0) / n,
        min(sum(b - a for a, b in words) / n, 20), np.log1p(len(words) / lines), ends / lines, sum(48 <= b <= 57 for b in data) / size,
        sum(65 <= b <= 90 for b in data) / size, sum(letter) / size, sum(v == 1 for v in of_line.values()) / n, np.log1p(len(words)), float(not words),
    ]


def test_toxicity_query_equals_plain_features_and_trees(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.Fitted(toxicity.taught_rows(docs, labels, toxicity.TRAIN_ROWS))
    lexicon = dict(zip(map(int, model.lexicon[0]), model.lexicon[1].tolist(), strict=True))
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, data).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        p = model.trees.predictProbability(Vectors.dense(plain_toxicity(r.text, lexicon)))[1]
        want = np.interp(p, list(model.steps.boundaries), list(model.steps.predictions))
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-6) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)


def test_quality_query_equals_plain_features_and_ranking(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    x = {i: plain_quality(t) for i, t in docs.items()}
    taught = spark.createDataFrame([(i, y[i], *map(float, x[i])) for i in y if i in x], "doc_id long, y int, " + ", ".join(f"{f} double" for f in features.QUALITY))
    weights = quality.fit(taught)
    strength = {i: float(np.dot(v, weights)) for i, v in x.items()}
    own = [strength[i] for i in y if i in x]
    threshold = np.quantile(own, 1 - np.mean([y[i] for i in y if i in x]))
    got = {r.doc_id: r for r in quality.op6_quality(spark, data).collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        ahead = strength[i] - threshold
        assert r.score == pytest.approx(1 / (1 + np.exp(-ahead - np.log(0.7 / 0.3))), abs=2e-3)
        assert r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_few_labels_that_fall_on_one_side(spark):
    """Toxic rows all in the calibrating part, or none of them there: both sides then take all rows."""
    ids = [i for i in range(4_000) if zlib.crc32(str(i).encode()) % 5]
    part = {r.id for r in spark.createDataFrame([(i,) for i in ids], "id long").where(F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(5)) == 0).collect()}
    aside, others = [i for i in ids if i in part][:4], [i for i in ids if i not in part][:4]
    for chosen in (aside, others, [aside[0], *others[:3]]):
        docs = spark.createDataFrame([(i, f"you are an awful person {i}" if k % 2 else f"a gentle river {i}", "aa", "s", 1) for k, i in enumerate(chosen)], DOCS)
        labels = spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(chosen)], "doc_id long, quality int, toxic int")
        rows = toxicity.score(docs, labels).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)


def test_labels_of_one_kind_decide(spark):
    docs = documents(spark, [prose("aa", 20, i) for i in range(20)])
    for y in (0, 1):
        labels = spark.createDataFrame([(i, y, y) for i in range(20)], "doc_id long, quality int, toxic int")
        assert {r.predicted for r in quality.score(docs, labels).collect()} == {y}


# fits in plain Python -----------------------------------------------------------------------------------------------


def _seeded(*values) -> int:
    """Spark's xxhash64 of longs and strings."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_ranking(x: dict, y: dict) -> tuple:
    """Weights of least penalised logistic loss, and that loss, over the differences of pairs that meet in a bucket, by Newton's method."""
    worse = max(1, sum(v == 0 for v in y.values()))
    buckets: dict = {}
    for i in y:
        if y[i] == 0:
            buckets.setdefault(_seeded(i, "worse") % worse, []).append(i)
    d = np.array([np.subtract(x[i], x[j]) for i in y if y[i] == 1 for j in buckets.get(_seeded(i, "better") % worse, [])], float)
    penalty = quality.PENALTY * (2 * (d**2).sum(axis=0) / (2 * len(d) - 1))
    w = np.zeros(d.shape[1])

    def loss(v):
        return np.logaddexp(0, -d @ v).mean() + 0.5 * (penalty * v**2).sum()

    for _ in range(60):
        p = 1 / (1 + np.exp(d @ w))
        step = np.linalg.lstsq((d.T * (p * (1 - p))) @ d / len(d) + np.diag(penalty), d.T @ p / len(d) - penalty * w, rcond=None)[0]
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-9:
            size /= 2
        w = w + size * step
    return w, loss


def test_ranking_equals_newtons_method(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.quality is not None}
    y = {i: v for i, v in known.items() if i in docs and zlib.crc32(str(i).encode()) % 4 != 2}
    x = {i: plain_quality(t) for i, t in docs.items()}
    best, loss = plain_ranking(x, y)
    taught = spark.createDataFrame([(i, y[i], *map(float, x[i])) for i in y], "doc_id long, y int, " + ", ".join(f"{f} double" for f in features.QUALITY))
    own = np.array(quality.fit(taught))
    assert loss(best) <= loss(own) + 1e-9 and loss(own) < loss(best) + 0.05 * loss(np.zeros(len(best)))
    strength = {i: float(np.dot(v, best)) for i, v in x.items()}
    threshold = np.quantile([strength[i] for i in y], 1 - np.mean(list(y.values())))
    got = {r.doc_id: r for r in quality.op6_quality(spark, data).collect()}
    assert np.mean([got[i].predicted == (strength[i] >= threshold) for i in docs]) > 0.98
    held = [i for i in known if i in docs and zlib.crc32(str(i).encode()) % 4 == 2]
    assert abs(auc([strength[i] for i in held], [known[i] for i in held]) - auc([got[i].score for i in held], [known[i] for i in held])) < 0.01


def plain_isotonic(p: list[float], label: list[float]) -> list[tuple[float, float, float]]:
    """(first, last, mean) of each step: neighbours that fall are pooled until none does."""
    pools: list = []
    for value in sorted(set(p)):
        own = [v for q, v in zip(p, label, strict=True) if q == value]
        pools.append([value, value, sum(own), len(own)])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, last, total, n = pools.pop()
            pools[-1][1:] = [last, pools[-1][2] + total, pools[-1][3] + n]
    return [(a, b, total / n) for a, b, total, n in pools]


def test_calibration_equals_pooling_of_neighbours(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.beta(0.6, 0.8, 400), 3).clip(0.001, 0.999).tolist()
    label = [float(rng.random() < v**1.5) for v in p]
    model = toxicity.calibration(spark.createDataFrame(list(zip(p, label, strict=True)), "p double, label double"))
    least = 0.5 / (len(p) + 1)
    knots = [(0.0, 0.0), *(((a + b) / 2, min(max(v, least), 1 - least)) for a, b, v in plain_isotonic(p, label)), (1.0, 1.0)]
    at = np.linspace(0, 1, 301)
    got = np.interp(at, list(model.boundaries), list(model.predictions))
    assert got == pytest.approx(np.interp(at, *zip(*knots, strict=True)), abs=1e-9) and len(knots) > 8
