"""Mixing sources to target weights by soft domain membership, in DataFrame operations only.

A classifier kept as a table (word, one scaled log weight per domain) is learned from labelled rows. A document's posterior
over the domains comes from the mean weight of its words. Nonnegative document rates are then fitted by projected-gradient
least squares so that the expected token totals of the domains (sum of rate * tokens * posterior) meet the targets.

Each gradient step needs the few totals only, so every round is one aggregation over the narrow table of posteriors and rates. The
rates of STRIDE rounds are one expression; then the table is written anew. The fit ends when the targets are met or when the squares
fall no more, which is their least where targets can't be met; it raises if neither comes about.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factfold.llm.common import BROADCAST_IDS, cut, free_name, read

#: Bounds: labelled rows that teach (about), words of the table. The table is broadcast, so its rows are bounded: each domain has its
#: own most frequent words in it, an equal part of VOCABULARY but OWN_WORDS at least, so no domain's words push out another's. A domain
#: of which fewer than DOMAIN_ROWS rows would teach gives up to about that many. SUMS is how many sums one aggregation takes.
TRAIN_ROWS, VOCABULARY, OWN_WORDS, DOMAIN_ROWS, SUMS = 20_000, 60_000, 1_000, 200, 1_024
ROUNDS, STRIDE, TOLERANCE, STILL, FLATTEN, EVIDENCE, SCALE = 400, 8, 1e-6, 1e-4, 0.7, 25, 1 << 20
_SPLIT = r"[\s.,;:!?|()\"']+"


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """The words of each row, and empty ones at its ends; a row without a word has an empty one."""
    return docs.select(*keep, F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), _SPLIT)).alias("word"))


def classifier(docs: DataFrame, domain: str, train_rows: int = TRAIN_ROWS, vocabulary: int = VOCABULARY) -> tuple[list[str], list[float], DataFrame]:
    """All domains by name, their shares of the labelled rows and the table (word, w0, w1, ...), from about ``train_rows`` rows and
    DOMAIN_ROWS of each rarer domain."""
    known = docs.where(F.col(domain).isNotNull()).select(F.col(domain).cast("string").alias("__domain"), "doc_id", "text")
    sizes = known.groupBy("__domain").count().orderBy("__domain").collect()
    names, total = [r["__domain"] for r in sizes], sum(r["count"] for r in sizes)
    chance = [int((1 << 20) * min(1.0, max(train_rows / max(total, 1), DOMAIN_ROWS / r["count"]))) for r in sizes]
    at = F.array_position(F.array(*map(F.lit, names)), F.col("__domain")).cast("int") - 1
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (F.array(*map(F.lit, chance))[at] if names else F.lit(0))
    seen = cut(_words(known.where(part), "__domain").where("word <> ''").groupBy("word", "__domain").agg(F.count("*").alias("c")))
    rank = F.row_number().over(Window.partitionBy("__domain").orderBy(F.desc("c"), "word"))
    own = max(OWN_WORDS, -(-vocabulary // max(len(names), 1)))
    chosen = seen.withColumn("rank", rank).where(F.col("rank") <= own).select("word").distinct()
    counts = [F.sum(F.when(F.col("__domain") == F.lit(name), F.col("c")).otherwise(0)).alias(f"c{k}") for k, name in enumerate(names)]
    table = cut(seen.join(chosen, "word").groupBy("word").agg(F.sum("c").alias("c"), *counts).where("c > 1"))
    sums = table.agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(len(names))), F.count("*").alias("n")).first()
    weight = lambda k: F.round((F.log(F.col(f"c{k}") + 0.5) - math.log((sums[f"c{k}"] or 0) + 0.5 * (sums["n"] + 1))) * SCALE).cast("long").alias(f"w{k}")
    return names, [r["count"] / total for r in sizes], table.select("word", *(weight(k) for k in range(len(names))))


def posteriors(docs: DataFrame, domain: str, **options) -> tuple[list[str], DataFrame]:
    """The domains and (doc_id, tokens, p: array of posteriors), one row per doc_id; without a word p holds the domains' shares.

    Words are looked up where they are read and their weights are summed as integers before the shuffle, so one row per
    document moves and the sums don't depend on the order.
    """
    names, shares, table = classifier(docs, domain, **options)
    sums = [F.sum(f"w{k}").alias(f"s{k}") for k in range(len(names))]
    scored = _words(docs, "doc_id").join(F.broadcast(table), "word", "left").groupBy("doc_id").agg(F.count_if(F.col("word") != "").alias("tokens"), F.count(F.col("w0") if names else F.lit(None)).alias("known"), *sums)
    mean = lambda k: F.coalesce(F.col(f"s{k}") / F.col("known"), F.lit(0)) / SCALE * F.least(F.col("known"), F.lit(EVIDENCE)) + math.log(shares[k])
    logits = F.array(*(mean(k) for k in range(len(names)))).alias("logits")
    raised = F.transform("logits", lambda x: F.exp(x - F.array_max("logits")))
    soft = scored.select("doc_id", "tokens", logits).select("doc_id", "tokens", raised.alias("e"))
    p = F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b))
    return names, soft.select("doc_id", "tokens", p.alias("p"))


def rate_of(steps: list[np.ndarray], start: Column, p: str = "p") -> Column:
    """The rate after the given steps, each projected on the nonnegative numbers."""
    rate = start
    for step in steps:
        change = F.zip_with(p, F.array(*(F.lit(float(v)) for v in step)), lambda a, b: a * b)  # not a sum of terms, whose depth would follow the domains
        rate = F.greatest(F.lit(0.0), rate + F.aggregate(change, F.lit(0.0), lambda a, b: a + b))
    return rate


def _sums(soft: DataFrame, terms: list[Column]) -> np.ndarray:
    """The sums of the terms over soft, zero where there is no row, SUMS of them in one pass."""
    parts = [soft.agg(*(F.coalesce(F.sum(t), F.lit(0.0)).alias(f"s{k}") for k, t in enumerate(terms[i : i + SUMS]))).first() for i in range(0, len(terms), SUMS)]
    return np.array([v for row in parts for v in row], float)


def fit(soft: DataFrame, names: list[str], weights: dict[str, float] | None, rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """soft with the rates (column rate, 1 at first) that bring the expected token totals to the targets, and a report of both.

    With weights given by domain (domains not named get none, unknown ones raise) the targets are those shares of all tokens, otherwise the
    present shares raised to FLATTEN. The squares are weighted by the inverse Gram matrix of the posteriors, under which a
    gradient step of length one never overshoots.
    """
    k, soft = len(names), soft.withColumn("rate", F.lit(1.0))
    if not k:
        return soft, {"targets": {}, "reached": {}, "rounds": 0}
    if weights and (unknown := sorted(set(weights) - set(names))):
        raise ValueError(f"weights for unknown domains: {unknown}")
    p, above = F.col("p"), [(i, j) for i in range(k) for j in range(i, k)]
    first = _sums(soft, [F.col("tokens") * p[i] for i in range(k)] + [F.col("tokens") * p[i] * p[j] for i, j in above])
    now, gram = first[:k], np.zeros((k, k))
    for (i, j), v in zip(above, first[k:], strict=True):
        gram[i, j] = gram[j, i] = v
    everything = now.sum()
    if not everything:
        return soft, {"targets": dict.fromkeys(names, 0.0), "reached": dict.fromkeys(names, 0.0), "rounds": 0}
    wanted = np.array([weights.get(n, 0.0) for n in names], float) if weights else (now / everything) ** FLATTEN
    targets = everything * wanted / max(wanted.sum(), 1e-300)
    inverse, steps, held, before = np.linalg.pinv(gram, hermitian=True), [], soft, np.inf
    for done in range(rounds):
        squares = (targets - now) @ inverse @ (targets - now)
        if np.abs(targets - now).max() <= TOLERANCE * everything or squares >= before * (1 - STILL):
            break
        before = squares
        steps.append(inverse @ (targets - now))
        moved = held.withColumn("rate", rate_of(steps, F.col("rate")))
        if len(steps) == STRIDE:
            held, steps = cut(moved), []
            moved = held
        now = _sums(moved, [F.col("tokens") * p[i] * F.col("rate") for i in range(k)])
    else:
        raise RuntimeError(f"rates did not settle in {rounds} rounds")
    reached = {"targets": dict(zip(names, targets.tolist(), strict=True)), "reached": dict(zip(names, now.tolist(), strict=True)), "rounds": done}
    return held.withColumn("rate", rate_of(steps, F.col("rate"))), reached


def rates(docs: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, **options) -> DataFrame:
    """(doc_id, tokens, domain, posterior, rate, copies, target, reached), one row per doc_id of docs.

    domain is the likeliest (the first by name of equals), posterior its probability. copies is the rate rounded down or up
    by a hash of doc_id, so that it is the rate on average. target and reached are the domain's totals of expected tokens that
    were wanted and that the rates give; they differ where no rates can meet all targets. Rows that share a doc_id, or have
    none, count as one document. Null texts and texts without a word hold no tokens, have no domain and keep rate 1. With no
    labelled row there is no domain and every rate is 1. Other columns are ignored; an empty table gives an empty result.
    """
    names, soft = posteriors(docs, domain, **options)
    fitted, report = fit(cut(soft), names, weights)
    best = F.array_max("p")
    of = lambda values: (F.array(*map(F.lit, values))[F.array_position("p", best).cast("int") - 1] if names else F.lit(None))
    some = lambda c, kind: F.when(F.col("tokens") > 0, c).cast(kind)
    rate = F.when(F.col("tokens") > 0, F.round("rate", 9)).otherwise(1.0)
    found = fitted.select(
        "doc_id", "tokens", some(of(names), "string").alias("domain"), some(best if names else F.lit(None), "double").alias("posterior"), rate.alias("rate"),
        *(some(of([report[c][n] for n in names]), "double").alias(c[:-1] if c == "targets" else c) for c in ("targets", "reached")),
    )
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).alias("copies")
    return found.select("doc_id", "tokens", "domain", "posterior", "rate", copies, "target", "reached")


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as its document's copies say."""
    key, count, each = (free_name(docs, n) for n in ("mixed_id", "copies", "copy"))
    moved = cut(rates(docs, **options).where("copies <> 1").select(F.col("doc_id").alias(key), F.col("copies").alias(count)))
    small = moved.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    joined = docs.join(F.broadcast(moved) if small else moved, docs["doc_id"].eqNullSafe(F.col(key)), "left")
    copies = F.coalesce(count, F.lit(1)).cast("int")
    return joined.select(*(docs[c] for c in docs.columns), F.explode(F.array_repeat(F.lit(1), copies)).alias(each)).drop(each)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(read(spark, sf_dir, "documents"))
