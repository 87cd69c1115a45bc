"""Quality by Bradley-Terry pairwise ranking.

Pairs of a better and a worse labelled document are drawn by a join on hash buckets, about as many as there are better ones.
Logistic loss on the differences of their features gives one weight per feature; a document's strength is the weighted sum.
The threshold is the quantile of the strengths of all labelled documents that teach that leaves as many above it as were labelled good, and scores are a
logistic of the strength that equals 0.7 there.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.llm.common import crc_bucket, cut, read
from factfold.llm.features import QUALITY, feature_rows, quality
from factfold.llm.toxicity import labelled, parted

CUTOFF, PENALTY, ITERATIONS = 0.7, 1e-4, 40
#: Bins that a pass of ``ranked`` counts.
BINS = 1_024


def fit(rows: DataFrame, features: list[str] = QUALITY) -> list[float]:
    """A weight per feature from rows (doc_id, y, features)."""
    worse = max(1, rows.where("y = 0").count())
    side = lambda y, tag: rows.where(F.col("y") == y).select(F.pmod(F.xxhash64("doc_id", F.lit(tag)), F.lit(worse)).alias("bucket"), *(F.col(f).alias(f"{tag}_{f}") for f in features))
    pairs = side(1, "better").join(side(0, "worse"), "bucket")
    ahead = [(F.col(f"better_{f}") - F.col(f"worse_{f}")) for f in features]
    both = pairs.select(F.lit(1.0).alias("label"), *(d.alias(f) for d, f in zip(ahead, features, strict=True))).unionByName(pairs.select(F.lit(0.0).alias("label"), *((-d).alias(f) for d, f in zip(ahead, features, strict=True))))
    data = cut(parted(VectorAssembler(inputCols=features, outputCol="features").transform(both).select("label", "features"), 2 * rows.where("y = 1").count()))
    if data.isEmpty():
        return [0.0] * len(features)
    return LogisticRegression(fitIntercept=False, regParam=PENALTY, maxIter=ITERATIONS).fit(data).coefficients.tolist()


def ranked(rows: DataFrame, column: str, rank: int) -> float:
    """The value of that rank (from 0) of a column without nulls: bins between the least and the greatest value are counted, and the one that
    holds the rank is cut into bins again, until its values are one. No pass sends more than BINS rows."""
    s = F.col(column)
    low, high = rows.agg(F.min(s), F.max(s)).first()
    while low < high:
        within = rows.where(s.between(low, high))
        by = F.least(F.floor((s - low) / F.lit(high - low) * BINS), F.lit(BINS - 1)).alias("bin")
        for r in within.groupBy(by).agg(F.count("*").alias("n"), F.min(s).alias("low"), F.max(s).alias("high")).orderBy("bin").collect():
            if rank < r.n:
                low, high = r.low, r.high
                break
            rank -= r.n
    return low


def quantile(rows: DataFrame, column: str, share: float) -> float:
    """As ``percentile``, which would hold all values in one task: exact, and linear between neighbours."""
    at = share * (rows.count() - 1)
    below = ranked(rows, column, math.floor(at))
    return below if at == math.floor(at) else below + (at - math.floor(at)) * (ranked(rows, column, math.ceil(at)) - below)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, strength), one row per row of docs.

    Only labelled rows outside the held-out quarter teach; an id with several labels counts as good if one says so. Null and
    empty texts have their own features and get the score that these earn. Without pairs every strength is zero and every
    score is 0.7, but 0.3 where all labels say bad. Null ids are scored and teach nothing; repeated rows stay; other columns are ignored; an empty table gives
    an empty result.
    """
    held_out = crc_bucket("doc_id", 4) == 2
    work = lambda at, t, batch: quality(t)
    known = cut(feature_rows(labelled(docs, labels, "quality", ~held_out), ["doc_id", "y"], QUALITY, work))
    weights = fit(known)
    strength = sum((F.col(f) * w for f, w in zip(QUALITY, weights, strict=True)), F.lit(0.0))
    good = known.agg(F.avg("y")).first()[0]
    threshold = 0.0 if good is None else 2 * math.log(CUTOFF / (1 - CUTOFF)) if good == 0 else quantile(cut(known.select(strength.alias("s"))), "s", 1 - good)
    shift = math.log(CUTOFF / (1 - CUTOFF))
    scored = feature_rows(docs, ["doc_id"], QUALITY, work).select("doc_id", held_out.alias("held_out"), strength.alias("strength"))
    ahead = F.col("strength") - threshold
    final = F.when(ahead >= 0, F.greatest(F.lit(CUTOFF), 1 / (1 + F.exp(-ahead - shift)))).otherwise(1 / (1 + F.exp(-ahead - shift)))
    return scored.select("doc_id", "held_out", final.alias("score"), (final >= CUTOFF).cast("int").alias("predicted"), "strength")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
