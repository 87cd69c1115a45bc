"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and stems is learned from the labelled rows by smoothed log odds, in FOLDS folds: the rows of one fold get
their features from the lexicon of the others, so that the trees don't trust words that only their own row made look toxic.
Trees are fitted on four fifths of all labelled rows and calibrated on the rest (both on all of it, if either side lacks toxic or clean rows); texts are scored with the lexicon of all folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.llm.common import crc_bucket, cut, join_ids, read
from factfold.llm.features import TOXICITY, feature_rows, runs, toxicity

#: All labelled rows teach: there is no bound. A lexicon has the words and stems that at least so many toxic rows hold and that are so much
#: likelier there.
TRAIN_ROWS, FOLDS, LEAST_ROWS, LEAST_ODDS = None, 5, 3, 2.5
#: Least partitions of the fitted rows, which are numbers only, and rows of a partition.
PARTS, PART_ROWS = 8, 100_000
TREES, DEPTH, STEP = 12, 3, 0.4


def labelled(docs: DataFrame, labels: DataFrame, label: str, taught) -> DataFrame:
    """(doc_id, y, text): all ids that may teach and have a label.

    One row per id: of repeated ids the smallest text, of several labels the greatest.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    return join_ids(docs.select("doc_id", "text"), y.where(taught), "inner").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def parted(rows: DataFrame, n: int) -> DataFrame:
    """rows, which are numbers only and n in number, in at least PARTS parts of about PART_ROWS rows."""
    return rows.repartition(max(PARTS, -(-n // PART_ROWS)))


def lexicons(sample: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes and weights of words and stems: learned without each of the folds in turn, and last from all."""
    cells = [f"{a}{k}" for a in "np" for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("y").to_numpy() * FOLDS + batch.column("fold").to_numpy()
            for at, t in runs(batch.column("text").to_pylist()):
                pairs = np.unique(np.stack([np.concatenate([t.row, t.row]).astype(np.uint64), np.concatenate([t.word, t.stem])], 1), axis=0)
                h, back = np.unique(pairs[:, 1], return_inverse=True)
                counts = np.bincount(kind[pairs[:, 0].astype(int) + at] * len(h) + back, minlength=2 * FOLDS * len(h)).reshape(2 * FOLDS, len(h))
                yield pa.record_batch([pa.array(h.view(np.int64)), *map(pa.array, counts)], ["h", *cells])

    schema = "h long, " + ", ".join(f"{c} long" for c in cells)
    toxic = sum((F.col(f"p{k}") for k in range(FOLDS)), F.lit(0))
    size = np.zeros((2, FOLDS))
    for r in sample.groupBy("y", "fold").count().collect():
        size[r.y, r.fold] = r["count"]

    def likely(left_out: int):
        """Whether the lexicon without a fold may take a word; a little wide, as the driver decides below."""
        folds = [k for k in range(FOLDS) if k != left_out]
        n, p = (sum((F.col(f"{a}{k}") for k in folds), F.lit(0)) for a in "np")
        rows = size[:, folds].sum(axis=1)
        return F.log((p + 0.5) / F.lit(float(rows[1] + 1))) - F.log((n + 0.5) / F.lit(float(rows[0] + 1))) >= LEAST_ODDS - 1e-6

    some = likely(FOLDS)
    for k in range(FOLDS):
        some = some | likely(k)
    seen = sample.select("text", "y", "fold").mapInArrow(run, schema).groupBy("h").agg(*(F.sum(c).alias(c) for c in cells)).where((toxic >= LEAST_ROWS) & some).toArrow()
    h, counts = seen.column("h").to_numpy().view(np.uint64), np.stack([seen.column(c).to_numpy() for c in cells]).reshape(2, FOLDS, -1)
    out = []
    for left_out in range(FOLDS + 1):
        folds = [k for k in range(FOLDS) if k != left_out]
        own, rows = counts[:, folds].sum(axis=1), size[:, folds].sum(axis=1)
        odds = np.log((own[1] + 0.5) / (rows[1] + 1)) - np.log((own[0] + 0.5) / (rows[0] + 1))
        good = (own[1] >= LEAST_ROWS) & (odds >= LEAST_ODDS)
        order = np.argsort(h[good])
        out.append((h[good][order], odds[good][order]))
    return out


def calibration(rows: DataFrame) -> IsotonicRegressionModel:
    """Isotonic regression of label on p (centred): the steps' values stand at their middles and lines join them, so that two
    probabilities never tie. Values stay within half a row of 0 and 1, and 0 and 1 stand for themselves."""
    flat = IsotonicRegression(featuresCol="p").fit(rows)
    x, y = np.array(flat.boundaries), np.array(flat.predictions)
    values, step = np.unique(y, return_inverse=True)
    middle = np.array([(x[step == k].min() + x[step == k].max()) / 2 for k in range(len(values))])
    least = 0.5 / (rows.count() + 1)
    inner = [(m, v) for m, v in zip(middle.tolist(), values.clip(least, 1 - least).tolist(), strict=True) if 0 < m < 1]
    knots = rows.sparkSession.createDataFrame([(0.0, 0.0), *inner, (1.0, 1.0)], "p double, label double")
    return IsotonicRegression(featuresCol="p", predictionCol="calibrated").fit(knots)


class Fitted:
    """What is learned: the lexicons (the last one of all folds), the trees and the calibration."""

    def __init__(self, sample: DataFrame):
        held = self.lexicons = sample.sparkSession.sparkContext.broadcast(lexicons(sample))
        crossed = [self.features(sample.where(F.col("fold") == k), ["doc_id", "y"], k) for k in range(FOLDS)]
        every = crossed[0]
        for other in crossed[1:]:
            every = every.unionByName(other)
        self.vectors = VectorAssembler(inputCols=TOXICITY, outputCol="features")
        rows = cut(parted(self.vectors.transform(every).select("doc_id", "features", F.col("y").cast("double").alias("label")), sample.count()))
        part = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0
        sides = rows.select("label", part.alias("part")).distinct().count()
        fitted, rest = (rows.where(~part), rows.where(part)) if sides == 4 else (rows, rows)
        self.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=42, maxBins=64).fit(fitted)
        self.steps = calibration(self.probability(rest))
        self.lexicon = held.value[FOLDS]

    def features(self, rows: DataFrame, keep: list[str], left_out: int) -> DataFrame:
        held = self.lexicons
        return feature_rows(rows, keep, TOXICITY, lambda at, t, batch: toxicity(t, *held.value[left_out]))

    def probability(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    def scored(self, docs: DataFrame, *keep: str) -> DataFrame:
        """keep and ``calibrated`` of each row of docs."""
        return self.steps.transform(self.probability(self.vectors.transform(self.features(docs, list(keep), FOLDS)))).select(*keep, "calibrated")


def taught_rows(docs: DataFrame, labels: DataFrame, train_rows: int | None = TRAIN_ROWS) -> DataFrame:
    """All rows of ``labelled`` outside the held-out fifth, with the fold of each row, a folder per fold; ``train_rows`` is no longer
    a bound and must be None."""
    if train_rows is not None:
        raise ValueError("all labelled rows teach")
    rows = labelled(docs, labels, "toxic", crc_bucket("doc_id", 5) != 0)
    return cut(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")), by="fold")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    Only labelled rows outside the held-out fifth teach; an id with several labels counts as toxic if one says so. Null and
    empty texts have zero features and get the score that these earn. If the rows that teach have no label or one kind only, every
    score is the share of toxic rows smoothed by one of each. Null ids are scored and teach nothing; repeated rows stay;
    other columns are ignored; an empty table gives an empty result.
    """
    held_out = crc_bucket("doc_id", 5) == 0
    sample = taught_rows(docs, labels)
    counts = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    if not 0 < counts.p < counts.n:
        flat = F.lit((counts.p + 1) / (counts.n + 2))
        return docs.select("doc_id", held_out.alias("held_out"), flat.alias("score"), (flat >= 0.5).cast("int").alias("predicted"))
    final = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated")))
    out = Fitted(sample).scored(docs, "doc_id").select("doc_id", held_out.alias("held_out"), final.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
