"""Language identification by interpolated Kneser-Ney character models.

Counting runs over all labelled training texts as a Spark job: each task sums the character n-grams of its rows and the
sums meet by (language, n-gram). The Kneser-Ney quantities of every order (discounts, continuation counts, context totals)
are DataFrame aggregations of those counts. All n-grams become sorted hash arrays with one row of log probabilities per n-gram,
a column per language. About ``max_grams`` of them (the bound of what is broadcast) make one part; a larger model takes several
passes over the texts, whose log probabilities add up. A text gets the language of lowest cross-entropy per character.
Temperature and rejection limits are set on a tenth of the training texts that is not counted.

The parts are ranges of the n-grams' contexts read backwards, so that an n-gram meets all it backs off to in its own part but
for the contexts that the first of the range ends with, which are added to it. Each character of a text belongs to one part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.llm.common import crc_bucket, cut, free_name, join_ids, read

ORDER, MAX_GRAMS, CHUNK, SPACE = 4, 600_000, 250_000, 32
UNKNOWN, END, SCALES = "und", (1 << 63) - 1, (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
#: A language of fewer training rows than this has all of them counted; its limit then stands on counted texts, so it is widened, and
#: is that of all languages together if that is wider. One row in ASIDE of the others is not counted.
FEW, ASIDE, QUANTILE, ACCURACY, WIDER, WIDEST = 1_000, 10, 0.999, 100_000, 1.25, 1.5
#: N-grams of all languages that a counting task holds before it passes them on.
HELD = 400_000


@cache
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK characters, so that memory doesn't follow the batch."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts with each run of other characters as one space, and where each text starts.

    A text ends with a space; one without a letter is empty.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    ends = np.cumsum([len(t) + 1 for t in low])
    kept = np.cumsum(keep)
    return np.where(letter, codes, SPACE)[keep], np.concatenate([[0], kept[ends - 1]]) if len(low) else np.zeros(1, int)


def grams(codes: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """For each character the ``order`` codes that end there; before the start of a text there are spaces."""
    at = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
    out = np.empty((len(codes), order), np.uint32)
    for back in range(order):
        column = out[:, order - 1 - back]
        column[back:] = codes[: len(codes) - back]
        column[at < back] = SPACE
    return out


def hashed(rows: np.ndarray) -> np.ndarray:
    """One 64-bit hash per row of codes."""
    h = np.full(len(rows), rows.shape[1] + 1, np.uint64)
    for k in range(rows.shape[1]):
        h = (h ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def places(rows: np.ndarray) -> np.ndarray:
    """The last three characters of each n-gram's context, the last one first, as one number; zeros stand for missing ones."""
    n = rows.shape[1]
    out = np.zeros(len(rows), np.int64)
    for back in range(1, min(n, 4)):
        out |= rows[:, n - 1 - back].astype(np.int64) << (63 - 21 * back)
    return out


def place():
    """``places`` as a column, from n and g."""
    code = lambda back: F.when(F.col("n") > back, F.ascii(F.expr(f"substring(g, n - {back}, 1)"))).otherwise(0).cast("long")
    return F.shiftleft(code(1), 42).bitwiseOR(F.shiftleft(code(2), 21)).bitwiseOR(code(3))


def count_grams(train: DataFrame, order: int) -> DataFrame:
    """(lang, g, c) over all rows of train: each task adds up its own rows before the shuffle, HELD n-grams at a time."""

    def given(sums: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for one, (_, rows, c) in sums.items():
            text = rows.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            g = [text[i : i + order] for i in range(0, len(text), order)]
            for k in range(0, len(g), 50_000):
                part = g[k : k + 50_000]
                yield pa.record_batch([pa.array([one] * len(part), pa.string()), pa.array(part, pa.string()), pa.array(c[k : k + 50_000], pa.int64())], ["lang", "g", "c"])
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            texts = np.array(batch.column(1).to_pylist(), object)
            for one in dict.fromkeys(lang):
                own = texts[lang == one].tolist()
                for i, j in _chunks(own):
                    rows = grams(*characters(own[i:j]), order)
                    h, first, c = np.unique(hashed(rows), return_index=True, return_counts=True)
                    rows = rows[first]
                    if one in sums:
                        h0, rows0, c0 = sums[one]
                        h, first, back = np.unique(np.concatenate([h0, h]), return_index=True, return_inverse=True)
                        rows, c = np.concatenate([rows0, rows])[first], np.bincount(back, np.concatenate([c0, c])).astype(np.int64)
                    sums[one] = h, rows, c
                    if sum(len(h) for h, *_ in sums.values()) > HELD:
                        yield from given(sums)
        yield from given(sums)

    return train.select("lang", "text").mapInArrow(run, "lang string, g string, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """(lang, n, g, c, total, kinds): counts of the highest order, continuation counts of the lower ones, and of each
    n-gram's context the sum and the number of its continuations."""
    level, levels = counts.select("lang", "g", "c"), []
    for n in range(order, 0, -1):
        levels.append(level.withColumn("n", F.lit(n)))
        level = level.groupBy("lang", F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("c"))
    every = levels[0]
    for one in levels[1:]:
        every = every.unionByName(one)
    every = every.withColumn("ctx", F.expr("substring(g, 1, n - 1)"))
    context = every.groupBy("lang", "n", "ctx").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    return every.join(context, ["lang", "n", "ctx"]).select("lang", "n", "g", "c", "total", "kinds")


class Model:
    """Sorted hash arrays: for each order n-grams with their log probabilities and contexts with their back-off weights.

    It scores the characters whose place is from ``low`` up to ``high``.
    """

    def __init__(self, langs: list[str], order: int, rows: dict[str, np.ndarray], discounts: np.ndarray, low: int = 0, high: int = END):
        self.langs, self.order, self.low, self.high = langs, order, low, high
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.contexts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.alphabet = max(1, int(len(np.unique(rows["g"][rows["n"] == 1]))))
        for n in range(1, order + 1):
            at = rows["n"] == n
            codes = np.frombuffer("".join(rows["g"][at]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
            lang, c, total, kinds = (rows[k][at] for k in ("lang", "c", "total", "kinds"))
            discount = discounts[lang, n]
            ctx, first, back = np.unique(hashed(codes[:, :-1]), return_index=True, return_inverse=True)
            weight = np.zeros((len(ctx), len(langs)), np.float32)
            weight[back, lang] = np.log(discount * kinds / total)
            self.contexts[n] = ctx, weight
            key, first, back = np.unique(hashed(codes), return_index=True, return_inverse=True)
            own = codes[first]
            table = self._backed_off(own, n).astype(np.float64)  # what an n-gram has where a language never saw it
            table[back, lang] = np.logaddexp(np.log(np.maximum(c - discount, 1e-9) / total), table[back, lang])
            self.grams[n] = key, table.astype(np.float32)

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        return at, keys[at] == h if len(keys) else np.zeros(len(h), bool)

    def _backed_off(self, codes: np.ndarray, n: int) -> np.ndarray:
        lower = self.log_probability(codes[:, 1:], n - 1) if n > 1 else np.full((len(codes), len(self.langs)), -np.log(self.alphabet + 1), np.float32)
        keys, weight = self.contexts[n]
        at, hit = self._find(keys, hashed(codes[:, :-1]))
        lower[hit] += weight[at[hit]]
        return lower

    def log_probability(self, codes: np.ndarray, n: int) -> np.ndarray:
        keys, table = self.grams[n]
        at, hit = self._find(keys, hashed(codes))
        out = table[at] if len(keys) else np.zeros((len(codes), len(self.langs)), np.float32)
        if not hit.all():
            out[~hit] = self._backed_off(codes[~hit], n)
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text and, under each language, the log probability of those that this part scores."""
        size, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        for i, j in _chunks(texts):
            codes, starts = characters(texts[i:j])
            size[i:j] = np.diff(starts)
            rows = grams(codes, starts, self.order)
            at = places(rows)
            own = np.flatnonzero((at >= self.low) & (at < self.high))
            if len(own):
                sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.log_probability(rows[own], self.order), axis=0, dtype=np.float64)])
                edge = np.searchsorted(own, starts)
                out[i:j] = sums[edge[1:]] - sums[edge[:-1]]
        return size, out


class Parts:
    """The model of all n-grams as a table (lang, n, g, c, total, kinds, place); iteration gives it part by part."""

    def __init__(self, langs: list[str], order: int, table: DataFrame, discounts: np.ndarray, starts: list[int]):
        self.langs, self.order, self.table, self.discounts, self.starts = langs, order, table, discounts, starts

    def __len__(self) -> int:
        return len(self.starts)

    def __iter__(self) -> Iterator[Model]:
        index = {x: k for k, x in enumerate(self.langs)}
        for low, high in zip(self.starts, [*self.starts[1:], END], strict=True):
            above = [low >> bits << bits for bits in (63, 42, 21)]  # the contexts that the first place ends with
            at = F.col("place")
            own = self.table.where(((at >= low) & (at < high)) | at.isin(above)).toArrow()
            rows = {k: own.column(k).to_numpy() for k in ("n", "c", "total", "kinds")} | {"g": np.array(own.column("g").to_pylist(), object), "lang": np.array([index[x] for x in own.column("lang").to_pylist()], int)}
            yield Model(self.langs, self.order, rows, self.discounts, low, high)

    def log_probability(self, codes: np.ndarray, n: int) -> np.ndarray:
        at, out = places(codes), np.zeros((len(codes), len(self.langs)), np.float32)
        for model in self:
            own = (at >= model.low) & (at < model.high)
            out[own] = model.log_probability(codes[own], n)
        return out


def train(docs: DataFrame, order: int = ORDER, max_grams: int = MAX_GRAMS) -> Parts:
    """The model of the rows of docs (lang, text) that have both, in parts of about ``max_grams`` n-grams."""
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    table = cut(kneser_ney(cut(count_grams(known, order)), order).withColumn("place", place()))
    once = F.sum((F.col("c") == 1).cast("long"))
    stats = table.groupBy("lang", "n").agg(once.alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"), F.count("*").alias("rows")).collect()
    langs = sorted({r.lang for r in stats})
    discounts = np.full((len(langs), order + 1), 0.5)
    for r in stats:
        if r.n1 and r.n2:
            discounts[langs.index(r.lang), r.n] = r.n1 / (r.n1 + 2 * r.n2)
    parts, edges = -(-sum(r.rows for r in stats) // max_grams), []
    if parts > 1:
        edges = table.agg(F.percentile_approx("place", [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    return Parts(langs, order, table, discounts, sorted({0, *edges}))


def score(docs: DataFrame, parts: Parts, *keep: str) -> DataFrame:
    """(*keep, size, entropy): characters of each row's text and its cross-entropy per character under each language.

    With several parts the sums of the passes meet by the text's digest, as nothing but the text decides.
    """
    spark, several = docs.sparkSession, len(parts) > 1
    digest = F.md5(F.coalesce("text", F.lit(""))).alias("__text")
    rows = docs.select(digest, "text") if several else docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema) + ", size long, sums array<double>"

    def one(model: Model) -> DataFrame:
        held = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    size, sums = held.value.sums([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
                    lists = pa.array(list(sums), pa.list_(pa.float64()))
                    yield pa.record_batch([*batch.columns[:-1], pa.array(size), lists], [*batch.schema.names[:-1], "size", "sums"])

        out = rows.mapInArrow(run, schema)
        if not several:
            return out
        out = cut(out.dropDuplicates(["__text"]))
        held.unpersist()
        return out

    passes = [one(model) for model in parts]
    if several:
        every = passes[0]
        for other in passes[1:]:
            every = every.unionByName(other)
        sums = F.array(*(F.sum(F.col("sums")[k]) for k in range(len(parts.langs))))
        found = every.groupBy("__text").agg(F.max("size").alias("size"), sums.alias("sums"))
        passes = [docs.select(*keep, digest).join(found, "__text")]
    return cut(passes[0].select(*keep, "size", F.transform("sums", lambda x: -x / F.greatest("size", F.lit(1))).alias("entropy")))


class Rule:
    """What the entropies say: language, score and rejection."""

    def __init__(self, langs: list[str], scale: float = 1.0):
        self.langs, self.scale, self.limits = langs, scale, np.full(len(langs), np.inf)

    def calibrate(self, scored: DataFrame, few: list[str] | tuple[str, ...] = ()) -> None:
        """Set the scale by log loss over all rows of scored (taught, size, entropy) with a language, and each language's
        rejection limit beyond nearly all it has seen there; those of few rows are named."""
        width, index = len(self.langs), {x: k for k, x in enumerate(self.langs)}
        own = F.col("entropy")[F.array_position(F.array(*map(F.lit, self.langs)), F.col("taught")).cast("int") - 1]
        known = scored.where((F.col("size") > 0) & F.col("taught").isin(self.langs)).withColumn("own", own)  # a language without a model teaches nothing
        cube = known.rollup("taught").agg(F.percentile_approx("own", QUANTILE, ACCURACY).alias("q")).collect()
        pooled = next((r.q for r in cube if r.taught is None), None)
        for r in cube:
            if r.taught is not None:
                self.limits[index[r.taught]] = WIDEST * max(r.q, pooled) if r.taught in few else WIDER * r.q
        if pooled is None:
            return
        rules = [Rule(self.langs, scale) for scale in SCALES]

        def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    truth, size, entropy = np.array([index[x] for x in batch.column(0).to_pylist()]), batch.column(1).to_numpy(), _matrix(batch.column(2), width)
                    loss = [-np.log(np.maximum(r.posterior(size, entropy)[np.arange(len(size)), truth], 1e-12)).sum() for r in rules]
                    yield pa.record_batch([pa.array(SCALES), pa.array(loss)], ["scale", "loss"])

        sums = known.select("taught", "size", "entropy").mapInArrow(losses, "scale double, loss double").groupBy("scale").agg(F.sum("loss").alias("loss"))
        self.scale = min(sums.collect(), key=lambda r: (r.loss, r.scale)).scale

    def posterior(self, size: np.ndarray, entropy: np.ndarray) -> np.ndarray:
        score = -entropy * (np.minimum(size, 100) * self.scale)[:, None]
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def decide(self, size: np.ndarray, entropy: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, for each text."""
        if not self.langs:
            return [UNKNOWN] * len(size), np.zeros(len(size)), np.ones(len(size), bool)
        best, at = entropy.argmin(axis=1), np.arange(len(size))
        score = np.where(size > 0, self.posterior(size, entropy)[at, best], 0.0)
        odd = entropy[at, best] > self.limits[best] + 4 / np.sqrt(np.maximum(size, 1))
        return [self.langs[k] if n else UNKNOWN for k, n in zip(best, size, strict=True)], score, odd | (size == 0)


def _matrix(column: pa.Array, langs: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, langs) if langs else np.zeros((len(column), 0))


def judged(docs: DataFrame, *keep: str, **options) -> DataFrame:
    """(*keep, lang_pred, score, rejected) for each row of docs, after training on those not held out."""
    taught = ~held_out() & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    sizes = docs.where(taught).groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") < FEW).collect()
    few = sorted(r.lang for r in sizes)
    of_few, known = F.col("lang").isin(few), taught
    aside = F.pmod(F.xxhash64("doc_id", "text", F.lit("aside")), F.lit(ASIDE)) == 0
    parts = train(docs.where(known & (of_few | ~aside)), **options)
    scored = score(docs.withColumn("__taught", F.when(known & (of_few | aside), F.col("lang"))), parts, *keep, "__taught")
    rule, width = Rule(parts.langs), len(parts.langs)
    if width:
        rule.calibrate(scored.withColumnRenamed("__taught", "taught"), few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lang, score, odd = rule.decide(batch.column("size").to_numpy(), _matrix(batch.column("entropy"), width))
                yield pa.record_batch([*(batch.column(k) for k in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(odd)], [*keep, "lang_pred", "score", "rejected"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.select(*keep).schema)
    return scored.mapInArrow(run, f"{kept}, lang_pred string, score double, rejected boolean")


def held_out():
    return crc_bucket("doc_id", 5) == 0


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row per row of docs.

    Rows whose id falls in the held-out fifth and rows without lang or text teach nothing. Null and letterless texts are
    ``und`` with score 0 and rejected; so is every text if no row can teach. Ties go to the language first by name. Repeated
    rows stay; other columns are ignored; an empty table gives an empty result.
    """
    return judged(docs.select("doc_id", "lang", "text"), "doc_id", **options).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that language ID rejects; they go by the text's digest, as nothing but the text decides."""
    digest, name = F.md5(F.coalesce("text", F.lit(""))), free_name(docs, "digest")
    found = judged(docs.select("doc_id", "lang", "text", digest.alias(name)), name, **options)
    odd = found.where("rejected").select(name).distinct()
    return join_ids(docs.withColumn(name, digest), odd, "left_anti", name).select(*docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
