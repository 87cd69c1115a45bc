"""Small tables of documents with the cases that every operator must stand."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "aa": "river stone bright morning window garden letter winter silver carry follow gentle market number people summer travel valley wonder yellow".split(),
    "bb": "fluss stein hell morgen fenster garten brief silber tragen folgen sanft markt zahl leute sommer reise tal wunder gelb haus".split(),
}


def prose(lang: str, words: int, seed) -> str:
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(WORDS[lang]) for _ in range(words))


def documents(spark, texts, langs=None, first: int = 0):
    langs = langs or ["aa"] * len(texts)
    return spark.createDataFrame([(first + i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))], DOCS)


def odd_documents(spark):
    """Null, empty, blank, very long, repeated and null-id rows, and columns whose names clash with the operators' own."""
    long = prose("aa", 60_000, "long")
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "!!! ??"), (4, long), (5, "one"), (5, "one"), (6, "one"), (None, prose("aa", 40, 1)), (None, None), (7, prose("bb", 40, 2)), (8, "é漢字 ß" * 30)]
    extra = [(i, t, "aa" if i != 7 else "bb", None, None, 1, 2, 3, "x", 0.5, 9, 9, "p") for i, t in rows]
    names = "shard int, fp int, key int, lang_pred string, score double, component_id int, copies int, tokens string"
    return spark.createDataFrame(extra, f"{DOCS}, {names}")


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def string_type(df, column):
    return isinstance(df.schema[column].dataType, T.StringType)
