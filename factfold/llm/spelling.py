"""Spelling variants grouped by anagram hashing.

A word's key is the sum of the fifth powers of its letters' codes, modulo a prime. Two words that differ by one letter have keys
that differ by one letter's power or by the difference of two. So each word is entered under its own key and, for each of its
letters, under the key without that letter: a word meets a longer one where its key is the other's key less a letter (addition,
removal), and two words of one length meet where both lack a letter (exchange). The sums say nothing of the order of letters. Of
two words one edit apart, either the first half of the letters they share is the same or the second half is, so an entry also
carries a half, which keeps anagrams apart before the join; then the order is verified by edit distance.

Every pair is found once: the removed letters are what the two words don't share (fifth powers of two letters add up to no other
two's), and a pair that agrees in both halves counts for the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.llm.common import LOWER, UPPER, cut, read
from factfold.operators.graph import chain_ends

#: Words: letters in a row; how many code points and occurrences make one; how many times a form is as frequent as its variant.
RUN, LEAST_LENGTH, LEAST_COUNT, TIMES = "[A-Za-zÀ-ÿ]", 7, 2, 10
#: One run in EVERY loses a letter before it is counted (by crc32 of id and run), which plants misspellings; None plants none.
EVERY, PRIME = 31, (1 << 61) - 1


def words(docs: DataFrame, every: int | None = EVERY) -> DataFrame:
    """(word, n) of all texts: maximal runs of letters, A-Z lower-cased, of LEAST_LENGTH code points and LEAST_COUNT occurrences.

    Null and empty texts have none; a null doc_id counts as no digits before the colon of what is hashed.
    """
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))
    low = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if every:
        hashed = low.select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "utf-8")).alias("h"))
        at = (F.col("h") % F.char_length("run")).cast("int")
        low = hashed.select(F.when(F.col("h") % every == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run")).alias("run"))
    return low.where(F.char_length("run") >= LEAST_LENGTH).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return F.pmod(code * code * code * code * code, F.lit(PRIME))


def anagram_key(letters: Column) -> Column:
    return F.aggregate(letters, F.lit(0).cast("long"), lambda a, c: F.pmod(a + power(c), F.lit(PRIME)))


def _letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def entries(keyed: DataFrame) -> DataFrame:
    """(bucket, value, letter, side, size, word, n) of keyed (word, n, key): the key itself (no letter) and the key less each letter, once
    with the first half and once with the second half of as many letters as are left (size)."""
    size = F.char_length("word")
    whole = F.struct(F.lit("").alias("letter"), F.col("key").alias("value"), size.alias("size"))
    less = F.transform(F.array_distinct(_letters(F.col("word"))), lambda c: F.struct(c.alias("letter"), F.pmod(F.col("key") - power(c), F.lit(PRIME)).alias("value"), (size - 1).alias("size")))
    each = keyed.select("word", "n", F.explode(F.concat(F.array(whole), less)).alias("e")).select("word", "n", "e.*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    half = F.when(F.col("side") == 0, _first("word", "size")).otherwise(_second("word", "size"))
    return each.select(F.xxhash64("value", "size", "side", half).alias("bucket"), "value", "letter", "side", "size", "word", "n")


def _first(word: str, size: str) -> Column:
    return F.substr(word, F.lit(1), F.floor(F.col(size) / 2).cast("int"))


def _second(word: str, size: str) -> Column:
    rest = (F.col(size) - F.floor(F.col(size) / 2)).cast("int")
    return F.substr(word, F.char_length(word) - rest + 1, rest)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n), each two words of vocabulary (word, n) that are one edit apart once."""
    keyed = cut(vocabulary.select("word", "n", anagram_key(_letters(F.col("word"))).alias("key")))
    one = entries(keyed)
    other = one.select(*(F.col(c).alias(f"other_{c}") for c in one.columns))
    meets = one.join(other, F.col("bucket") == F.col("other_bucket"))
    same = (F.col("value") == F.col("other_value")) & (F.col("size") == F.col("other_size")) & (F.col("side") == F.col("other_side"))
    edit = (F.col("other_letter") != "") & (F.col("letter") < F.col("other_letter"))  # no letter: the other has one more; a letter: exchanged
    first, second = (half("word", "size") == half("other_word", "other_size") for half in (_first, _second))
    once = F.when(F.col("side") == 0, first).otherwise(second & ~first)
    return meets.where(same & edit & once & (F.levenshtein("word", "other_word", 1) == 1)).select("word", "n", "other_word", "other_n")


def variants(docs: DataFrame, every: int | None = EVERY, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of ``words``.

    n_near is how many words are one edit apart. form is the most frequent of these (ties: the first by code points) if it is at least
    ``times`` as frequent, else null, and form_n how often it occurs; root is where following the forms ends, the word itself without
    one. Repeated rows count again; other columns are ignored; an empty table gives an empty result.
    """
    vocabulary = cut(words(docs, every))
    pairs = near_pairs(vocabulary)
    both = F.inline(F.array(F.struct(F.col("word"), F.col("other_word").alias("near"), F.col("other_n").alias("near_n")), F.struct(F.col("other_word").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    best = pairs.select(both).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    joined = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    found = cut(joined)
    roots = chain_ends(found.select(F.col("word").alias("node"), F.col("form").alias("next"))).select(F.col("node").alias("word"), F.col("last").alias("root"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))
