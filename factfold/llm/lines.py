"""Line dedup in DataFrame operations only: of a line that several documents hold, the smallest doc_id keeps its own.

Each line's key becomes two 64-bit hashes, which are range-partitioned and sorted by hash, document and position. Within a hash the
first row names the document that keeps the line; every row of another document is dropped as the rows stream by. What comes
back is no text but a bitmap per document, 64 lines to a word, of which only words that drop a line are kept.

A line that a large part of all rows holds would be one task's. A sample of the rows names such lines (at most CROWDS, so that the
table can be broadcast); their first documents are found by a pre-aggregated minimum and broadcast to their lines, which are
never shuffled by hash. The sample decides where a line is treated and not how, so it doesn't change the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factfold.llm.common import LOWER, UPPER, cut, free_name, read

#: Lines of fewer code points stay everywhere; characters that are stripped off a line's ends before it is compared.
LEAST, BLANKS = 10, " \t\n\x0b\x0c\r"
#: One line in SAMPLE tells which lines are crowded: those that are CROWD times among them, at most CROWDS of them.
SAMPLE, CROWD, CROWDS = 64, 32, 20_000
WORD = 64


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, copy, at, h, g): each line that is long enough, by document, hash of its text, position and the key's hashes."""
    split = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("copy"), F.posexplode(split_lines(F.col("text"))).alias("at", "line"))
    keyed = split.select("doc", "copy", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= LEAST)
    return keyed.select("doc", "copy", "at", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc, copy, at) of the lines that go."""
    lines, key = cut(occurrences(docs)), ["h", "g"]  # numbers only, written once: texts are split and hashed in one pass
    sampled = lines.sample(1 / SAMPLE, seed=42).groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= CROWD)
    crowded = cut(sampled.orderBy(F.desc("n"), *key).limit(CROWDS).select(*key))
    order = F.struct(F.col("doc").isNull().alias("none"), "doc")
    least = cut(lines.join(F.broadcast(crowded), key, "left_semi").groupBy(*key).agg(F.min(order)["doc"].alias("first")))
    hot = lines.join(F.broadcast(least), key)
    sorted_by = Window.partitionBy(*key).orderBy(F.col("doc").asc_nulls_last(), "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = lines.join(F.broadcast(crowded), key, "left_anti").repartitionByRange(*key).withColumn("first", F.first("doc").over(sorted_by))
    columns = ["doc", "copy", "at", "first"]
    return hot.select(*columns).unionByName(rest.select(*columns)).where(~F.col("doc").eqNullSafe(F.col("first"))).drop("first")


def line_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, n_dropped, keep) of the documents that lose a line; copy is xxhash64 of the text and tells rows of one id apart.

    keep is an array of (word, bits) in the order of words: bit i of word w is set if line 64 * w + i stays; words that are not there
    keep all their lines. Null and empty texts are one empty line. Rows of one doc_id are one document, rows without an id are one
    document that comes after all others. Repeated rows share a bitmap; other columns are ignored; an empty table gives none.
    """
    bits = dropped_lines(docs).select("doc", "copy", F.shiftright("at", 6).alias("word"), F.expr(f"shiftleft(1L, at % {WORD})").alias("bit"))
    words = bits.groupBy("doc", "copy", "word").agg(F.bit_or("bit").alias("gone"))
    each = F.struct("word", F.bitwise_not("gone").alias("bits"))
    return words.groupBy("doc", "copy").agg(F.sum(F.bit_count("gone")).alias("n_dropped"), F.array_sort(F.collect_list(each)).alias("keep")).withColumnRenamed("doc", "doc_id")


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of text that keep (null: all of them) leaves, joined."""
    lines = split_lines(text)
    words = F.sequence(F.lit(0), F.shiftright(F.size(lines) - 1, 6))
    bits = F.transform(words, lambda w: F.coalesce(F.get(F.filter(keep, lambda k: k["word"] == w), 0)["bits"], F.lit(-1).cast("long")))
    flags = F.flatten(F.transform(bits, lambda b: F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(b, i) == 1)))
    left = F.array_join(F.array_compact(F.zip_with(lines, flags, lambda line, stays: F.when(stays, line))), "\n")
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(left)


def marked(docs: DataFrame, keep: str = "keep", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with the columns keep (null: all lines) and n_dropped; names that docs has already raise."""
    if taken := {c.lower() for c in docs.columns} & {keep.lower(), n_dropped.lower()}:
        raise ValueError(f"docs has columns {sorted(taken)}")
    found, (doc, copy) = line_bitmaps(docs), (free_name(docs, n) for n in ("line_doc", "line_copy"))
    found = found.withColumnsRenamed({"doc_id": doc, "copy": copy}).withColumnsRenamed({"keep": keep, "n_dropped": n_dropped})
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found[doc]) & (F.xxhash64(docs["text"]) == found[copy]), "left")
    return joined.select(*(docs[c] for c in docs.columns), found[keep], F.coalesce(found[n_dropped], F.lit(0)).cast("long").alias(n_dropped))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines gone from their texts; null texts without a loss stay null."""
    keep, n = free_name(docs, "line_keep"), free_name(docs, "line_dropped")
    text = F.when(F.col(keep).isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col(keep)))
    return marked(docs, keep, n).withColumn("text", text).select(*docs.columns)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = marked(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(kept_text(F.col("text"), F.col("keep")), 256)
    return found.select("doc_id", F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"), "n_dropped", digest.alias("kept_sha256"))


OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT r, doc_id, i, line, coalesce(doc_id <> first, false) AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256 FROM m GROUP BY r, doc_id"""
