"""Line dedup against its SQL and a plain version."""

from __future__ import annotations

import hashlib

from factfold.llm import lines
from tests.llm.helpers import documents, empty_documents, odd_documents, prose
from tests.oracle import expected, found

BLANK = " \t\n\x0b\x0c\r"


def plain(rows):
    """(doc_id, lines, dropped, digest) of each (doc_id, text)."""
    key = lambda line: line.strip(BLANK).translate(str.maketrans(lines.UPPER, lines.LOWER))
    last = lambda i: (i is None, i or 0)
    first: dict[str, tuple] = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                first[k] = min(first.get(k, last(i)), last(i))
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if first.get(key(x), last(i)) == last(i)]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def digests(docs):
    from pyspark.sql import functions as F

    rows = lines.marked(docs.select("doc_id", "text")).select("doc_id", F.size(lines.split_lines(F.col("text"))), "n_dropped", F.sha2(lines.kept_text(F.col("text"), F.col("keep")), 256))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_query_equals_its_sql(spark, data):
    assert found(lines.op11_line_dedup(spark, data)) == expected(lines.OP11_SQL, data)


def test_first_document_keeps_its_own_lines(spark):
    shared, other = "A line that is SHARED", "only of one document"
    long = "\n".join([f"line number {i} of a long text" for i in range(300)])
    rows = [shared, f"{other}\n  {shared.lower()}\t\n{other}\nshort", f"{shared}\n{shared}", long, f"{long}\nand its own end\n", "short\r\nshort", f"x\n\n{shared}\r", None, "", "Éa line with Accents", "éa line with accents"]
    docs = documents(spark, rows)
    assert digests(docs) == plain(texts_of(docs))
    left = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs).collect()}
    assert (left[0], left[1], left[2], left[4], left[7]) == (shared, f"{other}\n{other}\nshort", "", "and its own end\n", None)
    assert left[9] == rows[9] and left[10] == rows[10]  # only A-Z are lowered


def test_bitmaps_hold_only_words_that_lose_a_line(spark):
    docs = documents(spark, ["the repeated line", "\n".join(["x"] * 130 + ["the repeated line"] + ["x"] * 100)])
    (row,) = lines.line_bitmaps(docs).collect()
    assert (row.doc_id, row.n_dropped, [tuple(k) for k in row.keep]) == (1, 1, [(2, ~(1 << 2))])


def test_odd_documents_and_clashing_names(spark):
    docs = odd_documents(spark)
    assert digests(docs) == plain(texts_of(docs))
    named = docs.withColumnsRenamed({"shard": "line_keep", "fp": "Line_Doc", "key": "keep"})
    left = lines.drop_repeated_lines(named)
    assert left.columns == named.columns and left.count() == named.count()
    assert digests(empty_documents(spark)) == [] and lines.drop_repeated_lines(empty_documents(spark)).count() == 0


def test_crowded_lines_have_the_same_result(spark, monkeypatch):
    rows = ["\n".join(["this line is everywhere", prose("aa", 12, i // 3), "this line is everywhere"]) for i in range(400)]
    docs = documents(spark, rows).repartition(7)
    want = plain(texts_of(docs))
    assert digests(docs) == want
    monkeypatch.setattr(lines, "SAMPLE", 1)
    monkeypatch.setattr(lines, "CROWD", 3)
    assert digests(docs) == want
    monkeypatch.setattr(lines, "CROWDS", 1)
    assert digests(docs) == want
