"""Dense text features of whole Arrow batches, for the toxicity and quality models.

Everything is counted on the bytes and word hashes of a run of texts at once. Rates are per word or per character, so that
features of long and short texts compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factfold.llm.decontam import _mix, plain

CHUNK, STEM = 250_000, 5
#: Second-person words of the four languages of the corpus.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes ti vosotros os su".split()
_P, _PI = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ALL = np.arange(256)
_LOWER, _UPPER, _DIGIT = (_ALL >= 97) & (_ALL <= 122), (_ALL >= 65) & (_ALL <= 90), (_ALL >= 48) & (_ALL <= 57)
_HIGH = _ALL >= 128
_SPACE = np.isin(_ALL, [9, 10, 11, 12, 13, 32])
_LETTER, _SYMBOL = _LOWER | _UPPER | _HIGH, ~(_LOWER | _UPPER | _HIGH | _DIGIT | _SPACE)
#: Characters that stand for letters in disguised words.
_DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_PLAIN = np.array([ord(_DISGUISE.get(chr(b), chr(b).lower() if b < 128 else chr(b))) if b < 128 else b for b in range(256)], np.uint8)
_MASKED = np.isin(_ALL, [ord(c) for c in "0134579@$*#"])

TOXICITY = ["hits", "hit_rate", "weight", "weight_rate", "top1", "top2", "stem_hits", "second_person", "near_second", "capitals", "shouted", "exclaims", "questions", "punctuation", "disguised", "log_words"]
QUALITY = ["symbols", "symbol_runs", "pipes", "repeats", "unique", "top_word", "word_length", "line_words", "line_ends", "digits", "capitals", "letters", "one_word_lines", "log_words", "no_words"]


class Text:
    """The bytes of a run of texts with their words: starts, stops, hashes of words and stems, rows."""

    def __init__(self, texts: list[str]):
        parts = [plain(t).encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        self.begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
        self.rows = len(texts)
        letter = _LETTER[self.data]
        following = np.concatenate([letter[1:], [False]])
        inside = letter | _DIGIT[self.data] | (np.isin(self.data, [36, 64]) & following)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        self.start, self.stop = edge[::2], edge[1::2]
        self.row = np.searchsorted(self.begins, self.start, "right") - 1
        read_as = _PLAIN[self.data].astype(np.uint64) + np.uint64(1)
        powers, back = np.full(len(read_as), _P, np.uint64), np.full(len(read_as), _PI, np.uint64)
        powers[:1] = back[:1] = 1
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(read_as * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64)])
        scale = np.cumprod(back, dtype=np.uint64)[self.start]
        self.word = _mix((prefix[self.stop] - prefix[self.start]) * scale)
        self.stem = _mix((prefix[np.minimum(self.stop, self.start + STEM)] - prefix[self.start]) * scale) ^ np.uint64(0x5DEECE66D)

    def per_byte(self, mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[self.begins[1:]] - sums[self.begins[:-1]]).astype(float)

    def per_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, values, self.rows)

    @property
    def words(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows).astype(float)

    @property
    def sizes(self) -> np.ndarray:
        return np.maximum(np.diff(self.begins) - 1, 1).astype(float)

    def largest(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows)
        np.maximum.at(out, self.row, values)
        return out


def runs(texts: list[str | None]) -> Iterator[tuple[int, Text]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK):
            size += len(texts[end] or "")
            end += 1
        yield at, Text([t or "" for t in texts[at:end]])
        at = end


_YOU = np.unique(Text([" ".join(SECOND_PERSON)]).word)


def _weights(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], 0.0)


def toxicity(t: Text, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """TOXICITY by row, given a lexicon of sorted hashes with weights."""
    words, sizes = np.maximum(t.words, 1), t.sizes
    own, stem = _weights(keys, values, t.word), _weights(keys, values, t.stem)
    weight = np.maximum(own, stem)
    hit = weight > 0
    top1 = t.largest(weight)
    order = np.lexsort([-weight, t.row])
    place = np.arange(len(order)) - np.searchsorted(t.row[order], t.row[order])
    top2 = np.bincount(t.row[order], np.where(place < 2, weight[order], 0), t.rows)
    you = np.isin(t.word, _YOU)
    sums = np.concatenate([[0], np.cumsum(you)])
    lo = np.maximum(np.arange(len(you)) - 5, np.searchsorted(t.row, t.row))
    hi = np.minimum(np.arange(len(you)) + 6, np.searchsorted(t.row, t.row, "right"))
    near = hit & (sums[hi] > sums[lo])
    upper, letter = _UPPER[t.data], _LETTER[t.data]
    caps = np.concatenate([[0], np.cumsum(upper)])
    shouted = (caps[t.stop] - caps[t.start] == t.stop - t.start) & (t.stop - t.start > 2)
    mask = _MASKED[t.data]
    mask[1:-1] &= letter[:-2] & letter[2:]
    n = t.per_word(hit)
    return np.stack([
        n, n / words, t.per_word(weight), t.per_word(weight) / words, top1, top2, t.per_word(stem > 0), t.per_word(you) / words, t.per_word(near) / words,
        t.per_byte(upper) / sizes, t.per_word(shouted) / words, t.per_byte(t.data == 33) / sizes, t.per_byte(t.data == 63) / sizes,
        t.per_byte(_SYMBOL[t.data]) / sizes, t.per_byte(mask) / sizes, np.log1p(t.words),
    ], 1)


def quality(t: Text) -> np.ndarray:
    """QUALITY by row."""
    words, sizes, data = np.maximum(t.words, 1), t.sizes, t.data
    symbol = _SYMBOL[data]
    run = np.zeros(len(data), bool)
    run[1:] = symbol[1:] & (data[1:] == data[:-1])
    again = np.zeros(len(t.word), bool)
    again[1:] = (t.word[1:] == t.word[:-1]) & (t.row[1:] == t.row[:-1])
    order = np.lexsort([t.word, t.row])
    first = np.ones(len(order), bool)
    first[1:] = (t.word[order][1:] != t.word[order][:-1]) | (t.row[order][1:] != t.row[order][:-1])
    spot = np.flatnonzero(first)
    counts = np.diff(np.concatenate([spot, [len(order)]]))
    top = np.zeros(t.rows)
    np.maximum.at(top, t.row[order][spot], counts)
    kinds = np.bincount(t.row[order][spot], minlength=t.rows)
    newline = data == 10
    lines = np.maximum(t.per_byte(newline), 1)  # the separator after each text counts as its last line's end
    stop_before = np.zeros(len(data), bool)
    stop_before[1:] = newline[1:] & np.isin(data[:-1], [33, 46, 63, 34, 58])
    line = np.cumsum(newline)[t.start] if len(t.start) else np.zeros(0, int)
    alone = np.ones(len(line), bool)
    alone[1:] &= line[1:] != line[:-1]
    alone[:-1] &= line[:-1] != line[1:]
    return np.stack([
        t.per_byte(symbol) / sizes, t.per_byte(run) / sizes, t.per_byte(data == 124) / words, t.per_word(again) / words, kinds / words ** 0.8, top / words,
        np.minimum(t.per_word(t.stop - t.start) / words, 20), np.log1p(t.words / lines), t.per_byte(stop_before) / lines, t.per_byte(_DIGIT[data]) / sizes,
        t.per_byte(_UPPER[data]) / sizes, t.per_byte(_LETTER[data]) / sizes, t.per_word(alone) / words, np.log1p(t.words), (t.words == 0).astype(float),
    ], 1)


def feature_rows(docs: DataFrame, keep: list[str], names: list[str], work) -> DataFrame:
    """keep and the named features of each row; work(first row, Text, batch) gives them for a run of rows."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in keep), *(f"{n} double" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.concatenate([work(at, t, batch) for at, t in runs(batch.column("text").to_pylist())])
                yield pa.record_batch([*(batch.column(c) for c in keep), *(pa.array(x[:, k]) for k in range(len(names)))], [*keep, *names])

    return docs.select(*keep, "text").mapInArrow(run, schema)
