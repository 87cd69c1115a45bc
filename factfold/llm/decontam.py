"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased runs of letters and digits of any script. A document window as long as a benchmark item is fingerprinted by
the SimHash of its five-word shingles, each counted as often as it occurs. Multi-index Hamming blocks over the items of that
length give every item within ``radius`` bits; weighted shingle similarity (sum of the smaller counts over sum of the larger)
of at least ``similarity`` then decides. A window that shares no shingle with an item has similarity zero, so windows are
fingerprinted only where a shingle of an item of that length occurs, and the blocks are made of the items that share one there;
this loses nothing. An item of fewer than five words is one shingle of its own length and matches where it occurs.

The items of one pass are bounded by ``max_bytes`` of text; a larger benchmark takes several passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.llm.common import read
from factfold.llm.simhash import _segments, balls

WIDTH, SIMILARITY, RADIUS, BLOCKS, MAX_BYTES, CHUNK = 5, 0.8, 20, 8, 32_000_000, 250_000
_PRIME, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.array([bytes([b]).isalnum() or b >= 128 for b in range(256)])
_MARKS = regex.compile(r"[^\p{L}\p{N}\p{M}\x00-\x7F]")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def plain(text: str) -> str:
    """The text with a space for every character beyond ASCII that belongs to no word, so that bytes from 128 on are in words."""
    return text if text.isascii() else _MARKS.sub(" ", text)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and where each text's words start (one more entry ends the last)."""
    parts = [plain(t.lower()).encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    inside = np.concatenate([[False], _WORD[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    powers = np.full(len(data), _PRIME, np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
    back = np.full(len(data), _INVERSE, np.uint64)
    back[:1] = 1
    h = _mix((prefix[stop] - prefix[start]) * np.cumprod(back, dtype=np.uint64)[start])
    begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    return h, np.searchsorted(start, begins)


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash of each run of ``width`` words, or of the whole sequence if it is shorter."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * _PRIME + words[k : k + len(out)])
    return out


def simhash_windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of ``size`` hashes: a bit is set if it is in over half of them."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits((sums[size:] - sums[:-size]) * 2 > size, axis=1, bitorder="little").view("<u8").ravel()


def shared(own: np.ndarray, keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` hashes of own: the sum over the sorted keys of the lesser of their counts there and ``counts``.

    An occurrence counts in the windows that hold fewer than its key's count of earlier ones, which is a range of windows.
    """
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    spot = np.flatnonzero(keys[at] == own)
    key = at[spot]
    order = np.argsort(key, kind="stable")
    spot, key = spot[order], key[order]
    back = np.arange(len(spot)) - counts[key]
    same = (back >= 0) & (key[np.maximum(back, 0)] == key)
    low = np.maximum(np.where(same, spot[np.maximum(back, 0)] + 1, 0), spot - size + 1).clip(0)
    windows = len(own) - size + 1
    steps = np.bincount(np.minimum(low, windows), minlength=windows + 1) - np.bincount(np.minimum(spot + 1, windows), minlength=windows + 1)
    return np.cumsum(steps)[:windows]


class Items:
    """Benchmark items of one pass: shingle counts, fingerprints, and which items hold a shingle."""

    def __init__(self, rows: list[tuple[int | None, str]], width: int = WIDTH, radius: int = RADIUS, blocks: int = BLOCKS):
        self.width, self.radius, self.blocks, self.ids, words, self.counts = width, radius, blocks, [], [], []
        hashes, fps = [], []
        self.short: dict[int, dict[int, list[int]]] = {}  # by number of words: the one shingle to items
        for item, text in rows:
            own_words, _ = word_hashes([text])
            if not len(own_words):
                continue
            own = shingles(own_words, width)
            if len(own_words) < width:
                self.short.setdefault(len(own_words), {}).setdefault(int(own[0]), []).append(len(self.ids))
            hashes.append(own if len(own_words) >= width else own[:0])
            fps.append(simhash_windows(own, len(own))[0])
            self.ids.append(item)
            words.append(len(own_words))
            self.counts.append(np.unique(own, return_counts=True))
        self.sizes, self.fps = np.array(words, int), np.array(fps, np.uint64)
        every = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.zeros(0, int)
        order = np.lexsort([owner, every])
        every, owner = every[order], owner[order]
        first = np.ones(len(every), bool)
        first[1:] = (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])
        self.keys, self.owners = every[first], owner[first]  # sorted by hash; a hash has each item that holds it once

    def _index(self, items: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first bit, mask, sorted keys, their items) of each block: every key of an item's Hamming ball."""
        out = []
        for (at, w), masks in zip(_segments(self.blocks), balls(self.radius, self.blocks), strict=True):
            own = (self.fps[items] >> np.uint64(at)) & np.uint64((1 << w) - 1)
            keys = (own[:, None] ^ np.array(masks, np.uint64)[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            out.append((at, (1 << w) - 1, keys[order], np.repeat(items, len(masks))[order]))
        return out

    def near(self, fps: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all windows and of the given items within the radius."""
        found = []
        for at, ones, keys, of_key in self._index(items):
            own = (fps >> np.uint64(at)) & np.uint64(ones)
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            count = hi - lo
            flat = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            found.append(np.repeat(np.arange(len(fps)), count) * len(self.ids) + of_key[flat])
        window, item = np.divmod(np.unique(np.concatenate(found)), len(self.ids))
        distance = np.bitwise_count(fps[window] ^ self.fps[item])
        ok = distance <= self.radius
        return window[ok], item[ok], distance[ok]

    def matches(self, texts: list[str | None], similarity: float) -> Iterator[tuple[int, int | None, float, int, int, int]]:
        """(row, item, similarity, distance, first word, words) of the best window for each row and item that match."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK):
                size += len(texts[end] or "")
                end += 1
            words, starts = word_hashes([t or "" for t in texts[at:end]])
            every = shingles(words, self.width) if len(words) >= self.width else np.zeros(0, np.uint64)
            hit = np.zeros(len(every), bool)
            if len(every) and len(self.keys):
                hit = self.keys[np.minimum(np.searchsorted(self.keys, every), len(self.keys) - 1)] == every
            rows = np.unique(np.searchsorted(starts, np.flatnonzero(hit), "right") - 1)
            for row in rows[np.diff(starts)[rows] >= self.width].tolist():
                for item, *best in self._in_document(shingles(words[starts[row] : starts[row + 1]], self.width), similarity):
                    yield at + row, self.ids[item], *best
            for n, keys in self.short.items():
                yield from ((at + row, item, 1.0, 0, first, n) for row, item, first in self._short(words, starts, n, keys))
            at = end

    def _short(self, words: np.ndarray, starts: np.ndarray, n: int, keys: dict[int, list[int]]) -> Iterator[tuple[int, int | None, int]]:
        """(row, item, first word) of the first place in each row of each item of n words, fewer than a shingle."""
        if len(words) < n:
            return
        own = shingles(words, n)
        place = np.flatnonzero(np.isin(own, np.array(list(keys), np.uint64)))
        row = np.searchsorted(starts, place, "right") - 1
        seen = set()
        for p, r in zip(place[place + n <= starts[row + 1]].tolist(), row[place + n <= starts[row + 1]].tolist(), strict=True):
            for item in keys[int(own[p])]:
                if (r, item) not in seen:
                    seen.add((r, item))
                    yield r, self.ids[item], p - int(starts[r])

    def _in_document(self, own: np.ndarray, similarity: float) -> Iterator[tuple[int, float, int, int, int]]:
        lo, hi = np.searchsorted(self.keys, own, "left"), np.searchsorted(self.keys, own, "right")
        place = np.repeat(np.arange(len(own)), hi - lo)
        owner = self.owners[np.arange(len(place)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        best: dict[int, tuple[float, int, int, int]] = {}
        for n in np.unique(self.sizes[owner]):
            of_size = self.sizes[owner] == n
            at, held = place[of_size], owner[of_size]
            q = min(int(n) - self.width + 1, len(own))
            edge = np.concatenate([[0], np.flatnonzero(np.diff(at) > q) + 1, [len(at)]])
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                first, last = max(0, int(at[i]) - q + 1), min(int(at[j - 1]), len(own) - q)
                first = min(first, last)
                window, item, distance = self.near(simhash_windows(own[first : last + q], q), np.unique(held[i:j]))
                order = np.lexsort([window, item])
                window, item, distance = window[order], item[order], distance[order]
                spot = np.concatenate([[0], np.flatnonzero(np.diff(item)) + 1, [len(item)]]) if len(item) else np.zeros(0, int)
                for a, b in zip(spot[:-1].tolist(), spot[1:].tolist(), strict=True):
                    one, (keys, counts) = int(item[a]), self.counts[item[a]]
                    least = shared(own[first : last + q], keys, counts, q)[window[a:b]]
                    score = least / (q + counts.sum() - least)
                    k = np.lexsort([window[a:b], distance[a:b], -score])[0]
                    if score[k] >= similarity and (one not in best or (score[k], -distance[a + k]) > (best[one][0], -best[one][1])):
                        best[one] = float(score[k]), int(distance[a + k]), first + int(window[a + k]), min(int(n), len(own) + self.width - 1)
        for item, row in best.items():
            yield item, *row


def passes(benchmark: DataFrame, max_bytes: int = MAX_BYTES) -> Iterator[Items]:
    """The benchmark in parts of about ``max_bytes`` of text at most; null texts and texts without a word are no items, those with a
    null id are."""
    rows = benchmark.where("text is not null").select("item_id", "text")
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = int(-(-total // max_bytes))
    for k in range(parts):
        yield Items([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).distinct().orderBy("item_id", "text").collect()])


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, distance, first_word, n_words): the best window of each document for each item it leaks.

    Documents without a leak, null and wordless texts give no row; an item under five words matches where its words follow each
    other (similarity 1); a document shorter than an item is one window; items with a null id give rows with a null item_id;
    repeated rows give repeated results; of equal windows the nearer fingerprint wins, then the first; other columns are ignored;
    an empty table on either side gives an empty result.
    """
    schema, out = "doc_id long, item_id long, similarity double, distance int, first_word int, n_words int", None
    for items in passes(benchmark, max_bytes):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if found := list(held.value.matches(batch.column(1).to_pylist(), similarity)):
                    row, item, score, distance, first, n = map(list, zip(*found, strict=True))
                    yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(distance, pa.int32()), pa.array(first, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "item_id", "similarity", "distance", "first_word", "n_words"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs without the rows that leak an item; every other row and column stays as it is."""
    for items in passes(benchmark, max_bytes):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in held.value.matches(batch.column("text").to_pylist(), similarity)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
