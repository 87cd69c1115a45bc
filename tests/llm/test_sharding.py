from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from factfold.llm import sharding
from tests.llm.helpers import documents, empty_documents, odd_documents, prose


def test_pack_takes_the_highest_dot_product_first():
    room = np.array([[10.0, 10, 10], [30.0, 30, 30]])
    assert sharding.pack(np.array([[8.0, 8, 8], [9.0, 9, 9]]), room).tolist() == [1, 1]
    assert sharding.pack(np.zeros((0, 3)), room).tolist() == []


def test_whole_table_is_placed_evenly_and_gapless(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sharding.op1_sharding(spark, data).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots, bytes_of = defaultdict(list), Counter()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
        bytes_of[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(bytes_of.values()) - min(bytes_of.values()) <= 2 * max(r.size for r in rows)


def test_bytes_tokens_and_rows_are_all_level(spark):
    texts = [prose("aa", 5 + i % 60, i) + " longerwords" * (i % 7) + " a b" * (i % 5) for i in range(4_000)]
    loads = defaultdict(lambda: np.zeros(3))
    for r in sharding.shard(documents(spark, texts), 8, cell_rows=500).collect():
        loads[r.shard] += (r.size, len(texts[r.doc_id].split()), 1)
    every = np.stack(list(loads.values()))
    assert len(every) == 8 and (every.max(axis=0) <= [1.02, 1.06, 1.06] * every.min(axis=0)).all()


def test_equal_texts_stay_together_unless_they_fill_shards(spark):
    texts = [prose("aa", 20, i) for i in range(400)] + ["small group"] * 3
    shards = defaultdict(set)
    for r in sharding.shard(documents(spark, texts), 4, cell_rows=100).collect():
        shards[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_hot_group_is_split_and_shards_are_level(spark):
    texts = ["the same text over and over"] * 900 + [prose("aa", 5, i) for i in range(900)]
    rows = sharding.shard(documents(spark, texts), 6, cell_rows=300).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    assert len(rows) == 6
    assert max(r.b for r in rows) < 1.1 * min(r.b for r in rows)


def test_packing_sees_groups_not_rows(spark):
    texts = ["copied text"] * 60 + [prose("aa", 5, i) for i in range(900)]
    rows = sharding.shard(documents(spark, texts * 20), 4, cell_rows=50).collect()
    shards = defaultdict(set)
    for r in rows:
        shards[(r.text_crc32, r["size"])].add(r.shard)
    assert len(rows) == len(texts) * 20
    assert len(shards) == len(set(texts))
    assert sum(len(s) > 1 for s in shards.values()) <= 1
    loads = Counter()
    for r in rows:
        loads[r.shard] += r["size"]
    assert max(loads.values()) < 1.1 * min(loads.values())


def test_odd_rows(spark):
    rows = sharding.shard(odd_documents(spark), 3).collect()
    assert len(rows) == 12
    assert sorted(r["size"] for r in rows)[:2] == [16, 16]
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= {0, 1, 2} and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty_documents(spark)).collect() == []


def _hash(value, seed: int) -> int:
    """Spark's xxhash64 of one string, long or int, seeded with the hash of what stands before it."""
    raw = value.encode() if isinstance(value, str) else int(value).to_bytes(8 if isinstance(value, np.int64) else 4, "little", signed=True)
    return int(np.uint64(xxhash.xxh64_intdigest(raw, seed)).view(np.int64))


def _chain(*values) -> int:
    seed = 42
    for v in values:
        seed = _hash(v, seed % (1 << 64))
    return seed


def _replayed(loads: list, room: list, given: list) -> None:
    """Each piece, the largest first, went where its weighted dot product with the room that was left is highest."""
    scale = [max(sum(max(r[d], 0.0) for r in room), 1e-9) / len(room) for d in range(3)]
    left = [[r[d] / scale[d] for d in range(3)] for r in room]
    own = [[v[d] / scale[d] for d in range(3)] for v in loads]
    for i in sorted(range(len(own)), key=lambda i: (-sum(own[i]), i)):
        fit = [own[i][0] * r[0] + 0.02 * own[i][1] * r[1] + 0.02 * own[i][2] * r[2] for r in left]
        assert fit[given[i]] >= max(fit) - 1e-9 * (1 + abs(max(fit)))
        for d in range(3):
            left[given[i]][d] -= own[i][d]


def test_placement_equals_packing_in_plain_python(spark):
    """Groups, cells, large pieces first and the dot products, worked out from the texts alone."""
    shards, cell_rows = 8, 300
    texts = [prose("aa", 5 + i * 7 % 50, i) for i in range(3_000)]
    texts += [t for k in range(30) for t in [prose("bb", 60, k)] * (5 + k)] + [prose("aa", 900, k) for k in range(12)] + [""] * 3
    rows = sharding.shard(documents(spark, texts), shards, cell_rows=cell_rows).collect()
    groups: dict = defaultdict(lambda: [0, 0, 0])
    of = {}
    for i, t in enumerate(texts):
        of[i] = (_chain(t, 7), zlib.crc32(t.encode()), len(t.encode()) + 16)
        for d, v in enumerate((of[i][2], len(t.split()), 1)):
            groups[of[i]][d] += v
    placed: dict = {}
    for r in rows:
        assert placed.setdefault(of[r.doc_id], r.shard) == r.shard  # no group here fills half a shard
    full = [sum(g[d] for g in groups.values()) / shards for d in range(3)]
    big = sorted(k for k, g in groups.items() if max(g[d] / (full[d] * 0.01) for d in range(3)) > 1)
    assert 20 < len(big) < 200 and placed.keys() == groups.keys()
    _replayed([groups[k] for k in big], [list(full) for _ in range(shards)], [placed[k] for k in big])
    room = [[max(full[d] - sum(groups[k][d] for k in big if placed[k] == s), 0.0) for d in range(3)] for s in range(shards)]
    cells, total = defaultdict(list), [sum(r[d] for r in room) for d in range(3)]
    number = max(1, round(len(groups) / cell_rows))
    for key in sorted(groups.keys() - set(big)):
        cells[_chain(np.int64(key[0]), np.int64(key[1]), np.int64(key[2])) % number].append(key)
    assert len(cells) == number > 5
    for keys in cells.values():
        own = [sum(groups[k][d] for k in keys) for d in range(3)]
        _replayed([groups[k] for k in keys], [[r[d] / max(total[d], 1e-9) * own[d] for d in range(3)] for r in room], [placed[k] for k in keys])
