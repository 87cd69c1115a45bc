from __future__ import annotations

import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from factfold.llm import common, simhash
from tests.llm.helpers import documents, empty_documents, odd_documents, prose

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps: list[int], ids: list, radius: int = 4) -> list:
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {k: min((ids[i] for i in range(len(ids)) if label[i] == k and ids[i] is not None), default=None) for k in set(label)}
    return [least[k] for k in label]


@given(st.text(alphabet="ab AZé\n\t  漢", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_equals_its_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_balls_reach_every_pair():
    rng = random.Random(1)
    for radius, n in ((4, 3), (4, 5), (3, 2), (20, 8)):
        masks, segments = simhash.balls(radius, n), simhash._segments(n)
        for _ in range(50):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any((diff >> at) & ((1 << w) - 1) in own for (at, w), own in zip(segments, map(set, masks), strict=True))


@pytest.mark.parametrize("segments", [2, 3, 5])
def test_groups_are_those_of_brute_force(spark, segments):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(25)} | {0, (1 << 64) - 1, 15, 31})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = dict(zip(signed, plain_components(fps, signed), strict=True))
    got = {r.fp: r.top for r in simhash.groups(spark.createDataFrame([(f,) for f in signed], "fp long"), segments=segments).collect()}
    assert got.keys() == want.keys()
    names = {}
    assert all(names.setdefault(got[f], want[f]) == want[f] for f in signed) and len(set(got.values())) == len(set(want.values()))


def test_a_dense_group_never_gives_its_pairs(spark, monkeypatch):
    rng = random.Random(3)
    centre = rng.getrandbits(63)
    fps = sorted({centre ^ sum(1 << x for x in rng.sample(range(63), 2)) for _ in range(1_500)})
    given_edges = []
    monkeypatch.setattr(simhash, "components", lambda edges: given_edges.append(edges.count()) or common.components(edges))
    rows = simhash.groups(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert len({r.top for r in rows}) == 1
    assert sum(given_edges) < 10 * len(fps)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 4)
    monkeypatch.setattr(simhash, "CROWDED", 2)
    rng = random.Random(6)
    base = rng.getrandbits(64)
    centres = [base, base ^ 0b1111 << 40, base ^ 0b111111 << 40, base ^ 0b11111 << 10, rng.getrandbits(64)]
    fps = sorted({c ^ sum(1 << x for x in rng.sample(range(22, 64), rng.randint(0, 2))) for c in centres for _ in range(40)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want, got = dict(zip(signed, plain_components(fps, signed), strict=True)), simhash.groups(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    names = {}
    assert all(names.setdefault(r.top, want[r.fp]) == want[r.fp] for r in got) and len(names) == len(set(want.values())) > 1


def test_query_equals_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    fps, ids = [plain_fingerprint(r.text) for r in rows], [r.doc_id for r in rows]
    want = {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, plain_components(fps, ids), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash_dedup(spark, data).collect()} == want


def test_odd_rows(spark):
    rows = simhash.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == 12
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert [r.component_id for r in rows if r.fingerprint == "0" * 16] == [0] * 4
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert simhash.near_duplicates(empty_documents(spark)).collect() == []


def test_deduplicate_keeps_one_row_of_each_group(spark):
    same = prose("aa", 80, "x")
    docs = documents(spark, [same, same + " ", same.upper(), prose("bb", 80, 1), prose("bb", 80, 2)])
    docs = docs.unionByName(docs.where("doc_id in (0, 4)"))
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [0, 3, 4]
    assert simhash.deduplicate(docs).columns == docs.columns


def test_deduplicate_goes_by_rows_and_not_by_ids(spark):
    one, other, third = (prose("aa", 80, k) for k in range(3))
    rows = [(1, one), (2, one), (2, other), (None, third), (None, third + "\n"), (None, one), (3, None), (4, "")]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, one), (2, other), (3, None), next(tuple(r) for r in got if r.doc_id is None)], key=str)
    assert next(r.text for r in got if r.doc_id is None).strip() == third
