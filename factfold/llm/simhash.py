"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint is the bitwise majority over the hashes of its word shingles. Fingerprints within ``radius`` bits are
linked; linked documents form groups. Candidates come from multi-index hashing: the 64 bits are cut into segments, each
fingerprint is stored once per segment, and each looks up a small Hamming ball around its own segments. With radius 4 and 3
segments, two fingerprints within 4 bits differ by at most 1 bit in one of the first two segments or not at all in the
third, so 22 + 23 + 1 look-ups find every partner. Complete distances are verified inside the join. From WIDE fingerprints on
two segments of 32 bits are taken (529 + 33 look-ups), whose buckets stay small; either way every link is found.

A dense group never gives all its pairs: first each bucket is linked in a star to one of its own, as far as the distances
allow, which makes nearly all of a group one. Then only fingerprints of different groups are compared: in a crowded bucket, one of
many fingerprints in few groups, a look-up goes to the groups first and to the fingerprints of other groups only. What comes out is
pairs of groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.llm.common import arrow_map, components, cut, free_name, join_ids, read

RADIUS, SHINGLE, SEED = 4, 4, 42
#: So many distinct fingerprints make a bucket of a third of the bits (2^21) hold dozens of unrelated ones.
WIDE = 1 << 27
#: A bucket is crowded from so many fingerprints on if they are in so many times fewer groups.
CROWD, CROWDED = 64, 8
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = np.arange(8) * 256


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash; zero for null texts and texts without a word."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    if len(words) < width:
        hashes = digest(joined, seed)
    else:
        starts, stops = [0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist()
        hashes = b"".join([digest(joined[i:j], seed) for i, j in zip(starts, stops, strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)[:, ::-1]  # digests are big-endian; byte 0 becomes the lowest
    set_bits = np.einsum("bv,vk->bk", np.bincount((rows + _BYTE).ravel(), minlength=2048).reshape(8, 256), _BITS)
    return int.from_bytes(np.packbits(set_bits.ravel() * 2 > len(rows), bitorder="little").tobytes(), "little")


def signatures(docs: DataFrame, *keep: str, width: int = SHINGLE) -> DataFrame:
    """(*keep, fp): one signed 64-bit fingerprint per row of docs, whatever its other columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.record_batch([*(batch.column(k) for k in keep), pa.array(fp.view(np.int64))], [*keep, "fp"])

    return arrow_map(docs, [*keep, "text"], f"{schema}, fp long", work)


def _segments(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of n segments of 64 bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return list(zip(edges, np.diff(edges).tolist(), strict=False))


def balls(radius: int, n: int) -> list[list[int]]:
    """For each of n segments the XOR masks to look up: every two fingerprints within ``radius`` share a key.

    With radius = n * q + a the first a + 1 segments are searched within q bits, the others within q - 1.
    """
    q, a = divmod(radius, n)
    out = []
    for k, (_, width) in enumerate(_segments(n)):
        masks, ring = ([0], [(0, -1)]) if (most := q if k <= a else q - 1) >= 0 else ([], [])
        for _ in range(most):
            ring = [(m | 1 << b, b) for m, last in ring for b in range(last + 1, width)]
            masks += [m for m, _ in ring]
        out.append(masks)
    return out


def _keys(fps: DataFrame, masks: list[list[int]]) -> DataFrame:
    """The columns of fps with (seg, key): the segments of each fingerprint XORed with the masks of that segment."""
    spots = [(k, at, (1 << w) - 1, m) for k, ((at, w), own) in enumerate(zip(_segments(len(masks)), masks, strict=True)) for m in own]
    table = ",".join(f"({k},{at},{ones}L,{m}L)" for k, at, ones, m in spots)
    probes = fps.select("*", F.inline(F.expr(f"transform(array({table}), x -> named_struct('seg', x.col1, 'at', x.col2, 'ones', x.col3, 'mask', x.col4))")))
    return probes.select(*fps.columns, "seg", F.expr("(shiftrightunsigned(fp, at) & ones) ^ mask").alias("key"))


def _near(a: str, b: str, radius: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def groups(fps: DataFrame, radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """(fp, top): the fingerprint that names the group of each; fingerprints within ``radius`` bits are in one group, and so on.
    fps: distinct (fp)."""
    n = segments or (3 if fps.limit(WIDE).count() < WIDE else 2)
    entries = _keys(fps.select("fp"), [[0]] * n)
    centres = entries.groupBy("seg", "key").agg(F.min_by("fp", F.xxhash64("fp")).alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = entries.join(centres, ["seg", "key"]).where((F.col("fp") != F.col("centre")) & _near("fp", "centre", radius))
    first = components(stars.select(F.col("fp").alias("a"), F.col("centre").alias("b"))).withColumnsRenamed({"node": "fp", "component": "top"})
    own = cut(fps.select("fp").join(first, "fp", "left").select("fp", F.coalesce("top", "fp").alias("top")))
    table, probes = _keys(own, [[0]] * n), _keys(own, balls(radius, n)).withColumnsRenamed({"fp": "p", "top": "from"})
    by_group = table.groupBy("seg", "key", "top").agg(F.count("*").alias("n"))
    crowded = by_group.groupBy("seg", "key").agg(F.sum("n").alias("n"), F.count("*").alias("groups")).where((F.col("n") >= CROWD) & (F.col("n") >= CROWDED * F.col("groups"))).select("seg", "key")
    other, near = F.col("from") != F.col("top"), _near("p", "fp", radius)
    plain = probes.join(table.join(crowded, ["seg", "key"], "left_anti"), ["seg", "key"]).where(other & near)
    asked = probes.join(by_group.join(crowded, ["seg", "key"], "left_semi").drop("n"), ["seg", "key"]).where(other)
    met = plain.select("from", "top").unionByName(asked.join(table, ["seg", "key", "top"]).where(near).select("from", "top"))
    second = components(met.select(F.col("from").alias("a"), F.col("top").alias("b"))).withColumnsRenamed({"node": "top", "component": "above"})
    return own.join(second, "top", "left").select("fp", F.coalesce("above", "top").alias("top"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, segments: int | None = None, width: int = SHINGLE) -> DataFrame:
    """One row (doc_id, fingerprint, component_id, kept) per row of docs.

    component_id is the smallest doc_id reachable over links, kept marks the rows of that id. Copies share one
    fingerprint and are grouped before any link is sought. Null and wordless texts have fingerprint zero and are linked
    like any other; rows with a null doc_id take part and get the group's smallest id (their group's null if it has no
    other); repeated rows stay repeated; an empty table gives an empty result; other columns of docs are ignored.
    """
    sig = cut(signatures(docs, "doc_id", width=width))
    fps = cut(sig.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = cut(groups(fps, radius, segments).join(fps, "fp"))
    names = found.join(found.groupBy("top").agg(F.min("least").alias("component_id")), "top").select("fp", "component_id")
    out = sig.join(names, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, radius: int = RADIUS, segments: int | None = None, width: int = SHINGLE) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, null ones last, and of several texts of that id the one of
    the smallest digest. Of rows that repeat id and text one stays. Groups are those of near_duplicates."""
    text = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.when(F.col("text").isNull(), "0").otherwise("1"), F.coalesce("text", F.lit(""))]
    key, repeats = free_name(docs, "key"), free_name(docs, "again")
    keyed = docs.withColumn(key, F.md5(F.concat_ws(" ", *text)))
    sig = cut(signatures(keyed.select("doc_id", "text", F.col(key).alias("key")), "key", "doc_id", width=width))
    rank = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    best = cut(sig.groupBy("fp").agg(rank))
    found = cut(groups(best, radius, segments).join(best, "fp"))
    winners = found.join(found.groupBy("top").agg(F.min("best").alias("won")), "top").select("fp", F.col("won.key").alias("won"))
    marked = cut(sig.join(winners, "fp").select(F.col("key").alias(key), (F.col("key") == F.col("won")).alias("stays")))
    rest = join_ids(keyed, marked.where("not stays").select(key).distinct(), "left_anti", key)
    again = cut(marked.where("stays").groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").select(key, F.lit(True).alias(repeats)))
    if again.isEmpty():
        return rest.select(*docs.columns)
    several = join_ids(rest, again, "left", key)
    once = several.where(F.col(repeats).isNull()).unionByName(several.where(F.col(repeats)).dropDuplicates([key]))
    return once.select(*docs.columns)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
