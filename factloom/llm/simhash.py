"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within 3 bits of each other: the 64 bits fall into three blocks, and leaving out the block with the most
differing bits leaves at most 2 of them in the other two. So for each block left out, every distinct fingerprint emits
the remaining bits and all their variants at half that radius (1 bit): 132 variants in all. Two fingerprints that link
share a variant, those that share one are verified on all 64 bits. Shuffling is by variant; copies of a fingerprint
emit once.

A variant's fingerprints are joined into a spanning forest of verified links as they stream by in sorted order, so a
dense group gives fewer links than it has members and never its pairs; a key of more than ``PAIRS`` fingerprints is split by bits on
which linked ones have to be equal somewhere. A task passes its links on whenever it holds
``HELD`` of them, and starts a new forest.

Edge cases: a null text is empty; a text without words has fingerprint 0, which links like any other. Null ids belong
to their group but never name it, unless no member has an id. Repeated rows each keep their row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.components import connected_components
from factloom.storage import Scratch, table, unused

SHINGLE = 3
RADIUS = 3
SEED = 42
_BLOCKS = ((0, 22), (22, 43), (43, 64))  # from bit, to bit
_SMALL = 32
HELD = 200_000
#: Members of a group up to which each is compared with all before it; and bits of a set that larger groups are split by.
PAIRS = 20_000
SET = 6


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit number: a bit is set if over half of the shingles' hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        bits = h(joined, SEED)
        return bits - (1 << 64) if bits >> 63 else bits
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], ">u8")
    n, sums = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        sums += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int(np.packbits(sums * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _flips() -> list[np.ndarray]:
    """For each block left out: the bits of a one-bit change in the rest, and no change."""
    return [np.array([0, *(1 << i for i in range(64) if not lo <= i < hi)], np.uint64) for lo, hi in _BLOCKS]


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        all_fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(all_fps), 4096):
            fps, keys = all_fps[i : i + 4096], []
            for which, ((lo, hi), flips) in enumerate(zip(_BLOCKS, _flips(), strict=True)):
                v = fps[:, None] ^ flips[None, :]
                low, high = v & np.uint64((1 << lo) - 1), v >> np.uint64(hi) if hi < 64 else np.uint64(0)
                keys.append(((high << np.uint64(lo)) | low | np.uint64(which << 60)).reshape(-1))
            out = np.concatenate([np.repeat(fps, len(f)) for f in _flips()])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(out.view(np.int64))], ["key", "fp"])


class _Forest:
    """Union-find over fingerprints; ``links`` holds one link for each union."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        p = self.parent
        while (y := p.setdefault(x, x)) != x:
            p[x] = x = p.setdefault(y, y)
        return x

    def link(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.links.append((a, b))

    def group(self, fps: np.ndarray) -> None:
        """A large group of different fingerprints: links between all of it that is within the radius, none within a tree."""
        if len({self.root(x) for x in fps.tolist()}) > 1:
            _Dense(fps, self.link).split(np.arange(len(fps)), 0)


class _Dense:
    """Links of a group by splitting it: of ``RADIUS`` + 1 sets of bits, fingerprints within the radius are equal on one at least.

    So those equal on a set are a part of the group, and a part that is still large is split again by other bits, the most even ones of it. Parts
    whose members are in one tree already are left out.
    """

    def __init__(self, fps: np.ndarray, link: Callable[[int, int], None]):
        self.fps, self.link, self.parent = fps, link, np.arange(len(fps))

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.parent[at]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                self.parent[at] = r
                return r
            r = up

    def split(self, at: np.ndarray, fixed: int) -> None:
        r = self.roots(at)
        if (r == r[0]).all():
            return
        fps = self.fps[at]
        masks = [np.uint64(sum(1 << b for b in bits)) for bits in self.sets(fps, fixed)] if len(at) > PAIRS else []
        parts = [np.unique(fps & m, return_inverse=True, return_counts=True)[1:] for m in masks]
        if not parts or sum(int((n * n).sum()) for _, n in parts) > len(at) ** 2 // 2:  # splitting has to halve the pairs
            self.pairs(at)
            return
        for mask, (code, n) in zip(masks, parts, strict=True):
            order = np.argsort(code, kind="stable")
            for x, y in zip((np.cumsum(n) - n).tolist(), np.cumsum(n).tolist(), strict=True):
                if y > x + 1:
                    self.split(at[order[x:y]], fixed | int(mask))

    def sets(self, fps: np.ndarray, fixed: int) -> list[list[int]]:
        """``RADIUS`` + 1 sets of bits that split the group most evenly; none if too few bits differ."""
        ones = np.array([np.count_nonzero(fps & np.uint64(1 << b)) for b in range(64)])
        even = np.minimum(ones, len(fps) - ones)
        best = [b for b in np.argsort(-even, kind="stable").tolist() if even[b] and not fixed >> b & 1][: SET * (RADIUS + 1)]
        return [best[k :: RADIUS + 1] for k in range(RADIUS + 1)] if len(best) > RADIUS else []

    def pairs(self, at: np.ndarray) -> None:
        """Row by row: a link to each tree that the row touches."""
        fps, label = self.fps[at], self.roots(at)
        for i in range(1, len(at)):
            near = np.flatnonzero((label[:i] != label[i]) & (np.bitwise_count(fps[:i] ^ fps[i]) <= RADIUS))
            if len(near):
                trees, first = np.unique(label[near], return_index=True)
                for j in near[first].tolist():
                    self.link(int(fps[i]), int(fps[j]))
                all_trees = np.append(trees, label[i])
                least = int(all_trees.min())
                self.parent[all_trees] = least
                label[np.isin(label, all_trees)] = least


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> links; the last key of a batch waits for the next one."""
    forest, keys, fps = _Forest(), np.empty(0, np.int64), np.empty(0, np.uint64)

    def out() -> pa.RecordBatch:
        links = np.array(forest.links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["a", "b"])

    def take(keys: np.ndarray, fps: np.ndarray) -> None:
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(keys)))
        size = np.repeat(sizes, sizes)
        two = np.flatnonzero((size > 1) & (size <= _SMALL))
        k, f = keys[two], fps[two]
        found = []
        for s in range(1, int(sizes[sizes <= _SMALL].max(initial=1))):
            hit = np.flatnonzero((k[s:] == k[:-s]) & (np.bitwise_count(f[s:] ^ f[:-s]) <= RADIUS))
            found.append(np.stack([f[hit], f[hit + s]], 1))
        if found:
            for a, b in np.unique(np.concatenate(found), axis=0).tolist():
                forest.link(a, b)
        for s, n in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
            forest.group(fps[s : s + n])

    for b in batches:
        if not len(b):
            continue
        keys = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        whole = int(np.searchsorted(keys, keys[-1]))
        if whole:
            take(keys[:whole], fps[:whole])
            keys, fps = keys[whole:], fps[whole:]
            if len(forest.links) >= HELD or len(forest.parent) >= 4 * HELD:
                yield out()
                forest = _Forest()
    if len(keys):
        take(keys, fps)
    yield out()


def near_links(distinct: DataFrame) -> DataFrame:
    """distinct(fp) -> verified links (a, b) that connect all fingerprints within the radius of each other."""
    variants = distinct.select("fp").mapInArrow(_variants, "key long, fp long")
    return variants.repartition("key").sortWithinPartitions("key").mapInArrow(_verified, "a long, b long")


def groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id that links reach."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, text=text, doc_id=doc_id), "prints")
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(near_links(distinct), scratch)
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = scratch.save(named, "named")
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.select("fp", "root").join(heads, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that name their group: of each, the smallest id, and of its texts the one with the least hash. Rows equal in both stay once."""
    name = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"))
    k = unused(docs, "k")
    found = groups(docs.select(name.alias("name"), F.col(text).alias("text")), doc_id="name").select(F.xxhash64("doc_id").alias(k), (F.col("doc_id") == F.col("component_id")).alias("first"))
    found = Scratch(docs.sparkSession, "keep").save(found, "found")
    kept = docs.withColumn(k, F.xxhash64(name)).join(found.where("first").select(k).distinct(), k, "left_semi")
    if found.groupBy(k).count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([k])
    return kept.drop(k)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
