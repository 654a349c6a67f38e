"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of segments; one row holds a slice of the documents with, for each of its terms, the sorted positions of
its postings (a position counts words through the segment, with a gap between documents that no phrase can bridge), as
differences. All words of all documents are in it, as 64-bit hashes, so that it serves any benchmark. Segments are written
once to the shared folder, by the tasks that read the documents, without a shuffle.

Phrases are a table too: the distinct windows of the items. Which of their terms are rare is known from the sums over all
segments. A search takes each phrase's postings from its rarest term on and intersects them with those of the next rarest,
offsets adjusted; what is left are exact matches. With a slop, a term may stand up to that many words off its place
(proximity matches). Up to ``BLOCK`` words of phrases are sent to all segments, which take those whose rarest term they have;
beyond that, phrases meet the segments that have their rarest term in a join.

Edge cases: a null text has no words and no hits; an item with a null or empty text has no window. An item without an id
counts for hits and contamination, and is left out of the items found and their number. Repeated documents each keep
their row. Two items with the same window both count. Ids may have any type that has a text form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.storage import Scratch, table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Words of phrases that are broadcast and pass through the driver, some 50 bytes each.
BLOCK = 500_000
#: Words of documents in a segment, about; a longer document is a segment of its own.
SEGMENT = 1_000_000
#: Words whose hash a Python worker remembers.
CACHE = 1_000_000


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z are lower-cased, digits, letters a-z and all beyond ASCII belong to words (UTF-8)."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class _Terms(dict):
    """Words -> places in ``hashes``."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's words as hashes."""
        if len(self) > CACHE:
            self.clear(), self.hashes.clear()
        codes = [np.fromiter(map(self.__getitem__, w), np.int64, len(w)) for w in map(words, texts)]
        hashes = np.array(self.hashes, np.uint64).view(np.int64)
        return [hashes[c] for c in codes]


def build_index(docs: DataFrame, scratch: Scratch, gap: int = WINDOW + 1, *, text: str = "text", doc_id: str = "doc_id", segment: int = SEGMENT) -> DataFrame:
    """Segments: (segment, doc_ids, n_words, starts, terms, counts, postings); all but the first are arrays, postings int32 bytes.

    ``gap``: at least the words of the longest phrase and the slop to be searched for, and one.
    """
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, made, held_words = _Terms(), TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Scalar] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, held_words
            n = np.array(sizes, np.int64)
            starts = np.concatenate(([0], np.cumsum(n + gap)[:-1]))
            at = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            term = np.concatenate(held)
            order = np.argsort(term, kind="stable")
            term, at = term[order], at[order]
            first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.empty(0, np.int64)
            step = np.diff(at, prepend=0)
            step[first] = at[first]
            list_of = lambda x, t: pa.array([x], pa.list_(t))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made]), pa.array([ids], pa.list_(id_type)), list_of(n, pa.int64()), list_of(starts, pa.int64()), list_of(term[first], pa.int64()), list_of(np.diff(np.append(first, len(term))), pa.int64()), pa.array([step.astype("<i4").tobytes()], pa.binary())],
                ["segment", "doc_ids", "n_words", "starts", "terms", "counts", "postings"],
            )
            made, held_words = made + 1, 0
            ids.clear(), sizes.clear(), held.clear()
            return out

        for b in (batch.slice(k, 500) for batch in batches for k in range(0, len(batch), 500)):
            id_type = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), known(b.column(1).to_pylist()), strict=True):
                ids.append(i), sizes.append(len(t)), held.append(t)
                held_words += len(t)
                if held_words >= segment or len(sizes) >= 50_000:
                    yield flush()
        if ids:
            yield flush()

    schema = f"segment long, doc_ids array<{kind.simpleString()}>, n_words array<long>, starts array<long>, terms array<long>, counts array<long>, postings binary"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    return scratch.save(rows, "index")


def phrases(items: DataFrame, window: int = WINDOW, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(terms, names): the distinct windows of the items as hashes, and the items that have them; a name may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms()
        for b in batches:
            names, found = [], []
            for name, t in zip(b.column(0).to_pylist(), known(b.column(1).to_pylist()), strict=True):
                for i in range(max(1, len(t) - window + 1) if len(t) else 0):
                    names.append(name), found.append(t[i : i + window])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["name", "terms"])

    each = items.select(F.col(item_id).cast("string"), F.col(text)).mapInArrow(run, "name string, terms array<long>")
    nameless = F.when(F.max(F.col("name").isNull()), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    return each.groupBy("terms").agg(F.concat(F.collect_set("name"), nameless).alias("names"))


class _Segment(NamedTuple):
    number: int
    starts: np.ndarray
    n_words: np.ndarray
    terms: np.ndarray
    ends: np.ndarray
    postings: np.ndarray

    @classmethod
    def of(cls, row: pa.RecordBatch) -> _Segment:
        flat = {c: row.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("starts", "n_words", "terms", "counts")}
        return cls(row.column("segment")[0].as_py(), flat["starts"], flat["n_words"], flat["terms"], np.cumsum(flat["counts"]), np.frombuffer(row.column("postings")[0].as_py(), "<i4"))

    def places(self, term: int) -> np.ndarray:
        k = int(np.searchsorted(self.terms, term))
        if k == len(self.terms) or self.terms[k] != term:
            return np.empty(0, np.int64)
        return np.cumsum(self.postings[self.ends[k - 1] if k else 0 : self.ends[k]], dtype=np.int64)

    def has(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(len(terms), bool)
        return self.terms[np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)] == terms

    def search(self, plan: list[tuple[int, int]], slop: int, known: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document number, from, to) of a phrase's places. plan: (term, offset), the rarest term first; ``known`` keeps the lists decoded."""
        lists = []
        for term, offset in plan:
            if (have := known.get(term)) is None:
                have = known[term] = self.places(term)
            if not len(have):
                return (np.empty(0, np.int64),) * 3
            lists.append((have, offset))
        at = lists[0][0] - lists[0][1]
        for have, offset in lists[1:]:
            k = np.minimum(np.searchsorted(have, at + offset - slop), len(have) - 1)
            at = at[np.abs(have[k] - at - offset) <= slop]
            if not len(at):
                break
        at = np.unique(at)
        d = np.maximum(np.searchsorted(self.starts, at, side="right") - 1, 0)
        return d, np.maximum(at - self.starts[d], 0), np.minimum(at - self.starts[d] + len(plan), self.n_words[d])


_SPAN = "struct<item:string,`from`:int,`to`:int>"


def find(index: DataFrame, windows: DataFrame, *, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """Every document of the index as (segment, doc_no, doc_id, n_words, spans); a span is (item, from, to) in words of the document, to excluded.

    A span of a proximity match reaches over the phrase's own length from where its rarest term places it.
    """
    spark = index.sparkSession
    scratch = Scratch(spark, "phrases")
    windows = scratch.save(windows, "windows")
    each = windows.select("terms", "names", F.posexplode("terms").alias("at", "term"))
    wanted = each.select("term").distinct()
    counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    counts = counts.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    plan = F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("plan")
    plans = each.join(counts, "term").groupBy("terms").agg(plan, F.first("names").alias("names")).where(F.size("plan") == F.size("terms"))
    plans = scratch.save(plans.select(F.transform("plan", lambda x: F.struct(x["term"].alias("term"), x["at"].alias("at"))).alias("plan"), "names"), "plans")
    held = plans.agg(F.sum(F.size("plan") + F.size("names"))).first()[0] or 0  # one number
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("doc_no", "x")).select("segment", "doc_no", F.col("x.doc_ids").alias("doc_id"), F.col("x.n_words").alias("n_words"))
    hits = _sent(index, plans, slop) if held <= block else _met(index, plans, slop)
    hits = scratch.save(hits, "hits").groupBy("segment", "doc_no").agg(F.collect_list(F.struct("item", "from", "to")).alias("spans"))
    none = F.array().cast(f"array<{_SPAN}>")
    return docs.join(hits, ["segment", "doc_no"], "left").withColumn("spans", F.coalesce("spans", none))


_HIT = "segment long, doc_no int, item string, `from` int, `to` int"


def _hits(segment: _Segment, plans: Iterator[tuple[list[tuple[int, int]], list[str | None]]], slop: int) -> pa.RecordBatch:
    known: dict[int, np.ndarray] = {}
    doc, begin, end, item = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    for plan, names in plans:
        d, lo, hi = segment.search(plan, slop, known)
        for name in names if len(d) else ():
            doc.append(d), begin.append(lo), end.append(hi)
            item += [name] * len(d)
    d, lo, hi = (np.concatenate(x).astype(np.int32) for x in (doc, begin, end))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(d), segment.number, np.int64)), pa.array(d), pa.array(item, pa.string()), pa.array(lo), pa.array(hi)], ["segment", "doc_no", "item", "from", "to"])


def _pairs(plan: list[dict]) -> list[tuple[int, int]]:
    return [(x["term"], x["at"]) for x in plan]


def _sent(index: DataFrame, plans: DataFrame, slop: int) -> DataFrame:
    """Hits of a few phrases, which all tasks are sent."""
    listed = [([(x["term"], x["at"]) for x in r["plan"]], r["names"]) for r in plans.collect()]  # at most a block of words
    sent = index.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = sent.value
        rarest = np.array([plan[0][0] for plan, _ in listed], np.int64)
        for b in batches:
            for row in range(len(b)):
                segment = _Segment.of(b.slice(row, 1))
                yield _hits(segment, (listed[k] for k in np.flatnonzero(segment.has(rarest)).tolist()), slop)

    return index.select("segment", "n_words", "starts", "terms", "counts", "postings").mapInArrow(run, _HIT)


def _met(index: DataFrame, plans: DataFrame, slop: int) -> DataFrame:
    """Hits of many phrases: segments meet the phrases whose rarest term they have."""
    holders = index.select("segment", F.explode("terms").alias("rarest"))
    asked = plans.withColumn("rarest", F.col("plan")[0]["term"]).join(holders, "rarest").select("segment", F.lit(1).alias("kind"), "plan", "names")
    held = index.select("segment", F.lit(0).alias("kind"), "n_words", "starts", "terms", "counts", "postings")
    both = held.unionByName(asked, allowMissingColumns=True).repartition("segment").sortWithinPartitions("segment", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = None
        for b in batches:
            kind = b.column("kind").to_numpy()
            edges = [*np.flatnonzero(kind == 0).tolist(), len(b)]
            if segment is not None and edges[0]:
                yield _hits(segment, _listed(b.slice(0, edges[0])), slop)
            for x, y in zip(edges, edges[1:], strict=False):
                segment = _Segment.of(b.slice(x, 1))
                if y > x + 1:
                    yield _hits(segment, _listed(b.slice(x + 1, y - x - 1)), slop)

    return both.mapInArrow(run, _HIT)


def _listed(b: pa.RecordBatch) -> Iterator[tuple[list[tuple[int, int]], list[str | None]]]:
    return zip(map(_pairs, b.column("plan").to_pylist()), b.column("names").to_pylist(), strict=True)


def search(docs: DataFrame, items: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Index ``docs`` and find the windows of all ``items``; see ``find`` for the result."""
    index = build_index(docs, Scratch(docs.sparkSession, "postings"), window + slop + 1, text=text, doc_id=doc_id)
    return find(index, phrases(items, window, item_id=item_id, text=item_text), slop=slop)


def digest(found: DataFrame) -> DataFrame:
    """Adds n_hit (words under any span), items (those found, sorted), n_items and contaminated."""
    covered = F.expr("""
        aggregate(array_sort(transform(spans, s -> struct(s.`from` AS f, s.`to` AS t))), struct(cast(0 AS bigint) AS n, 0 AS last),
          (a, s) -> struct(a.n + greatest(0, s.t - greatest(s.f, a.last)) AS n, greatest(a.last, s.t) AS last), a -> a.n)""")
    items = F.expr("array_sort(array_distinct(filter(transform(spans, s -> s.item), x -> x IS NOT NULL)))")
    return found.withColumns({"n_hit": covered, "items": items}).withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = digest(search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, {split} AS w FROM documents),
    i AS (SELECT CAST(item_id AS VARCHAR) AS item, {split} AS w FROM benchmark),
    win AS (SELECT DISTINCT item, n, list_slice(w, p, p + n - 1) AS g FROM
      (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM win),
    dg AS (SELECT k, n, p, list_slice(w, p, p + n - 1) AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes)),
    m AS (SELECT k, item, p, n FROM dg JOIN win USING (n, g)),
    hit AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM m) GROUP BY k),
    its AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM m GROUP BY k)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
      sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (k) LEFT JOIN its USING (k)"""
