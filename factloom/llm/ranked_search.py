"""Ranked lexical search of many queries at once, by evaluating what they share only once.

1. The tasks that read the documents write an index of segments: a slice of documents, with the postings (document, occurrences) of
   all its terms as 64-bit hashes. It serves any queries.
2. Which terms a query set shares is mined in rounds: a query is a sequence of nodes, most frequent first; neighbouring
   nodes that at least two queries have side by side, and that no better pair overlaps, become one node. What results is a graph: terms,
   shared term sets made of two smaller ones each, and queries as the few nodes left to them.
3. The graph is sent to the segments, at most about ``BLOCK`` terms at a time. A segment computes each node's accumulator
   (a partial score for each of its documents) once, however many sets and queries use it, adds them up along the graph, and keeps
   the best documents of each query. The best of all are a ranked pick by query.

Scores are whole numbers, so the order in which parts are added doesn't matter.

Edge cases: null and empty texts have no terms and are never found; a query without terms, or without a match, has no rows.
Documents with equal scores stand by id, nulls last; repeated documents are found each for itself. Queries with the same id are
ranked each for itself. Empty tables give an empty table. Other columns are not read.
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
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.storage import Scratch, table

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOP = 20
#: Terms of queries that are sent at a time.
BLOCK = 500_000
#: Terms of documents in a segment, about; a longer document is a segment of its own.
SEGMENT = 1_000_000
#: Terms whose hash a Python worker remembers.
CACHE = 1_000_000
#: Rounds of mining at most; each joins sets of the round before, so a shared set may have 2^ROUNDS terms.
ROUNDS = 12
#: Documents in a segment at most; an accumulator has a number for each.
DOCS = 8192
#: Segments in a row group of the index: some 6 MB each as Parquet, 24 at most as arrays.
GROUP = 2
#: Bytes of accumulators of shared sets that a worker holds, about: with many sets, a segment's documents are taken in slices, of LEAST documents or more.
ACCUMULATORS, LEAST = 64 << 20, 64
SATURATION, LENGTH_PERCENT = 12, 25


def terms(text: str | None) -> list[bytes]:
    """Terms of a text: runs of digits, ASCII letters (A-Z lower-cased) and all beyond ASCII, as UTF-8."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


class _Hashes(dict):
    """Terms -> their hashes."""

    def __missing__(self, term: bytes) -> int:
        h = xxhash.xxh64_intdigest(term)
        h = self[term] = h - (1 << 64) if h >> 63 else h
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        found = terms(text)
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def build_index(docs: DataFrame, scratch: Scratch, *, text: str = "text", doc_id: str = "doc_id", segment: int = SEGMENT) -> DataFrame:
    """Segments: (segment, doc_ids ascending, n terms of each, terms, df of each in the segment, docs, tf); ``docs`` and ``tf`` are the postings of one term after the other, as int32 bytes."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, made, size = _Hashes(), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[object, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, size
            held.sort(key=lambda x: (x[0] is None, 0 if x[0] is None else x[0]))
            n = np.array([len(t) for _, t in held], np.int64)
            term = np.concatenate([t for _, t in held])
            order = np.argsort(term, kind="stable")
            term, doc = term[order], np.repeat(np.arange(len(n)), n)[order]
            new_term = np.concatenate(([True], term[1:] != term[:-1])) if len(term) else np.empty(0, bool)
            first = np.flatnonzero(new_term | np.concatenate(([True], doc[1:] != doc[:-1]))) if len(term) else np.empty(0, np.int64)
            tf = np.diff(np.append(first, len(term)))
            heads = np.flatnonzero(new_term[first])
            list_of = lambda x, t: pa.array([x], pa.list_(t))
            row = [pa.array([part << 32 | made]), pa.array([[i for i, _ in held]], pa.list_(id_type)), list_of(n, pa.int64()), list_of(term[first][heads], pa.int64()), list_of(np.diff(np.append(heads, len(first))), pa.int64())]
            row += [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (doc[first], tf)]
            made, size = made + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays(row, ["segment", "doc_ids", "n", "terms", "df", "docs", "tf"])

        for b in batches:
            id_type = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append((i, known(t.as_py())))
                size += len(held[-1][1])
                if size >= segment or len(held) >= DOCS:
                    yield flush()
        if held:
            yield flush()

    schema = f"segment long, doc_ids array<{kind}>, n array<long>, terms array<long>, df array<long>, docs binary, tf binary"
    return scratch.save(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema), "index", rows=GROUP)


def query_terms(items: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(query, item_id, term, times): the distinct terms of every row of ``items``; ``query`` tells rows apart."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, made = _Hashes(), TaskContext.get().partitionId(), 0
        for b in batches:
            rows, at, found, times = [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                term, n = np.unique(known(t), return_counts=True)
                rows += [part << 32 | (made + k)] * len(term)
                at += [k] * len(term)
                found.append(term), times.append(n)
            made += len(b)
            empty = [np.empty(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), b.column(0).take(pa.array(at, pa.int64())), pa.array(np.concatenate(found + empty)), pa.array(np.concatenate(times + empty))], ["query", "item_id", "term", "times"])

    return items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).mapInArrow(run, f"query long, item_id {kind}, term long, times long")


def mine(sequences: DataFrame, scratch: Scratch, rounds: int = ROUNDS, name: str = "mined") -> tuple[DataFrame, DataFrame]:
    """sequences(query, pos, node) -> the sequences with shared neighbours joined to sets, and the sets (node, a, b, round)."""
    spark = sequences.sparkSession
    sets = spark.createDataFrame([], "node long, a long, b long, round int")
    along = W.partitionBy("query").orderBy("pos")
    for r in range(rounds):
        pairs = sequences.withColumn("next", F.lead("node").over(along))
        shared = pairs.where("next IS NOT NULL").groupBy("node", "next").count().where("count > 1")
        rank = F.when(F.col("count").isNotNull(), F.struct("count", F.xxhash64("node", "next").alias("h")))
        ranked = pairs.join(shared, ["node", "next"], "left").withColumn("rank", rank)
        better = lambda other: F.coalesce(F.col("rank") > other, F.lit(True))
        best = F.col("rank").isNotNull() & better(F.lag("rank").over(along)) & better(F.lead("rank").over(along))
        picked = scratch.save(ranked.select("query", "pos", "node", "next", best.alias("best")), f"{name}-picked{r}")
        made = picked.where("best").groupBy("node", "next").count().where("count > 1").select("node", "next", F.xxhash64(F.lit(r), "node", "next").alias("set"))
        made = scratch.save(made, f"{name}-sets{r}")
        if not made.limit(1).count():
            break
        joined = picked.join(made, ["node", "next"], "left").withColumn("set", F.when(F.col("best"), F.col("set")))
        joined = joined.withColumn("gone", F.lag("set").over(along).isNotNull()).where("NOT gone")
        sequences = scratch.save(joined.select("query", "pos", F.coalesce("set", "node").alias("node")), f"{name}-sequences{r}")
        sets = sets.unionByName(made.select(F.col("set").alias("node"), F.col("node").alias("a"), F.col("next").alias("b"), F.lit(r).alias("round")))
    return sequences, sets


class Graph(NamedTuple):
    """What is sent to the segments: leaves' terms, weights and places; sets as pairs of places, small ones first; queries as lists of places."""

    terms: np.ndarray
    leaf_term: list[int]
    leaf_weight: list[int]
    sets: list[tuple[int, int]]
    queries: list[tuple[int, list[int]]]


def graph(sequences: DataFrame, leaves: DataFrame, sets: DataFrame) -> Graph:
    """leaves(node, term, weight). A block's worth of terms passes through the driver."""
    first = leaves.collect()
    place = {r["node"]: k for k, r in enumerate(first)}
    terms = np.unique(np.array([r["term"] for r in first], np.int64))
    pairs = []
    for r in sorted(sets.collect(), key=lambda r: (r["round"], r["node"])):
        place[r["node"]] = len(place)
        pairs.append((place[r["a"]], place[r["b"]]))
    queries: dict[int, list[int]] = {}
    for r in sequences.collect():
        queries.setdefault(r["query"], []).append(place[r["node"]])
    return Graph(terms, np.searchsorted(terms, [r["term"] for r in first]).tolist(), [r["weight"] for r in first], pairs, sorted(queries.items()))


def _evaluate(g: Graph, terms: np.ndarray, df: np.ndarray, docs: np.ndarray, tf: np.ndarray, m: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(query, first document, score of each document from there on) of a segment's slices, in order, for queries with a match. A node's accumulator is made once a slice."""
    ends, at = np.cumsum(df), np.searchsorted(terms, g.terms)
    at[at == len(terms)] = 0
    have = (terms[at] == g.terms) if len(terms) else np.zeros(len(g.terms), bool)
    base: list[tuple[np.ndarray, np.ndarray] | None] = []
    for k, there in zip(at.tolist(), have.tolist(), strict=True):
        if there:
            x = slice(ends[k] - df[k], ends[k])
            d, n = docs[x], tf[x].astype(np.int64)
            base.append((d, 1_000_000_000 * n // (1000 * n + SATURATION * m[d])))
        else:
            base.append(None)
    width = max(LEAST, ACCUMULATORS // (8 * max(1, len(g.sets))))
    if width >= len(m):
        yield from ((query, 0, score) for query, score in _slice(g, base, len(m)))
        return
    for first in range(0, len(m), width):
        part: list[tuple[np.ndarray, np.ndarray] | None] = []
        for x in base:
            a, b = np.searchsorted(x[0], (first, first + width)) if x else (0, 0)
            part.append((x[0][a:b] - first, x[1][a:b]) if a < b else None)
        yield from ((query, first, score) for query, score in _slice(g, part, min(width, len(m) - first)))


def _slice(g: Graph, base: list[tuple[np.ndarray, np.ndarray] | None], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, score of each of ``size`` documents), from each term's documents and parts of scores."""
    leaves = len(g.leaf_term)
    made: list[np.ndarray | None] = [None] * len(g.sets)

    def add(node: int, to: np.ndarray) -> bool:
        if node >= leaves:
            if (x := made[node - leaves]) is None:
                return False
            to += x
            return True
        if (x := base[g.leaf_term[node]]) is None:
            return False
        to[x[0]] += g.leaf_weight[node] * x[1]
        return True

    spare = np.zeros(size, np.int64)
    for k, (a, b) in enumerate(g.sets):
        if add(a, spare) | add(b, spare):
            made[k], spare = spare, np.zeros(size, np.int64)
    for query, nodes in g.queries:
        some = False
        for node in nodes:
            some |= add(node, spare)
        if some:
            yield query, spare
            spare = np.zeros(size, np.int64)


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """(query, item_id, rank, doc_id, score): the ``top`` documents of every row of ``items``."""
    scratch = Scratch(docs.sparkSession, "search")
    index = build_index(docs, scratch, text=text, doc_id=doc_id, segment=segment)
    return rank(index, query_terms(items, item_id=item_id, text=item_text), scratch, top=top, block=block)


def rank(index: DataFrame, queries: DataFrame, scratch: Scratch, *, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The ``top`` documents of an index for queries(query, item_id, term, times); see ``search``."""
    queries = scratch.save(queries, "queries")
    over = lambda e: F.expr(f"aggregate(n, cast(0 AS bigint), (a, x) -> a + {e})")
    n_docs, n_terms = index.agg(F.sum(over("if(x > 0, 1, 0)")), F.sum(over("x"))).first()  # two numbers
    n_docs, n_terms = n_docs or 0, n_terms or 1
    held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    df = held.join(queries.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    used = scratch.save(queries.join(df, "term").select("query", "term", "times", "df", (weight * F.col("times")).alias("weight"), F.xxhash64("term", "times").alias("node")), "used")
    blocks = max(1, -(-used.count() // block))
    order = F.row_number().over(W.partitionBy("query").orderBy(F.desc("df"), "node"))
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    found = None
    for k in range(blocks):
        mine_of = used.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k)
        sequences, sets = mine(mine_of.select("query", order.alias("pos"), "node"), scratch, name=f"mined{k}")
        sent = index.sparkSession.sparkContext.broadcast(graph(sequences, mine_of.select("node", "term", "weight").distinct(), sets))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            least: dict[int, list[int]] = {}
            for b in batches:
                for r in range(len(b)):
                    row = b.slice(r, 1)
                    ids, n, terms, df = (row.column(c).flatten() for c in ("doc_ids", "n", "terms", "df"))
                    n, terms, df = (x.to_numpy(zero_copy_only=False) for x in (n, terms, df))
                    docs, tf = (np.frombuffer(row.column(c)[0].as_py(), "<i4") for c in ("docs", "tf"))
                    m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * n * n_docs // n_terms
                    query, at, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                    for q, first, score in _evaluate(sent.value, terms, df, docs, tf, m):
                        best = least.setdefault(q, [0])  # the best scores so far, of which the last is to be met
                        hit = np.flatnonzero(score >= (1 if len(best) < top else max(1, best[-1])))
                        hit = hit[np.argsort(-score[hit], kind="stable")[:top]]
                        if len(hit):
                            query.append(np.full(len(hit), q)), at.append(hit + first), scores.append(score[hit])
                            least[q] = sorted([*(x for x in best if x), *score[hit].tolist()], reverse=True)[:top]
                    at = np.concatenate(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), ids.take(pa.array(at)), pa.array(np.concatenate(scores))], ["query", "doc_id", "score"])

        part = index.select("doc_ids", "n", "terms", "df", "docs", "tf").mapInArrow(run, f"query long, doc_id {kind}, score long")
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", place).where(F.col("rank") <= top)
    return queries.select("query", "item_id").distinct().join(best, "query").select("query", "item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, {split} AS w FROM documents),
    s AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
    q AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS q, item_id, {split} AS w FROM benchmark)) GROUP BY ALL),
    p AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
    f AS (SELECT t, CAST(floor(1000 * ln((2.0 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY t, n),
    c AS (SELECT p.k, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + {SATURATION} * (100 - {LENGTH_PERCENT} + (CAST({LENGTH_PERCENT} * len(w) AS BIGINT) * n) // l))) AS c FROM p JOIN d USING (k) JOIN f USING (t), s),
    r AS (SELECT q, item_id, k, doc_id, CAST(sum(times * c) AS BIGINT) AS score FROM q JOIN c USING (t) GROUP BY ALL),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM r WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {TOP}"""
