"""Ranked search against a plain score of every document for every query."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from factloom.llm import ranked_search as rs

SCHEMA = "doc_id long, text string, query string, term string, n string, segment string, score string, rank string"


def texts():
    r = random.Random(3)
    usual, rare = ["the", "And", "of", "in", "to"], [f"w{k}" for k in range(60)]
    made = lambda n: " ".join(r.choice(usual) if r.random() < 0.5 else r.choice(rare) for _ in range(n))
    rows = [(k, made(r.randrange(1, 60))) for k in range(150)]
    rows += [(200 + k, "the same words of w1 w2") for k in range(30)]  # more ties than places
    rows += [(300, None), (301, ""), (302, "-- !! \n"), (303, "ünï Cödé 漢字 w3"), (303, "ünï Cödé 漢字 w3"), (None, "the w4"), (None, None), (304, "the " * 5000), (305, "A1b2 x_y")]
    queries = [(k, made(r.randrange(1, 25))) for k in range(25)]
    queries += [(30, "the of in to and"), (31, "the the w1 w1 w1"), (31, "w5 the"), (32, None), (33, ""), (34, "unknownterm"), (None, "the w4 w4"), (35, "漢字 ÜNÏ x y"), (36, "the same words of w1 w2")]
    return rows, queries


def plain(docs, queries, top=rs.TOP):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    held = [(i, Counter(split(t))) for i, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, t in queries:
        scored = []
        for i, c in held:
            m = 75 + (25 * c.total() * n_docs) // n_all
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, n in Counter(split(t)).items() if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return out


def frames(spark):
    docs, queries = texts()
    wide = lambda rows: spark.createDataFrame([(*r, *"qtnssr") for r in rows], SCHEMA)
    return wide(docs), wide(queries).withColumnRenamed("doc_id", "item_id")


@pytest.mark.parametrize("segment,block,partitions", [(rs.SEGMENT, rs.BLOCK, 3), (40, 60, 5)])
def test_equals_plain_scores(spark, segment, block, partitions):
    docs, queries = frames(spark)
    got = rs.search(docs.repartition(partitions), queries, segment=segment, block=block).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(*texts()), key=repr)


@pytest.mark.parametrize("top", [1, 2])
def test_few_places(spark, top):
    docs, queries = frames(spark)
    got = rs.search(docs, queries, top=top, segment=100).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(*texts(), top=top), key=repr)


def test_shared_terms_become_sets(spark):
    """Sets are used by two queries or more, a query's nodes spell exactly its terms, and the graph has fewer additions."""
    _, queries = frames(spark)
    scratch = rs.Scratch(spark, "t")
    q = scratch.save(rs.query_terms(queries), "q")
    df = q.groupBy("term").agg(F.countDistinct("query").alias("df"))
    order = F.row_number().over(rs.W.partitionBy("query").orderBy(F.desc("df"), "term"))
    start = q.join(df, "term").select("query", order.alias("pos"), F.xxhash64("term", "times").alias("node"))
    sequences, sets = rs.mine(start, scratch)
    parts = {r.node: (r.a, r.b) for r in sets.collect()}
    spell = lambda n: spell(parts[n][0]) + spell(parts[n][1]) if n in parts else [n]
    inside = lambda n: {n}.union(*map(inside, parts.get(n, ())))
    want, got, uses = {}, {}, Counter()
    for r in start.collect():
        want.setdefault(r["query"], []).append(r["node"])
    for r in sequences.collect():
        got.setdefault(r["query"], []).extend(spell(r["node"]))
        uses.update(inside(r["node"]))
    assert parts and {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(uses[n] >= 2 for n in parts)
    assert sequences.count() + 2 * len(parts) < start.count()


def test_one_index_serves_any_queries(spark):
    docs, queries = frames(spark)
    scratch = rs.Scratch(spark, "t")
    index = rs.build_index(docs, scratch, segment=200)
    rows, asked = texts()
    for part in (asked[:10], asked[10:]):
        ids = queries.where(F.col("item_id").isin([i for i, _ in part])) if None not in [i for i, _ in part] else queries.where(~F.coalesce(F.col("item_id").isin([i for i, _ in asked[:10]]), F.lit(False)))
        got = rs.rank(index, rs.query_terms(ids), rs.Scratch(spark, "t")).select("item_id", "rank", "doc_id", "score").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(plain(rows, part), key=repr)


def test_empty_tables(spark):
    docs, queries = frames(spark)
    assert rs.search(docs.limit(0), queries).count() == 0
    assert rs.search(docs, queries.limit(0)).count() == 0


def test_readers_hold_few_segments_at_a_time(spark):
    docs, _ = frames(spark)
    scratch = rs.Scratch(spark, "t")
    assert rs.build_index(docs.coalesce(1), scratch, segment=40).count() > 20
    held = [f.row_group(k).num_rows for p in Path(scratch.root.removeprefix("file:")).glob("index/*.parquet") for f in [pq.ParquetFile(p).metadata] for k in range(f.num_row_groups)]
    assert sum(held) > 20 and max(held) <= rs.GROUP


@pytest.mark.parametrize("least", [1, 7, 64])
def test_slices_of_a_segment_add_up(monkeypatch, least):
    rng = np.random.default_rng(5)
    terms, n = np.arange(0, 60, 2), 50
    held = [np.sort(rng.choice(n, rng.integers(1, 12), replace=False)).astype("<i4") for _ in terms]
    df, docs = np.array([len(h) for h in held]), np.concatenate(held)
    tf, m = rng.integers(1, 9, len(docs)).astype("<i4"), rng.integers(75, 150, n)
    asked = np.arange(0, 40)  # every other one is in no document
    g = rs.Graph(asked, list(range(40)), rng.integers(1, 99, 40).tolist(), [(0, 2), (1, 3), (40, 4)], [(7, [42, 6]), (8, [41]), (9, [40, 10, 12])])
    whole = {q: s for q, _, s in rs._evaluate(g, terms, df, docs, tf, m)}
    monkeypatch.setattr(rs, "ACCUMULATORS", 1)
    monkeypatch.setattr(rs, "LEAST", least)
    sliced = {q: np.zeros(n, np.int64) for q in whole}
    for q, first, s in rs._evaluate(g, terms, df, docs, tf, m):
        assert len(s) <= max(least, 1) and first % least == 0
        sliced[q][first : first + len(s)] = s
    assert set(whole) == {7, 9} and all(np.array_equal(whole[q], sliced[q]) for q in whole)
