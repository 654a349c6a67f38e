"""What keeps work in proportion to the input: no shuffle of pairs, short lists that are broadcast."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.operators import assemble, dealt, evaluate, ranked, refgraph, resolve, scoring
from factloom.plans import evidence, registry
from factloom.storage import listed


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_compatible_pairs_are_not_shuffled(spark):
    owners = spark.createDataFrame([(1, "bow", ["a", "b", "a"]), (1, "axe", ["a"]), (2, "axe", [])], "owner int, weapon string, traits array<string>")
    items = spark.createDataFrame([(1, "a", None, None), (1, "b", None, None), (2, None, "axe", None), (3, None, None, ["bow", "bow"]), (4, None, None, None), (4, None, None, [])], "item_id int, trait string, weapon_req string, weapon_group array<string>")
    got = resolve.compatible_items(owners, items)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 4)]
    assert not plan(got).startswith("Aggregate")


def test_request_pairs_are_not_shuffled(spark):
    requests = spark.createDataFrame([(1, "bow"), (1, "axe"), (2, "axe"), (2, "axe"), (3, None)], "request_id int, weapon string")
    items = spark.createDataFrame([(1, "weapon", "bow"), (1, "weapon", "axe"), (1, "armor", None), (2, "weapon", "axe"), (3, "armor", "bow"), (3, "armor", None), (4, "other", "axe")], "item_id int, slot string, weapon string")
    got = resolve.items_for(requests, items)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 3)]
    assert not plan(got).startswith("Aggregate")


def test_rows_of_one_trait_are_dealt_to_parts(spark):
    owners = spark.range(20).select(F.col("id").alias("owner"), F.lit("t").alias("trait"))
    items = spark.range(200).select(F.col("id").alias("item_id"), F.lit("t").alias("trait"), F.lit(True).alias("shareable"))
    got = resolve.shared_path(owners, owners, items)
    assert got.count() == got.distinct().count() == 4000
    assert "_part" in plan(got)  # how many tasks make them is left to Spark, which puts as few rows as these into one


def test_rows_of_one_pool_are_dealt_to_parts(spark):
    pool = spark.range(100).select(F.lit(1).alias("request_id"), F.col("id").alias("owner"))
    got = assemble.allowed_swaps(pool.select("request_id", F.col("owner").alias("candidate_id"), F.array("owner").alias("members")), pool)
    assert got.count() == got.distinct().count() == 9900
    assert "_part" in plan(got)  # how many tasks make them is left to Spark, which puts as few rows as these into one


def test_traits_of_owners_come_from_distinct_brands(spark):
    assert "Aggregate [p_size" in plan(evidence.R.queries["legality_context"](spark, "/root/testdata/sf0.001"))


def test_references_of_a_class_are_cut_before_they_meet_requests(spark):
    requests = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, ["b"], [])], "request_id int, tags array<string>, types array<string>")
    refs = spark.range(50).select("id", F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("tags"), F.when(F.col("id") == 7, "x").alias("mechanic_type"))
    refs = refs.unionByName(spark.createDataFrame([(3, ["a"], None)], "id long, tags array<string>, mechanic_type string"))
    got = ranked.topk_references(requests, refs, 3)
    assert sorted(map(tuple, got.select("request_id", "rank", "id", "hits").collect())) == [(1, 1, 0, 2), (1, 2, 2, 2), (1, 3, 3, 2), (2, 1, 0, 1), (2, 2, 1, 1), (2, 3, 2, 1)]
    assert "WindowGroupLimit [c" in plan(got)


def test_short_lists_have_a_known_size(spark):
    for df in (scoring.role_map(spark), scoring.profile_table(spark), listed(spark, [("a", 1)], "label string, n int")):
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 100_000


def test_labels_are_not_shuffled_to_their_few_keys(spark):
    got = evidence.R.queries["labeled_fields"](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_cohort_errors_come_from_one_grouping(spark):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "witness_id string")
    exp = spark.createDataFrame([("a", 1, 2), ("b", 2, 2), ("b", None, 3), ("d", 1, 2), (None, 1, 2)], "witness_id string, start int, end int")
    got = evaluate.cohort_errors(rows("a", "a", "e", None), exp, rows("a", "b", "c", None))
    want = [("anchor_incomplete", "b"), ("exp_foreign", "d"), ("exp_foreign", None), ("exp_missing", "c"), ("exp_missing", None), ("pred_foreign", "e"), ("pred_foreign", None), ("pred_missing", "b"), ("pred_missing", "c"), ("pred_missing", None)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert "Join" not in plan(got) and plan(got).count("Aggregate") == 1


def test_anchors_meet_tokens_only(spark):
    tokens = spark.createDataFrame([("u", 1, i, w) for i, w in enumerate(["one", "two", "three"], 1)], "unit_id string, block_ord int, tok_ord int, text string")
    ranges = spark.createDataFrame([("x", "u", 1, 4, 9, "k"), ("y", "u", 1, 90, 99, "k"), ("z", "u", None, None, None, "k"), ("v", "w", 1, 0, 3, "k")], "anchor_id string, unit_id string, block_ord int, `from` int, `to` int, more string")
    stored = refgraph.anchors(tokens, ranges)
    assert sorted(map(tuple, stored.select("anchor_id", "more", "tok_start", "tok_end").collect())) == [("v", "k", None, None), ("x", "k", 2, 3), ("y", "k", None, None), ("z", "k", None, None)]
    got = refgraph.validate_anchors(stored, tokens.withColumn("text", F.replace("text", F.lit("two"), F.lit("2wo"))))
    assert sorted(map(tuple, got.collect())) == [("v", True), ("x", False), ("y", True), ("z", True)]
    assert plan(got).count("Join") == 2  # with the tokens, once when stored and once when checked


def test_quotes_are_looked_for_directly_in_small_units(spark):
    blocks = spark.createDataFrame([("u", 1, "😀😀 aaa bb"), ("u", 2, "Cc aa bb dd"), ("v", 1, "aa"), ("v", 2, None)], "unit_id string, block_ord int, text string")
    quotes = spark.createDataFrame([(1, "u", "AAA"), (2, "u", "aa"), (3, "u", "c AA  b"), (4, "v", "aa"), (5, "u", "none of it"), (6, "w", "aa"), (7, "u", "aa bb dd"), (8, "v", " ")], "anchor_id int, unit_id string, quote string")
    want = [(1, 1, 3, 6, 1), (2, None, None, None, 3), (3, 2, 1, 7, 1), (4, 1, 0, 2, 1), (5, None, None, None, 0), (6, None, None, None, 0), (7, 2, 3, 11, 1)]
    for direct in (0, 12, 1000):  # by the index; one unit so, the other directly; all directly
        assert sorted(map(tuple, refgraph.quote_ranges(blocks, quotes, direct).collect())) == want
    assert plan(refgraph.quote_ranges(blocks, quotes)).count("Join") == 2  # units that are larger, and the blocks


def test_roles_of_unique_facts_need_no_grouping(spark):
    r = random.Random(3)
    caps = ["shield", "heal_hp", "recover_mp", "hold_ground", "direct_damage", "unknown", None]
    rows = [(r.randrange(3), r.randrange(4), i, [r.choice(caps) for _ in range(r.randrange(5))] if i else None, r.choice(["weak", "neutral", "resisted", None])) for i in range(60)]
    facts = spark.createDataFrame(rows, "request_id int, owner int, fact_id int, capabilities array<string>, matchup string")
    counters = spark.createDataFrame([(1, "shield"), (1, "recover_mp"), (1, "shield"), (2, None)], "request_id int, capability string")
    for c in (counters, None):
        one, many = (scoring.fact_roles(facts, scoring.role_map(spark), c, unique=u) for u in (True, False))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert "fact_id" not in "".join(x for x in plan(one).splitlines() if "Aggregate [" in x)


def test_members_meet_one_row_an_owner(spark):
    r = random.Random(4)
    roles = [f"r{i:02d}" for i in range(64)] + ["primary_damage", "reserve_utility", *assemble.SURVIVAL]
    scores = [(1, o, x, r.randrange(-1, 4)) for o in range(6) for x in r.sample(roles, r.randrange(40, 60))]
    teams = [(1, i, [r.randrange(8) for _ in range(r.randrange(8))]) for i in range(20)]
    of = lambda o: {x: s for _, p, x, s in scores if p == o and s > 0}
    want = []
    for _, i, m in teams:
        front = set(m[:4])
        add = lambda ms, names: float(sum(s for o in ms for x, s in of(o).items() if x in names))
        overlap = sum(max(0, sum(x in of(o) for o in front) - 2) for x in roles)
        want.append((i, sorted({x for o in m for x in of(o)}), add(m, ["primary_damage"]), add(m[:4], assemble.SURVIVAL), add(m[4:], ["reserve_utility", "mp_sustain"]), float(sum(max(0, len(of(o)) - 1) for o in front)), float(overlap)))
    lu, s = spark.createDataFrame(teams, "request_id int, lineup_id int, members array<int>"), spark.createDataFrame(scores, "request_id int, owner int, role string, score int")
    got = assemble.score_lineups(lu, s, assemble.coverage_gaps(lu, s, spark.createDataFrame([(1, ["r01"])], "request_id int, roles array<string>")))
    cols = ["lineup_id", "covered", *(f"c_{c}" for c in ("boss_matchup", "sustain_mitigation", "reserve_utility", "synergy", "role_overlap"))]
    assert sorted(map(tuple, got.select(*cols).collect())) == want
    assert "collect_" not in plan(got)


def test_pairs_are_made_by_many_tasks(spark):
    left = spark.range(300).select(F.col("id").alias("a"), F.lit("k").alias("kind"))
    got = dealt.pairs(left, left.withColumnRenamed("a", "b"), "a", "b", lambda x, y: x.join(y, "kind"))
    assert got.count() == got.distinct().count() == 90_000
    assert got.select(F.spark_partition_id()).distinct().count() > 4  # not the one that Spark would join so few rows in


@pytest.mark.parametrize("states", [(1, 8, 64), (1, 2), (1,)])
def test_lineups_are_searched_by_use_only_where_least_vectors_end(spark, monkeypatch, states):
    r, caps = random.Random(7), {"a": 1, "b": 2, "c": 1, "d": 1, "none": 0, "free": None}
    kinds = {k: [sorted(r.choices([*caps, "unknown"], weights=[6, 3, 6, 6, 1, 2, 1], k=r.randrange(1, 4))) for _ in range(r.randrange(1, 5))] for k in range(12)}
    members = [(k, o if o < 4 else None, r.randrange(12)) for k in range(80) for o in range(r.randrange(1, 6))]
    want = {}
    for k in range(80):
        own = sorted(((o, kinds[kind]) for i, o, kind in members if i == k), key=lambda x: (len(x[1]), x[0] is None, x[0] or 0))
        fits = lambda v: all(sum(items.count(c) for items in v) <= n for c, n in caps.items() if n is not None)
        vectors = (v for v in itertools.product(*(range(len(x)) for _, x in own)) if fits([x[i] for (_, x), i in zip(own, v)]))
        want[k] = next(([(None if o is None else str(o), i) for (o, _), i in zip(own, v)] for v in vectors), None)
    assert None in want.values() and sum(v is not None for v in want.values()) > 10
    m = spark.createDataFrame(members, "lineup_id int, owner int, kind int")
    o = spark.createDataFrame([(k, i, items) for k, options in kinds.items() for i, items in enumerate(options)], "kind int, option int, item_ids array<string>")
    limits = listed(spark, list(caps.items()), "item_id string, limit int")
    asked, by_use = [], assemble._by_use
    monkeypatch.setattr(assemble, "_by_use", lambda *a: asked.append(a) or by_use(*a))
    monkeypatch.setattr(assemble, "STATES", states)
    plain = m.join(o, "kind").select("lineup_id", "owner", "option", "item_ids")
    for got in (assemble.allocate(o, limits, None, members=m), assemble.allocate(plain, limits, 5)):
        got = got.collect()
        assert {x["lineup_id"]: x["options"] and [tuple(y) for y in x["options"]] for x in got} == want and len(got) == 80 and not any(x["exhausted"] for x in got)
    assert len(asked) == (0 if len(states) == 3 else 2)


@pytest.mark.parametrize("states", [(1, 8, 64), (1,)])
def test_allocation_of_odd_lines_equals_sql(spark, tmp_path, monkeypatch, states):
    monkeypatch.setattr(assemble, "STATES", states)
    r = random.Random(3)
    lines = [(k, r.choice([None, 1, 2, 3, 4, 5, 6, 7]), r.randrange(-9, 30)) for k in range(40) for _ in range(r.randrange(1, 14))] + [(99, i, 4) for i in range(4)] + [(None, 1, 4), (None, 2, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    cols = ["lineup_id", "options", "exhausted"]
    want = c.sql(registry.oracle_sql()["allocate_items"]).select(*cols).fetchall()
    got = list(map(tuple, registry.queries()["allocate_items"](spark, str(tmp_path)).select(*cols).collect()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(x[1] is None and x[0] is not None for x in want)


def test_shared_path_is_made_by_many_tasks(spark):
    owners = spark.range(300).select(F.col("id").alias("owner"))
    edges = owners.select("owner", F.concat(F.lit("n"), F.col("owner") % 3).alias("trait"))
    items = spark.range(400).select(F.col("id").alias("item_id"), F.concat(F.lit("n"), F.col("id") % 4).alias("trait"), (F.col("id") % 2 == 0).alias("shareable"))
    made = resolve.shared_path(owners, edges, items).withColumn("task", F.spark_partition_id()).collect()
    assert len(made) == 2 * 100 * 100 and {r["trait"] for r in made} == {"n0", "n2"}
    assert len({(r["owner"], r["item"]) for r in made}) == len(made) and len({r["task"] for r in made}) > 8
