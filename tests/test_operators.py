import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import aggregate, assemble, evaluate, ranked, reconcile, refgraph, resolve, rules, scoring, validate
from factloom.sources import pages


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def test_validate_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (-1, "")], "n int, t string")
    checks = {"positive": F.col("n") > 0, "text": F.col("t") != ""}
    ok, bad = validate.validate_rows(df, checks)
    assert rows(ok, "n") == [(1,)]
    assert rows(bad, "n", "reasons") == [(-1, ["positive", "text"]), (2, ["text"])]
    with pytest.raises(validate.RowsRejected):
        validate.validate_rows(df, checks, "strict")


def test_resolve_exact_tells_ambiguous_from_unresolved(spark):
    owners = spark.createDataFrame([("Mia", ["M"]), ("Max", ["M", "Maxi"])], "name string, aliases array<string>")
    names = spark.createDataFrame([("mia",), ("m",), ("zoe",)], "input string")
    assert rows(resolve.resolve_exact(names, owners), "input", "status") == [("m", "ambiguous"), ("mia", "resolved"), ("zoe", "unresolved")]


def test_bind_units_uses_a_unit_once(spark):
    units = spark.createDataFrame([("u1", "k", "t", "x"), ("u2", "k", "s", "y")], "unit_id string, kind string, title string, text string")
    facts = spark.createDataFrame([("f1", "k", "t", "x"), ("f2", "k", "s", "other"), ("f3", "k", "s", "y"), ("f4", "k", "none", "y")], "fact_id string, kind string, title string, text string")
    bound, bad = resolve.bind_units(units, facts)
    assert rows(bound) == [("f1", "u1", "exact_text"), ("f3", "u2", "exact_text")]
    assert rows(bad) == [("f2", "unit_used"), ("f4", "no_unit")]


FACTS = "fact_id string, record_type string, text string"
RULES = "rule_id string, record_types array<string>, pattern string, negatives array<string>, kind string, value string, direction string, target string, phase string"


def test_rules_positive_misleading_and_review(spark):
    facts = spark.createDataFrame([("1", "active", "deals fire damage"), ("2", "active", "takes fire damage"), ("3", "passive", "fire damage")], FACTS)
    rule = spark.createDataFrame([("r", ["active"], "fire damage", ["takes"], "capability", "direct_damage", "up", "enemy", "match")], RULES)
    p = rules.propose(facts, rule)
    assert rows(p, "fact_id", "matched") == [("1", "fire damage")]
    d = p.select("proposal_id", "record_type", "fact_id", "rule_id", "semantics", F.lit("approve").alias("decision"))
    assert rows(rules.materialize(p, d), "fact_id", "capabilities", "state") == [("1", ["direct_damage"], "proven")]
    drifted = d.withColumn("semantics", F.lit("other"))
    assert rows(rules.materialize(p, drifted), "capabilities", "state") == [([], "candidate")]
    cases = spark.createDataFrame([("r", "positive", "1", True, "direct_damage"), ("r", "misleading_negative", "2", False, None)], "rule_id string, case string, fact_id string, present boolean, value string").withColumns({"direction": F.lit(None).cast("string"), "target": F.lit(None).cast("string")})
    assert rows(rules.check_rule_cases(cases, p), "ok") == [(True,), (True,)]


def test_resource_operations(spark):
    b = spark.createDataFrame([("u", 1, "When hit: gain +2 Charge. Consumes 3 charge")], "unit_id string, block_ord int, text string")
    assert rows(rules.resource_operations(b), "operation", "amount") == [("consumption", 3), ("gain", 2)]


def test_upsert_is_idempotent_and_keeps_missing_columns(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, w int")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    once = reconcile.upsert(old, new, ["k"])
    assert rows(once) == [(1, "a", 5), (2, "B", 6), (3, "c", None)]
    assert rows(reconcile.upsert(once, new, ["k"])) == rows(once)


def test_managed_reconcile(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key int, name string")
    s = spark.createDataFrame([(2, "b", True), (3, "x", True), (4, "d", True), (5, "e", False), (6, "f", True)], "key int, name string, managed boolean")
    got = reconcile.managed_reconcile(e, s, spark.createDataFrame([(6,)], "key int"), True)
    assert rows(got, "key", "action") == [(1, "create"), (2, "keep"), (3, "conflict"), (4, "delete"), (5, "keep"), (6, "keep")]


def test_matchup_outcomes(spark):
    a = "array<string>"
    df = spark.createDataFrame(
        [("weak", ["fire"], ["slash"], ["fire"], [], [], []), ("resisted", ["water"], ["slash"], ["fire"], ["water"], [], []), ("blocked", ["wind"], ["slash"], ["fire"], [], ["wind"], []),
         ("neutral", ["earth"], ["slash"], ["fire"], [], [], []), ("unknown", ["fire"], ["slash"], ["unknown"], [], [], []), ("unknown", [], ["slash"], ["fire"], [], [], []),
         ("unknown", ["fire", "water"], ["slash"], ["fire"], [], [], []), ("unknown", ["fire"], ["slash"], ["fire"], ["slash"], [], [])],
        f"want string, e {a}, a {a}, weak {a}, resist {a}, nul {a}, absorb {a}",
    )
    got = df.select("want", scoring.matchup(*(F.col(c) for c in ("e", "a", "weak", "resist", "nul", "absorb"))).alias("got")).collect()
    assert [r["want"] for r in got] == [r["got"] for r in got]


def test_pareto_and_packages(spark):
    p = spark.createDataFrame([("r", "o", "balanced", ["a"], 5, 1), ("r", "o", "offensive", ["a"], 5, 1), ("r", "o", "sustain", ["b"], 4, 0), ("r", "o", "counter", ["c"], 3, 9)], "request_id string, owner string, profile string, family_ids array<string>, score int, m int")
    assert rows(scoring.pareto(p, ["score", "m"]), "profile", "rank") == [("balanced", 1), ("counter", 2)]


def test_allocate_takes_the_first_feasible_vector(spark):
    o = spark.createDataFrame([(1, "a", 1, ["x"]), (1, "a", 2, ["y"]), (1, "b", 1, ["x"]), (2, "a", 1, ["x"]), (2, "b", 1, ["x"])], "lineup_id int, owner string, option int, item_ids array<string>")
    got = assemble.allocate(o, spark.createDataFrame([("x", 1)], "item_id string, limit int"), 3)
    out = {r["lineup_id"]: r["options"] and {x["owner"]: x["option"] for x in r["options"]} for r in got.collect()}
    assert out == {1: {"b": 1, "a": 2}, 2: None}


def test_allocate_searches_on_where_vectors_were_cut(spark):
    rows_ = [(k, o, i, [item]) for k in range(3) for o, items in (("a", "xy"), ("b", "xy"), ("c", "xyz"[: 2 + k % 2])) for i, item in enumerate(items)]
    o = spark.createDataFrame(rows_, "lineup_id int, owner string, option int, item_ids array<string>")
    caps = spark.createDataFrame([(x, 1) for x in "xyz"], "item_id string, limit int")
    get = lambda **kw: {r["lineup_id"]: (r["options"] and [x["option"] for x in r["options"]], r["exhausted"]) for r in assemble.allocate(o, caps, 3, **kw).collect()}
    assert get(width=1) == get(width=64) == {0: (None, False), 1: ([0, 1, 2], False), 2: (None, False)}
    tight = spark.createDataFrame([(1, "a", 1, ["x"]), (1, "a", 2, ["y"]), (1, "b", 1, ["x"]), (1, "b", 2, ["x"])], "lineup_id int, owner string, option int, item_ids array<string>")
    assert [(r["options"], r["exhausted"]) for r in assemble.allocate(tight, caps, 2, width=1, search_on=False).collect()] == [(None, True)]
    assert [[x["option"] for x in r["options"]] for r in assemble.allocate(tight, caps, 2, width=1).collect()] == [[2, 1]]


def test_allocate_equals_brute_force(spark):
    r, rows_, want = random.Random(12), [], {}
    caps = {"a": 1, "b": 2, "c": 1, "d": 3, "free": None}
    for k in range(40):
        owners = {f"o{i}": [sorted(r.choices([*caps, "unknown"], k=r.randrange(0, 4))) for _ in range(r.randrange(1, 5))] for i in range(r.randrange(1, 6))}
        rows_ += [(k, o, i, items) for o, options in owners.items() for i, items in enumerate(options)]
        order = sorted(owners, key=lambda o: (len(owners[o]), o))
        fits = lambda v: all(sum(items.count(c) for items in v) <= n for c, n in caps.items() if n is not None)
        want[k] = next(([(o, i) for o, i in zip(order, vector)] for vector in itertools.product(*(range(len(owners[o])) for o in order)) if fits([owners[o][i] for o, i in zip(order, vector)])), None)
    o = spark.createDataFrame(rows_, "lineup_id int, owner string, option int, item_ids array<string>")
    got = assemble.allocate(o, spark.createDataFrame(list(caps.items()), "item_id string, limit int"), 5).collect()
    assert {r["lineup_id"]: r["options"] and [tuple(x) for x in r["options"]] for r in got} == want and not any(r["exhausted"] for r in got)
    assert None in want.values()


def test_rules_compiled_and_joined_agree(spark, monkeypatch):
    facts = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("a", "red fox"), ("a", "red dog"), ("b", "Red fox"), ("c", "fox"), ("a", None), (None, "red")])], "fact_id int, record_type string, text string")
    table = spark.createDataFrame([("r1", ["a", "b"], "(?i)red", ["dog"], "k", "v", "up", "t", "match"), ("r2", ["a"], "fox$", [], "k", "w", None, "t", "text"), ("r3", ["c", "a"], "o", ["cat", "red"], "k", "x", "up", "t", "match")], "rule_id string, record_types array<string>, pattern string, negatives array<string>, kind string, value string, direction string, target string, phase string")
    one = sorted(map(tuple, rules.propose(facts, table).collect()), key=repr)
    monkeypatch.setattr(rules, "COMPILED", 2)
    assert one == sorted(map(tuple, rules.propose(facts, table).collect()), key=repr) and len(one) == 4
    assert rules.propose(facts, table.limit(0)).count() == 0


def test_beam_has_distinct_members_and_is_deterministic(spark):
    c = spark.createDataFrame([(1, r, e, "p", s) for r in ("x", "y") for e, s in (("a", 3), ("b", 2), ("c", 2))], "request_id int, role string, entity_id string, package_id string, score int")
    get = lambda: assemble.beam(c, {"t": ("x", "y", "x")}, 4, 3).select("members", "score").collect()
    first = get()
    assert all(len(set(r["members"])) == 3 for r in first) and sorted(map(tuple, first)) == sorted(map(tuple, get()))


@pytest.mark.parametrize("n,m", [(1, 2), (2, 2), (3, 1), (2, 0)])
def test_matching_pairs_blocks(spark, n, m):
    p = spark.createDataFrame([(i, i, "k") for i in range(n)], "pred_id int, ord int, key string")
    e = spark.createDataFrame([(10 + i, i, "k") for i in range(m)], "exp_id int, ord int, key string")
    k = min(n, m)
    assert rows(evaluate.match_one_to_one(p, e, ["key"]), "pred_id", "exp_id") == [(i, 10 + k - 1 - i) for i in range(k)]


def test_precision_recall_conventions(spark):
    p = spark.createDataFrame([(1, "a")], "pred_id int, kind string")
    e = spark.createDataFrame([(1, "b")], "exp_id int, kind string")
    none = spark.createDataFrame([], "pred_id int, exp_id int")
    assert rows(evaluate.precision_recall(p, e, none), "kind", "precision", "recall") == [("a", 0.0, 0.0), ("b", 0.0, 0.0), (None, 0.0, 0.0)]


def test_bounded_refs_with_cycle_and_limits(spark):
    refs = spark.createDataFrame([("a", 1, "http://x/b"), ("b", 1, "http://x/a"), ("b", 2, "http://x/c"), ("c", 1, "http://x/d"), ("a", 2, "http://x/none")], "unit_id string, occurrence int, url string")
    units = spark.createDataFrame([(u, f"http://x/{u}") for u in "abcd"], "unit_id string, url string")
    classes = spark.createDataFrame([(u, "combat") for u in "abcd"], "unit_id string, class string")
    out = refgraph.resolve_bounded(spark.createDataFrame([("a",)], "root string"), refs, refgraph.destination_index(units), classes, max_depth=2)
    assert rows(out, "unit_id", "occurrence", "status") == [("a", 1, "resolved"), ("a", 2, "unresolved"), ("b", 1, "visited"), ("b", 2, "resolved"), ("c", 1, "depth_exhausted")]


def test_anchors_and_quotes(spark):
    t = spark.createDataFrame([("u", 1, i, w) for i, w in enumerate(["one", "two", "three"], 1)], "unit_id string, block_ord int, tok_ord int, text string")
    r = spark.createDataFrame([("x", "u", 1, 4, 9)], "anchor_id string, unit_id string, block_ord int, `from` int, `to` int")
    got = refgraph.anchors(t, r)
    assert rows(got, "tok_start", "tok_end") == [(2, 3)]
    assert rows(refgraph.validate_anchors(got, t)) == [("x", True)]
    q = refgraph.quote_ranges(spark.createDataFrame([("u", 1, "a b a")], "unit_id string, block_ord int, text string"), spark.createDataFrame([("p", "u", "b"), ("q", "u", "a")], "anchor_id string, unit_id string, quote string"))
    assert rows(q, "anchor_id", "from", "n") == [("p", 2, 1), ("q", None, 2)]


def test_extract_rows_by_attribute_header_and_position(spark):
    html = '<table><tr><th>Name</th><th>MP</th></tr><tr data-id="7"><td>Slash</td><td>1,200</td></tr><tr><td>Burn</td><td>many</td></tr></table>'
    df = spark.createDataFrame([("p", html)], "page_id string, html string")
    fields = [pages.Field("id", attr="data-id"), pages.Field("name", header="name"), pages.Field("mp", header="MP", type="int"), pages.Field("first", position=0)]
    assert rows(pages.extract_rows(df, fields), "id", "name", "mp", "first", "diagnostics") == [("7", "Slash", 1200, "Slash", []), (None, "Burn", None, "Burn", ["mp"])]


def test_sections_end_at_rank_or_anchor(spark):
    html = "<h1>T</h1><h2>A</h2><p>one</p><h3>sub</h3><p>two</p><h2>B</h2><p>three</p>"
    b = pages.page_blocks(spark.createDataFrame([("p", html), ("q", "<p>no</p>")], "page_id string, html string"))
    a = spark.createDataFrame([("p", "s", "a", "zzz"), ("q", "s", "a", "zzz"), ("p", "t", "b", "zzz")], "page_id string, section_id string, start string, end string")
    assert rows(pages.bounded_sections(b, a), "section_id", "text", "bounded") == [("s", "one", True), ("s", "sub", True), ("s", "two", True), ("t", "three", False)]


def test_ranked_picks_do_not_depend_on_partitions(spark):
    s = spark.createDataFrame([("q", "r", i, 5) for i in range(20)], "request_id string, role string, entity_id int, score int")
    covers = spark.createDataFrame([("q", 15)], "request_id string, entity_id int")
    a, b = (rows(ranked.role_pools(x, covers), "entity_id", "via") for x in (s, s.repartition(5)))
    assert a == b and (15, "counter") in a and len(a) == 9


def test_classify_runs(spark):
    runs = spark.createDataFrame([("a", "backend_failure", 0, 1, False, False), ("b", None, None, None, None, None)], "run_id string, failure_type string, structure_errors int, validation_errors int, budget_warning boolean, degraded boolean")
    calls = spark.createDataFrame([("b", "openrouter", "provider.timeout", False)], "run_id string, provider string, error_code string, fallback boolean")
    got = {r["run_id"]: r for r in aggregate.classify_runs(runs, calls).collect()}
    assert got["a"]["categories"] == ["analyzer_refinement_failure", "backend_failure", "local_validation_failure"]
    assert got["b"]["categories"] == ["openrouter_transport_failure"] and not got["b"]["ready_for_review"]
