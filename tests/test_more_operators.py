"""Operators without a query of their own, on hand-made rows."""

from pyspark.sql import functions as F

from factloom.functions import expr
from factloom.operators import aggregate, assemble, evaluate, resolve, rules
from factloom.sources import pages, tables


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def test_labeled_fields_take_the_first_value(spark):
    s = spark.createDataFrame([("s", 1, "HP:", ""), ("s", 2, "hp", "10"), ("s", 3, "HP", "20"), ("s", 4, "other", "x")], "section_id string, ord int, label string, value string")
    assert rows(pages.labeled_fields(s, spark.createDataFrame([("HP", "hp")], "label string, field string"))) == [("s", "hp", "10")]


def test_affinity_observations_keep_unknown_from_empty(spark):
    t = spark.createDataFrame([("s", 0, "weak"), ("s", 1, "resist"), ("s", 2, "null")], "section_id string, idx int, status string")
    c = spark.createDataFrame([("s", 0, "Fire"), ("s", 0, "fire"), ("s", 1, "None")], "section_id string, idx int, value string")
    assert rows(pages.affinity_observations(t, c), "status", "values", "state") == [("null", [], "unknown"), ("resist", [], "confirmed_empty"), ("weak", ["fire"], "confirmed_values")]


def test_sidekick_rows_and_aura_fields(spark):
    b = spark.createDataFrame([("p", 1, "Aura: power"), ("p", 2, "Consumes 2 charge"), ("p", 3, "Auto skill"), ("p", 4, "?")], "page_id string, ord int, text string")
    assert rows(pages.sidekick_rows(b), "ord", "kind", "diagnostic") == [(1, "aura", None), (2, "charge", None), (3, "auto", None), (4, "unknown", "unclassified_block")]
    u = spark.createDataFrame([("u", 1, "When it rains"), ("u", 2, "power up"), ("v", 1, "power up")], "unit_id string, ord int, text string")
    assert rows(pages.aura_fields(u)) == [("u", "When it rains", "power up", "ok"), ("v", None, "power up", "no_condition")]


def test_skill_rows_mark_gated(spark):
    html = "<table><tr><th>Name</th></tr><tr><td>Slash</td></tr><tr><td>Stellar Slash</td></tr></table>"
    got = pages.skill_rows(spark.createDataFrame([("p", html)], "page_id string, html string"), {"active": [pages.Field("name", header="Name")]})
    assert rows(got, "name", "record_type", "gated") == [("Slash", "active", False), ("Stellar Slash", "active", True)]


def test_artifacts_reviews_and_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema_version":"2","x":1}\n{"schema_version":"1","x":2}\nbroken\n')
    assert sorted(r["accepted"] for r in tables.read_artifacts(spark, str(tmp_path / "a.json"), "schema_version string, x int", "2").collect()) == [False, False, True]
    (tmp_path / "c.json").write_text('[{"status":"ok","x":1},{"status":"no","x":2}]')
    assert rows(tables.read_curated(spark, str(tmp_path / "c.json"), "status string, x int", ["ok"])) == [("ok", 1)]
    (tmp_path / "r.csv").write_text("id,decision\np1, approve \np2,\n")
    review = tables.read_review_csv(spark, str(tmp_path / "r.csv"), ["id", "decision"])
    assert rows(review) == [("p1", "approve"), ("p2", None)]
    tables.write_report(review, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_normalized_reviews(spark):
    r = spark.createDataFrame([("p", " PCT ", "clear")], "id string, unit string, target string")
    a = spark.createDataFrame([("unit", "pct", "percent"), ("target", "foe", "enemy")], "column string, alias string, value string")
    assert rows(expr.normalize_review(r, a), "unit", "target") == [("percent", "__clear__")]


def test_exact_candidates_items_and_contexts(spark):
    f = spark.createDataFrame([(["a"], ["s"])], "member_ids array<string>, skill_ids array<string>")
    c = spark.createDataFrame([(["a"], ["s"], 1), (["a"], ["t"], 2)], "member_ids array<string>, skill_ids array<string>, candidate int")
    assert rows(resolve.exact_candidate(f, c), "candidate") == [(1,)]
    items = spark.createDataFrame([("w", "weapon", "bow"), ("x", "weapon", "axe"), ("a", "armor", None)], "item_id string, slot string, weapon string")
    assert rows(resolve.items_for(spark.createDataFrame([(1, "bow")], "request_id int, weapon string"), items)) == [(1, "a"), (1, "w")]
    lineups = spark.createDataFrame([(1, "o", "w")], "lineup_id int, owner string, item_id string")
    ctx = resolve.legality_context(lineups, spark.createDataFrame([("o", "bow")], "owner string, weapon string"), spark.createDataFrame([("o", "t")], "owner string, trait string"), spark.createDataFrame([("w", 2)], "item_id string, limit int"))
    assert rows(ctx, "weapon", "traits", "limit") == [("bow", ["t"], 2)]
    p = spark.createDataFrame([("s",)], "sidekick string")
    kids = spark.createDataFrame([("s", 1), ("s", 2)], "sidekick string, id int")
    got = resolve.with_children(p, {"skills": (kids, ["id"]), "auras": (kids, ["id"])}, "sidekick").first()
    assert len(got["skills"]) == len(got["auras"]) == 2


def test_source_coverage_and_frontier(spark):
    o = spark.createDataFrame([("a",), ("b",)], "owner string")
    u = spark.createDataFrame([("a", 1)], "owner string, unit_id int")
    f = spark.createDataFrame([("a", 1), ("a", 2)], "owner string, fact_id int")
    assert rows(aggregate.source_coverage(o, u, f, spark.createDataFrame([(1,)], "fact_id int"))) == [("a", 1, 2, 1, 1), ("b", 0, 0, 0, 0)]
    p = spark.createDataFrame([("o", "p1", 3), ("o", "p2", -1)], "owner string, package_id string, score int")
    best, reasons = assemble.package_frontier(p, {"positive": F.col("score") > 0})
    assert rows(best, "package_id") == [("p1",)] and rows(reasons) == [("positive", 1)]


def test_build_options_and_errors(spark):
    c = spark.createDataFrame([("o", "ring", x, i, "alternative", s) for i, (x, s) in enumerate([("a", 5), ("b", 3), ("c", 1)], 1)], "owner string, slot string, item_id string, rank int, kind string, score int")
    got = assemble.build_options(c, "ring", 2, n=2).orderBy("option").collect()
    assert [r["item_ids"] for r in got] == [["a", "b"], ["a", "c"], ["generic:ring"]]
    packages = spark.createDataFrame([("p", [("ring", "a"), ("ring", "b"), ("ring", "zz")])], "package_id string, items array<struct<slot:string,item_id:string>>")
    assert rows(assemble.package_errors(packages, spark.createDataFrame([("a", "ring"), ("b", "hat")], "item_id string, slot string"), {"ring": 2})) == [("p", "foreign_slot:b"), ("p", "too_many:ring"), ("p", "unknown_item:zz")]


def test_sidekick_pairs_have_different_bases(spark):
    e = spark.createDataFrame([(1, "x", "b1", "main", 5), (1, "y", "b1", "sub", 9), (1, "z", "b2", "sub", 1)], "request_id int, sidekick string, base string, placement string, score int")
    assert rows(assemble.sidekick_pairs(e), "main", "sub", "score") == [("x", "z", 6)]


def test_witnesses_gaps_and_cohorts(spark):
    w = spark.createDataFrame([("w1", "o", "t", "h"), ("w2", "o", "none", "h"), ("w3", "o", "t2", "old")], "witness_id string, owner string, title string, sha256 string")
    u = spark.createDataFrame([("u1", "o", "t", "h"), ("u2", "o", "t2", "new")], "unit_id string, owner string, title string, capture_sha256 string")
    t = spark.createDataFrame([("u1", 1, 1, "a", "x")], "unit_id string, block_ord int, tok_ord int, text string, href string")
    assert rows(evaluate.resolve_witnesses(w, u, t), "witness_id", "status") == [("w1", "resolved"), ("w2", "missing"), ("w3", "capture_changed")]
    p = spark.createDataFrame([(1, 1, "a", "o"), (2, 2, "a", None)], "pred_id int, ord int, anchor string, owner string")
    e = spark.createDataFrame([(1, 1, "a", "o"), (2, 2, "a", None)], "exp_id int, ord int, anchor string, owner string")
    assert rows(evaluate.match_gaps(p, e)) == [(1, 1)]
    c = spark.createDataFrame([("w1",), ("w2",)], "witness_id string")
    x = spark.createDataFrame([("w1", 5, 3), ("w9", 1, 2)], "witness_id string, start int, end int")
    assert rows(evaluate.cohort_errors(x, x, c)) == [("anchor_incomplete", "w1"), ("exp_foreign", "w9"), ("exp_missing", "w2"), ("pred_foreign", "w9"), ("pred_missing", "w2")]


def test_rule_table_and_drift(spark):
    t = spark.createDataFrame([("r", ["a"], "x", "cap"), ("r", ["a"], "x", "cap"), ("s", [], " ", "odd")], "rule_id string, record_types array<string>, pattern string, kind string")
    assert rows(rules.rule_table_errors(t, {"kind": ["cap"]})) == [("r", "duplicate_id"), ("s", "blank_pattern"), ("s", "kind_vocabulary"), ("s", "no_record_type")]
    m = spark.createDataFrame([("1", ["a"], [], "proven")], "fact_id string, capabilities array<string>, dependencies array<string>, state string")
    assert rows(rules.materialization_drift(m, m.withColumn("state", F.lit("candidate")))) == [("1", "changed")]
