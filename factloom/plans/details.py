"""Queries on the smaller operators: gates on requests, lookups, contracts, item choices, refinements, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import expr
from factloom.operators import aggregate, assemble, evaluate, ranked, reconcile, refgraph, resolve, rules, scoring, validate
from factloom.plans.common import Registry
from factloom.storage import table

R = Registry()


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


@R.add("SELECT p_partkey, CASE WHEN p_name LIKE '%1%' THEN 'repeatable' WHEN p_size = 1 THEN 'unique' WHEN p_size <= 20 THEN 'finite' WHEN p_size % 3 = 0 THEN 'unique' ELSE 'unknown' END AS class, CASE WHEN p_name LIKE '%1%' THEN NULL WHEN p_size <= 20 THEN p_size WHEN p_size % 3 = 0 THEN 1 END AS cap FROM part")
def acquisition_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_name").contains("1"), "unlimited").when(F.col("p_size") <= 20, F.concat("p_size", F.lit("x box"))).otherwise("?")
    a = expr.acquisition(text, F.when(F.col("p_size") % 3 == 0, 3).otherwise(1))
    return p.select("p_partkey", a["class"].alias("class"), a["cap"].alias("cap"))


@R.add("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', ''), '/+$', '') AS page, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM pages")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = expr.canonical_url("url")
    return table(spark, sf_dir, "pages").select("page_id", u["page"].alias("page"), u["fragment"].alias("fragment"))


@R.add("SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'high' WHEN p_size >= 20 THEN 'medium' ELSE 'low' END AS fit, CASE WHEN p_size % 4 = 0 THEN 'high' WHEN p_size % 4 <= 2 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN length(p_name) > 8 THEN rtrim(substr(p_name, 1, 7)) || '…' ELSE p_name END AS short FROM part")
def labels_and_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", expr.fit_label(F.when(F.col("p_size") >= 40, 500).when(F.col("p_size") >= 20, 250).otherwise(1)).alias("fit"), expr.confidence_label(F.col("p_size") % 4).alias("confidence"), expr.cut("p_name", 8).alias("short"))


@R.add("SELECT o_orderkey, array_to_string(list_slice(l, 1, 3), ',') AS items, CAST(greatest(0, len(l) - 3) AS INTEGER) AS omitted FROM (SELECT o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS l FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def limited_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    parts = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("l"))
    x = expr.limit_items("l", 3)
    return parts.select("o_orderkey", F.concat_ws(",", x["items"].cast("array<string>")).alias("items"), x["omitted"].alias("omitted"))


@R.add("SELECT s_suppkey FROM supplier WHERE lower(trim(s_name)) NOT IN (SELECT lower(trim(s_name)) FROM supplier WHERE s_suppkey % 9 = 0)")
def drop_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return validate.drop_placeholders(s, s.where("s_suppkey % 9 = 0").select(F.upper("s_name").alias("s_name")), "s_name").select("s_suppkey")


@R.add("SELECT p_partkey AS item_id, p_brand AS trait FROM part WHERE p_size % 2 = 0")
def requirement_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("personality_req"), F.when(F.col("p_size") % 2 == 1, "VC").alias("category"))
    return validate.requirement_edges(p)


@R.add("SELECT o_orderkey AS fact_id, c_custkey % 3 AS request_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus != 'F' AND (o_orderpriority != '1-URGENT' OR c_mktsegment = 'BUILDING') AND (o_orderkey % 4 != 0 OR c_nationkey % 2 = 0)")
def available_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _t(spark, sf_dir, "orders", "customer")
    facts = o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") == "F", "not_equipable").otherwise("active_equipable").alias("slot_eligibility"), (F.col("o_orderpriority") == "1-URGENT").alias("gated"), F.when(F.col("o_orderkey") % 4 == 0, "Big Sword").alias("requires_equipment"), F.lit(None).cast("string").alias("requires_manifest"))
    req = c.select((F.col("c_custkey") % 3).alias("request_id"), F.col("c_custkey").alias("owner"), (F.col("c_mktsegment") == "BUILDING").alias("awakened"), F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("requires_big_sword"))).otherwise(F.array().cast(expr.STRINGS)).alias("dependencies"))
    return validate.available_facts(facts, req, c.select(F.col("c_custkey").alias("owner"))).select("fact_id", "request_id")


@R.add("""SELECT 'total' AS error, CAST(count(*) AS VARCHAR) AS detail FROM supplier HAVING count(*) != 7 UNION ALL SELECT 'unknown_stratum', CAST(k AS VARCHAR) FROM (SELECT s_suppkey % 3 AS k FROM supplier GROUP BY 1) WHERE k = 2
  UNION ALL SELECT 'stratum_size', CAST(k AS VARCHAR) FROM (SELECT s_suppkey % 3 AS k, count(*) AS n FROM supplier GROUP BY 1) WHERE k != 2 AND n != 5 UNION ALL SELECT 'digest', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 10 = 0""")
def manifest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).cast("string").alias("cohort"), F.when(F.col("s_suppkey") % 10 == 0, "bad").otherwise(F.sha2("s_name", 256)).alias("sha256"))
    return validate.manifest_errors(s, 7, {"0": 5, "1": 5})


@R.add("SELECT c_custkey AS request_id, 'blank_target' AS code FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'empty_roster' FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'negative_points' FROM customer WHERE c_acctbal < 0")
def request_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    req = table(spark, sf_dir, "customer").select(k.alias("request_id"), F.when(k % 5 == 0, " ").otherwise("b").alias("boss_id"), F.when(k % 7 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("x"))).alias("roster"), F.col("c_acctbal").alias("points"))
    return validate.validate_requests(req)[1]


@R.add("SELECT r_regionkey AS request_id, l_orderkey * 100 + l_linenumber AS fact_id, l_suppkey AS owner FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey")
def roster_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, li = _t(spark, sf_dir, "nation", "supplier", "lineitem")
    req = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("request_id")).agg(F.collect_list("s_suppkey").alias("roster"))
    facts = li.select(F.col("l_suppkey").alias("owner"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("fact_id"))
    return resolve.facts_for(req, facts).select("request_id", "fact_id", "owner")


@R.add("SELECT s_suppkey AS owner, coalesce(t, '') AS traits FROM supplier LEFT JOIN (SELECT l_suppkey, string_agg(DISTINCT l_returnflag || CAST(l_quantity AS INTEGER), ',' ORDER BY l_returnflag || CAST(l_quantity AS INTEGER)) AS t FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey")
def owner_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, li = _t(spark, sf_dir, "supplier", "lineitem")
    edges = li.select(F.col("l_suppkey").alias("owner"), F.concat("l_returnflag", F.col("l_quantity").cast("int")).alias("trait"))
    return resolve.with_traits(s.select(F.col("s_suppkey").alias("owner")), edges).select("owner", F.concat_ws(",", "traits").alias("traits"))


@R.add("SELECT doc_id AS fact_id, doc_id AS unit_id, 'exact_text' AS how FROM documents WHERE doc_id % 3 != 0 AND doc_id % 5 = 0 UNION ALL SELECT doc_id, doc_id, 'sole_candidate' FROM documents WHERE doc_id % 3 != 0 AND doc_id % 5 != 0")
def bound_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    facts = d.select(F.col("doc_id").alias("fact_id"), F.col("lang").alias("kind"), F.concat(F.lit("t"), "doc_id").alias("title"), F.col("text"))
    units = d.where("doc_id % 3 != 0").select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("kind"), F.concat(F.lit("t"), "doc_id").alias("title"), F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise("edited").alias("text"))
    return resolve.bind_units(units, facts)[0]


@R.add("SELECT l_orderkey AS slot, p.p_partkey AS fact, CASE WHEN p.p_partkey % 2 = 0 THEN 'available' ELSE 'unavailable' END AS status FROM lineitem JOIN part p ON l_partkey = p.p_partkey")
def slot_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = _t(spark, sf_dir, "lineitem", "part")
    even = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("fact"), F.array("p_name").alias("effects"))
    twice = p.where("p_partkey % 4 = 1").select(F.col("p_partkey").alias("fact"), F.array("p_name").alias("effects"))
    slots = li.select(F.col("l_orderkey").alias("slot"), F.col("l_partkey").alias("fact"))
    return resolve.selected_evidence(slots, even.unionByName(twice).unionByName(twice)).drop("effects")


@R.add("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'unknown' WHEN page_id % 4 = 1 THEN 'failed' ELSE 'passed' END AS status FROM pages")
def fixture_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("capture"), F.sha2("url", 256).alias("slice"))
    fixture = p.where("page_id % 4 != 0").withColumn("slice", F.when(F.col("page_id") % 4 == 1, "x").otherwise(F.col("slice")))
    return resolve.compare_fixture(p, fixture, "page_id", ["capture", "slice"]).select("page_id", "status")


@R.add("SELECT o_custkey AS request_id, 'u' || o_orderkey % 3 AS url, min(CASE WHEN o_orderstatus = 'O' THEN 'a' ELSE 'b' END) AS label FROM orders GROUP BY 1, 2")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request_id"), F.concat(F.lit("u"), F.col("o_orderkey") % 3).alias("url"), "o_orderstatus")
    blank = o.limit(0).select("request_id", F.lit(" ").alias("url"), F.lit("z").alias("label"))
    return resolve.collect_citations(blank, o.where("o_orderstatus = 'O'").withColumn("label", F.lit("a")), o.where("o_orderstatus != 'O'").withColumn("label", F.lit("b")))


@R.add("SELECT s_suppkey AS owner FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ON l_orderkey = o_orderkey WHERE r <= 2)")
def referenced_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, s = _t(spark, sf_dir, "orders", "lineitem", "supplier")
    c = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("candidate_id"), F.col("o_totalprice").alias("score")).agg(F.collect_set("l_suppkey").alias("owner_ids"), F.collect_set("l_partkey").alias("fact_ids"))
    return resolve.project_referenced(c, s.select(F.col("s_suppkey").alias("owner")), s.select(F.col("s_suppkey").alias("fact_id")), 2)[0]


@R.add("SELECT l_orderkey AS id, l_partkey IS NOT NULL AND p_partkey IS NOT NULL AS known, p_name AS label FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = _t(spark, sf_dir, "lineitem", "part")
    ids = li.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("o"))
    out = resolve.resolve_display(ids, p.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")))
    return out.select(F.col("o").alias("id"), "known", "label")


@R.add("SELECT * FROM (SELECT coalesce(m.metric, c.metric) AS metric, m.value, c.unit, CASE WHEN m.metric IS NULL THEN 'no_value' WHEN c.metric IS NULL THEN 'no_contract' ELSE 'ok' END AS contract_state FROM (SELECT event_type AS metric, count(*) AS value FROM events GROUP BY 1) m FULL JOIN (VALUES ('click', 'n'), ('purchase', 'n'), ('refund', 'n')) AS c(metric, unit) ON m.metric = c.metric)")
def metric_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))
    return aggregate.with_contract(m, spark.createDataFrame([("click", "n"), ("purchase", "n"), ("refund", "n")], "metric string, unit string"))


@R.add("""SELECT 'orders:rows' AS "check", count(*) AS n FROM orders UNION ALL SELECT 'orders:missing_id', count(CASE WHEN o_orderkey IS NULL THEN 1 END) FROM orders UNION ALL SELECT 'orders:stale_version', count(CASE WHEN o_orderkey % 50 = 0 THEN 1 END) FROM orders
  UNION ALL SELECT 'customer_orders:without_children', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def graph_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _t(spark, sf_dir, "orders", "customer")
    o = o.withColumn("schema_version", F.when(F.col("o_orderkey") % 50 == 0, "1").otherwise("3"))
    return aggregate.graph_readiness({"orders": (o, "o_orderkey", 3)}, {"customer_orders": (c, "c_custkey", o, "o_custkey")})


@R.add("SELECT count(DISTINCT c_custkey) AS requested, count(o) AS found, count(CASE WHEN o THEN 1 END) AS complete, count(DISTINCT c_custkey) = count(o) AND count(DISTINCT c_custkey) = count(CASE WHEN o THEN 1 END) AS ready FROM customer LEFT JOIN (SELECT o_custkey, count(*) >= 8 AS o FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def receipt_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _t(spark, sf_dir, "orders", "customer")
    r = o.groupBy(F.col("o_custkey").alias("owner")).agg(F.when(F.count("*") >= 8, "complete").otherwise("failed").alias("overall"))
    return aggregate.receipt_readiness(r, c.select(F.col("c_custkey").alias("owner")))


@R.add("SELECT o_custkey, max(o_totalprice) AS priority, arg_max(o_orderkey, o_totalprice) AS o_orderkey, bool_or(o_orderstatus = 'F') AS any_f FROM orders GROUP BY 1")
def folded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("priority"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("any_f"))
    return aggregate.fold_corpus(o, "o_custkey", "priority", ["any_f"])


@R.add("""WITH c AS (SELECT conv_id, bool_or(role = 'system') AS sys, max(turn) AS t FROM conversations GROUP BY 1) SELECT conv_id AS run_id, concat_ws(',', CASE WHEN t % 2 = 1 THEN 'analyzer_refinement_failure' END, CASE WHEN t = 2 THEN 'backend_failure' END, CASE WHEN t % 2 = 1 THEN 'local_validation_failure' END, CASE WHEN sys THEN 'provider_transport_failure' END) AS categories, t != 2 AND NOT sys AS ready_for_review FROM c""")
def run_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    runs = c.groupBy(F.col("conv_id").alias("run_id")).agg(F.max("turn").alias("t")).select("run_id", F.when(F.col("t") == 2, "backend_failure").alias("failure_type"), F.lit(0).alias("structure_errors"), (F.col("t") % 2).alias("validation_errors"), F.lit(False).alias("budget_warning"), F.lit(None).cast("boolean").alias("degraded"))
    calls = c.select(F.col("conv_id").alias("run_id"), F.lit("other").alias("provider"), F.when(F.col("role") == "system", "provider.timeout").otherwise("x").alias("error_code"), F.lit(False).alias("fallback"))
    return aggregate.classify_runs(runs, calls).select("run_id", F.concat_ws(",", "categories").alias("categories"), "ready_for_review")


@R.add("""WITH m AS (SELECT * FROM (VALUES ('en', 5), ('fr', 1), ('xx', 3)) AS t(suite, expected)), g AS (SELECT lang AS suite, count(*) AS observed, count(CASE WHEN quality = 1 THEN 1 END) AS passed FROM documents JOIN labels USING (doc_id) GROUP BY 1)
  SELECT suite, CAST(expected AS INTEGER) AS expected, coalesce(observed, 0) AS observed, coalesce(passed, 0) AS passed, coalesce(observed, 0) = expected AND coalesce(passed, 0) = expected AS ready FROM m LEFT JOIN g USING (suite)""")
def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = _t(spark, sf_dir, "documents", "labels")
    cases = d.join(lab, "doc_id").select(F.col("lang").alias("suite"), F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("passed"))
    return aggregate.suite_summary(cases, {"en": 5, "fr": 1, "xx": 3}).drop("failed_ids")


@R.add("SELECT archetype, CAST(required AS INTEGER) AS required, coalesce(n, 0) AS n, greatest(0, required - coalesce(n, 0)) AS missing FROM (VALUES ('STANDARD', 3), ('BRASS', 10000000), ('none', 2)) AS m(archetype, required) LEFT JOIN (SELECT a AS archetype, count(*) AS n FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_type, ' '))) AS a FROM part) GROUP BY 1) USING (archetype)")
def stratum_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("witness_id"), F.split("p_type", " ").alias("archetypes"))
    return aggregate.stratum_coverage(w, {"STANDARD": 3, "BRASS": 10_000_000, "none": 2})


@R.add("""WITH c AS (SELECT p_brand AS owner, p_type AS slot, p_partkey AS i, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, CAST(p_partkey AS VARCHAR)) AS r FROM part)
  SELECT owner, slot, CAST(i AS VARCHAR) AS item_id, CAST(r AS INTEGER) AS rank, CASE WHEN r = 1 THEN 'choice' ELSE 'alternative' END AS kind FROM c WHERE r <= 4 UNION ALL SELECT DISTINCT owner, slot, 'generic:' || slot, 99, 'generic' FROM c""")
def item_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.item_choices(_compatible(spark, sf_dir), 3)


def _compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.col("p_type").alias("slot"), F.col("p_partkey").cast("string").alias("item_id"), F.col("p_size").alias("score"))


@R.add("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END DESC, p_size DESC, p_partkey) AS rank FROM part WHERE p_size > 3) SELECT p_brand AS owner, p_partkey AS fact_id, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 6""")
def skill_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.col("p_partkey").alias("fact_id"), F.col("p_size").alias("score"), (F.col("p_size") > 3).alias("legal"))
    return ranked.skill_options(p, p.where("fact_id % 10 = 0")).select("owner", "fact_id", "rank")


@R.add("""WITH r AS (SELECT n_regionkey AS request_id, n_name AS name, n_nationkey AS position, 0 AS o FROM nation UNION ALL SELECT r_regionkey, x, p, 1 FROM region, (VALUES ('france', 1), ('ATLANTIS', 2)) AS a(x, p)),
  f AS (SELECT request_id, lower(name) AS k, arg_min(name, o * 1000 + position) AS name, min(o * 1000 + position) AS pos FROM r GROUP BY 1, 2) SELECT request_id, name, CAST(row_number() OVER (PARTITION BY request_id ORDER BY pos, name) AS INTEGER) AS position FROM f""")
def augmented_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("request_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"))
    return ranked.augment(n, spark.createDataFrame([("france", 1), ("ATLANTIS", 2)], "name string, position int"))


@R.add("SELECT doc_id AS fact_id, 'override' AS rule_id, 'reviewed_clean' AS value FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id % 4 = 0")
def proposal_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = _t(spark, sf_dir, "documents", "labels")
    o = lab.where("quality = 1 AND toxic = 0 AND doc_id % 4 = 0").select(F.col("doc_id").alias("fact_id"), F.lit("override").alias("rule_id"), F.lit("capability").alias("kind"), F.lit("reviewed_clean").alias("value"), F.lit("none").alias("direction"), F.lit("text").alias("target"))
    return rules.propose_overrides(d.select(F.col("doc_id").alias("fact_id"), F.col("lang").alias("record_type"), "text"), o).select(F.col("fact_id").cast("long").alias("fact_id"), "rule_id", "value")


@R.add("SELECT 'p' || o_orderkey AS proposal_id, o_orderpriority AS rule_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'split' ELSE 'drift' END AS reason FROM orders WHERE o_orderkey % 4 = 0 OR o_orderpriority = '5-LOW'")
def migration_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), "o_orderkey").alias("proposal_id"), F.col("o_orderpriority").alias("rule_id"), F.col("o_orderstatus").alias("semantics"), "o_orderkey")
    d = p.withColumn("semantics", F.when(F.col("o_orderkey") % 4 == 0, "old").otherwise(F.col("semantics")))
    return rules.migration_set(d, p, spark.createDataFrame([("5-LOW", "6")], "rule_id string, new_rule_id string"))


@R.add("SELECT page_id, 'not_captured' AS error FROM pages WHERE page_id % 6 = 0 UNION ALL SELECT page_id, 'digest' FROM pages WHERE page_id % 6 = 1 UNION ALL SELECT page_id, 'duplicate' FROM pages WHERE page_id % 6 = 2 UNION ALL SELECT page_id, 'not_listed' FROM pages WHERE page_id % 6 = 3")
def capture_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))
    got = p.where("page_id % 6 != 0").select("page_id", F.when(F.col("page_id") % 6 == 1, "x").otherwise(F.col("sha256")).alias("capture_sha256"))
    return reconcile.capture_errors(p.where("page_id % 6 != 3"), got.unionByName(got.where("page_id % 6 = 2")))


@R.add("SELECT s_suppkey, 'row' AS field FROM supplier WHERE s_suppkey % 8 = 0 UNION ALL SELECT s_suppkey, 's_name' FROM supplier WHERE s_suppkey % 8 = 1")
def corpus_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    a = s.where("s_suppkey % 8 != 0").withColumn("s_name", F.when(F.col("s_suppkey") % 8 == 1, "x").otherwise(F.col("s_name")))
    return reconcile.corpus_errors(s, a, ["s_name", "s_nationkey"], "s_suppkey")


@R.add("SELECT page_id AS target_id, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 5 = 1 THEN 'stale_version' WHEN page_id % 5 = 2 THEN 'failed' ELSE 'url_changed' END AS reason FROM pages WHERE page_id % 5 != 4")
def stale_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    p = table(spark, sf_dir, "pages")
    t = p.select(F.col("page_id").alias("target_id"), "url", F.when(k == 2, "failed").otherwise("parsed").alias("state"))
    a = p.where("page_id % 5 != 0").select(F.col("page_id").alias("target_id"), F.when(k == 3, "http://old").otherwise(F.col("url")).alias("url"), F.when(k == 1, "1").otherwise("2").alias("schema_version"))
    return reconcile.select_stale(t, a, "2").select("target_id", "reason")


@R.add("SELECT s_suppkey AS sidekick, p AS placement, CASE p WHEN 'main' THEN coalesce(a, '') ELSE coalesce(b, '') END AS fact_ids FROM supplier, (VALUES ('main'), ('sub')) AS t(p), LATERAL (SELECT string_agg(DISTINCT f, ',' ORDER BY f) AS a, string_agg(DISTINCT CASE WHEN k THEN f END, ',' ORDER BY CASE WHEN k THEN f END) AS b FROM (SELECT CAST(l_partkey AS VARCHAR) AS f, l_returnflag = 'A' AS k FROM lineitem WHERE l_suppkey = s_suppkey))")
def sidekick_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, li = _t(spark, sf_dir, "supplier", "lineitem")
    facts = li.select(F.col("l_suppkey").alias("sidekick"), F.col("l_partkey").cast("string").alias("fact_id"), F.when(F.col("l_returnflag") == "A", "aura").otherwise("charge").alias("kind"))
    return scoring.sidekick_entities(s.select(F.col("s_suppkey").alias("sidekick")), facts).withColumn("fact_ids", F.concat_ws(",", "fact_ids"))


@R.add("SELECT n_nationkey AS boss_id, concat_ws(',', CASE WHEN n_nationkey % 2 = 0 THEN 'barrier_pierce' END, CASE WHEN n_nationkey % 3 = 0 THEN 'recover_mp' END, CASE WHEN n_nationkey < 10 THEN 'shield' END) AS counters FROM nation")
def required_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    none = F.array().cast(expr.STRINGS)
    n = table(spark, sf_dir, "nation")
    targets = n.select(k.alias("boss_id"), F.when(k % 2 == 0, F.array(F.lit("barrier"))).otherwise(none).alias("mechanic_tags"), F.when(k % 3 == 0, F.array(F.lit("recover_mp"), F.lit("dance"))).otherwise(none).alias("needs"))
    refs = n.where("n_nationkey < 10").select(k.alias("boss_id"), F.array(F.lit("shield")).alias("applies_to"))
    return scoring.required_counters(targets, refs, {"barrier": "barrier_pierce"}, scoring.ROLE_CAPABILITIES["boss_counter"]).withColumn("counters", F.concat_ws(",", "counters"))


@R.add("""WITH c AS (SELECT p_brand AS owner, p_type AS slot, CAST(p_partkey AS VARCHAR) AS i, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, CAST(p_partkey AS VARCHAR)) AS r FROM part), k AS (SELECT DISTINCT owner, slot FROM c),
  f AS (SELECT k.owner, k.slot, coalesce(i, 'generic:' || k.slot) AS item FROM k LEFT JOIN c ON k.owner = c.owner AND k.slot = c.slot AND r <= CASE WHEN k.slot LIKE 'PROMO%' THEN 2 WHEN k.slot LIKE 'STANDARD%' THEN 1 ELSE 0 END)
  SELECT owner, string_agg(item, ',' ORDER BY slot, item) AS items, count(CASE WHEN item LIKE 'generic:%' THEN 1 END) AS n_assumed FROM f GROUP BY 1""")
def build_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _compatible(spark, sf_dir)
    slots = {r["slot"]: 2 if r["slot"].startswith("PROMO") else 1 for r in c.select("slot").distinct().collect() if r["slot"].startswith(("PROMO", "STANDARD"))}  # part types, a fixed handful
    b = assemble.build_packages(ranked.item_choices(c, 3), slots)
    return b.select("owner", F.concat_ws(",", F.transform("items", lambda x: x["item_id"])).alias("items"), F.size("assumptions").cast("long").alias("n_assumed"))


@R.add("SELECT a.s_nationkey AS request_id, a.s_suppkey AS candidate_id, b.s_suppkey AS old FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey != b.s_suppkey")
def allowed_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    cand = s.select(F.col("s_nationkey").alias("request_id"), F.col("s_suppkey").alias("candidate_id"), F.array("s_suppkey").alias("members"))
    out = assemble.allowed_swaps(cand, s.select(F.col("s_nationkey").alias("request_id"), F.col("s_suppkey").alias("owner")))
    return out.select("request_id", "candidate_id", F.col("owner").alias("old"))


@R.add("SELECT o_orderkey AS candidate_id, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS accepted FROM orders")
def accepted_refinements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(k.alias("candidate_id"), F.col("o_totalprice").alias("score"), F.lit(1).alias("n_missing"))
    r = c.where("candidate_id % 2 = 0").select("candidate_id", F.when(F.col("candidate_id") % 3 == 0, F.col("score") + 1).otherwise(F.col("score") - 1).alias("score"), "n_missing", F.array().cast(expr.STRINGS).alias("members"))
    return assemble.accept_refinements(c, r).select("candidate_id", "accepted")


@R.add("SELECT doc_id, CASE a WHEN 0 THEN 'weak' WHEN 1 THEN 'moderate' ELSE 'strong' END AS offense, CASE WHEN contains(lower(text), 'license') THEN 'moderate' ELSE 'weak' END AS defense FROM (SELECT *, CAST(contains(lower(text), 'idiot') AS INTEGER) + CAST(contains(lower(text), 'moron') AS INTEGER) + CAST(contains(lower(text), 'scum') AS INTEGER) AS a FROM documents)")
def fit_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.fit_rubric(table(spark, sf_dir, "documents"), {"offense": ("idiot", "moron", "scum"), "defense": ("license",)}, "doc_id")


@R.add("SELECT n_nationkey AS boss_id, 'weak' AS field, n_nationkey % 3 != 0 AS ok FROM nation UNION ALL SELECT n_nationkey, 'resist', true FROM nation")
def affinity_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    names = lambda *x: F.array(*map(F.lit, x))
    stored = n.select(F.col("n_nationkey").alias("boss_id"), names("fire", "water").alias("weak"), names("wind").alias("resist"))
    said = n.select(F.col("n_nationkey").alias("boss_id"), F.when(F.col("n_nationkey") % 3 == 0, names("fire")).otherwise(names("Water", "fire", "fire")).alias("weak"), names(" WIND").alias("resist"))
    return assemble.affinity_fidelity(said, stored, fields=["weak", "resist"])


@R.add("""WITH s AS (SELECT l_orderkey AS o, l_linenumber AS p, l_returnflag AS f FROM lineitem) SELECT DISTINCT o AS lineup_id, 'harmful:inflict_pain' AS warning FROM s WHERE f = 'R' UNION ALL SELECT o, 'alternative_zones' FROM s WHERE f = 'A' GROUP BY 1 HAVING count(DISTINCT p) > 1 UNION ALL SELECT o, 'idle_reserve' FROM s GROUP BY 1 HAVING max(p) < 4""")
def lineup_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = F.when(F.col("l_returnflag") == "R", "inflict_pain").when(F.col("l_returnflag") == "A", "deploy_zone").otherwise("guard")
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lineup_id"), F.lit(1).alias("boss_id"), F.col("l_linenumber").alias("pos"), cap.alias("capability"))
    return assemble.warnings(s, spark.createDataFrame([(1, "inflict_pain")], "boss_id int, capability string"))


@R.add("SELECT l_orderkey AS lineup_id, count(*) AS facts, count(CASE WHEN l_quantity > 10 AND l_quantity <= 45 THEN 1 END) AS evidenced, CASE WHEN max(l_quantity) > 45 THEN NULL ELSE min(l_quantity) > 10 END AS complete FROM lineitem GROUP BY 1")
def evidence_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return assemble.evidence_diagnostics(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lineup_id"), F.col("l_partkey").alias("fact_id"), F.when(q <= 45, F.when(q > 10, 1).otherwise(0)).alias("n_evidence")))


@R.add("WITH w AS (SELECT lang AS cohort, CASE WHEN n_chars > 1000 THEN 'passed' ELSE 'failed' END AS a, CASE WHEN doc_id % 2 = 0 THEN 'passed' END AS b FROM documents) SELECT cohort, 'length' AS dimension, a AS status, count(*) AS n FROM w GROUP BY 1, 3 UNION ALL SELECT cohort, 'parity', coalesce(b, 'unknown'), count(*) FROM w GROUP BY 1, 3")
def dimension_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.col("lang").alias("cohort"), F.when(F.col("n_chars") > 1000, "passed").otherwise("failed").alias("length"), F.when(F.col("doc_id") % 2 == 0, "passed").alias("parity"))
    return evaluate.dimension_status(w, ["length", "parity"])


@R.add("SELECT o_orderkey AS occ_id, coalesce(d, '') AS dependencies, d IS NULL AS gap FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def attached_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    rel = li.select(F.col("l_partkey").alias("rel_id"), F.col("l_orderkey").alias("owner_occ"), F.col("l_returnflag").alias("value"))
    rows, _ = evaluate.attach_relationships(o.select(F.col("o_orderkey").alias("occ_id")), rel)
    return rows.withColumn("dependencies", F.concat_ws(",", "dependencies"))


@R.add("SELECT role AS variant, CAST(sum(length(text)) AS BIGINT) AS tokens, CASE WHEN sum(length(text)) <= 50000 THEN 'within' ELSE 'above' END AS status FROM conversations GROUP BY 1")
def budget_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.budget_check(table(spark, sf_dir, "conversations").select(F.col("role").alias("variant"), F.length("text").alias("prompt_tokens")), 50_000)


@R.add("SELECT doc_id AS unit_id, CASE WHEN regexp_matches(lower(text), '(?:^|[^a-z])(?:idiot|moron)(?:[^a-z]|$)') THEN 'combat' WHEN regexp_matches(lower(text), '(?:^|[^a-z])(?:license|licensed)(?:[^a-z]|$)') THEN 'excluded' ELSE 'unresolved' END AS class FROM documents")
def destination_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), "text")
    return refgraph.classify_destination(d, ["idiot", "moron"], ["license", "licensed"])


@R.add("SELECT item_id AS anchor_id, CAST(2 AS INTEGER) AS tok_start, CAST(3 AS INTEGER) AS tok_end, sha256(w[2] || chr(31) || w[3]) AS tokens_sha256 FROM (SELECT item_id, regexp_extract_all(text, '[^ ]+') AS w FROM benchmark) WHERE len(w) >= 3")
def source_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    w = b.select(F.col("item_id").alias("unit_id"), F.regexp_extract_all("text", F.lit("[^ ]+"), 0).alias("w")).where("size(w) >= 3")
    t = w.select("unit_id", F.lit(1).alias("block_ord"), F.posexplode("w").alias("p", "text")).select("unit_id", "block_ord", (F.col("p") + 1).alias("tok_ord"), "text")
    at = F.length(F.col("w")[0]) + 1
    r = w.select(F.col("unit_id").alias("anchor_id"), "unit_id", F.lit(1).alias("block_ord"), at.alias("from"), (at + F.length(F.col("w")[1]) + 2).alias("to"))
    return refgraph.anchors(t, r).select("anchor_id", "tok_start", "tok_end", "tokens_sha256")


@R.add("SELECT doc_id AS occurrence, CASE WHEN doc_id % 4 = 0 THEN 'unresolved' WHEN doc_id % 4 = 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM documents")
def variant_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("k"))
    refs = d.select(F.col("doc_id").alias("occurrence"), F.lit("o").alias("owner"), F.concat(F.lit("Form "), "doc_id").alias("label"))
    one = d.where("k != 0").select(F.concat(F.lit("u"), "doc_id").alias("unit_id"), F.lit("o").alias("owner"), F.concat(F.lit("form "), "doc_id").alias("title"))
    two = d.where("k = 1").select(F.concat(F.lit("v"), "doc_id").alias("unit_id"), F.lit("o").alias("owner"), F.concat(F.lit("FORM "), "doc_id", F.lit(", Alt")).alias("title"))
    return refgraph.variant_links(refs, one.unionByName(two)).select("occurrence", "status")
