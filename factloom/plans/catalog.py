"""Catalogue queries: identities, receipts, reconciliation, upserts, name resolution, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import expr
from factloom.operators import aggregate, ranked, reconcile, resolve, validate
from factloom.plans.common import Registry
from factloom.storage import table

R = Registry()


@R.add("SELECT p_partkey, 'part:' || substr(sha256(lower(trim(p_name)) || chr(31) || lower(trim(p_brand))), 1, 20) AS stable_id, regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g') AS family, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", expr.stable_id("part", "p_name", "p_brand").alias("stable_id"), expr.family_name("p_name").alias("family"), expr.slug("p_type").alias("slug"))


@R.add("""SELECT sha256(string_agg(s, ',' ORDER BY b)) AS sha, CAST(sum(n) AS BIGINT) AS n FROM (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS s, count(*) AS n
  FROM (SELECT sha256('{"acctbal":' || CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS VARCHAR) || ',"name":"' || s_name || '"}') AS h FROM supplier) GROUP BY 1)""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(expr.fingerprint(name=F.col("s_name"), acctbal=F.round(F.col("s_acctbal") * 100).cast("long")).alias("h"))
    return expr.corpus_fingerprint(s, "h")


_RULES_SQL = "concat_ws(',', CASE WHEN NOT o_totalprice >= 50000 THEN 'low_price' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'priority' END)"


@R.add(f"SELECT o_orderkey, {_RULES_SQL} AS reasons FROM orders WHERE {_RULES_SQL} != ''")
def validate_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"low_price": F.col("o_totalprice") >= 50000, "status": F.col("o_orderstatus").isin("O", "F"), "priority": ~F.col("o_orderpriority").startswith("5")}
    _, bad = validate.validate_rows(table(spark, sf_dir, "orders"), rules)
    return bad.select("o_orderkey", F.concat_ws(",", "reasons").alias("reasons"))


@R.add("""SELECT 'lineitem_rows' AS "check", count(*) AS observed, CAST(1000 AS BIGINT) AS expected, count(*) >= 1000 AS ok FROM lineitem
  UNION ALL SELECT 'orders_without_key', count_if(o_orderkey IS NULL), 0, count_if(o_orderkey IS NULL) = 0 FROM orders
  UNION ALL SELECT 'discount_out_of_range', count_if(l_discount < 0 OR l_discount > 1), 0, count_if(l_discount < 0 OR l_discount > 1) = 0 FROM lineitem
  UNION ALL SELECT 'repeated_order_keys', count(*), 0, count(*) = 0 FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)""")
def schema_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return validate.schema_assertions(
        {
            "lineitem_rows": (li, F.lit(True), ">=", 1000),
            "orders_without_key": (o, F.col("o_orderkey").isNull(), "=", 0),
            "discount_out_of_range": (li, (F.col("l_discount") < 0) | (F.col("l_discount") > 1), "=", 0),
            "repeated_order_keys": (validate.duplicate_keys(o, "o_orderkey"), F.lit(True), "=", 0),
        }
    )


@R.add("""SELECT kind, coalesce(n, 0) AS n, CAST(minimum AS BIGINT) AS minimum, coalesce(n, 0) >= minimum AS ok, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n < minimum THEN 'below_minimum' ELSE 'ok' END AS reason
  FROM (VALUES ('click', 1), ('purchase', 1000000), ('refund', 5)) AS m(kind, minimum) LEFT JOIN (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1) USING (kind)""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return validate.quality_gate(n, {"click": 1, "purchase": 1_000_000, "refund": 5})


@R.add("""WITH names AS (SELECT upper(n_name) AS input FROM nation UNION ALL SELECT 'nobody' UNION ALL SELECT DISTINCT 'group ' || n_regionkey FROM nation),
  al AS (SELECT n_name AS name, n_name AS a FROM nation UNION SELECT n_name, 'group ' || n_regionkey FROM nation),
  g AS (SELECT input, string_agg(DISTINCT name, ',' ORDER BY name) AS matches, count(DISTINCT name) AS n FROM names LEFT JOIN al ON lower(trim(input)) = lower(trim(a)) GROUP BY input)
  SELECT input, coalesce(matches, '') AS matches, CASE WHEN n = 0 THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM g""")
def resolve_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    group = F.concat(F.lit("group "), F.col("n_regionkey"))
    names = n.select(F.upper("n_name").alias("input")).unionByName(n.select(group.alias("input")).distinct()).unionByName(spark.range(1).select(F.lit("nobody").alias("input")))
    return resolve.resolve_exact(names, n.select(F.col("n_name").alias("name"), F.array(group).alias("aliases"))).select("input", F.concat_ws(",", "matches").alias("matches"), "status")


@R.add("""WITH i AS (SELECT DISTINCT lower(substr(p_name, 1, 6)) AS input FROM part UNION SELECT DISTINCT lower(p_brand) FROM part),
  c AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part),
  h AS (SELECT input, name, CASE WHEN trim(input) = lower(trim(name)) THEN 0 ELSE 2 END AS how FROM i JOIN c ON contains(lower(trim(name)), trim(input)) AND trim(input) != ''),
  r AS (SELECT input, name, row_number() OVER (PARTITION BY input ORDER BY how, length(name), name) AS k FROM h)
  SELECT i.input, r.name AS canonical FROM i LEFT JOIN r ON i.input = r.input AND k = 1""")
def resolve_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = p.select(F.lower(F.substring("p_name", 1, 6)).alias("input")).union(p.select(F.lower("p_brand")))
    owners = p.select(F.col("p_brand").alias("name")).union(p.select("p_type")).distinct().withColumn("aliases", F.array().cast(expr.STRINGS))
    return resolve.resolve_ranked(names, owners)


@R.add("""WITH n AS (SELECT DISTINCT unnest([regexp_extract(text, '^[^ ]+ [^ ]+'), regexp_extract(text, '[^ ]+ [^ ]+$'), CAST(item_id AS VARCHAR) || '% #']) AS name FROM benchmark),
  k AS (SELECT name, lower(name) AS needle FROM n WHERE name != '' UNION SELECT name, t FROM (SELECT name, unnest(string_split(lower(name), ' ')) AS t FROM n) WHERE length(t) >= 4),
  h AS (SELECT DISTINCT doc_id, name FROM documents JOIN k ON contains(lower(text), needle))
  SELECT doc_id AS text_id, name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS r FROM h) WHERE r = 1""")
def mention_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last two words of benchmark items as names."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    part = lambda p: F.regexp_extract("text", p, 0)
    names = b.select(F.explode(F.array(part("^[^ ]+ [^ ]+"), part("[^ ]+ [^ ]+$"), F.concat("item_id", F.lit("% #")))).alias("name"))
    return resolve.mentions(d.select(F.col("doc_id").alias("text_id"), "text"), names)


@R.add("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def richest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return ranked.top(li, ["l_orderkey", "l_partkey"], [F.desc("l_quantity"), F.desc("l_extendedprice"), "l_linenumber"]).select("l_orderkey", "l_partkey", "l_linenumber")


@R.add("SELECT owner, family_id, fact_id FROM (SELECT p_brand AS owner, p_type AS family_id, CAST(p_partkey AS VARCHAR) AS fact_id, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, length(p_name) DESC, CAST(p_partkey AS VARCHAR)) AS r FROM part) WHERE r = 1")
def best_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.col("p_type").alias("family_id"), F.col("p_partkey").cast("string").alias("fact_id"), F.col("p_size").alias("upgrade_rank"), F.length("p_name").alias("proven_count"))
    return ranked.best_per_family(f).select("owner", "family_id", "fact_id")


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    facts = o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("fact_id"), F.when(F.col("o_orderstatus") == "P", "passive").otherwise("active").alias("record_type"), F.when(F.col("o_totalprice") > 100000, "active_equipable").otherwise("not_equipable").alias("slot_eligibility"), F.col("o_orderpriority").alias("family_id"), (F.col("o_orderpriority") == "1-URGENT").alias("gated"))
    return aggregate.owner_receipts(facts, c.select(F.col("c_custkey").alias("owner"), (F.col("c_mktsegment") == "BUILDING").alias("awakened")))


_RECEIPT_SQL = """WITH f AS (SELECT o_custkey AS owner, count_if(o_orderstatus != 'P' AND o_totalprice > 100000) AS a, string_agg(DISTINCT CASE WHEN o_orderstatus != 'P' AND o_totalprice > 100000 THEN o_orderpriority END, ',' ORDER BY CASE WHEN o_orderstatus != 'P' AND o_totalprice > 100000 THEN o_orderpriority END) AS fam,
    count(DISTINCT CASE WHEN o_orderstatus != 'P' AND o_totalprice > 100000 THEN o_orderpriority END) AS nf, count_if(o_orderstatus = 'P') AS p, bool_or(o_orderpriority = '1-URGENT') AS g FROM orders GROUP BY 1)
  SELECT c_custkey AS owner, coalesce(a, 0) AS active_count, CAST(coalesce(nf, 0) AS INTEGER) AS family_count, coalesce(fam, '') AS families, coalesce(p, 0) AS passive_count, CASE WHEN coalesce(nf, 0) >= 3 THEN 'complete' ELSE 'failed' END AS active_state,
    CASE WHEN coalesce(p, 0) > 0 THEN 'complete' ELSE 'verified_absent' END AS passive_state, CASE WHEN c_mktsegment = 'BUILDING' OR coalesce(g, false) THEN 'complete' ELSE 'not_applicable' END AS awakening_state, CASE WHEN coalesce(nf, 0) >= 3 THEN 'complete' ELSE 'failed' END AS overall
  FROM customer LEFT JOIN f ON c_custkey = owner"""


@R.add(_RECEIPT_SQL)
def owner_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _receipts(spark, sf_dir).withColumn("families", F.concat_ws(",", "families")).drop("diagnostics")


@R.add(f"WITH r AS ({_RECEIPT_SQL}) SELECT owner, 'active_count' AS field FROM r WHERE owner % 7 = 0 UNION ALL SELECT owner, 'receipt' FROM r WHERE owner % 11 = 0 AND owner % 7 != 0")
def receipt_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _receipts(spark, sf_dir)
    stored = now.where("NOT (owner % 11 = 0 AND owner % 7 != 0)").withColumn("active_count", F.when(F.col("owner") % 7 == 0, F.col("active_count") + 1).otherwise(F.col("active_count")))
    return aggregate.receipt_drift(stored, now)


_ASKED = "o_custkey"


@R.add("""WITH a AS (SELECT c_custkey AS id FROM customer), b AS (SELECT o_custkey AS id FROM orders), t AS (
  SELECT 'left_duplicates' AS "check", count(*) AS n FROM (SELECT id FROM a GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'right_duplicates', count(*) FROM (SELECT id FROM b GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'missing', count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT 'extra', count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a)
  UNION ALL SELECT 'count_off', abs(count(DISTINCT id) - 1000) FROM b)
  SELECT "check", n, n = 0 AS ok FROM t UNION ALL SELECT 'ready', count_if(n != 0), count_if(n != 0) = 0 FROM t""")
def reconcile_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return aggregate.reconcile_ids(c.select(F.col("c_custkey").alias("id")), o.select(F.col("o_custkey").alias("id")), 1000)


@R.add("SELECT key, 'expected_only' AS side FROM (SELECT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30) UNION ALL SELECT key, 'stored_only' FROM (SELECT l_partkey AS key FROM lineitem WHERE l_quantity > 30 EXCEPT SELECT p_partkey FROM part)")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    return resolve.missing_keys(p.withColumnRenamed("p_partkey", "key"), li.where("l_quantity > 30").withColumnRenamed("l_partkey", "key"), "key")


@R.add("""WITH k AS (SELECT DISTINCT c_custkey AS name FROM customer WHERE c_acctbal > 0 INTERSECT SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment != 'BUILDING')
  SELECT name, coalesce(n, 0) AS orders, coalesce(u, 0) AS urgent, CASE WHEN coalesce(n, 0) + coalesce(u, 0) = 0 THEN 'delete' ELSE 'keep' END AS cleanup
  FROM k LEFT JOIN (SELECT o_custkey AS name, count(*) AS n, nullif(count_if(o_orderpriority = '1-URGENT'), 0) AS u FROM orders GROUP BY 1) USING (name)""")
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "name"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "name")
    return resolve.overlap_report(c.where("c_acctbal > 0"), c.where("c_mktsegment != 'BUILDING'"), {"orders": o, "urgent": o.where("o_orderpriority = '1-URGENT'")})


@R.add("""WITH e AS (SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey % 3 != 0), s AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 10 = 0 THEN c_name || 'x' ELSE c_name END AS name, c_custkey % 2 = 0 AS managed FROM customer WHERE c_custkey % 5 != 0 OR c_custkey % 10 = 0),
  l AS (SELECT DISTINCT o_custkey AS key FROM orders), j AS (SELECT coalesce(e.key, s.key) AS key, e.key IS NOT NULL AS ee, s.key IS NOT NULL AS ss, e.name AS n1, s.name AS n2, managed FROM e FULL JOIN s ON e.key = s.key)
  SELECT j.key, CASE WHEN ee AND NOT ss THEN 'create' WHEN ee AND ss AND n1 != n2 THEN 'conflict' WHEN ee THEN 'keep' WHEN NOT managed THEN 'keep' WHEN l.key IS NOT NULL THEN 'keep' ELSE 'delete' END AS action,
    CASE WHEN ee AND NOT ss THEN 'missing' WHEN ee AND ss AND n1 != n2 THEN 'name_differs' WHEN ee THEN 'expected' WHEN NOT managed THEN 'unmanaged' WHEN l.key IS NOT NULL THEN 'connected' ELSE 'stale' END AS reason FROM j LEFT JOIN l ON j.key = l.key""")
def managed_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    stored = c.where("key % 5 != 0 OR key % 10 = 0").select("key", F.when(F.col("key") % 10 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")).alias("name"), (F.col("key") % 2 == 0).alias("managed"))
    return reconcile.managed_reconcile(c.where("key % 3 != 0"), stored, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), True)


@R.add("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"), "c_mktsegment")
    stored = c.where("c_custkey % 3 != 0 OR c_custkey % 2 = 1")
    once = reconcile.upsert(stored, new, ["c_custkey"])
    return reconcile.upsert(once, new, ["c_custkey"])


@R.add("SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_custkey % 4 != 0 OR o_totalprice > 100000")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    rows = o.where("o_totalprice > 100000").select("o_custkey", "o_orderkey", F.lit("new").alias("o_orderstatus"))
    parents = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return reconcile.replace_children(o.drop("o_totalprice"), parents, rows, "o_custkey")


@R.add("SELECT DISTINCT name FROM (SELECT unnest(string_split(p_type, ' ')) AS name FROM part UNION ALL SELECT p_brand FROM part WHERE p_size > 25) WHERE name IS NOT NULL AND trim(name) != ''")
def trait_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return aggregate.trait_union(p.select(F.split("p_type", " ").alias("personalities")), p.where("p_size > 25").select(F.col("p_brand").alias("personality_req")))


@R.add("SELECT key, 'changed' AS kind FROM (SELECT s_suppkey AS key FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 7 != 0) UNION ALL SELECT s_suppkey, 'missing' FROM supplier WHERE s_suppkey % 7 = 0")
def graph_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), "s_name", "s_nationkey")
    stored = s.where("key % 7 != 0").withColumn("s_nationkey", F.when(F.col("key") % 5 == 0, F.col("s_nationkey") + 100).otherwise(F.col("s_nationkey")))
    return resolve.drift(s, stored, "key", ["s_name", "s_nationkey"])


@R.add("SELECT o_orderkey AS fact_id, o_custkey AS owner, CASE WHEN o_orderkey % 3 = 0 THEN 'approve' WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'reject' END AS decision, CASE WHEN o_orderkey % 3 = 0 THEN 'proposal_id' WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'legacy' END AS via FROM orders")
def decision_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), "o_orderkey").alias("proposal_id"), F.lit("order").alias("record_type"), F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("rule_id"), F.col("o_orderstatus").alias("semantics"))
    new = p.where("fact_id % 3 = 0").withColumn("decision", F.lit("approve"))
    old = p.where("fact_id % 3 = 1").withColumns({"decision": F.lit("reject"), "proposal_id": F.lit(None).cast("string"), "semantics": F.when(F.col("fact_id") % 2 == 0, F.col("semantics")).otherwise("other")})
    return resolve.match_decisions(p, new.unionByName(old)).select("fact_id", "owner", "decision", "via")


@R.add("SELECT l_suppkey AS owner, count(*) AS n_items, min(l_partkey) AS first_item FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1")
def collected_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("item_id")).distinct()
    o = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("owner"))
    got = resolve.lineup_context(o.withColumn("request_id", F.lit(1)), {"items": (li, ["item_id"])}, 12).where("items IS NOT NULL")
    return got.select("owner", F.col("n_items"), F.col("items")[0]["item_id"].alias("first_item"))
