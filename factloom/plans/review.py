"""Queries on rules, reviews and coverage: documents are facts, labels are decisions, sources are owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import expr
from factloom.operators import aggregate, ranked, resolve, rules
from factloom.plans import common
from factloom.plans.common import PROPOSALS_SQL, Registry
from factloom.storage import table

R = Registry()


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = common.proposals(spark, sf_dir)
    return rules.with_states(p, common.decisions(spark, sf_dir, p))


@R.add(f"WITH {PROPOSALS_SQL} SELECT proposal_id, fact_id, record_type, rule_id, kind, value FROM prop")
def propose_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.propose(common.facts(spark, sf_dir), common.rules(spark)).select("proposal_id", "fact_id", "record_type", "rule_id", "kind", "value")


@R.add(f"WITH {PROPOSALS_SQL} SELECT value, count(*) AS proposed, count_if(state = 'proven') AS proven, count_if(state = 'candidate') AS candidate, count_if(state = 'rejected') AS rejected, count_if(state = 'ambiguous') AS ambiguous FROM st GROUP BY ROLLUP (value)")
def proposal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.proposal_states(_states(spark, sf_dir))


@R.add(f"""WITH {PROPOSALS_SQL}, g AS (SELECT fact_id,
    coalesce(string_agg(DISTINCT CASE WHEN state = 'proven' AND kind = 'capability' THEN value END, ',' ORDER BY CASE WHEN state = 'proven' AND kind = 'capability' THEN value END), '') AS capabilities,
    coalesce(string_agg(DISTINCT CASE WHEN state = 'proven' AND kind = 'dependency' THEN value END, ',' ORDER BY CASE WHEN state = 'proven' AND kind = 'dependency' THEN value END), '') AS dependencies,
    count_if(state = 'proven') AS n_evidence, count_if(state = 'candidate') AS n_candidate, count_if(state = 'rejected') AS n_rejected, count_if(state = 'ambiguous') AS n_ambiguous FROM st GROUP BY fact_id)
  SELECT *, CASE WHEN n_evidence > 0 THEN 'proven' WHEN n_ambiguous > 0 THEN 'ambiguous' WHEN n_candidate > 0 THEN 'candidate' WHEN n_rejected > 0 THEN 'rejected' ELSE 'untagged' END AS state FROM g""")
def materialize_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = common.proposals(spark, sf_dir)
    m = rules.materialize(p, common.decisions(spark, sf_dir, p))
    return m.select("fact_id", F.concat_ws(",", "capabilities").alias("capabilities"), F.concat_ws(",", "dependencies").alias("dependencies"), F.size("evidence").cast("long").alias("n_evidence"), "n_candidate", "n_rejected", "n_ambiguous", "state")


@R.add(f"""WITH {PROPOSALS_SQL}, t AS (SELECT count(DISTINCT source) AS o, count(DISTINCT doc_id) AS f FROM documents),
  fam AS (SELECT DISTINCT value, split_part(value, '_', 1) AS family FROM rules WHERE kind = 'capability')
  SELECT 'owners_with:' || family AS metric, coalesce(n, 0) AS value, o AS denominator FROM (SELECT DISTINCT family FROM fam) LEFT JOIN (SELECT family, count(DISTINCT owner) AS n FROM st JOIN fam USING (value) WHERE state = 'proven' GROUP BY family) USING (family), t
  UNION ALL SELECT 'facts_in_state:' || state, count(DISTINCT fact_id), any_value(f) FROM st, t GROUP BY state""")
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    fam = common.rules(spark).where("kind = 'capability'").select("value", F.substring_index("value", "_", 1).alias("family")).distinct()
    return aggregate.coverage(common.facts(spark, sf_dir), _states(spark, sf_dir), fam)


@R.add(f"""WITH {PROPOSALS_SQL}, j AS (SELECT d.source AS request_id, d.doc_id, d.n_chars, s.state FROM documents d LEFT JOIN st s USING (doc_id))
  SELECT request_id, 'captured' AS metric, count(DISTINCT doc_id) AS value, CAST(0 AS BIGINT) AS unknown FROM j GROUP BY 1
  UNION ALL SELECT request_id, 'long', count(DISTINCT CASE WHEN n_chars >= 1000 THEN doc_id END), 0 FROM j GROUP BY 1
  UNION ALL SELECT request_id, 'proven', count(DISTINCT CASE WHEN state = 'proven' THEN doc_id END), count(DISTINCT CASE WHEN state IS NULL THEN doc_id END) FROM j GROUP BY 1""")
def coverage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("request_id"), F.col("doc_id").cast("string").alias("fact_id"), "n_chars")
    rows = d.join(_states(spark, sf_dir).select("fact_id", "state"), "fact_id", "left")
    return aggregate.coverage_funnel(rows, {"captured": F.lit(True), "long": F.col("n_chars") >= 1000, "proven": F.col("state") == "proven"}, entity="fact_id")


_BANDS = [("b0", "P0", ["insult", "license"]), ("b1", "P1", ["license", "markup"]), ("b2", "P1", ["article"])]
_BANDS_SQL = "(SELECT * FROM (VALUES ('b0', 'P0', 'insult'), ('b0', 'P0', 'license'), ('b1', 'P1', 'license'), ('b1', 'P1', 'markup'), ('b2', 'P1', 'article')) AS t(boss_id, band, counter_id))"


@R.add(f"""WITH {PROPOSALS_SQL}, l AS (SELECT s.*, split_part(value, '_', 1) AS counter_id FROM st s WHERE kind = 'capability'),
  per AS (SELECT counter_id, count(*) AS proposals, count(DISTINCT owner) AS owners, count_if(state = 'proven') AS proven, count(DISTINCT rule_id) AS rules FROM l GROUP BY 1),
  need AS (SELECT counter_id, band, count(DISTINCT boss_id) AS targets FROM {_BANDS_SQL} GROUP BY 1, 2)
  SELECT counter_id, band, targets, coalesce(proposals, 0) AS proposals, coalesce(owners, 0) AS owners, coalesce(proven, 0) AS proven, coalesce(rules, 0) AS rules FROM need LEFT JOIN per USING (counter_id)""")
def counter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir).join(common.facts(spark, sf_dir).select("fact_id", "owner"), "fact_id")
    known = common.rules(spark).where("kind = 'capability'").groupBy(F.substring_index("value", "_", 1).alias("counter_id")).agg(F.collect_set("value").alias("capabilities")).withColumn("related", F.array().cast("array<string>"))
    links = resolve.counter_links(s, known, spark.createDataFrame([], "rule_id string, counter_id string"))
    return aggregate.counter_report(links, s, spark.createDataFrame(_BANDS, "boss_id string, band string, counter_ids array<string>"))


@R.add(f"""WITH {PROPOSALS_SQL}, b AS (SELECT * FROM (VALUES ('insult_wit', 'P0', true), ('license_apache', 'P1', true), ('markup_noise', 'P2', false)) AS t(value, band, required)),
  p AS (SELECT s.*, count(*) OVER (PARTITION BY rule_id) AS n_rule, band, required FROM st s LEFT JOIN b USING (value)),
  q AS (SELECT *, CASE WHEN band = 'P0' THEN 'p0' WHEN state = 'ambiguous' THEN 'ambiguous' WHEN n_rule >= 20 THEN 'recurring_rule' WHEN coalesce(required, false) THEN 'required_counter' END AS queue FROM p WHERE state IN ('candidate', 'ambiguous')),
  r AS (SELECT queue, proposal_id, row_number() OVER (PARTITION BY queue ORDER BY n_rule DESC, proposal_id) AS rank FROM q WHERE queue IS NOT NULL)
  SELECT queue, proposal_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 25""")
def review_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([("insult_wit", "P0", True), ("license_apache", "P1", True), ("markup_noise", "P2", False)], "value string, band string, required boolean")
    return ranked.review_queues(_states(spark, sf_dir), bands, 25, 20)


@R.add(f"""WITH {PROPOSALS_SQL}, u AS (SELECT * FROM st WHERE decision IS NULL),
  t AS (SELECT proposal_id, value, row_number() OVER (PARTITION BY value ORDER BY sha256('s1' || proposal_id), proposal_id) AS turn FROM u)
  SELECT proposal_id, value, CAST(turn AS INTEGER) AS turn FROM t ORDER BY turn, value LIMIT 40""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir)
    return ranked.stratified_sample(s, s.where("decision IS NOT NULL"), 40, "s1").select("proposal_id", "value", "turn")


@R.add(f"""WITH {PROPOSALS_SQL}, f AS (SELECT value, min(proposal_id) AS proposal_id FROM st GROUP BY value),
  k AS (SELECT DISTINCT r.value, split_part(r.value, '_', 1) AS family, f.proposal_id FROM rules r LEFT JOIN f USING (value)),
  h AS (SELECT family, list(proposal_id ORDER BY proposal_id, value) AS ids FROM k WHERE proposal_id IS NOT NULL GROUP BY family)
  SELECT k.value, k.proposal_id, CASE WHEN k.proposal_id IS NOT NULL THEN CASE WHEN ids[1] != k.proposal_id THEN ids[1] ELSE ids[2] END END AS cross_id, k.proposal_id IS NULL AS missing FROM k LEFT JOIN h USING (family)""")
def seed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = common.rules(spark).select("value", F.substring_index("value", "_", 1).alias("family")).distinct()
    return ranked.seed_coverage(_states(spark, sf_dir), active)


@R.add(f"""WITH {PROPOSALS_SQL}, x AS (SELECT proposal_id, 0 AS origin FROM st WHERE state = 'proven' AND rule_id = 'r04' UNION ALL SELECT min(proposal_id), 1 FROM st GROUP BY value UNION ALL SELECT proposal_id, 2 FROM st)
  SELECT proposal_id, CAST(origin AS INTEGER) AS origin FROM (SELECT proposal_id, min(origin) AS origin FROM x GROUP BY 1) ORDER BY origin, proposal_id LIMIT 60""")
def refill_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir)
    batch = s.where("rule_id = 'r04'").select("proposal_id", (F.col("state") == "proven").alias("reviewed"))
    return ranked.refill(batch, s.groupBy("value").agg(F.min("proposal_id").alias("proposal_id")), s, 60)


@R.add(f"""WITH {PROPOSALS_SQL}, j AS (SELECT proposal_id, state, CASE WHEN rule_id < 'r05' THEN 'proven' ELSE 'candidate' END AS want FROM st)
  SELECT 'open' AS error, proposal_id FROM st WHERE state = 'candidate' UNION ALL SELECT 'gold_mismatch', proposal_id FROM j WHERE state != want""")
def handoff_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = common.proposals(spark, sf_dir)
    gold = p.select("proposal_id", F.when(F.col("rule_id") < "r05", "proven").otherwise("candidate").alias("expected_state"))
    return rules.handoff_audit(p, common.decisions(spark, sf_dir, p), gold)


@R.add(f"""WITH {PROPOSALS_SQL}, c AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS fact_id, position('MIT License' IN text) > 0 AS present FROM documents)
  SELECT 'r03' AS rule_id, CASE WHEN present THEN 'positive' ELSE 'negative' END AS "case", fact_id, CASE WHEN present THEN p.value IS NOT NULL ELSE p.value IS NULL END AS ok
  FROM c LEFT JOIN (SELECT * FROM prop WHERE rule_id = 'r03') p USING (fact_id)""")
def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = common.facts(spark, sf_dir)
    p = rules.propose(f, common.rules(spark))
    hit = F.col("text").contains("MIT License")
    cases = f.select(F.lit("r03").alias("rule_id"), F.when(hit, "positive").otherwise("negative").alias("case"), "fact_id", hit.alias("present"), F.when(hit, "license_mit").alias("value"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("string").alias("target"))
    return rules.check_rule_cases(cases, p)


@R.add(f"""WITH {PROPOSALS_SQL}, r AS (SELECT proposal_id, CASE WHEN rule_id = 'r10' THEN '' WHEN rule_id = 'r09' THEN 'maybe' ELSE 'approve' END AS decision, CASE WHEN rule_id = 'r04' THEN 'license_x' ELSE NULL END AS v, rule_id FROM prop)
  SELECT proposal_id, concat_ws(',', CASE WHEN decision = '' THEN 'blank_decision' END, CASE WHEN decision = 'maybe' THEN 'decision_vocabulary' END, CASE WHEN v IS NOT NULL THEN 'value_vocabulary' END, CASE WHEN v IS NOT NULL THEN 'stray_correction' END) AS errors
  FROM r WHERE decision != 'approve' OR v IS NOT NULL""")
def review_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = common.proposals(spark, sf_dir)
    rows = p.select("proposal_id", "semantics", F.when(F.col("rule_id") == "r10", "").when(F.col("rule_id") == "r09", "maybe").otherwise("approve").alias("decision"), F.when(F.col("rule_id") == "r04", "license_x").alias("corrected_value"), F.lit(None).cast("string").alias("magnitude"))
    out = rules.validate_review(rows, p, {"decision": ("approve", "reject", "correct", "ambiguous"), "value": [r[5] for r in common.RULES]})
    return out.select("proposal_id", F.concat_ws(",", "errors").alias("errors"))


@R.add("SELECT doc_id, string_agg(t, ',' ORDER BY k) AS tags FROM (SELECT doc_id, k, t FROM documents, (VALUES (1, 'tone:harsh', 'idiot|moron|scum'), (2, 'tone:theatre', 'clown'), (3, 'legal:license', 'license|licensed'), (4, 'noise:symbols', '[#$%&*]{3}')) AS p(k, t, r) WHERE regexp_matches(lower(text), r)) GROUP BY doc_id")
def effect_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = (("tone:harsh", "idiot|moron|scum"), ("tone:theatre", "clown"), ("legal:license", "license|licensed"), ("noise:symbols", "[#$%&*]{3}"))
    tags = F.concat_ws(",", expr.effect_tags("text", patterns))
    return table(spark, sf_dir, "documents").select("doc_id", tags.alias("tags")).where("tags != ''")


@R.add("SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'gnu') OR contains(lower(text), 'copyleft') THEN 'copyleft' END, CASE WHEN contains(lower(text), 'creative') OR contains(lower(text), 'cc by') THEN 'creative' END, CASE WHEN contains(lower(text), 'mit license') OR contains(lower(text), 'apache license') THEN 'permissive' END) AS tags FROM documents")
def mechanic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = {"permissive": ("mit license", "apache license"), "copyleft": ("gnu", "copyleft"), "creative": ("creative", "cc by")}
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", expr.needle_tags("text", needles)).alias("tags"))


@R.add("""SELECT doc_id, m AS magnitude_value, CASE WHEN m != '' THEN 'percent' ELSE '' END AS magnitude_unit, regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9_])([0-9]+)\\s+(?:times?|activations?|uses?)(?:[^A-Za-z0-9_]|$)', 1) AS activation_count,
  regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9_])for\\s+([0-9]+)\\s+turns?(?:[^A-Za-z0-9_]|$)', 1) AS duration_turns, CASE WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])the(?:[^A-Za-z0-9_]|$)') THEN 'the' ELSE 'none' END AS "trigger",
  CASE WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])(?:overwrite|replaces?)(?:[^A-Za-z0-9_]|$)') THEN 'overwrites' WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])stacks?(?:[^A-Za-z0-9_]|$)') THEN 'stackable' ELSE 'not_applicable' END AS stacking_behavior,
  coalesce(nullif(regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9_])max(?:imum)?\\s+([0-9]+)\\s+stacks?(?:[^A-Za-z0-9_]|$)', 1), ''), regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9_])up to\\s+([0-9]+)\\s+stacks?(?:[^A-Za-z0-9_]|$)', 1)) AS max_stacks
  FROM (SELECT *, regexp_extract(text, '(?:^|[^A-Za-z0-9_])([0-9]+(?:\\.[0-9]+)?)\\s*%', 1) AS m FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '.', 'g') AS text FROM documents))""")
def qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", "[^ -~]", "."))
    return d.select("doc_id", expr.qualifiers("text", triggers=["none", "the"]).alias("q")).select("doc_id", "q.*").drop("eligibility")
