"""Registration of queries, and tables of rules that several of them use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.rules import propose
from factloom.storage import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep


def _word(w: str) -> str:
    return f"(?i)(?:^|[^A-Za-z]){w}(?:[^A-Za-z]|$)"


#: rule_id, record types, pattern, negatives, kind, value, direction, target, phase
RULES = [
    ("r01", ["en"], _word("worthless"), [], "capability", "insult_value", "down", "person", "match"),
    ("r02", ["en"], _word("idiot"), [_word("clown")], "capability", "insult_wit", "down", "person", "match"),
    ("r03", ["en", "de"], "(?i)MIT License", [], "capability", "license_mit", "none", "work", "match"),
    ("r04", ["en", "fr", "es", "de"], "(?i)Apache License", [], "capability", "license_apache", "none", "work", "match"),
    ("r05", ["en", "fr", "es", "de"], "(?i)GNU General Public License", [], "capability", "license_gpl", "none", "work", "match"),
    ("r06", ["es"], _word("del"), [_word("las")], "capability", "article_del", "none", "text", "text"),
    ("r07", ["fr"], _word("une"), [_word("des"), _word("sur")], "capability", "article_une", "none", "text", "text"),
    ("r08", ["de"], _word("nicht"), [], "dependency", "requires_negation", "none", "text", "text"),
    ("r09", ["en"], "[0-9]{16}", [], "dependency", "requires_redaction", "none", "work", "match"),
    ("r10", ["en", "fr", "es", "de"], "[#$%&*]{3}", [], "capability", "markup_noise", "none", "text", "text"),
]
RULE_SCHEMA = "rule_id string, record_types array<string>, pattern string, negatives array<string>, kind string, value string, direction string, target string, phase string"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def rules_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    a = lambda xs: "CAST([" + ", ".join(map(q, xs)) + "] AS VARCHAR[])"
    rows = ", ".join(f"({q(r)}, {a(t)}, {q(p)}, {a(n)}, {q(k)}, {q(v)}, {q(d)}, {q(g)}, {q(f)})" for r, t, p, n, k, v, d, g, f in RULES)
    return f"SELECT * FROM (VALUES {rows}) AS t(rule_id, record_types, pattern, negatives, kind, value, direction, target, phase)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("fact_id"), F.col("lang").alias("record_type"), "text", F.col("source").alias("owner"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of all facts, written once, as reviews and states both read them."""
    return Scratch(spark, "proposals").save(propose(facts(spark, sf_dir), rules(spark)), "all")


#: Proposals in SQL, for the queries built on them.
PROPOSALS_SQL = f"""
rules AS ({rules_sql()}),
prop AS (SELECT 'proposal:' || substr(sha256(lower(d.lang) || chr(31) || CAST(d.doc_id AS VARCHAR) || chr(31) || r.rule_id), 1, 20) AS proposal_id, CAST(d.doc_id AS VARCHAR) AS fact_id, d.doc_id, d.source AS owner,
    d.lang AS record_type, r.rule_id, r.kind, r.value, r.direction, r.target
  FROM documents d JOIN rules r ON list_contains(r.record_types, d.lang)
  WHERE regexp_matches(d.text, r.pattern) AND len(list_filter(r.negatives, lambda n: regexp_matches(d.text, n))) = 0),
dec AS (SELECT p.*, CASE WHEN l.toxic = 1 THEN 'ambiguous' WHEN l.quality = 1 THEN 'approve' WHEN l.quality = 0 THEN 'reject' END AS decision FROM prop p LEFT JOIN labels l USING (doc_id)),
st AS (SELECT *, CASE decision WHEN 'approve' THEN 'proven' WHEN 'reject' THEN 'rejected' WHEN 'ambiguous' THEN 'ambiguous' ELSE 'candidate' END AS state FROM dec)"""


def decisions(spark: SparkSession, sf_dir: str, proposals: DataFrame) -> DataFrame:
    """Labels as review decisions: toxic 1 ambiguous, else quality 1 approve, 0 reject."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("fact_id"), F.when(F.col("toxic") == 1, "ambiguous").when(F.col("quality") == 1, "approve").otherwise("reject").alias("decision"))
    return proposals.join(labels, "fact_id").select("proposal_id", "record_type", "fact_id", "rule_id", "semantics", "decision")
