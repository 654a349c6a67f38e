"""Rule extraction and human review. A proposal is a fact that a rule's pattern matches; only a review makes it proven."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from factloom.functions import expr
from factloom.operators import reconcile, resolve, validate

CLEAR = "__clear__"
#: Rules that are compiled into one projection; all that people write by hand.
COMPILED = 200
SEMANTICS = ("kind", "value", "direction", "target")


def propose(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(proposal_id, fact_id, record_type, rule_id, kind, value, direction, target, matched, semantics).

    facts(fact_id, record_type, text); rules(rule_id, record_types, pattern, negatives array, kind, value, direction, target,
    phase): the pattern matches the text and no negative does. ``matched`` is the match in phase "match", else the text.
    Up to ``COMPILED`` rules become one projection of literal patterns, without a join; a larger table is joined.
    """
    listed = rules.limit(COMPILED + 1).collect()
    j = _compiled(facts, listed) if len(listed) <= COMPILED else _joined(facts, rules)
    return j.select(proposal_id().alias("proposal_id"), F.col("fact_id").cast("string").alias("fact_id"), "record_type", "rule_id", *SEMANTICS, "matched", semantics().alias("semantics"))


def _compiled(facts: DataFrame, listed: Sequence[Row]) -> DataFrame:
    text, found = F.col("text"), []
    for r in listed:
        ok = F.col("record_type").isin(*r["record_types"]) & text.rlike(r["pattern"])
        for n in r["negatives"] or ():
            ok = ok & ~text.rlike(n)
        matched = F.regexp_extract(text, r["pattern"], 0) if r["phase"] == "match" else text
        found.append(F.when(ok, F.struct(*(F.lit(r[c]).cast("string").alias(c) for c in ("rule_id", *SEMANTICS)), matched.alias("matched"))))
    each = F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<rule_id:string,kind:string,value:string,direction:string,target:string,matched:string>>")
    return facts.select("fact_id", "record_type", F.explode(each).alias("x")).select("fact_id", "record_type", "x.*")


def _joined(facts: DataFrame, rules: DataFrame) -> DataFrame:
    r = rules.withColumn("record_type", F.explode("record_types")).drop("record_types")
    j = facts.join(r, "record_type").where(F.expr("rlike(text, pattern)"))
    negatives = rules.select("rule_id", F.explode("negatives").alias("negative"))
    hit = j.select("fact_id", "record_type", "rule_id", "text").join(negatives, "rule_id").where(F.expr("rlike(text, negative)"))
    j = j.join(hit.select("fact_id", "record_type", "rule_id").distinct(), ["fact_id", "record_type", "rule_id"], "left_anti")
    matched = F.when(F.col("phase") == "match", F.expr("regexp_extract(text, pattern, 0)")).otherwise(F.col("text"))
    return j.withColumn("matched", matched)


def proposal_id() -> Column:
    return expr.stable_id("proposal", "record_type", "fact_id", "rule_id")


def semantics() -> Column:
    """What a review decided on; a decision on other semantics no longer holds."""
    return F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in SEMANTICS))


def propose_overrides(facts: DataFrame, overrides: DataFrame) -> DataFrame:
    """Explicit proposals for single facts: overrides(fact_id, rule_id, kind, value, direction, target)."""
    j = facts.join(overrides, "fact_id")
    return j.select(proposal_id().alias("proposal_id"), F.col("fact_id").cast("string").alias("fact_id"), "record_type", "rule_id", *SEMANTICS, F.col("text").alias("matched"), semantics().alias("semantics"))


def with_states(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals with ``decision`` (null if none holds) and ``state``: proven, rejected, ambiguous or candidate."""
    out = resolve.match_decisions(proposals, decisions)
    state = F.when(F.col("decision").isin("approve", "correct"), "proven").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "ambiguous", "ambiguous").otherwise("candidate")
    return out.withColumn("state", state)


def materialize(proposals: DataFrame, decisions: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """(fact_id, capabilities, dependencies, evidence, n_candidate, n_rejected, n_ambiguous, state).

    corrections(proposal_id, value): the corrected value stands instead of the proposed one, ``__clear__`` for none.
    Evidence is in order of kind, value and proposal; a fact without proven evidence is untagged, candidate, ambiguous or rejected.
    """
    p = with_states(proposals, decisions)
    if corrections is not None:
        p = p.join(corrections.select("proposal_id", F.col("value").alias("corrected")), "proposal_id", "left")
        p = p.withColumn("value", F.when(F.col("decision") == "correct", F.coalesce("corrected", "value")).otherwise(F.col("value"))).drop("corrected")
    proven = (F.col("state") == "proven") & (F.col("value") != CLEAR)
    values = lambda kind: F.sort_array(F.collect_set(F.when(proven & (F.col("kind") == kind), F.col("value"))))
    n = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    out = p.groupBy("fact_id").agg(
        values("capability").alias("capabilities"),
        values("dependency").alias("dependencies"),
        F.sort_array(F.collect_list(F.when(proven, F.struct("kind", "value", "proposal_id", "decision")))).alias("evidence"),
        *map(n, ("candidate", "rejected", "ambiguous")),
    )
    state = F.when(F.size("evidence") > 0, "proven").when(F.col("n_ambiguous") > 0, "ambiguous").when(F.col("n_candidate") > 0, "candidate").when(F.col("n_rejected") > 0, "rejected").otherwise("untagged")
    return out.withColumn("state", state)


def validate_review(rows: DataFrame, proposals: DataFrame, vocabulary: Mapping[str, Sequence[str]]) -> DataFrame:
    """(proposal_id, errors) of review rows(proposal_id, semantics, decision, corrected_value, magnitude) that may not be applied."""
    n = rows.groupBy("proposal_id").agg(F.count("*").alias("_n"))
    j = rows.join(n, "proposal_id").join(proposals.select("proposal_id", F.col("semantics").alias("_s"), F.lit(True).alias("_p")), "proposal_id", "left")
    blank = F.coalesce(F.trim("decision"), F.lit("")) == ""
    value = F.coalesce(F.trim("corrected_value"), F.lit(""))
    rules = {
        "unknown_proposal": F.col("_p").isNotNull(),
        "semantic_drift": F.col("_p").isNull() | F.col("_s").eqNullSafe(F.col("semantics")),
        "duplicate": F.col("_n") == 1,
        "blank_decision": ~blank,
        "decision_vocabulary": blank | F.col("decision").isin(*vocabulary["decision"]),
        "value_vocabulary": (value == "") | value.isin(*vocabulary["value"], CLEAR),
        "numeric": F.col("magnitude").isNull() | F.trim("magnitude").isin("", CLEAR) | F.col("magnitude").try_cast("double").isNotNull(),
        "stray_correction": (value == "") | F.col("decision").eqNullSafe("correct"),
    }
    marked = validate.with_reasons(j, rules)
    return marked.where(F.size("reasons") > 0).select("proposal_id", F.col("reasons").alias("errors"))


def apply_review(decisions: DataFrame, rows: DataFrame) -> DataFrame:
    """Decisions with the new rows in place of those of the same proposal."""
    return reconcile.upsert(decisions, rows, ["proposal_id"])


def migration_set(decisions: DataFrame, proposals: DataFrame, splits: DataFrame) -> DataFrame:
    """(proposal_id, rule_id, reason): decisions on changed semantics, or on rules that splits(rule_id, new_rule_id) replaced."""
    known = proposals.select("proposal_id", F.col("semantics").alias("_s"))
    drifted = decisions.join(known, "proposal_id").where(~F.col("_s").eqNullSafe(F.col("semantics"))).select("proposal_id", "rule_id", F.lit("drift").alias("reason"))
    split = decisions.join(splits.select("rule_id").distinct(), "rule_id", "left_semi").select("proposal_id", "rule_id", F.lit("split").alias("reason"))
    return drifted.unionByName(split).groupBy("proposal_id", "rule_id").agg(F.max("reason").alias("reason"))


def handoff_audit(proposals: DataFrame, decisions: DataFrame, gold: DataFrame) -> DataFrame:
    """(error, proposal_id): orphaned and drifted decisions, proposals left open, states that differ from gold(proposal_id, expected_state)."""
    states = with_states(proposals, decisions)
    row = lambda df, e: df.select(F.lit(e).alias("error"), "proposal_id")
    known = proposals.select("proposal_id", F.col("semantics").alias("_s"))
    named = decisions.where("proposal_id IS NOT NULL")
    parts = [
        row(named.join(known, "proposal_id", "left_anti"), "orphaned"),
        row(named.join(known, "proposal_id").where(~F.col("_s").eqNullSafe(F.col("semantics"))), "drifted"),
        row(states.where("state = 'candidate'"), "open"),
        row(gold.join(states.select("proposal_id", "state"), "proposal_id", "left").where(~F.col("expected_state").eqNullSafe(F.col("state"))), "gold_mismatch"),
    ]
    return reduce(DataFrame.unionByName, parts)


def check_rule_cases(cases: DataFrame, proposals: DataFrame) -> DataFrame:
    """cases(rule_id, case, fact_id, present, value, direction, target) -> (rule_id, case, fact_id, ok): present and as expected, or absent."""
    got = proposals.select("rule_id", "fact_id", *(F.col(c).alias(f"_{c}") for c in ("value", "direction", "target")), F.lit(True).alias("_p"))
    j = cases.join(got, ["rule_id", "fact_id"], "left")
    fields = reduce(lambda a, b: a & b, (F.col(c).isNull() | F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("value", "direction", "target")))
    found = F.coalesce("_p", F.lit(False))
    return j.select("rule_id", "case", "fact_id", F.when(F.col("present"), found & fields).otherwise(~found).alias("ok"))


def rule_table_errors(rules: DataFrame, vocabulary: Mapping[str, Sequence[str]]) -> DataFrame:
    """(rule_id, error): repeated ids, blank patterns, words outside the vocabulary, no record type."""
    n = rules.groupBy("rule_id").agg(F.count("*").alias("_n"))
    checks = {
        "duplicate_id": F.col("_n") == 1,
        "blank_pattern": F.trim("pattern") != "",
        "no_record_type": F.size("record_types") > 0,
        **{f"{c}_vocabulary": F.col(c).isin(*words) for c, words in vocabulary.items()},
    }
    marked = validate.with_reasons(rules.join(n, "rule_id"), checks)
    return marked.select("rule_id", F.explode("reasons").alias("error")).distinct()


def resource_operations(blocks: DataFrame, resource: str = "charge") -> DataFrame:
    """blocks(unit_id, block_ord, text) -> (unit_id, block_ord, operation, amount, condition) for each stated operation on the resource."""
    patterns = {
        "consumption": rf"(?i)\bconsumes?\s+\d+\s+{resource}\b",
        "gain": rf"(?i)\b(?:stack|gains?)\s+(?:\+\s*)?(?:\d+|one|two)\s+{resource}\b",
        "availability_threshold": rf"(?i)\b(?:requires?|needs?|available\s+at|minimum\s+of)\s+\d+\s+{resource}\b",
    }
    t = F.regexp_replace(F.trim("text"), r"\s+", " ")
    b = blocks.select("unit_id", "block_ord", t.alias("t"))

    def found(operation: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("t", F.lit(pattern), 0), lambda m: F.struct(F.lit(operation).alias("operation"), m.alias("m")))

    each = F.concat(*(found(o, p) for o, p in patterns.items()))
    out = b.withColumn("x", F.explode(each)).select("unit_id", "block_ord", "t", "x.*")
    word = F.lower(F.regexp_extract("m", rf"(?i)(\d+|one|two)\s+{resource}$", 1))
    amount = F.when(word == "one", 1).when(word == "two", 2).otherwise(word.try_cast("int"))
    before = F.trim(F.expr("substring_index(t, m, 1)"))
    condition = F.nullif(F.trim(F.regexp_extract(before, r"(?i)(?:^|[.!?]\s*|\]\s*:?\s*)(When\b.*)$", 1)), F.lit(""))
    return out.select("unit_id", "block_ord", "operation", amount.cast("int").alias("amount"), condition.alias("condition"))


def materialization_drift(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """R11."""
    return resolve.drift(recomputed, stored, "fact_id", ["capabilities", "dependencies", "state"])
