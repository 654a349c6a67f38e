"""Predictions against expectations: one-to-one matching as rank joins, precision and recall, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import expr


def match_one_to_one(pred: DataFrame, exp: DataFrame, keys: Sequence[str], unmatched: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(pred_id, exp_id) of a largest matching; rows may match when all ``keys`` are equal (nulls are no key).

    Rows with equal keys form complete blocks, so with k the smaller side the first k predictions meet the first k expected
    rows in reverse order, by ``ord``. ``unmatched`` names values of a key that never match.
    """

    def ranked(df: DataFrame, name: str) -> DataFrame:
        ok = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
        for k, values in (unmatched or {}).items():
            ok = ok & ~F.col(k).isin(*values)
        w = W.partitionBy(*keys)
        return df.where(ok).select(*keys, F.col(f"{name}_id"), F.row_number().over(w.orderBy("ord", f"{name}_id")).alias(f"r_{name}"))

    p, e = ranked(pred, "pred"), ranked(exp, "exp")
    size = p.groupBy(*keys).agg(F.count("*").alias("np")).join(e.groupBy(*keys).agg(F.count("*").alias("ne")), list(keys)).select(*keys, F.least("np", "ne").alias("k"))
    p = p.join(size, list(keys)).where("r_pred <= k").withColumn("r_exp", F.col("k") + 1 - F.col("r_pred"))
    return p.join(e, [*keys, "r_exp"]).select("pred_id", "exp_id")


def precision_recall(pred: DataFrame, exp: DataFrame, matches: DataFrame, kind: str = "kind") -> DataFrame:
    """By kind and overall (kind null): predicted, expected, matched, precision (0 without predictions), recall (1 if nothing was expected or predicted, else 0 without expectation)."""
    side = lambda df, n: df.groupBy(kind).agg(F.count("*").alias(n))
    m = matches.join(pred.select("pred_id", kind), "pred_id")
    per = side(pred, "predicted").join(side(exp, "expected"), kind, "full_outer").join(side(m, "matched"), kind, "left").na.fill(0, ["predicted", "expected", "matched"])
    out = per.rollup(kind).agg(*(F.sum(c).alias(c) for c in ("predicted", "expected", "matched")))
    precision = F.when(F.col("predicted") == 0, 0.0).otherwise(F.bround(F.col("matched") / F.col("predicted"), 3))
    recall = F.when(F.col("expected") == 0, F.when(F.col("predicted") == 0, 1.0).otherwise(0.0)).otherwise(F.bround(F.col("matched") / F.col("expected"), 3))
    return out.withColumns({"precision": precision, "recall": recall})


def field_accuracy(matches: DataFrame, pred: DataFrame, exp: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field over the matched pairs: adjudicated, correct, unknown (expected value null), accuracy."""
    p = pred.select("pred_id", *(F.col(f).cast("string").alias(f"p_{f}") for f in fields))
    e = exp.select("exp_id", *(F.col(f).cast("string").alias(f"e_{f}") for f in fields))
    j = matches.join(p, "pred_id").join(e, "exp_id")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), expr.normalize_field(F.lit(f), F.col(f"p_{f}")).alias("p"), expr.normalize_field(F.lit(f), F.col(f"e_{f}")).alias("e")) for f in fields)))
    long = j.select(each.alias("x")).select("x.*")
    out = long.groupBy("field").agg(F.count("e").alias("adjudicated"), F.count_if(F.col("e").isNotNull() & F.col("p").eqNullSafe(F.col("e"))).alias("correct"), F.count_if(F.col("e").isNull()).alias("unknown"))
    return out.withColumn("accuracy", F.when(F.col("adjudicated") > 0, F.bround(F.col("correct") / F.col("adjudicated"), 3)))


def match_gaps(pred: DataFrame, exp: DataFrame) -> DataFrame:
    """Gaps by anchor and owner; those without an owner never match."""
    return match_one_to_one(pred, exp, ["anchor", "owner"])


def diagnose_misses(pred: DataFrame, exp: DataFrame, matches: DataFrame) -> DataFrame:
    """Unmatched expectations(exp_id, fact_id, block, start, end, label, operation) by what overlapping predictions of the block say: (exp_id, reason)."""
    miss = exp.join(matches.select("exp_id"), "exp_id", "left_anti")
    p = pred.select("fact_id", "block", F.col("start").alias("ps"), F.col("end").alias("pe"), F.col("label").alias("pl"), F.col("operation").alias("po"))
    j = miss.join(p, ["fact_id", "block"], "left")
    over = F.coalesce((F.col("ps") < F.col("end")) & (F.col("start") < F.col("pe")), F.lit(False))
    same = F.coalesce(F.col("pl") == F.col("label"), F.lit(False))
    op = F.coalesce(F.col("po") == F.col("operation"), F.lit(False))
    per = j.groupBy("exp_id").agg(F.max(over & same & op).alias("a"), F.max(over & same).alias("b"), F.max(over).alias("c"), F.max(same).alias("d"))
    return per.select("exp_id", F.when(F.col("a"), "anchor_differs").when(F.col("b"), "operation_mismatch").when(F.col("c"), "label_mismatch").when(F.col("d"), "elsewhere_in_block").otherwise("absent").alias("reason"))


def relation_groups(pred: DataFrame, exp: DataFrame, keys: Sequence[str], target: str = "target") -> DataFrame:
    """Groups by key and their sets of targets: (keys, status) exact, different, missing or extra."""
    group = lambda df, n: df.groupBy(*keys).agg(F.sort_array(F.collect_set(target)).alias(n))
    j = group(pred, "p").join(group(exp, "e"), list(keys), "full_outer")
    return j.select(*keys, F.when(F.col("p").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("p") == F.col("e"), "exact").otherwise("different").alias("status"))


def dimension_status(witnesses: DataFrame, dimensions: Sequence[str], cohort: str = "cohort") -> DataFrame:
    """Counts by cohort, dimension and status; a null status is unknown."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("unknown")).alias("status")) for d in dimensions)))
    return witnesses.select(cohort, each.alias("x")).groupBy(cohort, "x.dimension", "x.status").agg(F.count("*").alias("n"))


def attach_relationships(occurrences: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """occurrences(occ_id) with their dependencies from relationships(rel_id, owner_occ, value), gaps marked; and relationships without their owner."""
    per = relationships.groupBy(F.col("owner_occ").alias("occ_id")).agg(F.sort_array(F.collect_set("value")).alias("dependencies"))
    rows = occurrences.join(per, "occ_id", "left").withColumn("gap", F.col("dependencies").isNull())
    return rows, relationships.join(occurrences.select(F.col("occ_id").alias("owner_occ")), "owner_occ", "left_anti")


def cohort_errors(pred: DataFrame, exp: DataFrame, cohort: DataFrame, key: str = "witness_id") -> DataFrame:
    """(error, witness_id): witnesses missing from a side, foreign to the cohort, or with an incomplete anchor. One grouping by witness tells all."""
    sides = ("pred", "exp", "cohort")
    open_ = F.col("start").isNull() | F.col("end").isNull() | (F.col("end") <= F.col("start"))
    rows = lambda df, side, bad=F.lit(False): df.select(key, *(F.lit(side == s).alias(f"in_{s}") for s in sides), F.coalesce(bad, F.lit(False)).alias("open"))
    every = rows(pred, "pred").unionByName(rows(exp, "exp", open_)).unionByName(rows(cohort, "cohort"))
    per = every.groupBy(key).agg(*(F.max(c).alias(c) for c in (*(f"in_{s}" for s in sides), "open")))
    # A null is no witness of the other side.
    lacks = lambda side: F.col(key).isNull() | ~F.col(f"in_{side}")
    found = [F.when(F.col("in_cohort") & lacks(n), f"{n}_missing") for n in ("pred", "exp")]
    found += [F.when(F.col(f"in_{n}") & lacks("cohort"), f"{n}_foreign") for n in ("pred", "exp")]
    found.append(F.when(F.col("open"), "anchor_incomplete"))
    return per.select(F.explode(F.array_compact(F.array(*found))).alias("error"), F.col(key).cast("string").alias(key))


def acceptance(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """cases(case_id, expected feasible/infeasible, witness array, certificate), candidates(case_id, members, legal, certificate) -> (case_id, passed, codes).

    Feasible cases need a legal candidate with the witness's members, infeasible ones no candidate and the same certificate.
    """
    c = candidates.select("case_id", F.sort_array("members").alias("m"), "legal")
    j = cases.join(c, "case_id", "left")
    per = j.groupBy("case_id", "expected", "certificate", F.sort_array("witness").alias("w")).agg(F.count("m").alias("n"), F.count_if("legal").alias("n_legal"), F.coalesce(F.max(F.col("legal") & (F.col("m") == F.sort_array("witness"))), F.lit(False)).alias("hit"))
    proof = candidates.where("certificate IS NOT NULL").select("case_id", F.col("certificate").alias("got")).distinct() if "certificate" in candidates.columns else None
    per = per.join(proof.groupBy("case_id").agg(F.max("got").alias("got")), "case_id", "left") if proof is not None else per.withColumn("got", F.lit(None).cast("string"))
    feasible = F.col("expected") == "feasible"
    codes = F.array_compact(
        F.array(
            F.when(feasible & (F.col("n") == 0), "no_candidate"),
            F.when(feasible & (F.col("n") > 0) & (F.col("n_legal") == 0), "no_legal_candidate"),
            F.when(feasible & (F.col("n_legal") > 0) & ~F.col("hit"), "witness_not_found"),
            F.when(~feasible & (F.col("n_legal") > 0), "unexpected_candidate"),
            F.when(~feasible & ~F.col("certificate").eqNullSafe(F.col("got")), "certificate"),
        )
    )
    return per.select("case_id", (F.size(codes) == 0).alias("passed"), codes.alias("codes"))


def compare_variants(runs: DataFrame, base: str = "A", other: str = "B") -> DataFrame:
    """runs(scenario, variant, top_id, ranked_ids, valid, tokens, latency_ms) -> one row a scenario: same top and ranking, validity of both, deltas."""
    cols = ("top_id", "ranked_ids", "valid", "tokens", "latency_ms")
    side = lambda v, p: runs.where(F.col("variant") == v).groupBy("scenario").agg(F.max(F.struct(*cols)).alias(p))
    j = side(base, "a").join(side(other, "b"), "scenario", "full_outer")
    return j.select("scenario", F.col("a.top_id").eqNullSafe(F.col("b.top_id")).alias("same_top"), F.col("a.ranked_ids").eqNullSafe(F.col("b.ranked_ids")).alias("same_ranking"), (F.col("a.valid") & F.col("b.valid")).alias("both_valid"), (F.col("b.tokens") - F.col("a.tokens")).alias("token_delta"), (F.col("b.latency_ms") - F.col("a.latency_ms")).alias("latency_delta"))


SEVERITY = ("PASS", "REVIEW", "UNKNOWN", "FAIL")


def worst(status: str = "status") -> Column:
    """The worst of a group's statuses."""
    at = F.max(F.array_position(F.array(*map(F.lit, SEVERITY)), F.col(status)))
    return F.element_at(F.array(*map(F.lit, SEVERITY)), at.cast("int"))


def review_gates(gates: DataFrame, key: str = "candidate_id") -> tuple[DataFrame, DataFrame]:
    """gates(candidate_id, gate, value, need, review): PASS from ``need`` on, REVIEW from ``review`` on, else FAIL; UNKNOWN for null. Returns (rows with status, overall by key)."""
    v = F.col("value")
    rows = gates.withColumn("status", F.when(v.isNull(), "UNKNOWN").when(v >= F.col("need"), "PASS").when(v >= F.col("review"), "REVIEW").otherwise("FAIL"))
    return rows, rows.groupBy(key).agg(worst().alias("overall"))


def budget_check(calls: DataFrame, target: int, key: str = "variant") -> DataFrame:
    """(variant, tokens, status): within the target, above it, or unknown when no call tells."""
    out = calls.groupBy(key).agg(F.sum("prompt_tokens").alias("tokens"))
    return out.withColumn("status", F.when(F.col("tokens").isNull(), "unknown").when(F.col("tokens") <= target, "within").otherwise("above"))


def resolve_witnesses(witnesses: DataFrame, units: DataFrame, tokens: DataFrame) -> DataFrame:
    """witnesses(witness_id, owner, title, sha256) -> unit, status (resolved, capture_changed, ambiguous, missing), its references and a digest of its ordered tokens."""
    n = units.groupBy("owner", "title").agg(F.count("*").alias("n"), F.min("unit_id").alias("unit_id"), F.min("capture_sha256").alias("capture_sha256"))
    t = tokens.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("block_ord", "tok_ord", "text"))).alias("x"), F.sort_array(F.collect_set("href")).alias("references"))
    j = witnesses.join(n, ["owner", "title"], "left").join(t, "unit_id", "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(~F.col("sha256").eqNullSafe(F.col("capture_sha256")), "capture_changed").otherwise("resolved")
    digest = F.sha2(F.concat_ws("\u001f", F.transform("x", lambda y: y["text"])), 256)
    return j.select("witness_id", F.when(status != "ambiguous", F.col("unit_id")).alias("unit_id"), status.alias("status"), "references", F.when(F.col("x").isNotNull(), digest).alias("order_digest"))
