"""Receipts, reconciliation, coverage and run summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import expr
from factloom.storage import Scratch

RECEIPT_COLUMNS = ("active_count", "family_count", "passive_count", "active_state", "passive_state", "awakening_state", "overall")


def owner_receipts(facts: DataFrame, owners: DataFrame, min_families: int = 3) -> DataFrame:
    """One receipt an owner.

    facts(owner, fact_id, record_type active/passive, slot_eligibility, family_id, gated); owners(owner, awakened). An
    owner without facts has a failed receipt; no passive facts is verified absence.
    """
    eligible = (F.col("record_type") == "active") & F.col("slot_eligibility").isin("active_equipable", "basic_attack_replacement")
    per = facts.groupBy("owner").agg(
        F.count_if(eligible).alias("active_count"),
        F.sort_array(F.collect_set(F.when(eligible, F.col("family_id")))).alias("families"),
        F.count_if(F.col("record_type") == "passive").alias("passive_count"),
        F.max(F.coalesce("gated", F.lit(False))).alias("any_gated"),
    )
    out = owners.join(per, "owner", "left").withColumns({"families": F.coalesce("families", F.array().cast(expr.STRINGS)), "active_count": F.coalesce("active_count", F.lit(0)), "passive_count": F.coalesce("passive_count", F.lit(0))})
    out = out.withColumn("family_count", F.size("families"))
    out = out.withColumns(
        {
            "active_state": F.when(F.col("family_count") >= min_families, "complete").otherwise("failed"),
            "passive_state": F.when(F.col("passive_count") > 0, "complete").otherwise("verified_absent"),
            "awakening_state": F.when(F.coalesce("awakened", F.lit(False)) | F.coalesce("any_gated", F.lit(False)), "complete").otherwise("not_applicable"),
        }
    )
    issue = F.when(F.col("active_state") == "failed", F.struct(F.lit("insufficient_active_skill_families").alias("code"), F.col("family_count").alias("found")))
    out = out.withColumn("diagnostics", F.array_compact(F.array(issue)))
    return out.select("owner", "active_count", "family_count", "families", "passive_count", "active_state", "passive_state", "awakening_state", "diagnostics", F.when(F.col("active_state") == "complete", "complete").otherwise("failed").alias("overall"))


def receipt_drift(stored: DataFrame, recomputed: DataFrame, cols: Sequence[str] = RECEIPT_COLUMNS) -> DataFrame:
    """(owner, field) wherever a stored receipt differs from the recomputed one; missing ones differ in ``receipt``."""
    a, b = stored.select("owner", F.struct(*cols).alias("s")), recomputed.select("owner", F.struct(*cols).alias("r"))
    both = a.join(b, "owner", "full_outer")
    fields = F.array(F.when(F.col("s").isNull() | F.col("r").isNull(), "receipt"), *(F.when(F.col("s").isNotNull() & F.col("r").isNotNull() & ~F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")), c) for c in cols))
    return both.select("owner", F.explode(F.array_compact(fields)).alias("field"))


def reconcile_ids(left: DataFrame, right: DataFrame, expected_n: int | None = None, id_col: str = "id", pattern: str | None = None) -> DataFrame:
    """(check, n, ok): duplicates on either side, missing, extra, malformed, and the count; ``ready`` is that all are fine."""
    a, b = left.select(F.col(id_col).alias("id")), right.select(F.col(id_col).alias("id"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    parts = [
        count(a.groupBy("id").count().where("count > 1"), "left_duplicates"),
        count(b.groupBy("id").count().where("count > 1"), "right_duplicates"),
        count(a.distinct().join(b.distinct(), "id", "left_anti"), "missing"),
        count(b.distinct().join(a.distinct(), "id", "left_anti"), "extra"),
    ]
    if pattern is not None:
        parts.append(count(a.where(~F.coalesce(F.col("id").cast("string").rlike(pattern), F.lit(False))), "malformed"))
    if expected_n is not None:
        parts.append(count(b.distinct(), "count_off").withColumn("n", F.abs(F.col("n") - expected_n)))
    out = reduce(DataFrame.unionByName, parts).withColumn("ok", F.col("n") == 0)
    return out.unionByName(out.agg(F.count_if(~F.col("ok")).alias("n")).select(F.lit("ready").alias("check"), "n", (F.col("n") == 0).alias("ok")))


def coverage(facts: DataFrame, proposals: DataFrame, families: DataFrame) -> DataFrame:
    """(metric, value, denominator).

    facts(fact_id, owner); proposals(fact_id, value, state); families(value, family). Distinct owners with proven facts by family out
    of all owners, and facts by state out of all facts. What isn't proven is unknown, never absent.
    """
    totals = facts.agg(F.countDistinct("owner").alias("owners"), F.countDistinct("fact_id").alias("facts"))
    proven = proposals.where("state = 'proven'").join(families, "value").join(facts.select("fact_id", "owner").distinct(), "fact_id")
    fam = families.select("family").distinct().join(proven.groupBy("family").agg(F.countDistinct("owner").alias("value")), "family", "left")
    a = fam.select(F.concat(F.lit("owners_with:"), "family").alias("metric"), F.coalesce("value", F.lit(0)).alias("value"), F.lit("owners").alias("d"))
    b = proposals.groupBy("state").agg(F.countDistinct("fact_id").alias("value")).select(F.concat(F.lit("facts_in_state:"), "state").alias("metric"), "value", F.lit("facts").alias("d"))
    out = a.unionByName(b).crossJoin(F.broadcast(totals))  # one row
    return out.select("metric", "value", F.when(F.col("d") == "owners", F.col("owners")).otherwise(F.col("facts")).alias("denominator"))


def with_contract(metrics: DataFrame, contract: DataFrame) -> DataFrame:
    """Metrics joined to their definitions; a value without a contract, or the reverse, shows in ``contract_state``."""
    m, c = metrics.withColumn("_m", F.lit(True)), contract.withColumn("_c", F.lit(True))
    state = F.when(F.col("_m").isNull(), "no_value").when(F.col("_c").isNull(), "no_contract").otherwise("ok")
    return m.join(c, "metric", "full_outer").withColumn("contract_state", state).drop("_m", "_c")


def coverage_funnel(rows: DataFrame, stages: Mapping[str, Column], entity: str = "entity", request: str = "request_id") -> DataFrame:
    """(request_id, metric, value, unknown): distinct entities that meet each stage, and those for which it is unknown (null).

    Flags of each entity first, then their sums, so that rows are not multiplied by the stages. Rows without an entity count nowhere.
    """
    flags, sums = [], []
    for name, ok in stages.items():
        for kind, met in (("v", ok), ("u", ok.isNull())):
            flags.append(F.max(F.when(met & F.col(entity).isNotNull(), 1).otherwise(0)).alias(f"{kind}_{name}"))
            sums.append(F.sum(f"{kind}_{name}").alias(f"{kind}_{name}"))
    wide = rows.groupBy(request, entity).agg(*flags).groupBy(request).agg(*sums)
    long = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"v_{n}").alias("value"), F.col(f"u_{n}").alias("unknown")) for n in stages)))
    return wide.select(request, long.alias("x")).select(request, "x.*")


def set_diversity(candidates: DataFrame, request: str = "request_id", members: str = "members", front: int = 4, archetype: str | None = None) -> DataFrame:
    """Per request the number of candidates, of different sets and fronts, and mean and greatest Jaccard similarity of pairs.

    Candidates of a request are few by construction (at most ten); pairs are formed between distinct ones of one request only.
    """
    c = candidates.select(request, F.sort_array(F.array_distinct(members)).alias("s"), F.sort_array(F.slice(members, 1, front)).alias("f"), *([F.col(archetype).alias("t")] if archetype else [F.lit("").alias("t")]))
    per = c.groupBy(request).agg(F.count("*").alias("n"), F.countDistinct("s").alias("unique_sets"), F.countDistinct("f").alias("unique_fronts"), F.countDistinct("t").alias("archetypes"))
    d = c.select(request, "s").distinct()
    d = d.withColumn("i", F.row_number().over(W.partitionBy(request).orderBy("s")))
    b = d.select(request, F.col("s").alias("s2"), F.col("i").alias("i2"))
    pairs = d.join(b, request).where("i < i2").withColumn("j", F.size(F.array_intersect("s", "s2")) / F.size(F.array_union("s", "s2")))
    sim = pairs.groupBy(request).agg(F.bround(F.avg("j"), 3).alias("mean_jaccard"), F.bround(F.max("j"), 3).alias("max_jaccard"))
    warn = F.array_compact(F.array(F.when(F.col("unique_sets") < F.col("n"), "repeated_sets"), F.when(F.col("unique_fronts") == 1, "single_front"), F.when(F.col("max_jaccard") >= 0.8, "near_duplicates")))
    return per.join(sim, request, "left").withColumn("warnings", warn)


#: Ranges that a round of selection counts.
BINS = 1024


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(by, prob, value): exact quantiles, interpolated between neighbours, of each group's finite values; groups without any have no rows.

    Selection by counting: a group's range is cut into ``BINS`` and values counted by range, with partial sums before anything is shuffled; the range that
    holds the wanted rank is cut again, from its own least to its greatest value, until these are one. No task holds a group's values, and a round's result is
    at most ``BINS`` rows for a rank. Few rounds are needed, as a range shrinks a thousandfold.
    """
    scratch = Scratch(df.sparkSession, "quantiles")
    x = F.col(value).cast("double")
    rows = scratch.save(df.select(*by, x.alias("x")).where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')"), "rows")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.col("prob") * (F.col("n") - 1)
    wanted = scratch.save(sizes.withColumn("prob", F.explode(F.array(*map(F.lit, probs)))).withColumns({"low": F.floor(place), "part": place - F.floor(place)}).withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1)), "wanted")
    ranks = wanted.select(*by, "lo", "hi", F.explode(F.array("low", "high")).alias("rank")).distinct()
    state, step = scratch.save(ranks.withColumn("before", F.lit(0).cast("long")), "state0"), 0
    done = state.where("lo = hi")
    while (left := state.where("lo < hi")).limit(1).count():
        step += 1
        within = rows.join(left.select(*(F.col(c).alias(f"_{c}") for c in by), "lo", "hi", "rank", "before"), reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))))
        # Halves, so that the width of the widest range is a number; the last range is closed.
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        counted = within.groupBy(*by, "rank", "before", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("c").over(W.partitionBy(*by, "rank").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("before")
        inside = counted.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        state = scratch.save(inside.select(*by, "lo", "hi", "rank", (F.col("upto") - F.col("c")).alias("before")), f"state{step}")
        done = done.unionByName(state.where("lo = hi"))
    ends = wanted.select(*by, "prob", "part", F.explode(F.array(F.struct("low", F.lit(0).alias("high")), F.struct(F.col("high").alias("low"), F.lit(1).alias("high")))).alias("r")).select(*by, "prob", "part", F.col("r.low").alias("rank"), F.col("r.high").alias("upper"))
    found = done.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("rank").alias("_rank"), F.col("lo").alias("x"))
    met = ends.join(found, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.col("rank") == F.col("_rank")))
    got = met.groupBy(*by, "prob", "part").agg(F.max(F.when(F.col("upper") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("upper") == 1, F.col("x"))).alias("b"))
    return got.select(*by, "prob", ((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b")).alias("value"))


def distributions(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, min, median, max), by exact selection; null for a metric without values."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics)))
    long = df.select(each.alias("x")).select("x.*")
    ends = long.groupBy("metric").agg(F.min("v").alias("min"), F.max("v").alias("max"))
    middle = quantiles(long, ["metric"], "v", [0.5]).select("metric", F.col("value").alias("median"))
    return ends.join(middle, "metric", "left").select("metric", "min", "median", "max")


def proposal_states(proposals: DataFrame) -> DataFrame:
    """Counts by value, and over all of them (value null)."""
    state = lambda s: F.count_if(F.col("state") == s).alias(s)
    return proposals.rollup("value").agg(F.count("*").alias("proposed"), *map(state, ("proven", "candidate", "rejected", "ambiguous")))


def counter_report(links: DataFrame, proposals: DataFrame, targets: DataFrame) -> DataFrame:
    """A10: links(proposal_id, counter_id), proposals(proposal_id, owner, state, rule_id), targets(boss_id, band, counter_ids) -> a row a counter and band."""
    per = links.join(proposals, "proposal_id").groupBy("counter_id").agg(F.count("*").alias("proposals"), F.countDistinct("owner").alias("owners"), F.count_if(F.col("state") == "proven").alias("proven"), F.countDistinct("rule_id").alias("rules"))
    need = targets.select("boss_id", "band", F.explode("counter_ids").alias("counter_id")).groupBy("counter_id", "band").agg(F.countDistinct("boss_id").alias("targets"))
    return need.join(per, "counter_id", "left").na.fill(0, ["proposals", "owners", "proven", "rules"])


def graph_readiness(tables: Mapping[str, tuple[DataFrame, str, int]], edges: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(check, n): rows, missing ids and stale versions of tables name -> (df, key, version); rows of parents without children by edge name -> (parents, key, children, key)."""
    parts = []
    for name, (df, key, version) in tables.items():
        wide = df.agg(F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("missing_id"), F.count_if(~F.col("schema_version").eqNullSafe(F.lit(version).cast("string"))).alias("stale_version"))
        parts.append(wide.select(F.explode(F.array(*(F.struct(F.lit(f"{name}:{c}").alias("check"), F.col(c).alias("n")) for c in wide.columns))).alias("x")).select("x.*"))
    for name, (parents, key, children, other) in edges.items():
        lonely = parents.join(children.select(F.col(other).alias(key)).distinct(), key, "left_anti")
        parts.append(lonely.agg(F.count("*").alias("n")).select(F.lit(f"{name}:without_children").alias("check"), "n"))
    return reduce(DataFrame.unionByName, parts)


def receipt_readiness(receipts: DataFrame, names: DataFrame) -> DataFrame:
    """(requested, found, complete, ready) over the asked owners(owner)."""
    out = names.distinct().join(receipts.select("owner", "overall"), "owner", "left")
    out = out.agg(F.countDistinct("owner").alias("requested"), F.count("overall").alias("found"), F.count_if(F.col("overall") == "complete").alias("complete"))
    return out.withColumn("ready", (F.col("requested") == F.col("found")) & (F.col("requested") == F.col("complete")))


def crawl_summary(states: DataFrame) -> DataFrame:
    """states(target_id, state) -> totals, percentages to one digit (0 of nothing)."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    out = states.agg(F.count("*").alias("total"), n("loaded").alias("loaded"), n("failed").alias("failed"), n("pending", "cached", "parsed").alias("pending"))
    pct = lambda c: F.when(F.col("total") == 0, 0.0).otherwise(F.bround(100 * F.col(c) / F.col("total"), 1))
    return out.select("*", *(pct(c).alias(f"{c}_pct") for c in ("loaded", "failed", "pending")))


def fold_corpus(rows: DataFrame, key: str, priority: str, flags: Sequence[str] = ()) -> DataFrame:
    """The row of highest priority a key, its flags OR-ed over all of the key's rows."""
    rest = [c for c in rows.columns if c not in (key, priority, *flags)]
    best = F.max(F.struct(priority, *rest)).alias("b")
    out = rows.groupBy(key).agg(best, *(F.max(F.coalesce(f, F.lit(False))).alias(f) for f in flags))
    return out.select(key, F.col(f"b.{priority}").alias(priority), *(F.col(f"b.{c}").alias(c) for c in rest), *flags)


def usage_summary(calls: DataFrame, budget: int, baseline: int | None = None) -> DataFrame:
    """Per run the tokens (a call's total, or else the sum of its parts), the cost if any call reports one, over_budget and reduction."""
    parts = F.when(F.coalesce("prompt_tokens", "completion_tokens", "reasoning_tokens").isNotNull(), sum((F.coalesce(c, F.lit(0)) for c in ("completion_tokens", "reasoning_tokens")), F.coalesce("prompt_tokens", F.lit(0))))
    out = calls.groupBy("run_id").agg(F.count("*").alias("calls"), F.sum(F.coalesce("total_tokens", parts)).alias("tokens"), F.round(F.sum("cost"), 8).alias("cost"))
    out = out.withColumn("over_budget", F.col("tokens") > budget)
    return out if baseline is None else out.withColumn("reduction", F.bround(1 - F.col("tokens") / baseline, 4))


def classify_runs(runs: DataFrame, calls: DataFrame, home: str = "openrouter") -> DataFrame:
    """(run_id, categories sorted, backend_failure, ready_for_review).

    runs(run_id, failure_type, structure_errors, validation_errors, budget_warning, degraded); calls(run_id, provider, error_code, fallback).
    """
    transport = F.col("error_code").startswith("provider.")
    per = calls.groupBy("run_id").agg(F.max(transport).alias("transport"), F.max(F.col("provider") == home).alias("home"), F.max(F.coalesce("fallback", F.lit(False))).alias("fallback"))
    j = runs.join(per, "run_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.coalesce("failure_type", F.lit(""))
    found = {
        "backend_failure": kind.isin("no_backend_candidates", "backend_failure", "backend_projection_render_failed"),
        "analyzer_structure_failure": F.coalesce("structure_errors", F.lit(0)) > 0,
        "local_validation_failure": F.coalesce("validation_errors", F.lit(0)) > 0,
        "analyzer_refinement_failure": F.coalesce("validation_errors", F.lit(0)) > 0,
        f"{home}_transport_failure": yes("transport") & yes("home"),
        "provider_transport_failure": yes("transport") & ~yes("home"),
        "model_provider_fallback": yes("fallback"),
        "budget_degradation": yes("budget_warning"),
        "readiness_degraded": yes("degraded") | (kind == "analyzer_degraded"),
    }
    names = F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in found.items()))))
    bad = ("backend_failure", f"{home}_transport_failure", "provider_transport_failure")
    out = j.select("run_id", names.alias("categories"))
    return out.withColumns({"backend_failure": F.array_contains("categories", "backend_failure"), "ready_for_review": ~F.arrays_overlap("categories", F.array(*map(F.lit, bad)))})


def suite_summary(cases: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """cases(suite, case_id, passed) -> (suite, expected, observed, passed, failed_ids, ready) for every expected suite."""
    need = cases.sparkSession.createDataFrame(list(expected.items()), "suite string, expected int")
    per = cases.groupBy("suite").agg(F.count("*").alias("observed"), F.count_if("passed").alias("passed"), F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("case_id")))).alias("failed_ids"))
    out = need.join(per, "suite", "left").na.fill(0, ["observed", "passed"])
    return out.withColumn("ready", (F.col("observed") == F.col("expected")) & (F.col("passed") == F.col("expected")))


def stratum_coverage(witnesses: DataFrame, required: Mapping[str, int]) -> DataFrame:
    """witnesses(witness_id, archetypes) -> (archetype, n, required, missing)."""
    need = witnesses.sparkSession.createDataFrame(list(required.items()), "archetype string, required int")
    got = witnesses.select("witness_id", F.explode(F.array_distinct("archetypes")).alias("archetype")).groupBy("archetype").agg(F.count("*").alias("n"))
    out = need.join(got, "archetype", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("missing", F.greatest(F.lit(0), F.col("required") - F.col("n")))


def status_distribution(df: DataFrame, status: str = "status") -> DataFrame:
    """A19."""
    return df.groupBy(status).agg(F.count("*").alias("n"))


def trait_union(owners: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct traits of owners(personalities) and items(personality_req)."""
    a = owners.select(F.explode("personalities").alias("name"))
    return a.unionByName(items.select(F.col("personality_req").alias("name"))).where("name IS NOT NULL AND trim(name) != ''").distinct()


def source_coverage(owners: DataFrame, units: DataFrame, facts: DataFrame, bound: DataFrame) -> DataFrame:
    """Per owner the captured units, parsed facts, bound and unresolved facts."""
    u = units.groupBy("owner").agg(F.count("*").alias("captured"))
    f = facts.join(bound.select("fact_id", F.lit(1).alias("b")), "fact_id", "left").groupBy("owner").agg(F.count("*").alias("parsed"), F.count("b").alias("bound"))
    out = owners.select("owner").distinct().join(u, "owner", "left").join(f, "owner", "left").na.fill(0)
    return out.withColumn("unresolved", F.col("parsed") - F.col("bound"))
