"""Ranked picks: windows with a final tie-break by id, so that reruns and partitionings agree. Set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import expr


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows a key; Spark plans a group limit before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


SLOT_ORDER = ("active_equipable", "basic_attack_replacement", "ordinary_basic_attack", "not_equipable")


def richest_row(facts: DataFrame, key: str = "fact_id", text: str = "description") -> DataFrame:
    """Of a fact's rows the one with the best slot, then not gated, then the longest text, then its order."""
    slot = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SLOT_ORDER)), F.col("slot_eligibility")), F.lit(0)), F.lit(99))
    return top(facts, [key], [slot, F.coalesce("gated", F.lit(False)), F.length(text).desc_nulls_last(), F.col(text).asc_nulls_last()])


def best_per_family(facts: DataFrame, keys: Sequence[str] = ("owner", "family_id")) -> DataFrame:
    """Of a family the row with the highest upgrade rank, then most proven capabilities, then the first id."""
    return top(facts, keys, [F.desc_nulls_last("upgrade_rank"), F.desc_nulls_last("proven_count"), "fact_id"])


def shortlists(fact_roles: DataFrame, n: int = 6) -> DataFrame:
    """fact_roles(owner, role, fact_id, score) -> the best n facts of each owner and role, with ``rank``."""
    return top(fact_roles, ["owner", "role"], [F.desc("score"), "fact_id"], n, "rank")


def role_pools(scores: DataFrame, covers: DataFrame, n: int = 8, extra: int = 4) -> DataFrame:
    """scores(request_id, role, entity_id, score) -> the n best of a role, and up to ``extra`` of the rest that cover a required counter.

    covers(request_id, entity_id) lists entities that cover one. ``via`` is rank or counter.
    """
    order = W.partitionBy("request_id", "role").orderBy(F.desc("score"), "entity_id")
    ranked = scores.where("score > 0").withColumn("rank", F.row_number().over(order))
    best = ranked.where(F.col("rank") <= n).withColumn("via", F.lit("rank"))
    rest = ranked.where(F.col("rank") > n).join(covers.distinct(), ["request_id", "entity_id"], "left_semi")
    return best.unionByName(top(rest, ["request_id", "role"], ["rank"], extra).withColumn("via", F.lit("counter")))


def topk_references(requests: DataFrame, references: DataFrame, k: int = 8) -> DataFrame:
    """requests(request_id, tags, types) x references(id, tags, mechanic_type): shared tags, plus one for the type; the best k with a hit.

    References with the same tags and type are a class, of which the k smallest ids suffice. Requests and classes meet on a shared tag or type, not each with each.
    """
    none = F.array().cast(expr.STRINGS)
    kind = lambda c: F.concat(F.lit("type:"), c)
    tags = F.array_compact(F.concat(F.coalesce(F.array_distinct("tags"), none), F.array(kind("mechanic_type"))))
    of = references.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list(tags))).alias("c"))
    few = top(of, ["c"], ["id"], k)
    ask = requests.select("request_id", F.explode(F.array_distinct(F.concat("tags", F.transform("types", kind)))).alias("t"))
    met = ask.join(few.select("c").distinct().withColumn("t", F.explode("c")), "t").groupBy("request_id", "c").agg(F.count("*").alias("hits"))
    hits = met.join(few, "c").select("request_id", "id", "hits")
    return top(hits, ["request_id"], [F.desc("hits"), "id"], k, "rank")


def review_queues(proposals: DataFrame, bands: DataFrame, cap: int, recurring: int = 5) -> DataFrame:
    """(queue, proposal_id, rank): P0 band, ambiguous, recurring rule, required counter; each queue at most ``cap``.

    proposals(proposal_id, rule_id, value, state); bands(value, band, required). A proposal stands in the first queue that takes it.
    """
    n = F.count("*").over(W.partitionBy("rule_id"))
    b = bands.groupBy("value").agg(F.min("band").alias("band"), F.max("required").alias("required"))
    p = proposals.withColumn("n_rule", n).join(b, "value", "left").where(F.col("state").isin("candidate", "ambiguous"))
    queue = F.when(F.col("band") == "P0", "p0").when(F.col("state") == "ambiguous", "ambiguous").when(F.col("n_rule") >= recurring, "recurring_rule").when(F.coalesce("required", F.lit(False)), "required_counter")
    p = p.withColumn("queue", queue).where("queue IS NOT NULL")
    return top(p, ["queue"], [F.desc("n_rule"), "proposal_id"], cap, "rank").select("queue", "proposal_id", "rank")


def stratified_sample(proposals: DataFrame, reviewed: DataFrame, n: int, seed: str) -> DataFrame:
    """Exactly n (or all) unreviewed proposals, value by value in turn, in hash order within a value."""
    rest = proposals.join(reviewed.select("proposal_id").distinct(), "proposal_id", "left_anti")
    h = F.sha2(F.concat(F.lit(seed), F.col("proposal_id")), 256)
    turn = F.row_number().over(W.partitionBy("value").orderBy(h, "proposal_id"))
    few = rest.withColumn("turn", turn).where(F.col("turn") <= n)
    return few.orderBy("turn", "value").limit(n)


def seed_coverage(proposals: DataFrame, active: DataFrame) -> DataFrame:
    """active(value, family) -> (value, proposal_id, cross_id, missing): the first proposal of each value and the first of another value of the family."""
    first = proposals.groupBy("value").agg(F.min("proposal_id").alias("proposal_id"))
    known = active.join(first, "value", "left")
    heads = top(known.where("proposal_id IS NOT NULL"), ["family"], ["proposal_id", "value"], 2, "r").groupBy("family").agg(F.max(F.when(F.col("r") == 1, F.col("proposal_id"))).alias("h1"), F.max(F.when(F.col("r") == 2, F.col("proposal_id"))).alias("h2"))
    cross = F.when(F.col("h1") != F.col("proposal_id"), F.col("h1")).otherwise(F.col("h2"))
    return known.join(heads, "family", "left").select("value", "proposal_id", F.when(F.col("proposal_id").isNotNull(), cross).alias("cross_id"), F.col("proposal_id").isNull().alias("missing"))


def refill(batch: DataFrame, seeds: DataFrame, proposals: DataFrame, n: int) -> DataFrame:
    """Reviewed rows of the batch(proposal_id, reviewed) stay; seeds, then other proposals by id, fill up to n."""
    kept = batch.where("reviewed").select("proposal_id", F.lit(0).alias("origin"))
    new = seeds.select("proposal_id", F.lit(1).alias("origin")).unionByName(proposals.select("proposal_id", F.lit(2).alias("origin")))
    once = kept.unionByName(new).groupBy("proposal_id").agg(F.min("origin").alias("origin"))
    return once.orderBy("origin", "proposal_id").limit(n)


def item_choices(compatible: DataFrame, n: int = 8) -> DataFrame:
    """compatible(owner, slot, item_id, score) -> the best as ``choice``, up to n more as ``alternative``, and a generic row a slot."""
    ranked = top(compatible, ["owner", "slot"], [F.desc("score"), "item_id"], n + 1, "rank")
    out = ranked.select("owner", "slot", "item_id", "rank", F.when(F.col("rank") == 1, "choice").otherwise("alternative").alias("kind"))
    generic = compatible.select("owner", "slot").distinct().select("owner", "slot", F.concat(F.lit("generic:"), "slot").alias("item_id"), F.lit(99).alias("rank"), F.lit("generic").alias("kind"))
    return out.unionByName(generic)


def stable_order(df: DataFrame, keys: Sequence[Column | str], id_col: str) -> DataFrame:
    """W11."""
    return df.orderBy(*keys, id_col)


def skill_options(facts: DataFrame, packages: DataFrame, n: int = 6) -> DataFrame:
    """facts(owner, fact_id, score, legal): those of the owner's package(owner, fact_id) first, then by score; legal ones only."""
    inside = packages.select("owner", "fact_id").distinct().withColumn("in_package", F.lit(1))
    marked = facts.where("legal").join(inside, ["owner", "fact_id"], "left").withColumn("in_package", F.coalesce("in_package", F.lit(0)))
    return top(marked, ["owner"], [F.desc("in_package"), F.desc("score"), "fact_id"], n, "rank")


def augment(roster: DataFrame, additions: DataFrame, key: str = "request_id") -> DataFrame:
    """roster(request_id, name, position) and permanent additions(name, position), the first of each name, in order."""
    listed = additions.agg(F.sort_array(F.collect_list(F.struct("position", "name"))).alias("a"))  # one row: a short fixed list
    more = roster.select(key).distinct().crossJoin(F.broadcast(listed)).select(key, F.explode("a").alias("x")).select(key, "x.name", "x.position")
    both = roster.select(key, "name", "position", F.lit(0).alias("origin")).unionByName(more.withColumn("origin", F.lit(1)))
    first = both.groupBy(key, F.lower("name").alias("k")).agg(F.min(F.struct("origin", "position", "name")).alias("f"))
    at = F.row_number().over(W.partitionBy(key).orderBy("f.origin", "f.position", "f.name"))
    return first.select(key, F.col("f.name").alias("name"), at.alias("position"))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of what only one side has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def cap_intersect(a: Column | str, b: Column | str) -> Column:
    """U03."""
    return F.sort_array(F.array_intersect(expr.col(a), expr.col(b)))


def cap_except(a: Column | str, b: Column | str) -> Column:
    return F.sort_array(F.array_except(expr.col(a), expr.col(b)))


def union_facts(**tables: DataFrame) -> DataFrame:
    """Tables by record type as one stream of records; columns that a table lacks are null."""
    out = None
    for kind, df in tables.items():
        df = df.withColumn("record_type", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
