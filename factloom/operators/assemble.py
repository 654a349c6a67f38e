"""Builds, allocation and line-ups under shared limits; every step is a bounded window over one request."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import expr
from factloom.operators import dealt, ranked
from factloom.storage import Scratch

# The roles that each step of a template fills, and the weights of a line-up's score.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "burst": ("primary_damage", "offensive_enablement", "zone_setup", "boss_counter", "reserve_utility", "reserve_utility"),
    "sustain": ("primary_damage", "defense_mitigation", "recovery_protection", "offensive_enablement", "mp_sustain", "reserve_utility"),
    "hybrid": ("primary_damage", "zone_setup", "offensive_enablement", "defense_mitigation", "recovery_protection", "reserve_utility"),
}
WEIGHTS: dict[str, int] = {
    "coverage": 100, "boss_matchup": 18, "setup_completeness": 16, "synergy": 12, "sustain_mitigation": 12, "skill_package_readiness": 10,
    "sidekick_contribution": 8, "reserve_utility": 8, "role_overlap": -2, "item_assumption_burden": -2, "missing_setup": -20, "uncertainty": -4,
}
FRONT = 4
SURVIVAL = ("defense_mitigation", "recovery_protection", "tank_control", "mp_sustain")


def build_packages(choices: DataFrame, slots: Mapping[str, int]) -> DataFrame:
    """choices(owner, slot, item_id, rank, kind) -> (package_id, owner, items, assumptions): the best of each slot, as many as it holds; a generic item is an assumption."""
    n = F.lit(0)
    for s, k in slots.items():
        n = F.when(F.col("slot") == s, k).otherwise(n)
    order = W.partitionBy("owner", "slot").orderBy("rank", "item_id")
    picked = choices.where("kind != 'generic'").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    filled = choices.select("owner", "slot").distinct().join(picked, ["owner", "slot"], "left")
    item = F.coalesce("item_id", F.concat(F.lit("generic:"), "slot"))
    out = filled.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("slot", item.alias("item_id")))).alias("items"), F.sort_array(F.collect_set(F.when(F.col("item_id").isNull(), F.concat(F.lit("generic:"), "slot")))).alias("assumptions"))
    return out.select(expr.stable_id("build", "owner", F.concat_ws(",", F.transform("items", lambda x: x["item_id"]))).alias("package_id"), "owner", "items", "assumptions")


def build_options(choices: DataFrame, slot: str, k: int = 3, width: int = 6, n: int = 6) -> DataFrame:
    """(owner, option, item_ids, score): sets of k items out of the best ``width`` of a slot, the n best by score; the generic option last."""
    c = ranked.top(choices.where((F.col("slot") == slot) & (F.col("kind") != "generic")), ["owner"], ["rank", "item_id"], width, "i").select("owner", "i", "item_id", "score")
    sets = c.select("owner", "i", F.array("item_id").alias("item_ids"), F.col("score").alias("s"))
    for _ in range(k - 1):
        nxt = c.select("owner", F.col("i").alias("j"), F.col("item_id").alias("x"), "score")
        sets = sets.join(nxt, "owner").where("j > i").select("owner", F.col("j").alias("i"), F.concat("item_ids", F.array("x")).alias("item_ids"), (F.col("s") + F.col("score")).alias("s"))
    best = ranked.top(sets, ["owner"], [F.desc("s"), "item_ids"], n, "option").select("owner", "option", "item_ids", F.col("s").alias("score"))
    generic = choices.select("owner").distinct().select("owner", F.lit(n + 1).alias("option"), F.array(F.lit(f"generic:{slot}")).alias("item_ids"), F.lit(0).alias("score"))
    return best.unionByName(generic)


def package_errors(packages: DataFrame, catalog: DataFrame, slots: Mapping[str, int]) -> DataFrame:
    """(package_id, error): unknown items, too many of a slot, items in a foreign slot."""
    e = packages.select("package_id", F.explode("items").alias("x")).select("package_id", "x.slot", "x.item_id").where(~F.col("item_id").startswith("generic:"))
    j = e.join(catalog.select("item_id", F.col("slot").alias("real")), "item_id", "left")
    limit = F.lit(0)
    for s, k in slots.items():
        limit = F.when(F.col("slot") == s, k).otherwise(limit)
    many = e.groupBy("package_id", "slot").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("package_id", F.concat(F.lit("too_many:"), "slot").alias("error"))
    unknown = j.where("real IS NULL").select("package_id", F.concat(F.lit("unknown_item:"), "item_id").alias("error"))
    foreign = j.where("real IS NOT NULL AND real != slot").select("package_id", F.concat(F.lit("foreign_slot:"), "item_id").alias("error"))
    return many.unionByName(unknown).unionByName(foreign)


def limit_violations(lineup_items: DataFrame, limits: DataFrame) -> DataFrame:
    """lineup_items(lineup_id, item_id), limits(item_id, limit; null without one) -> (lineup_id, item_id, used, limit) beyond the limit."""
    used = lineup_items.groupBy("lineup_id", "item_id").agg(F.count("*").alias("used"))
    return used.join(limits, "item_id").where(F.col("used") > F.col("limit")).select("lineup_id", "item_id", "used", "limit")


#: States that the passes over a line-up's row keep at a step; each pass is made where the one before left the line-up open.
STATES = (1, 8, 64)


def allocate(options: DataFrame, limits: DataFrame, owners: int | None = 6, width: int = 256, search_on: bool = True, members: DataFrame | None = None) -> DataFrame:
    """options(lineup_id, owner, option, item_ids) -> (lineup_id, options, exhausted): the first feasible choice of one option an owner.

    With members(lineup_id, owner, kind), a row an owner, options(kind, option, item_ids) are given once a kind. Owners go in order of fewest options, then by id;
    a step an owner, ``owners`` steps at most (None: all). A line-up is one row, over which the least vectors of each step are followed: first one, then, where
    all end and others were left out, more of different use (``STATES``). A vector left out comes after all that were kept, so the least that gets to the
    end is the first of all. Line-ups that this leaves open are searched whole: what can still follow depends only on how many copies of which items are used, so
    of all vectors with the same use the least one stays: one pass finds the first vector of all. Items that no later owner has among the options are
    left out of the use. ``exhausted`` is then false. Without ``search_on`` only the ``width`` smallest vectors of a line-up stay at each step;
    a line-up without one whose vectors were cut off is ``exhausted``, which leaves open whether there is one.
    """
    every = options if members is None else members.join(options, members["kind"].eqNullSafe(options["kind"])).select("lineup_id", "owner", "option", "item_ids")
    if not search_on:
        return _allocate(every, limits, owners, width)
    scratch = Scratch(options.sparkSession, "allocate")
    if members is None:
        rows = _choices(options, limits, ["lineup_id", "owner"])
    else:
        kinds = scratch.save(_choices(options, limits, ["kind"]), "kinds")  # a table of known size
        rows = members.join(kinds, members["kind"].eqNullSafe(kinds["kind"])).select("lineup_id", "owner", "n", "choices")
    found = scratch.save(_followed(rows, owners), "found")
    done, rest = found.where("NOT open").select("lineup_id", "options", "exhausted"), found.where("open").select("lineup_id")
    return done if rest.isEmpty() else done.unionByName(_by_use(every.join(rest, "lineup_id", "left_semi"), limits, owners))


def _choices(options: DataFrame, limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, choices): number of options, and those that fit by themselves: their items with one copy, and those with more copies."""
    items = options.select(*keys, F.col("option").cast("int").alias("option"), F.posexplode_outer("item_ids").alias("p", "item_id")).join(limits.where("limit IS NOT NULL"), "item_id", "left")
    item = F.struct(F.col("item_id").cast("string").alias("item_id"), F.col("limit").cast("int").alias("limit"))
    o = items.groupBy(*keys, "option").agg(F.count_if(F.coalesce("p", F.lit(0)) == 0).alias("n"), F.collect_list(F.when(F.col("limit").isNotNull(), item)).alias("held"))
    need = F.transform(F.array_distinct("held"), lambda x: F.struct(x["item_id"].alias("item_id"), F.size(F.filter("held", lambda y: y == x)).alias("copies"), x["limit"].alias("limit")))
    o = o.withColumn("need", need)
    single = F.transform(F.filter("need", lambda x: x["limit"] == 1), lambda x: x["item_id"])
    choice = F.struct("option", single.alias("single"), F.filter("need", lambda x: x["limit"] > 1).alias("more"))
    fits = F.forall("need", lambda x: x["copies"] <= x["limit"])
    return o.groupBy(*keys).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.when(fits, choice))).alias("choices"))


def _follow(steps: Column, width: int) -> Column:
    """(states, cut): the ``width`` least vectors of different use that get through all steps, and whether others may have been left out."""

    def fits(used: Column, choice: Column) -> Column:
        return ~F.arrays_overlap(used, choice["single"]) & F.forall(choice["more"], lambda x: F.size(used) - F.size(F.array_remove(used, x["item_id"])) + x["copies"] <= x["limit"])

    def grown(state: Column, choice: Column) -> Column:
        used = F.concat(state["used"], choice["single"], F.flatten(F.transform(choice["more"], lambda x: F.array_repeat(x["item_id"], x["copies"]))))
        return F.struct((F.sort_array(used) if width > 1 else used).alias("used"), F.concat(state["vector"], F.array(choice["option"])).alias("vector"))

    def least(states: Column) -> Column:
        of_use = F.transform(F.array(F.sort_array(states)), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["used"] != x["used"])))[0]
        by_vector = F.sort_array(F.transform(of_use, lambda x: F.struct(x["vector"].alias("vector"), x["used"].alias("used"))))
        return F.transform(by_vector, lambda x: F.struct(x["used"].alias("used"), x["vector"].alias("vector")))

    def merge(acc: Column, step: Column) -> Column:
        of = lambda s: F.transform(F.slice(F.filter(step["choices"], lambda c: fits(s["used"], c)), 1, width), lambda c: grown(s, c))
        every = F.flatten(F.transform(acc["states"], of))
        cut = acc["cut"] | (F.size(step["choices"]) > width)
        if width == 1:
            return F.struct(every.alias("states"), cut.alias("cut"))
        return F.transform(F.array(least(every)), lambda x: F.struct(F.slice(x, 1, width).alias("states"), (cut | (F.size(x) > width)).alias("cut")))[0]

    start = F.struct(F.array(F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<int>").alias("vector"))).alias("states"), F.lit(False).alias("cut"))
    return F.aggregate(steps, start, merge)


def _followed(rows: DataFrame, owners: int | None) -> DataFrame:
    """rows(lineup_id, owner, n, choices) -> (lineup_id, options, exhausted, open): the first vector of each line-up, where following the least ones tells it; the others are open."""
    step = F.struct("n", F.col("owner").isNull().alias("nameless"), "owner", "choices")
    steps = F.sort_array(F.collect_list(step))
    rows = rows.groupBy("lineup_id").agg((steps if owners is None else F.slice(steps, 1, owners)).alias("steps"))
    ended = (F.size(F.col("last")["states"]) == 0) & F.col("last")["cut"]
    rows = rows.withColumn("last", _follow(F.col("steps"), STATES[0]))
    for width in STATES[1:]:
        rows = rows.withColumn("last", F.when(ended, _follow(F.col("steps"), width)).otherwise(F.col("last")))
    rows = rows.select("lineup_id", F.transform("steps", lambda s: s["owner"].cast("string")).alias("owners"), F.get(F.col("last")["states"], F.lit(0))["vector"].alias("vector"), ended.alias("open"))
    known = F.col("lineup_id").isNotNull()
    chosen = F.transform("owners", lambda w, i: F.struct(w.alias("owner"), F.get("vector", i).alias("option")))
    return rows.select("lineup_id", F.when(known & F.col("vector").isNotNull(), chosen).alias("options"), F.lit(False).alias("exhausted"), (known & F.col("open")).alias("open"))


_CAPPED = "array<struct<item_id:string,limit:int>>"


def _stepped(options: DataFrame, limits: DataFrame) -> DataFrame:
    """(lineup_id, owner, option, capped, o_step): the limited items of each option, and its owner's step."""
    n = options.groupBy("lineup_id", "owner").agg(F.count("*").alias("n"))
    at = n.withColumn("step", F.row_number().over(W.partitionBy("lineup_id").orderBy("n", F.asc_nulls_last("owner")))).select(F.col("lineup_id").alias("at"), F.col("owner").alias("who"), "step")
    items = options.select("lineup_id", "owner", "option", F.posexplode_outer("item_ids").alias("p", "item_id")).join(limits.where("limit IS NOT NULL"), "item_id", "left")
    o = items.groupBy("lineup_id", "owner", "option").agg(F.sort_array(F.collect_list(F.when(F.col("limit").isNotNull(), F.struct("item_id", "limit")))).cast(_CAPPED).alias("capped"))
    return o.join(at, (F.col("lineup_id") == F.col("at")) & F.col("owner").eqNullSafe(F.col("who"))).select("lineup_id", "owner", "option", "capped", F.col("step").alias("o_step"))


def _steps(stepped: DataFrame) -> int:
    return stepped.agg(F.max("o_step")).first()[0] or 0  # one number


def _by_use(options: DataFrame, limits: DataFrame, owners: int | None) -> DataFrame:
    scratch = Scratch(options.sparkSession, "allocate")
    o = scratch.save(_stepped(options, limits), "options")
    owners = _steps(o) if owners is None else owners
    last = o.select("lineup_id", "o_step", F.explode("capped.item_id").alias("item_id")).groupBy("lineup_id", "item_id").agg(F.max("o_step").alias("last"))
    last = last.groupBy("lineup_id").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "last"))).alias("last"))
    lineups = scratch.save(options.select("lineup_id").distinct().join(last, "lineup_id", "left"), "lineups")
    state = lineups.select("lineup_id", "last", F.array().cast(_CAPPED).alias("used"), F.struct(F.array().cast("array<int>").alias("vector"), F.array().cast("array<struct<owner:string,option:int>>").alias("chosen")).alias("best"))
    for step in range(1, owners + 1):
        j = state.join(o.where(F.col("o_step") == step).drop("o_step"), "lineup_id", "left")
        now = F.concat("used", F.coalesce("capped", F.array().cast(_CAPPED)))
        j = j.withColumn("now", now).where(F.forall("now", lambda x: F.size(F.filter("now", lambda y: y["item_id"] == x["item_id"])) <= x["limit"]))
        picked = F.struct(F.col("owner").cast("string").alias("owner"), F.col("option").cast("int").alias("option"))
        grown = F.struct(F.concat("best.vector", F.array(F.col("option").cast("int"))).alias("vector"), F.concat("best.chosen", F.array(picked)).alias("chosen"))
        open_ = F.array_sort(F.filter("now", lambda x: F.element_at("last", x["item_id"]) > step))
        state = scratch.save(j.select("lineup_id", "last", open_.alias("used"), F.when(F.col("option").isNull(), F.col("best")).otherwise(grown).alias("best")).groupBy("lineup_id", "used").agg(F.min("best").alias("best")).join(lineups, "lineup_id"), f"step{step}")
    best = state.groupBy("lineup_id").agg(F.min("best").alias("b"))
    return lineups.select("lineup_id").join(best, "lineup_id", "left").select("lineup_id", F.col("b.chosen").alias("options"), F.lit(False).alias("exhausted"))


def _allocate(options: DataFrame, limits: DataFrame, owners: int | None, width: int) -> DataFrame:
    o, none = _stepped(options, limits), F.array().cast(_CAPPED)
    owners = _steps(o) if owners is None else owners
    at = o.select("lineup_id", F.col("o_step").alias("step"))
    # Of each line-up one row that isn't live stays to the end and tells whether vectors were cut off.
    start = options.select("lineup_id").distinct().select("lineup_id", F.array().cast("array<struct<owner:string,option:int>>").alias("chosen"), F.array().cast("array<int>").alias("vector"), none.alias("used"), F.lit(False).alias("cut"), F.lit(0).alias("done"))
    state = start.withColumn("live", F.explode(F.array(F.lit(False), F.lit(True))))
    for step in range(1, owners + 1):
        j = state.join(o.where(F.col("o_step") == step).withColumn("live", F.lit(True)), ["lineup_id", "live"], "left")
        used = F.concat("used", F.coalesce("capped", none)).cast(_CAPPED)
        j = j.withColumn("now", used).where(F.forall("now", lambda x: F.size(F.filter("now", lambda y: y["item_id"] == x["item_id"])) <= x["limit"]))
        has = F.col("option").isNotNull()
        picked = F.struct(F.col("owner").cast("string").alias("owner"), F.col("option").cast("int").alias("option"))
        j = j.select("lineup_id", "live", F.when(has, F.concat("chosen", F.array(picked))).otherwise(F.col("chosen")).alias("chosen"), F.when(has, F.concat("vector", F.array(F.col("option").cast("int")))).otherwise(F.col("vector")).alias("vector"), F.col("now").alias("used"), "cut", (F.col("done") + has.cast("int")).alias("done"))
        w = W.partitionBy("lineup_id")
        j = j.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("live", "vector")))
        state = j.where(F.col("_r") <= width + 1).withColumn("cut", F.col("cut") | (F.col("_n") > width + 1)).drop("_n", "_r")
    total = at.groupBy("lineup_id").agg(F.max("step").alias("total"))
    full = F.col("live") & (F.col("done") == F.col("total"))
    best = state.join(total, "lineup_id").groupBy("lineup_id").agg(F.min(F.when(full, F.struct("vector", "chosen"))).alias("b"), F.max("cut").alias("cut"))
    return best.select("lineup_id", F.col("b.chosen").alias("options"), (F.col("b").isNull() & F.col("cut")).alias("exhausted"))


def beam(choices: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, width: int = 50, branching: int = 12) -> DataFrame:
    """choices(request_id, role, entity_id, package_id, score) -> (request_id, archetype, members, packages, score).

    One step a role: every state takes each of the role's ``branching`` best entities that it lacks, and the ``width`` best
    states of a request and archetype stay; ties go to the smaller members. Steps are written to the shared folder.
    """
    spark = choices.sparkSession
    scratch = Scratch(spark, "beam")
    pool = scratch.save(ranked.top(choices, ["request_id", "role"], [F.desc("score"), "entity_id", "package_id"], branching), "pool")
    steps = spark.createDataFrame([(a, i, r) for a, roles in templates.items() for i, r in enumerate(roles)], "archetype string, step int, role string")
    member = "array<struct<entity_id:string,package_id:string>>"
    state = pool.select("request_id").distinct().withColumn("archetype", F.explode(F.array(*map(F.lit, templates)))).select("*", F.array().cast(member).alias("picked"), F.lit(0).cast("long").alias("total"))
    for i in range(max(map(len, templates.values()))):
        role = steps.where(F.col("step") == i).select("archetype", "role")
        j = state.join(role, "archetype").join(pool, ["request_id", "role"])
        e = F.col("entity_id").cast("string")
        j = j.where(~F.exists("picked", lambda p: p["entity_id"] == F.col("entity_id").cast("string")))
        grown = F.concat("picked", F.array(F.struct(e.alias("entity_id"), F.col("package_id").cast("string").alias("package_id"))))
        j = j.select("request_id", "archetype", grown.alias("picked"), (F.col("total") + F.col("score")).cast("long").alias("total"))
        state = scratch.save(ranked.top(j, ["request_id", "archetype"], [F.desc("total"), "picked"], width), f"step{i}")
    return state.select("request_id", "archetype", F.transform("picked", lambda p: p["entity_id"]).alias("members"), F.transform("picked", lambda p: p["package_id"]).alias("packages"), F.col("total").alias("score"))


def sidekick_pairs(entities: DataFrame, n: int = 12) -> DataFrame:
    """entities(request_id, sidekick, base, placement, score) -> the n best (main, sub) of different bases a request.

    The n best of each base, and of these the 2n best of a side, suffice: for any other one, n better ones of another base than
    its partner's come first.
    """
    of_base = ranked.top(entities, ["request_id", "placement", "base"], [F.desc("score"), "sidekick"], n)
    best = ranked.top(of_base, ["request_id", "placement"], [F.desc("score"), "sidekick"], 2 * n)
    side = lambda p: best.where(F.col("placement") == p).select("request_id", F.col("sidekick").alias(p), F.col("base").alias(f"b_{p}"), F.col("score").alias(f"s_{p}"))
    pairs = side("main").join(side("sub"), "request_id").where("b_main != b_sub").withColumn("score", F.col("s_main") + F.col("s_sub"))
    return ranked.top(pairs, ["request_id"], [F.desc("score"), "main", "sub"], n, "rank").select("request_id", "main", "sub", "score", "rank")


#: Roles that one number has a bit for.
_BITS = 60


def _owners(scores: DataFrame) -> tuple[list[str], DataFrame]:
    """The roles with a score, in order, and (request_id, owner, primary, survival, reserve, m0, ...): sums by owner, and a bit a role. One row an owner, so that members aren't multiplied by roles."""
    some, role = scores.where("score > 0"), F.col("role")
    names = sorted(r["role"] for r in some.select("role").where("role IS NOT NULL").distinct().collect())  # roles, a handful
    part = lambda *roles: F.sum(F.when(role.isin(*roles), F.col("score")).otherwise(0))
    masks = [F.bit_or(reduce(lambda c, i: F.when(role == names[i], F.lit(1 << (i - k)).cast("long")).otherwise(c), range(k, min(k + _BITS, len(names))), F.lit(0).cast("long"))).alias(f"m{k // _BITS}") for k in range(0, len(names), _BITS)]
    own = some.groupBy("request_id", "owner").agg(part("primary_damage").alias("primary"), part(*SURVIVAL).alias("survival"), part("reserve_utility", "mp_sustain").alias("reserve"), *masks)
    return names, own


def _has(i: int) -> Column:
    """Whether the role of this place has its bit set."""
    return F.col(f"m{i // _BITS}").bitwiseAND(F.lit(1 << (i % _BITS)).cast("long")) != 0


def coverage_gaps(lineups: DataFrame, scores: DataFrame, required: DataFrame) -> DataFrame:
    """lineups(request_id, lineup_id, members), scores(request_id, owner, role, score), required(request_id, roles) -> (lineup_id, covered, missing)."""
    names, own = _owners(scores)
    masks = [c for c in own.columns if c.startswith("m")]
    m = lineups.select("request_id", "lineup_id", F.explode("members").alias("owner")).join(own.select("request_id", "owner", *masks), ["request_id", "owner"])
    got = m.groupBy("lineup_id").agg(F.count("*").alias("n"), *(F.bit_or(c).alias(c) for c in masks))
    got = got.select("lineup_id", F.array_compact(F.array(*(F.when(_has(i), F.lit(n)) for i, n in enumerate(names)))).cast(expr.STRINGS).alias("covered"))
    none = F.array().cast(expr.STRINGS)
    out = lineups.join(got, "lineup_id", "left").join(required, "request_id", "left").withColumns({"covered": F.coalesce("covered", none), "roles": F.coalesce("roles", none)})
    return out.select("request_id", "lineup_id", "covered", F.sort_array(F.array_except("roles", "covered")).alias("missing"), F.size("roles").alias("n_required"))


def score_lineups(lineups: DataFrame, scores: DataFrame, gaps: DataFrame, extras: DataFrame | None = None, weights: Mapping[str, int] = WEIGHTS, front: int = FRONT) -> DataFrame:
    """Twelve components and their weighted sum, rounded to four digits.

    Role scores by place (front or reserve) are summed over the exploded members; extras(lineup_id, weakness_bonus, setup_needed,
    setup_missing, packages_ready, sidekick_score, assumptions, uncertain) default to 0.
    """
    names, own = _owners(scores)
    masks = [c for c in own.columns if c.startswith("m")]
    in_front = F.col("pos") < front
    m = lineups.select("request_id", "lineup_id", F.posexplode("members").alias("pos", "owner")).join(own, ["request_id", "owner"])
    m = m.select("lineup_id", "owner", "primary", *(F.when(c, F.col(n)).otherwise(0).alias(n) for n, c in (("survival", in_front), ("reserve", ~in_front), *((k, in_front) for k in masks))))
    # By member, with the roles that one in front has; then by line-up. Both by one shuffle.
    each = m.repartition("lineup_id").groupBy("lineup_id", "owner").agg(*(F.sum(c).alias(c) for c in ("primary", "survival", "reserve")), *(F.max(k).alias(k) for k in masks))
    n_roles = sum((F.bit_count(k) for k in masks), F.lit(0))
    per = each.groupBy("lineup_id").agg(*(F.sum(c).alias(c) for c in ("primary", "survival", "reserve")), F.sum(F.greatest(F.lit(0), n_roles - 1)).alias("synergy"), *(F.count_if(_has(i)).alias(f"n{i}") for i in range(len(names))))
    overlap = sum((F.greatest(F.lit(0), F.col(f"n{i}") - 2) for i in range(len(names))), F.lit(0))
    per = per.select("lineup_id", "primary", F.col("survival").alias("sustain"), "reserve", "synergy", overlap.alias("overlap"))
    out = lineups.join(gaps.drop("request_id"), "lineup_id").join(per, "lineup_id", "left")
    names = ("weakness_bonus", "setup_needed", "setup_missing", "packages_ready", "sidekick_score", "assumptions", "uncertain")
    out = out.join(extras, "lineup_id", "left") if extras is not None else out.select("*", *(F.lit(0).alias(n) for n in names))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = {
        "coverage": (F.col("n_required") - F.size("missing")) / F.greatest(F.lit(1), "n_required") * 100,
        "boss_matchup": z("primary") + z("weakness_bonus"),
        "setup_completeness": F.greatest(F.lit(0), z("setup_needed") - z("setup_missing")),
        "synergy": z("synergy"),
        "sustain_mitigation": z("sustain"),
        "skill_package_readiness": z("packages_ready"),
        "sidekick_contribution": z("sidekick_score"),
        "reserve_utility": z("reserve"),
        "role_overlap": z("overlap"),
        "item_assumption_burden": z("assumptions"),
        "missing_setup": z("setup_missing"),
        "uncertainty": z("uncertain"),
    }
    total = sum((c * weights[n] for n, c in parts.items()), F.lit(0.0))
    return out.select(*lineups.columns, "covered", "missing", *(c.cast("double").alias(f"c_{n}") for n, c in parts.items()), F.bround(total.cast("double"), 4).alias("score"))


def dedupe_lineups(lineups: DataFrame, keys: Sequence[str] = ("request_id", "archetype")) -> DataFrame:
    """Of line-ups with the same members (in any order) and covered roles the best."""
    marked = lineups.withColumn("_set", F.sort_array("members"))
    return ranked.top(marked, [*keys, "_set", "covered"], [F.desc("score"), "lineup_id"]).drop("_set")


def diverse(lineups: DataFrame, n: int = 10) -> DataFrame:
    """The best of each archetype, then by score the best of every other set of members, at most n a request, with ``rank``."""
    marked = Scratch(lineups.sparkSession, "diverse").save(lineups.withColumn("_set", F.sort_array("members")), "lineups")  # read three times
    first = ranked.top(marked, ["request_id", "archetype"], [F.desc("score"), "lineup_id"]).withColumn("_tier", F.lit(0))
    rest = ranked.top(marked, ["request_id", "_set"], [F.desc("score"), "lineup_id"]).join(first.select("request_id", "_set").distinct(), ["request_id", "_set"], "left_anti").withColumn("_tier", F.lit(1))
    return ranked.top(first.unionByName(rest), ["request_id"], ["_tier", F.desc("score"), "lineup_id"], n, "rank").drop("_set", "_tier")


def zero_causes(rejections: DataFrame, n: int = 3) -> DataFrame:
    """rejections(request_id, reason), reasons as cause:detail -> the n most frequent causes of each request."""
    per = rejections.groupBy("request_id", F.substring_index("reason", ":", 1).alias("cause")).agg(F.count("*").alias("n"))
    return ranked.top(per, ["request_id"], [F.desc("n"), "cause"], n, "rank")


def package_frontier(packages: DataFrame, rules: Mapping[str, Column], keys: Sequence[str] = ("owner",), n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(the n best packages without a reason against them, reasons with counts)."""
    from factloom.operators import validate

    ok, bad = validate.validate_rows(packages, rules)
    return ranked.top(ok, keys, [F.desc("score"), "package_id"], n, "rank"), bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def legality_errors(slots: DataFrame, rosters: DataFrame, context: DataFrame, size: int = 6) -> DataFrame:
    """(lineup_id, error).

    slots(lineup_id, request_id, pos, owner, weapon, item_weapon, gated_used, awakened), rosters(request_id, owner), context(owner): known owners.
    """
    row = lambda df, e: df.select("lineup_id", F.lit(e).alias("error"), F.col("owner").cast("string").alias("detail"))
    n = slots.groupBy("lineup_id").agg(F.count("*").alias("n"), F.countDistinct("owner").alias("d")).withColumn("owner", F.lit(None).cast("string"))
    parts = [
        row(slots.join(context.select("owner").distinct(), "owner", "left_anti"), "unknown_owner"),
        row(slots.join(rosters.select("request_id", "owner").distinct(), ["request_id", "owner"], "left_anti"), "not_in_roster"),
        row(slots.where("gated_used AND NOT awakened"), "gated_skill"),
        row(slots.where("item_weapon IS NOT NULL AND item_weapon != weapon"), "weapon_mismatch"),
        row(n.where(F.col("n") != size), "size"),
        row(n.where("d < n"), "repeated_owner"),
    ]
    return reduce(DataFrame.unionByName, parts)


def closed_world_errors(proposals: DataFrame, ids: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """proposals(proposal_id, one array of ids a kind) against ids(kind, id): (proposal_id, kind, id) of ids that don't exist."""
    each = reduce(DataFrame.unionByName, (proposals.select("proposal_id", F.lit(k).alias("kind"), F.explode(k).alias("id")) for k in kinds))
    return each.join(ids.select("kind", "id").distinct(), ["kind", "id"], "left_anti").select("proposal_id", "kind", "id")


def allowed_swaps(candidates: DataFrame, pools: DataFrame) -> DataFrame:
    """candidates(request_id, candidate_id, members), pools(request_id, owner) -> (request_id, candidate_id, slot, old, owner) for every other member of the pool, which is short."""
    m = candidates.select("request_id", "candidate_id", "members", F.posexplode("members").alias("slot", "old"))
    j = dealt.join(m, pools.select("request_id", "owner").distinct(), "request_id", "owner")
    return j.where(~F.array_contains("members", F.col("owner"))).select("request_id", "candidate_id", "slot", "old", "owner")


def accept_refinements(candidates: DataFrame, refined: DataFrame) -> DataFrame:
    """candidates(candidate_id, score, n_missing), refined(candidate_id, score, n_missing, members): accepted if neither is worse."""
    r = refined.select("candidate_id", F.col("score").alias("new_score"), F.col("n_missing").alias("new_missing"), F.col("members").alias("new_members"))
    ok = (F.col("new_score") >= F.col("score")) & (F.col("new_missing") <= F.col("n_missing"))
    return candidates.join(r, "candidate_id", "left").withColumn("accepted", F.coalesce(ok, F.lit(False)))


def fit_rubric(texts: DataFrame, keywords: Mapping[str, Sequence[str]], key: str = "lineup_id", text: str = "text") -> DataFrame:
    """One row a line-up with a label for each area, from the number of its keywords in the joined text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    hits = lambda words: sum((t.contains(w).cast("int") for w in words), F.lit(0))
    return texts.select(key, *(expr.hits_label(hits(w)).alias(area) for area, w in keywords.items()))


def affinity_fidelity(reported: DataFrame, stored: DataFrame, key: str = "boss_id", fields: Sequence[str] = ("weak", "resist", "null", "absorb")) -> DataFrame:
    """(key, field, ok): reported sets equal the stored ones, without regard to order and case."""
    norm = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.lower(F.trim(x)))))
    j = reported.join(stored.select(key, *(F.col(f).alias(f"_{f}") for f in fields)), key, "left")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), norm(F.col(f)).eqNullSafe(norm(F.col(f"_{f}"))).alias("ok")) for f in fields)))
    return j.select(key, each.alias("x")).select(key, "x.*")


def warnings(slots: DataFrame, harmful: DataFrame) -> DataFrame:
    """slots(lineup_id, boss_id, pos, capability), harmful(boss_id, capability) -> (lineup_id, warning): effects that help the target, several zones, idle reserve."""
    bad = slots.join(harmful.distinct(), ["boss_id", "capability"]).select("lineup_id", F.concat(F.lit("harmful:"), "capability").alias("warning")).distinct()
    zones = slots.where("capability IN ('deploy_zone', 'awaken_zone')").groupBy("lineup_id").agg(F.countDistinct("pos").alias("n")).where("n > 1").select("lineup_id", F.lit("alternative_zones").alias("warning"))
    idle = slots.groupBy("lineup_id").agg(F.count_if((F.col("pos") >= FRONT) & F.col("capability").isNotNull()).alias("n")).where("n = 0").select("lineup_id", F.lit("idle_reserve").alias("warning"))
    return bad.unionByName(zones).unionByName(idle)


def evidence_diagnostics(selected: DataFrame) -> DataFrame:
    """selected(lineup_id, fact_id, n_evidence) -> facts, evidenced ones and ``complete``, null if any count is unknown."""
    return selected.groupBy("lineup_id").agg(F.count("*").alias("facts"), F.count_if(F.col("n_evidence") > 0).alias("evidenced"), F.when(F.max(F.col("n_evidence").isNull()), None).otherwise(F.min(F.col("n_evidence") > 0)).alias("complete"))
