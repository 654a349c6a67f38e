"""Contextual role scores of entities under a request's target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import expr
from factloom.operators import ranked
from factloom.storage import listed

# Role -> capabilities that count for it.
ROLE_CAPABILITIES: dict[str, tuple[str, ...]] = {
    "primary_damage": ("direct_damage", "fixed_damage", "attack_again", "chain_attack", "follow_up_attack"),
    "offensive_enablement": (
        "outgoing_damage_up", "enemy_resistance_down", "physical_resistance_down",
        "magic_resistance_down", "attack_type_resistance_down", "element_resistance_down",
        "power_up", "intelligence_up", "speed_up", "luck_up", "weakness_multiplier_up",
        "physical_critical_rate_up", "magic_critical_rate_up", "physical_critical_damage_up",
        "magic_critical_damage_up", "equipped_weapon_damage_up", "attack_type_damage_up",
        "element_damage_up", "non_type_damage_up", "grant_mental_focus", "grant_singular_focus",
        "grant_eagle_eyes", "grant_overthrow", "grant_physical_overcritical",
        "grant_magic_overcritical", "inflict_pain", "inflict_poison", "inflict_break",
        "apply_kaleido", "grant_link", "grant_copy", "activate_lunatic",
    ),
    "zone_setup": ("deploy_zone", "awaken_zone"),
    "defense_mitigation": ("damage_reduction", "damage_reduction_barrier", "shield", "ally_resistance_up", "hold_ground", "dodge"),
    "recovery_protection": ("heal_hp", "regen_hp", "revive", "remove_status_ailment", "remove_debuff", "grant_status_immunity", "knockback_immunity"),
    "tank_control": ("taunt", "cover", "guard", "stalk", "hold_ground", "dodge"),
    "af_support": ("af_gauge_restore", "af_gauge_gain_up", "af_combo_gain_up", "af_damage_up"),
    "mp_sustain": ("recover_mp",),
    "boss_counter": (
        "remove_status_ailment", "remove_debuff", "grant_status_immunity", "knockback_immunity",
        "damage_reduction", "damage_reduction_barrier", "shield", "ally_resistance_up",
        "recover_mp", "barrier_pierce", "ignore_target_defense", "invert_weakness_resistance",
    ),
    "reserve_utility": ("recover_mp", "af_gauge_restore", "af_gauge_gain_up", "grant_status_immunity", "heal_hp", "regen_hp"),
}
# Profile -> weight of each role.
PROFILES: dict[str, dict[str, int]] = {
    "balanced": {
        "primary_damage": 4, "offensive_enablement": 3, "zone_setup": 2, "defense_mitigation": 2, "recovery_protection": 2,
        "tank_control": 1, "af_support": 2, "mp_sustain": 2, "boss_counter": 5, "reserve_utility": 1,
    },
    "offensive": {
        "primary_damage": 7, "offensive_enablement": 6, "zone_setup": 3, "af_support": 3, "boss_counter": 4,
        "defense_mitigation": 1, "recovery_protection": 1,
    },
    "sustain": {
        "primary_damage": 3, "offensive_enablement": 2, "defense_mitigation": 6, "recovery_protection": 6, "tank_control": 4,
        "mp_sustain": 5, "boss_counter": 5,
    },
    "counter": {
        "primary_damage": 2, "offensive_enablement": 2, "zone_setup": 4, "defense_mitigation": 4, "recovery_protection": 4,
        "tank_control": 3, "af_support": 2, "mp_sustain": 3, "boss_counter": 12,
    },
}
ELEMENTS = ("fire", "water", "wind", "earth", "thunder", "shade", "crystal", "non-type")
ATTACKS = ("slash", "pierce", "blunt", "magic")


def role_map(spark, roles: Mapping[str, Sequence[str]] = ROLE_CAPABILITIES) -> DataFrame:
    return listed(spark, [(r, c) for r, cs in roles.items() for c in cs], "role string, capability string")


def profile_table(spark, profiles: Mapping[str, Mapping[str, int]] = PROFILES) -> DataFrame:
    return listed(spark, [(p, r, w) for p, rs in profiles.items() for r, w in rs.items()], "profile string, role string, weight int")


def required_counters(targets: DataFrame, references: DataFrame, tag_counters: Mapping[str, str], vocabulary: Sequence[str]) -> DataFrame:
    """targets(boss_id, mechanic_tags, needs) and references(boss_id, applies_to) -> (boss_id, counters) within the vocabulary."""
    mapped = F.array_compact(F.array(*(F.when(F.array_contains("mechanic_tags", t), F.lit(c)) for t, c in tag_counters.items())))
    ref = references.select("boss_id", F.explode("applies_to").alias("c")).groupBy("boss_id").agg(F.collect_set("c").alias("r"))
    none = F.array().cast(expr.STRINGS)
    every = F.array_union(F.array_union(F.coalesce("needs", none), mapped), F.coalesce("r", none))
    return targets.join(ref, "boss_id", "left").select("boss_id", F.sort_array(F.array_intersect(every, F.array(*map(F.lit, vocabulary)))).alias("counters"))


def affinity_state(weak: Column, resist: Column, null: Column, absorb: Column) -> Column:
    """Unknown while any of the four is unknown, incomplete while one is missing, none if all are confirmed empty, else available."""
    fields = (weak, resist, null, absorb)
    kinds = F.array(*(expr.value_state(f) for f in fields))
    missing = F.exists(F.array(*(f.isNull() for f in fields)), lambda x: x)
    out = F.when(missing, "incomplete").when(F.array_contains(kinds, "unknown"), "unknown").when(F.forall(kinds, lambda k: k == "confirmed_empty"), "none")
    return out.otherwise("available")


def matchup(elements: Column, attacks: Column, weak: Column, resist: Column, null: Column, absorb: Column) -> Column:
    """Unknown, blocked, resisted, weak or neutral; conflicting or missing evidence is unknown."""
    low = lambda a: F.array_distinct(F.transform(a, lambda x: F.lower(F.trim(x))))
    e, a, w, r = low(elements), low(attacks), low(weak), low(resist)
    blocked = F.array_union(low(null), low(absorb))
    known = F.array_union(F.array_union(w, r), blocked)
    hit = F.array_union(e, a)
    names = lambda x: F.array(*map(F.lit, x))
    unknown = (
        affinity_state(weak, resist, null, absorb).isin("unknown", "incomplete")
        | (F.size(e) > 1)
        | (F.size(a) > 1)
        | ((F.size(e) == 0) & F.arrays_overlap(known, names(ELEMENTS)))
        | ((F.size(a) == 0) & F.arrays_overlap(known, names(ATTACKS)))
        | (F.size(hit) == 0)
        | (F.arrays_overlap(hit, w) & (F.arrays_overlap(hit, r) | F.arrays_overlap(hit, blocked)))
    )
    return F.when(F.coalesce(unknown, F.lit(True)), "unknown").when(F.arrays_overlap(hit, blocked), "blocked").when(F.arrays_overlap(hit, r), "resisted").when(F.arrays_overlap(hit, w), "weak").otherwise("neutral")


def matchups(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """facts(request_id, boss_id, fact_id, elements, attacks) x targets(boss_id, weak, resist, null, absorb) -> (request_id, fact_id, state)."""
    state = matchup(*(F.col(c) for c in ("elements", "attacks", "weak", "resist", "null", "absorb")))
    return facts.join(targets, "boss_id").select("request_id", "fact_id", state.alias("state"))


def _own_roles(facts: DataFrame, roles: DataFrame, counters: DataFrame | None, usable_bonus: int, counter_bonus: int) -> DataFrame:
    """The roles of facts that have one row each, told row by row: no grouping."""
    none = F.array().cast(expr.STRINGS)
    of = roles.where("capability IS NOT NULL AND role IS NOT NULL").groupBy("capability").agg(F.collect_list("role").alias("roles"))
    of = of.agg(F.map_from_entries(F.collect_list(F.struct("capability", "roles"))).alias("of"))  # one row: the short list of roles
    c = facts.select("request_id", "owner", "fact_id", "matchup", F.array_distinct("capabilities").alias("caps")).crossJoin(F.broadcast(of))
    filled = lambda caps: F.flatten(F.transform(caps, lambda x: F.coalesce(F.element_at("of", x), none)))
    countered = none
    if counters is not None:
        asked = counters.groupBy("request_id").agg(F.collect_set("capability").alias("asked"))
        c = c.join(asked, "request_id", "left")
        countered = F.filter("caps", lambda x: F.array_contains(F.coalesce("asked", none), x))
    c = c.select("request_id", "owner", "fact_id", "matchup", filled("caps").alias("found"), filled(countered).alias("countered"))
    c = c.select("*", F.explode(F.array_distinct("found")).alias("role"))
    times = lambda roles_: F.size(F.filter(roles_, lambda x: x == F.col("role")))
    bonus = F.when(F.col("role") == "boss_counter", times("countered") * counter_bonus).otherwise(0)
    usable = F.when((F.col("role") == "primary_damage") & F.col("matchup").isin("weak", "neutral"), usable_bonus).otherwise(0)
    return c.select("request_id", "owner", "fact_id", "role", (times("found") + bonus + usable).cast("int").alias("score"))


def fact_roles(facts: DataFrame, roles: DataFrame, counters: DataFrame | None = None, usable_bonus: int = 2, counter_bonus: int = 2, unique: bool = False) -> DataFrame:
    """facts(request_id, owner, fact_id, capabilities, matchup) -> (request_id, owner, fact_id, role, score): matched capabilities of a role,
    plus a bonus for primary damage that is weak or neutral against the target, and one for each required counter(request_id, capability).

    ``unique`` says that a fact has one row a request and owner; else its rows are added up.
    """
    if unique:
        return _own_roles(facts, roles, counters, usable_bonus, counter_bonus)
    c = facts.select("request_id", "owner", "fact_id", "matchup", F.explode(F.array_distinct("capabilities")).alias("capability"))
    out = c.join(roles, "capability")
    if counters is not None:
        out = out.join(counters.select("request_id", "capability", F.lit(counter_bonus).alias("b")).distinct(), ["request_id", "capability"], "left")
        extra = F.when(F.col("role") == "boss_counter", F.coalesce("b", F.lit(0))).otherwise(0)
    else:
        extra = F.lit(0)
    per = out.groupBy("request_id", "owner", "fact_id", "role").agg(F.count("*").alias("n"), F.sum(extra).alias("x"), F.max("matchup").alias("m"))
    usable = F.when((F.col("role") == "primary_damage") & F.col("m").isin("weak", "neutral"), usable_bonus).otherwise(0)
    return per.select("request_id", "owner", "fact_id", "role", (F.col("n") + F.col("x") + usable).cast("int").alias("score"))


def role_scores(per_fact: DataFrame) -> DataFrame:
    """(request_id, owner, role, score) summed over facts."""
    return per_fact.groupBy("request_id", "owner", "role").agg(F.sum("score").cast("int").alias("score"))


def role_struct(scores: DataFrame, roles: Sequence[str] = tuple(ROLE_CAPABILITIES)) -> DataFrame:
    """The scores of all roles as one struct an owner; 0 without evidence."""
    wide = scores.groupBy("request_id", "owner").agg(*(F.coalesce(F.sum(F.when(F.col("role") == r, F.col("score"))), F.lit(0)).cast("int").alias(r) for r in roles))
    return wide.select("request_id", "owner", F.struct(*roles).alias("scores"))


def role_evidence(facts: DataFrame, roles: DataFrame) -> DataFrame:
    """(request_id, owner, role, fact_id, capability): what each score rests on."""
    return facts.select("request_id", "owner", "fact_id", F.explode(F.array_distinct("capabilities")).alias("capability")).join(roles, "capability").select("request_id", "owner", "role", "fact_id", "capability")


def slot_limit(points: Column | str, threshold: int = 80) -> Column:
    """Three, or four from the threshold on."""
    return F.when(F.coalesce(expr.col(points), F.lit(0)) >= threshold, 4).otherwise(3)


def skill_packages(per_fact: DataFrame, families: DataFrame, profiles: DataFrame, limits: DataFrame, least: int = 3) -> DataFrame:
    """Per (request, owner, profile) the best families, as many as the owner's slots; none for owners with fewer than ``least``.

    The profile's score is a sum over facts, so the best set is the set of the best. families(fact_id, family_id, bonus) names each
    fact's family; limits(request_id, owner, slots). Ties go to the larger family id.
    """
    # Facts meet their families once: the roles' scores of each family, and its bonus.
    f = per_fact.join(families, "fact_id").groupBy("request_id", "owner", "family_id", "role").agg(F.sum("score").alias("score"), F.max("bonus").alias("bonus"))
    scored = F.map_from_entries(F.collect_list(F.when(F.col("role").isNotNull(), F.struct("role", "score")))).alias("scores")
    f = f.groupBy("request_id", "owner", "family_id").agg(scored, F.max("bonus").alias("bonus"))
    f = f.withColumn("n", F.count("*").over(W.partitionBy("request_id", "owner")))
    listed = profiles.groupBy("profile").agg(F.collect_list(F.struct("role", "weight")).alias("weights")).agg(F.collect_list(F.struct("profile", "weights")).alias("p"))  # one row: the handful of profiles
    f = f.where(F.col("n") >= least).crossJoin(F.broadcast(listed)).withColumn("x", F.explode("p"))
    kind = "long" if per_fact.schema["score"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "double"
    s = F.aggregate("x.weights", F.lit(0).cast(kind), lambda t, w: (t + F.coalesce(F.element_at("scores", w["role"]), F.lit(0)) * w["weight"]).cast(kind))
    own = f.select("request_id", "owner", F.col("x.profile").alias("profile"), "family_id", (s + F.col("bonus")).alias("s"))
    w = W.partitionBy("request_id", "owner", "profile").orderBy(F.desc("s"), F.desc("family_id"))
    picked = own.withColumn("r", F.row_number().over(w)).join(limits, ["request_id", "owner"]).where(F.col("r") <= F.col("slots"))
    return picked.groupBy("request_id", "owner", "profile").agg(F.sort_array(F.collect_list("family_id")).alias("family_ids"), F.sum("s").alias("score"))


def pareto(packages: DataFrame, measures: Sequence[str], n: int = 3, keys: Sequence[str] = ("request_id", "owner"), profile_order: Sequence[str] = tuple(PROFILES)) -> DataFrame:
    """Equal family sets collapse to their first profile, dominated ones go, the best n by score stay.

    An owner has at most one package a profile, so comparing those of an owner is a handful.
    """
    at = F.array_position(F.array(*map(F.lit, profile_order)), F.col("profile"))
    one = ranked.top(packages.withColumn("_at", at), [*keys, "family_ids"], ["_at"])
    b = one.select(*keys, F.col("_at").alias("_b"), *(F.col(m).alias(f"_{m}") for m in measures))
    ge, gt = F.lit(True), F.lit(False)
    for m in measures:
        ge, gt = ge & (F.col(f"_{m}") >= F.col(m)), gt | (F.col(f"_{m}") > F.col(m))
    beaten = one.join(b, list(keys)).where((F.col("_b") != F.col("_at")) & ge & gt).select(*keys, "_at").distinct()
    front = one.join(beaten, [*keys, "_at"], "left_anti")
    return ranked.top(front, keys, [F.desc("score"), "_at"], n, "rank").drop("_at")


def contextual_score(scores: Column | str, weights: Mapping[str, int]) -> Column:
    """Weighted sum over a struct of role scores."""
    c = F.col(scores) if isinstance(scores, str) else scores
    return sum((F.coalesce(c[r], F.lit(0)) * w for r, w in weights.items()), F.lit(0))


def sidekick_entities(sidekicks: DataFrame, facts: DataFrame) -> DataFrame:
    """Each sidekick as main and as sub, with the facts available there: charge skills and auras as main, auras as sub."""
    both = sidekicks.select("sidekick", F.explode(F.array(F.lit("main"), F.lit("sub"))).alias("placement"))
    ok = (F.col("placement") == "main") | (F.col("kind") == "aura")
    return both.join(facts, "sidekick", "left").groupBy("sidekick", "placement").agg(F.sort_array(F.collect_set(F.when(ok, F.col("fact_id")))).alias("fact_ids"))
