"""Column expressions that the operators are built from. Columns in, a Column out; nulls stay unknown unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEP = "\u001f"

# Fixed values: (tag, pattern) pairs in order.
EFFECT_TAGS: tuple[tuple[str, str], ...] = (
    ("element:fire", r"\bfire\b"),
    ("element:water", r"\bwater\b"),
    ("element:wind", r"\bwind\b"),
    ("element:earth", r"\bearth\b"),
    ("element:thunder", r"\bthunder\b"),
    ("element:shade", r"\bshade\b|\bdark\b"),
    ("element:crystal", r"\bcrystal\b"),
    ("element:null", r"\bnull\b"),
    ("attack:slash", r"\bslash\b|katana|sword|blade"),
    ("attack:pierce", r"\bpierce\b|bow|spear"),
    ("attack:blunt", r"\bblunt\b|hammer|fist"),
    ("attack:magic", r"\bmagic\b|staff|tome"),
    ("status:pain", r"\bpain\b"),
    ("status:poison", r"\bpoison\b"),
    ("status:stun", r"\bstun\b"),
    ("status:sleep", r"\bsleep\b"),
    ("combat:critical", r"\bcritical\b|\bcrit\b"),
    ("combat:af", r"\baf\b|another force"),
    ("combat:zone", r"\bzone\b|stance"),
    ("combat:damage", r"\bdamage\b|\bdmg\b"),
    ("combat:heal", r"\bheal\b|restore hp|hp recovery"),
    ("combat:mp", r"\bmp\b"),
    ("combat:barrier", r"\bbarrier\b|shield"),
    ("stat:hp", r"\bhp\b"),
    ("stat:mp", r"\bmp\b"),
    ("stat:pwr", r"\bpwr\b|\bpower\b|\batk\b"),
    ("stat:int", r"\bint\b|intelligence"),
    ("stat:spd", r"\bspd\b|\bspeed\b"),
    ("stat:end", r"\bend\b|endurance"),
    ("stat:spr", r"\bspr\b|spirit"),
    ("stat:luck", r"\bluck\b"),
    ("resistance:type", r"type resistance|all type res"),
    ("resistance:physical", r"physical resistance"),
    ("resistance:magic", r"magic resistance"),
)
# Mechanic tag -> words of the text that tell it.
MECHANIC_NEEDLES: dict[str, tuple[str, ...]] = {
    "af seal": ("af seal", "another force seal", "af sealed"),
    "barrier": ("barrier",),
    "buff/debuff reset": ("buff debuff reset", "buff/debuff reset", "buff and debuff reset"),
    "companion summon": ("summon companion", "summon companions", "summons companion", "summons companions", "companion summon"),
    "fixed damage": ("fixed damage", "percentage damage"),
    "high firepower": ("high firepower", "high damage"),
    "hp stopper": ("stopper",),
    "long battle": ("long battle", "endurance battle"),
    "resistance change": ("resistance change", "weakness change"),
    "status ailment": ("status ailment", "status abnormal", "poison", "stun", "seal"),
}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(T.StringType())
def _nfkc_casefold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip().casefold())


def folded(x: Column | str, unicode: bool = False) -> Column:
    """Trimmed and lower-cased; with ``unicode`` compatibility-normalized and case-folded (a pandas UDF)."""
    c = F.coalesce(col(x).cast("string"), F.lit(""))
    return _nfkc_casefold(c) if unicode else F.lower(F.trim(c))


def stable_id(prefix: str, *parts: Column | str, unicode: bool = False) -> Column:
    """Prefix and 20 hex digits of SHA-256 over the folded parts; null counts as empty."""
    joined = F.concat_ws(SEP, *(folded(p, unicode) for p in parts))
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(joined, 256), 1, 20))


def family_name(name: Column | str) -> Column:
    """Spaces collapsed, a trailing plus and then an awakening suffix removed."""
    out = F.regexp_replace(folded(name), r"\s+", " ")
    out = F.regexp_replace(out, r"\s*(?:\+|＋)$", "")
    return F.regexp_replace(out, r"\s+\((?:sa|stellar awakened|stellar burst)\)$", "")


def family_id(owner: Column | str, name: Column | str) -> Column:
    return stable_id("skill_family", owner, family_name(name))


def dedupe(values: Column | str) -> Column:
    """Without nulls, empties and repeats; the first of each stays."""
    return F.array_distinct(F.filter(col(values), lambda x: x.isNotNull() & (x != "")))


def aliases(name: Column | str) -> Column:
    """The name; of "Base (X), Style" also base, style and "Base X"."""
    n = col(name)
    base = F.trim(F.regexp_extract(n, r"^([^,]*),", 1))
    style = F.trim(F.regexp_extract(n, r"^[^,]*,(.*)$", 1))
    inner = F.regexp_extract(base, r"^(.*?)\s*\(([^)]+)\)$", 1)
    paren = F.regexp_extract(base, r"^(.*?)\s*\(([^)]+)\)$", 2)
    more = F.array(n, base, style, F.when(paren != "", F.concat_ws(" ", inner, paren)))
    return F.when(n.contains(","), dedupe(more)).otherwise(dedupe(F.array(n)))


def slot_eligibility(name: Column | str, section: Column | str, kind: Column | str, text: Column | str) -> Column:
    """Four classes, the first rule that holds."""
    s, k, t = (F.lower(F.coalesce(col(x), F.lit(""))) for x in (section, kind, text))
    no = F.lit("not_equipable")
    return (
        F.when(s.contains("passive") | (k == "passive"), no)
        .when(s.contains("valor chant") | t.contains("valor chant"), no)
        .when(family_name(name) == "another zone", no)
        .when(s.contains("basic attack replacement") | t.contains("replaces basic attack"), F.lit("basic_attack_replacement"))
        .when(F.ltrim(t).startswith("basic attack:") | F.ltrim(t).startswith("basic attack "), F.lit("ordinary_basic_attack"))
        .otherwise(F.lit("active_equipable"))
    )


def to_int(text: Column | str) -> Column:
    """The first integer of the text, thousands commas dropped; NULL without one."""
    return F.nullif(F.regexp_extract(F.replace(col(text).cast("string"), F.lit(",")), r"(-?\d+)", 1), F.lit("")).try_cast("int")


def abs_int(text: Column | str) -> Column:
    return F.abs(to_int(text))


def to_float(text: Column | str) -> Column:
    """A number or the number of a percentage; NULL for anything else."""
    t = F.trim(F.replace(F.replace(col(text).cast("string"), F.lit(",")), F.lit("%")))
    return F.when(t.rlike(r"^[-+]?\d+(\.\d+)?$"), t).try_cast("double")


def truthy(text: Column | str, extra_words: Sequence[str] = ()) -> Column:
    """False for NULL and unknown words."""
    return F.coalesce(F.lower(F.trim(col(text).cast("string"))).isin("true", "1", "yes", "y", *extra_words), F.lit(False))


def split_list(text: Column | str, pattern: str = r"[,;/|]", empty: Sequence[str] = ("", "none", "n/a", "-")) -> Column:
    """Trimmed pieces without placeholders; NULL gives an empty list."""
    pieces = F.transform(F.split(F.coalesce(col(text), F.lit("")), pattern), lambda x: F.trim(x))
    return F.array_distinct(F.filter(pieces, lambda x: ~F.lower(x).isin(*empty)))


def override(df: DataFrame, table: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from ``table(key, column)`` where it has the key, else as it was. One row a key in ``table``."""
    new = table.select(F.col(key), F.col(column).alias("_new"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def display_label(name: Column | str, *discriminators: Column | str) -> Column:
    """P10: the name and its first non-empty discriminator."""
    first = F.coalesce(*(F.nullif(F.trim(col(d).cast("string")), F.lit("")) for d in discriminators))
    return F.concat(col(name), F.coalesce(F.concat(F.lit(" ("), first, F.lit(")")), F.lit("")))


def effect_tags(text: Column | str, patterns: Sequence[tuple[str, str]] = EFFECT_TAGS, prefixes: Column | None = None) -> Column:
    """Tags of the patterns that occur, in the table's order after the prefixes."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    found = F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(tag)) for tag, p in patterns)))
    return dedupe(found if prefixes is None else F.concat(prefixes, found))


def acquisition(text: Column | str, tier: Column | str) -> Column:
    """struct(class, cap)."""
    t = F.coalesce(col(text), F.lit(""))
    count = F.nullif(F.regexp_extract(F.trim(t), r"^(\d+)\s*[:x]", 1), F.lit("")).cast("int")
    pair = lambda c, n: F.struct(F.lit(c).alias("class"), n.cast("int").alias("cap"))
    return (
        F.when(t.contains("∞") | t.rlike(r"(?i)\b(?:unlimited|repeatable)\b"), pair("repeatable", F.lit(None)))
        .when(count == 1, pair("unique", count))
        .when(count.isNotNull(), pair("finite", count))
        .when(col(tier) == 3, pair("unique", F.lit(1)))
        .otherwise(pair("unknown", F.lit(None)))
    )


def needle_tags(text: Column | str, needles: Mapping[str, Sequence[str]] = MECHANIC_NEEDLES) -> Column:
    """Sorted tags of which any needle occurs."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    hits = []
    for tag in sorted(needles):
        any_of = F.lit(False)
        for n in needles[tag]:
            any_of = any_of | t.contains(n)
        hits.append(F.when(any_of, F.lit(tag)))
    return F.array_compact(F.array(*hits))


def passive_type(text: Column | str) -> Column:
    """P14."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    return F.when(t.contains("stance"), "stance").when(t.contains("valor chant"), "valor_chant").when(t.contains("ability"), "ability").otherwise("passive")


def level(text: Column | str) -> Column:
    """The number after "Lv" or "Level"."""
    return F.nullif(F.regexp_extract(col(text), r"(?i)\b(?:lv\.?|level)\s*(\d+)", 1), F.lit("")).cast("int")


def charge_cost(text: Column | str) -> Column:
    """P14."""
    return F.nullif(F.regexp_extract(col(text), r"(?i)\bconsumes?\s+(\d+)\s+charge\b", 1), F.lit("")).cast("int")


def value_state(values: Column | str) -> Column:
    """confirmed_values, confirmed_empty, or unknown for NULL and the sentinel list."""
    v = col(values)
    return F.when(v.isNull() | (F.array_contains(F.transform(v, lambda x: F.lower(x)), "unknown")), "unknown").when(F.size(v) == 0, "confirmed_empty").otherwise("confirmed_values")


def canonical_url(href: Column | str, base: str = "") -> Column:
    """struct(page, fragment): relative paths on ``base``, escapes decoded, spaces as underscores, query dropped, no closing slash."""
    h = col(href)
    full = F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.startswith("/"), F.concat(F.lit(base.rstrip("/")), h)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), h))
    fragment = F.nullif(F.regexp_extract(full, r"#(.*)$", 1), F.lit(""))
    page = F.regexp_replace(F.regexp_replace(F.regexp_replace(full, r"#.*$", ""), r"\?.*$", ""), r"/+$", "")
    return F.struct(F.replace(F.coalesce(F.try_url_decode(page), page), F.lit(" "), F.lit("_")).alias("page"), F.coalesce(F.try_url_decode(fragment), fragment).alias("fragment"))


def slug(text: Column | str) -> Column:
    """Lower case, other characters as single underscores; ``unknown`` when nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def qualifiers(text: Column | str, domains: Mapping[str, Sequence[str]] | None = None, triggers: Sequence[str] = ()) -> Column:
    """Struct of magnitude, turns, activations, max stacks, stacking, trigger, the values of each domain that occur, and the kinds of eligibility they speak of."""
    t = F.coalesce(col(text), F.lit(""))
    low = F.lower(t)
    # An expression is only tried where the lowered text has one of its words; (?i) is about the letters of ASCII alone.
    near = lambda *words: reduce(Column.__or__, (low.contains(w) for w in words))
    take = lambda p, *words: F.when(near(*words), F.regexp_extract(t, p, 1)).otherwise("")
    says = lambda p, *words: near(*words) & t.rlike(p)
    plain = lambda v: v.lower() if re.fullmatch(r"[A-Za-z0-9_ ]+", v) else ""
    # Arrays without a lambda, which Spark would interpret, and no nullif, which would keep the struct from being taken apart.
    kept = lambda pairs: F.flatten(F.array(*(F.when(c, F.array(F.lit(v))).otherwise(F.array().cast(STRINGS)) for c, v in pairs), F.array().cast(STRINGS)))
    magnitude = take(r"(?<!\w)(\d+(?:\.\d+)?)\s*%", "%")
    trigger = F.lit("none")
    for name in reversed([x for x in triggers if x != "none"]):
        trigger = F.when(says(rf"(?i)\b{name.replace('_', ' ')}\b", plain(name.replace("_", " "))), name).otherwise(trigger)
    most = take(r"(?i)\bmax(?:imum)?\s+(\d+)\s+stacks?\b", "stack")
    stacks = F.when(most != "", most).otherwise(take(r"(?i)\bup to\s+(\d+)\s+stacks?\b", "stack"))
    stacked = says(r"(?i)\bstacks?\b", "stack")
    behaviour = F.when(says(r"(?i)\b(?:overwrite|replaces?)\b", "overwrite", "replace"), "overwrites").when(stacked, "stackable").otherwise("not_applicable")
    said = {d: [(says(rf"(?i)\b{re.escape(v)}\b", plain(v)), v) for v in values] for d, values in (domains or {}).items()}
    hits = {d: kept(pairs) for d, pairs in said.items()}
    some = lambda d: reduce(Column.__or__, (c for c, _ in said.get(d, ())), F.lit(False))
    # Any run of letters, blanks, - and ' from a word's edge: its last word, or the signs after it, begins at one too. So no run is read twice.
    personality = says(r"(?i)\b(?:[A-Za-z]+|[' -]+) personality\b", " personality")
    kinds = [(some("equipment_class"), "weapon_class"), (some("element"), "element"), (personality, "personality"), (some("recipient_status"), "status"), (stacked, "stack"), (some("recipient_position"), "position")]
    return F.struct(
        magnitude.alias("magnitude_value"), F.when(magnitude != "", "percent").otherwise("").alias("magnitude_unit"), take(r"(?i)\b(\d+)\s+(?:times?|activations?|uses?)\b", "time", "activation", "use").alias("activation_count"),
        take(r"(?i)\bfor\s+(\d+)\s+turns?\b", "turn").alias("duration_turns"), trigger.alias("trigger"), behaviour.alias("stacking_behavior"), stacks.alias("max_stacks"),
        *(h.alias(d) for d, h in hits.items()), kept(kinds).alias("eligibility"),
    )


def target_scope(selector: Column | str, text: Column | str, default: Column | str) -> Column:
    """P19."""
    s, t = col(selector), F.coalesce(col(text), F.lit(""))
    every, one = t.rlike(r"(?i)on (?:all enemies|each enemy)\b"), t.rlike(r"(?i)\b(?:a single enemy|single enemy|enemy|enemies)\b")
    return (
        F.when(s == "enemy_attack_scope", F.when(every, "all_enemies").otherwise("single_enemy"))
        .when(s == "enemy_scope", F.when(t.rlike(r"(?i)\ball enemies\b"), "all_enemies").when(one, "single_enemy").otherwise("enemy"))
        .when((s == "fixed_response_scope") & t.rlike(r"(?i)\b(?:all party members|party members|all allies|allies)\b"), "party")
        .when((s == "fixed_response_scope") & t.rlike(r"(?i)\b(?:user|own|self)\b"), "self")
        .otherwise(col(default))
    )


def cut(text: Column | str, n: int) -> Column:
    """P20: at most n characters, the last an ellipsis where something is missing."""
    t = col(text)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…"))).otherwise(t)


def limit_items(values: Column | str, n: int) -> Column:
    """P20: struct(items, omitted)."""
    return F.struct(F.slice(col(values), 1, n).alias("items"), F.greatest(F.lit(0), F.size(col(values)) - n).alias("omitted"))


def fit_label(score: Column | str) -> Column:
    """P21."""
    return F.when(col(score) >= 500, "high").when(col(score) >= 250, "medium").otherwise("low")


def confidence_label(unknowns: Column | str) -> Column:
    return F.when(col(unknowns) == 0, "high").when(col(unknowns) <= 2, "medium").otherwise("low")


def component_label(score: Column | str) -> Column:
    return F.when(col(score) >= 75, "strong").when(col(score) >= 25, "moderate").otherwise("limited")


def hits_label(n: Column | str) -> Column:
    return F.when(col(n) >= 2, "strong").when(col(n) == 1, "moderate").otherwise("weak")


def canonical_json(**fields: Column) -> Column:
    """JSON text with the fields in alphabetical order; null fields are written."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def fingerprint(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def corpus_fingerprint(df: DataFrame, row_hash: str, buckets: int = 4096) -> DataFrame:
    """(sha, n): SHA-256 over the sorted row hashes; independent of partitioning.

    Rows hash in buckets of the hash's first digits, and buckets into one digest, so that no task holds all rows' hashes.
    """
    h = F.col(row_hash)
    per = df.groupBy(F.substring(h, 1, 3).alias("b")).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(h))), 256).alias("s"), F.count("*").alias("n"))
    return per.agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("b", "s"))), lambda x: x["s"])), 256).alias("sha"), F.sum("n").alias("n"))


def normalize_field(field: Column | str, value: Column | str) -> Column:
    """Numbers as plain decimals, other values as snake case; NULL stays."""
    v = F.trim(col(value).cast("string"))
    number = F.regexp_replace(F.regexp_replace(v, r"^\+", ""), r"(\.\d*?)0+$", "$1")
    number = F.regexp_replace(number, r"\.$", "")
    word = F.regexp_replace(F.regexp_replace(F.lower(v), r"[\s-]+", "_"), r"[^a-z0-9_]", "")
    word = F.when(col(field).isin("trigger", "condition") & word.isin("always", "unconditional", ""), F.lit("none")).otherwise(word)
    return F.when(v.rlike(r"^[-+]?\d+(\.\d+)?$"), number).otherwise(word)


def variant_key(section: Column | str, label: Column | str) -> Column:
    """struct(kind, key, ordinal) of a selector label within its section."""
    text = F.lower(F.concat_ws(" ", col(section), col(label)))
    kind = F.when(text.contains("stellar"), "stellar").when(text.contains("manifest"), "manifest").when(text.contains("form"), "form").otherwise("base")
    return F.struct(kind.alias("kind"), slug(label).alias("key"), F.nullif(F.regexp_extract(col(label), r"(\d+)\s*$", 1), F.lit("")).cast("int").alias("ordinal"))


def normalize_review(reviews: DataFrame, alias_table: DataFrame, clear: str = "__clear__") -> DataFrame:
    """P25: review columns by ``alias_table(column, alias, value)``; ``clear`` words become the sentinel."""
    names = [r["column"] for r in alias_table.select("column").distinct().collect()]  # review columns, a handful
    out = reviews
    for name in sorted(set(names) & set(reviews.columns)):
        a = alias_table.where(F.col("column") == name).select(F.lower("alias").alias("_a"), F.col("value").alias("_v"))
        out = out.join(a, F.lower(F.trim(name)) == F.col("_a"), "left")
        out = out.withColumn(name, F.when(F.lower(F.trim(name)).isin("clear", "(clear)", clear), clear).otherwise(F.coalesce("_v", F.trim(name)))).drop("_a", "_v")
    return out


def dependency_token(text: Column | str) -> Column:
    """requires_ and the snake-cased name."""
    s = slug(text)
    return F.when(s.startswith("requires_"), s).otherwise(F.concat(F.lit("requires_"), s))


STRINGS = T.ArrayType(T.StringType())
