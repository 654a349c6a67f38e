"""Joins: names to owners, facts to owners, items to owners, decisions to proposals. Unresolved and ambiguous rows are results, not drops."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import expr
from factloom.operators import dealt, validate
from factloom.storage import Scratch


def facts_for(requests: DataFrame, facts: DataFrame, key: str = "owner") -> DataFrame:
    """Facts of the owners in each request's roster: requests(request_id, roster array)."""
    return requests.select("request_id", F.explode(F.array_distinct("roster")).alias(key)).join(facts, key)


def with_traits(owners: DataFrame, edges: DataFrame, key: str = "owner", trait: str = "trait") -> DataFrame:
    """Owners with their sorted traits; owners without any have an empty list."""
    got = edges.groupBy(key).agg(F.sort_array(F.collect_set(trait)).alias("traits"))
    return owners.join(got, key, "left").withColumn("traits", F.coalesce("traits", F.array().cast(expr.STRINGS)))


def shared_path(owners: DataFrame, edges: DataFrame, items: DataFrame) -> DataFrame:
    """(owner, trait, item) over edges(owner, trait) and shareable items(item_id, trait, shareable)."""
    shared = items.where("shareable").select(F.col("item_id").alias("item"), "trait")
    return dealt.join(owners.select("owner").join(edges, "owner"), shared, "trait", "item", tasks=dealt.TASKS).select("owner", "trait", "item")


def resolve_exact(names: DataFrame, owners: DataFrame) -> DataFrame:
    """names(input) against owners(name, aliases) -> (input, matches, status resolved/unresolved/ambiguous), without regard to case."""
    known = owners.select("name", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast(expr.STRINGS)))).alias("a"))
    hits = names.join(known, expr.folded("input") == expr.folded("a"), "left").groupBy("input").agg(F.sort_array(F.collect_set("name")).alias("matches"))
    n = F.size("matches")
    return hits.withColumn("status", F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous"))


def resolve_ranked(names: DataFrame, owners: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Exact, then alias, then containment in a name or alias; the shortest name, then the first; (input, canonical), canonical null when nothing fits.

    Exact and alias matches are equi-joins; inputs left over are looked up by ``containing``. ``owners`` is the reference list.
    """
    pool = owners if exclude is None else owners.join(exclude.select("name"), "name", "left_anti")
    keyed = names.select("input", expr.folded("input").alias("k")).distinct()
    called = pool.select("name", F.explode("aliases").alias("a")).where("a IS NOT NULL").select("name", expr.folded("a").alias("k"))
    exact = keyed.join(pool.select("name", expr.folded("name").alias("k")), "k").select("input", "name", F.lit(0).alias("how"))
    alias = keyed.join(called, "k").select("input", "name", F.lit(1).alias("how"))
    direct = exact.unionByName(alias)
    rest = keyed.join(direct.select("input").distinct(), "input", "left_anti").where("k != ''")
    texts = pool.select("name", expr.folded("name").alias("text")).unionByName(called.select("name", F.col("k").alias("text")))
    found = containing(rest.select("k").distinct(), texts.where("text IS NOT NULL"))
    inside = rest.join(found, "k").select("input", "name", F.lit(2).alias("how"))
    best = direct.unionByName(inside).groupBy("input").agg(F.min(F.struct("how", F.length("name").alias("l"), "name"))["name"].alias("canonical"))
    return keyed.select("input").join(best, "input", "left")


def containing(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """keys(k) in texts(name, text) -> (k, name): the shortest name, then the first, of those with a text that has the key somewhere in it.

    A text has a key if one of the text's suffixes begins with it. Suffixes, as long as the longest key, are range-partitioned in sorted order; a key is a
    range of them and goes to the partitions that it meets. There keys and suffixes stream by in one order, and a stack of
    the keys that begin the current string takes the least name: no pair of a key and a text is ever made.
    """
    scratch = Scratch(keys.sparkSession, "containing")
    longest = keys.agg(F.max(F.length("k"))).first()[0] or 0  # one number
    tails = texts.where("text != ''").select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring("text", i, longest))).alias("s"))
    least = tails.groupBy("s").agg(F.min(F.struct(F.length("name").alias("l"), "name")).alias("best"))
    ranged = scratch.save(least.repartitionByRange("s").sortWithinPartitions("s").withColumn("part", F.spark_partition_id()), "suffixes")
    ends = [(r["part"], r["a"].encode(), r["b"].encode()) for r in ranged.groupBy("part").agg(F.min("s").alias("a"), F.max("s").alias("b")).orderBy("a").collect()]  # one row a partition

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs = [a for _, a, _ in ends], [b for _, _, b in ends]
        for batch in batches:
            parts, out = [], []
            for k in batch.column(0).to_pylist():
                key = k.encode()
                first, last = bisect_left(highs, key), bisect_left(lows, key + b"\xff")
                parts += [p for p, _, _ in ends[first:last]]
                out += [k] * (last - first)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(out, pa.string())], ["part", "s"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list[list] = []  # keys, each one beginning with the one below, and their least so far
        part, out = None, []

        def close(s: bytes | None) -> None:
            while opened and (s is None or not s.startswith(opened[-1][0])):
                key, best = opened.pop()
                if best is not None:
                    out.append((key.decode(), best[1]))
                    if opened and (opened[-1][1] is None or best < opened[-1][1]):
                        opened[-1][1] = best

        def batch() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["k", "name"])
            out.clear()
            return rows

        for b in batches:
            for r in b.to_pylist():
                if r["part"] != part:
                    close(None)
                    part = r["part"]
                s = r["s"].encode()
                close(s)
                if r["best"] is None:
                    opened.append([s, None])
                elif opened and (opened[-1][1] is None or (r["best"]["l"], r["best"]["name"]) < opened[-1][1]):
                    opened[-1][1] = (r["best"]["l"], r["best"]["name"])
            yield batch()
        close(None)
        yield batch()

    asked = keys.where("k != ''").select("k").mapInArrow(spread, "part int, s string")
    rows = ranged.select("part", "s", "best").unionByName(asked, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "s", F.col("best").isNotNull())
    found = rows.mapInArrow(sweep, "k string, name string")
    return found.groupBy("k").agg(F.min(F.struct(F.length("name").alias("l"), "name"))["name"].alias("name"))


#: Characters of needles in one automaton, some 60 bytes each.
AUTOMATON = 2_000_000
_automata: dict[str, object] = {}


def mentions(texts: DataFrame, names: DataFrame, min_token: int = 4, most: int = AUTOMATON) -> DataFrame:
    """texts(text_id, text) x names(name) -> (text_id, name): the lower-cased text contains the name, or one of the name's
    blank-separated tokens of ``min_token`` characters or more; the longest name wins.

    All needles are one automaton (Aho-Corasick), sent to the tasks, which read each text once. Needles of more than ``most`` characters
    are dealt to several automata by hash; each takes a pass over the texts. Nothing but the best name of a text is shuffled.
    """
    low = F.lower("name")
    long = F.filter(F.split(low, " "), lambda t: F.length(t) >= min_token)
    needles = names.select("name").distinct().where("name != ''").select("name", F.explode(F.array_union(F.array(low), long)).alias("needle"))
    needles = needles.groupBy("needle").agg(F.min(F.struct((-F.length("name")).alias("l"), "name")).alias("best"))
    needles = Scratch(texts.sparkSession, "mentions").save(needles.select("needle", "best.*"), "needles")
    size = needles.agg(F.sum(F.length("needle"))).first()[0] or 0  # one number
    shards = max(1, -(-size // most))
    hits = None
    for k in range(shards):
        mine = needles.where(F.pmod(F.xxhash64("needle"), F.lit(shards)) == k)
        listed = [(r["needle"], (r["l"], r["name"])) for r in mine.collect()]  # some ``most`` characters
        part = _matched(texts, listed) if listed else None
        hits = part if hits is None else hits.unionByName(part) if part is not None else hits
    if hits is None:
        return texts.select("text_id", F.lit(None).cast("string").alias("name")).limit(0)
    return hits.groupBy("text_id").agg(F.min(F.struct("l", "name"))["name"].alias("name"))


def _matched(texts: DataFrame, needles: Sequence[tuple[str, tuple[int, str]]]) -> DataFrame:
    """(text_id, l, name): the best name of each text that has one of the needles(needle, (rank, name))."""
    sent, key = texts.sparkSession.sparkContext.broadcast(needles), uuid.uuid4().hex
    kind = texts.schema["text_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _automata:  # a worker serves several tasks
            _automata.clear()
            built = ahocorasick.Automaton()
            for needle, best in sent.value:
                built.add_word(needle, best)
            built.make_automaton()
            _automata[key] = built
        find = _automata[key].iter
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column(1)):
                best = min((best for _, best in find(t.as_py() or "")), default=None)
                if best is not None:
                    rows.append(i), found.append(best)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.string())], ["text_id", "l", "name"])

    return texts.select("text_id", F.lower("text").alias("text")).mapInArrow(run, f"text_id {kind}, l int, name string")


def compatible_items(owners: DataFrame, items: DataFrame) -> DataFrame:
    """owners(owner, weapon, traits) x items(item_id, trait, weapon_req, weapon_group) on F06.

    Owners with the same weapons and traits are a class, and so are items with the same requirements; what fits is settled between classes.
    Items with a trait join on it; the few without a trait join on their weapon, and those without either apply to all owners.
    """
    none = F.array().cast(expr.STRINGS)
    own = owners.select("owner", F.struct("weapon", F.array_sort(F.array_distinct("traits")).alias("traits")).alias("kind"))
    asked = items.select("item_id", F.struct(F.col("trait").alias("t"), "weapon_req", F.array_sort(F.array_distinct(F.coalesce("weapon_group", none))).alias("weapon_group")).alias("kind"))

    def match(o: DataFrame, i: DataFrame) -> DataFrame:
        o, i = o.select("l", "kind.*"), i.select("r", "kind.*")
        ok = validate.is_compatible(F.col("t"), F.col("weapon_req"), F.col("weapon_group"), F.col("traits"), F.col("weapon"))
        by_trait = o.withColumn("t", F.explode("traits")).join(i.where("t IS NOT NULL"), "t").where(ok)
        by_weapon = o.join(i.where("t IS NULL AND weapon_req IS NOT NULL"), F.col("weapon") == F.col("weapon_req")).where(ok)
        loose = i.where("t IS NULL AND weapon_req IS NULL")
        by_group = o.join(loose.where("size(weapon_group) > 0").withColumn("g", F.explode("weapon_group")), F.col("weapon") == F.col("g"))
        free = o.crossJoin(loose.where("size(weapon_group) = 0").select("r"))  # classes of items without any requirement: one, or one for each set of kinds that holds it
        return reduce(DataFrame.unionByName, [x.select("l", "r") for x in (by_trait, by_weapon, by_group, free)])

    return dealt.pairs(own, asked, "owner", "item_id", match)


def missing_keys(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, side): expected_only or stored_only."""
    a, b = expected.select(F.col(key).alias("key")).distinct(), stored.select(F.col(key).alias("key")).distinct()
    return a.join(b, "key", "left_anti").withColumn("side", F.lit("expected_only")).unionByName(b.join(a, "key", "left_anti").withColumn("side", F.lit("stored_only")))


def overlap_report(left: DataFrame, right: DataFrame, children: dict[str, DataFrame], key: str = "name") -> DataFrame:
    """Keys on both sides with the number of their rows in each child table; ``cleanup`` where no child has any."""
    out = left.select(key).distinct().join(right.select(key).distinct(), key)
    for name, child in children.items():
        n = child.groupBy(key).agg(F.count("*").alias(name))
        out = out.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    total = reduce(lambda a, b: a + b, (F.col(c) for c in children), F.lit(0))
    return out.withColumn("cleanup", F.when(total == 0, "delete").otherwise("keep"))


def match_decisions(proposals: DataFrame, decisions: DataFrame, drift: Column | None = None) -> DataFrame:
    """Proposals with ``decision`` and ``via`` (proposal_id, legacy or null): by id first, else by (record_type, fact_id, rule_id).

    decisions(proposal_id?, record_type, fact_id, rule_id, decision, semantics): a decision on other semantics than the proposal's is dropped.
    """
    one = lambda d, *k: d.groupBy(*k).agg(F.max(F.struct("semantics", "decision")).alias("d"))
    by_id = one(decisions.where("proposal_id IS NOT NULL"), "proposal_id").withColumnRenamed("d", "d1")
    by_key = one(decisions.where("proposal_id IS NULL"), "record_type", "fact_id", "rule_id").withColumnRenamed("d", "d2")
    out = proposals.join(by_id, "proposal_id", "left").join(by_key, ["record_type", "fact_id", "rule_id"], "left")
    picked = F.coalesce("d1", "d2")
    stale = drift if drift is not None else ~picked["semantics"].eqNullSafe(F.col("semantics"))
    via = F.when(F.col("d1").isNotNull(), "proposal_id").when(F.col("d2").isNotNull(), "legacy")
    return out.withColumns({"decision": F.when(~stale, picked["decision"]), "via": F.when(~stale, via)}).drop("d1", "d2")


def bind_units(units: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """facts(fact_id, kind, title, text) to units(unit_id, kind, title, text): one unit with the same text, else the sole unit of that title.

    A unit serves one fact, the first by id. Returns (bound(fact_id, unit_id, how), diagnostics(fact_id, reason)).
    """
    pairs = facts.join(units.withColumnRenamed("text", "unit_text"), ["kind", "title"], "left")
    f = W.partitionBy("fact_id")
    same = F.coalesce(F.col("text") == F.col("unit_text"), F.lit(False))
    pairs = pairs.withColumns({"n": F.count("unit_id").over(f), "n_same": F.sum(same.cast("int")).over(f), "same": same})
    how = F.when((F.col("n_same") == 1) & F.col("same"), "exact_text").when((F.col("n_same") == 0) & (F.col("n") == 1), "sole_candidate")
    pairs = pairs.withColumn("how", how)
    first = F.row_number().over(W.partitionBy("unit_id").orderBy(F.when(F.col("how") == "exact_text", 0).otherwise(1), "fact_id"))
    picked = pairs.where("how IS NOT NULL").withColumn("r", first)
    bound = picked.where("r = 1").select("fact_id", "unit_id", "how")
    reason = F.when(F.max("n") == 0, "no_unit").when(F.max(F.col("how").isNotNull()), "unit_used").otherwise("ambiguous")
    diagnostics = pairs.groupBy("fact_id").agg(reason.alias("reason")).join(bound.select("fact_id"), "fact_id", "left_anti")
    return bound, diagnostics


def counter_links(proposals: DataFrame, registry: DataFrame, explicit: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """(proposal_id, counter_id, relationship): explicit(rule_id, counter_id) wins over registry(counter_id, capabilities, related) by value."""
    p = proposals.where(~F.col("value").isin(*excluded)) if excluded else proposals
    by_rule = p.join(explicit, "rule_id").select("proposal_id", "counter_id", F.lit("exact").alias("relationship"))
    rest = p.join(explicit.select("rule_id").distinct(), "rule_id", "left_anti")
    listed = registry.select("counter_id", F.explode("capabilities").alias("value"), F.lit("exact").alias("relationship")).unionByName(registry.select("counter_id", F.explode("related").alias("value"), F.lit("related").alias("relationship")))
    by_value = rest.join(listed, "value").groupBy("proposal_id", "counter_id").agg(F.min("relationship").alias("relationship"))
    return by_rule.distinct().unionByName(by_value)


def selected_evidence(slots: DataFrame, facts: DataFrame) -> DataFrame:
    """slots(slot, fact) with effects of facts(fact, effects); ``unavailable`` unless exactly one fact has the id."""
    known = facts.groupBy("fact").agg(F.count("*").alias("n"), F.first("effects").alias("effects"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    return slots.join(known, "fact", "left").select("slot", "fact", F.when(one, "available").otherwise("unavailable").alias("status"), F.when(one, F.col("effects")).alias("effects"))


def exact_candidate(final: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with the same ordered ids and the same skills."""
    return final.join(candidates, ["member_ids", "skill_ids"], "left")


def compare_fixture(rows: DataFrame, fixture: DataFrame, key: str, digests: Sequence[str]) -> DataFrame:
    """Rows with ``status``: passed if all digests agree, failed if one differs, unknown without a fixture row."""
    f = fixture.select(key, *(F.col(d).alias(f"_{d}") for d in digests), F.lit(True).alias("_f"))
    same = reduce(lambda a, b: a & b, (F.col(d).eqNullSafe(F.col(f"_{d}")) for d in digests))
    return rows.join(f, key, "left").withColumn("status", F.when(F.col("_f").isNull(), "unknown").when(same, "passed").otherwise("failed")).drop("_f", *(f"_{d}" for d in digests))


def drift(expected: DataFrame, stored: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, kind): missing, unexpected or changed."""
    a = expected.select(key, F.struct(*cols).alias("a"), F.lit(True).alias("ia"))
    b = stored.select(key, F.struct(*cols).alias("b"), F.lit(True).alias("ib"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("ib").isNull(), "missing").when(F.col("ia").isNull(), "unexpected").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(key, kind.alias("kind")).where("kind IS NOT NULL")


def collected(df: DataFrame, key: str | Sequence[str], columns: Sequence[str], name: str, cap: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """One row a key with ``name``: its rows as sorted structs, at most ``cap`` of them (the feature of J17), and how many there were."""
    keys = [key] if isinstance(key, str) else list(key)
    if cap is not None:
        df = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*(order or columns)))).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
        df = df.where(F.col("_r") <= cap)
    else:
        df = df.withColumns({"_r": F.lit(0), "_n": F.lit(0)})
    out = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name), F.max("_n").alias(f"n_{name}"))
    return out if cap is not None else out.drop(f"n_{name}")


def lineup_context(requests: DataFrame, parts: dict[str, tuple[DataFrame, Sequence[str]]], cap: int = 12, key: str = "owner") -> DataFrame:
    """requests(request_id, owner) with each part's rows collected before the join, so parts do not multiply each other."""
    out = requests
    for name, (df, columns) in parts.items():
        out = out.join(collected(df, key, columns, name, cap), key, "left")
    return out


def legality_context(lineups: DataFrame, owners: DataFrame, edges: DataFrame, limits: DataFrame) -> DataFrame:
    """lineups(lineup_id, owner, item_id) with weapon, traits and the item's limit; null where unknown."""
    return lineups.join(limits, "item_id", "left").join(with_traits(owners, edges), "owner", "left")  # the wide side last


def items_for(requests: DataFrame, items: DataFrame) -> DataFrame:
    """requests(request_id, weapon) x items(item_id, slot, weapon): armor for every request, weapons of its kinds; distinct."""
    asked = requests.select("request_id", F.struct("weapon").alias("kind"))
    had = items.where("slot IN ('weapon', 'armor')").select("item_id", F.struct("slot", F.when(F.col("slot") == "weapon", F.col("weapon")).alias("weapon")).alias("kind"))

    def match(q: DataFrame, i: DataFrame) -> DataFrame:
        q, i = q.select("l", "kind.weapon"), i.select("r", "kind.*")
        weapons = q.join(i.where("slot = 'weapon'"), "weapon").select("l", "r")
        return weapons.unionByName(q.select("l").distinct().crossJoin(i.where("slot = 'armor'").select("r")))  # classes

    return dealt.pairs(asked, had, "request_id", "item_id", match)


def with_children(parents: DataFrame, children: dict[str, tuple[DataFrame, Sequence[str]]], key: str) -> DataFrame:
    """Parents with each child table collected on its own."""
    out = parents
    for name, (df, columns) in children.items():
        out = out.join(collected(df, key, columns, name), key, "left")
    return out


def collect_citations(*sources: DataFrame) -> DataFrame:
    """sources(request_id, url, label) in order of trust -> one row a request and url, from the first source that has it."""
    ranked = reduce(DataFrame.unionByName, (s.select("request_id", "url", "label", F.lit(i).alias("s")) for i, s in enumerate(sources)))
    best = ranked.where("url IS NOT NULL AND trim(url) != ''").groupBy("request_id", "url").agg(F.min(F.struct("s", "label"))["label"].alias("label"))
    return best


def project_referenced(candidates: DataFrame, owners: DataFrame, facts: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Owners and facts that the best n candidates(request_id, score, candidate_id, owner_ids, fact_ids) of any request name."""
    top = candidates.withColumn("r", F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("score"), "candidate_id"))).where(F.col("r") <= n)
    return (
        owners.join(top.select(F.explode("owner_ids").alias("owner")).distinct(), "owner", "left_semi"),
        facts.join(top.select(F.explode("fact_ids").alias("fact_id")).distinct(), "fact_id", "left_semi"),
    )


def resolve_display(ids: DataFrame, lookup: DataFrame, key: str = "id") -> DataFrame:
    """Ids with the lookup's fields; ``known`` tells which were found."""
    return ids.join(lookup.withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
