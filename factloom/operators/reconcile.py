"""Keyed writes and state: what to store, delete, parse again. Plans are tables first; writing them is the caller's step."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(stored: DataFrame, rows: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """Stored rows with the new ones in place of, or beside, those of the same key; the last of a key's new rows (by ``order``) wins.

    Columns that the new rows lack keep their stored value; applying the same rows twice changes nothing.
    """
    keys = list(key)
    rest = [c for c in rows.columns if c not in keys]
    new = rows.groupBy(*keys).agg(F.max(F.struct(*([order] if order else []), *rest)).alias("_n")) if rest else rows.select(*keys).distinct().withColumn("_n", F.struct(F.lit(1)))
    new = new.withColumn("_has", F.lit(True))
    out = stored.join(new, keys, "full_outer")
    pick = lambda c: F.when(F.col("_has"), F.col(f"_n.{c}")).otherwise(F.col(c)) if c in stored.columns else F.col(f"_n.{c}")
    columns = [*stored.columns, *(c for c in rest if c not in stored.columns)]
    return out.select(*(F.col(c) if c in keys or c not in rest else pick(c).alias(c) for c in columns))


def replace_children(stored: DataFrame, parents: DataFrame, rows: DataFrame, parent_key: str, receipts: DataFrame | None = None) -> DataFrame:
    """Child rows of the selected parents replaced by ``rows``; refuses (raises) if a parent's receipt(parent_key, overall) isn't complete."""
    chosen = parents.select(parent_key).distinct()
    if receipts is not None:
        open_ = chosen.join(receipts.where("overall = 'complete'").select(parent_key), parent_key, "left_anti").count()
        if open_:
            raise ValueError(f"{open_} parents have no complete receipt")
    kept = stored.join(chosen, parent_key, "left_anti")
    return kept.unionByName(rows.join(chosen, parent_key, "left_semi"), allowMissingColumns=True)


def delete_by_keys(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored rows without those whose key columns are in ``keys``; rows with a null key stay."""
    return stored.join(keys.distinct(), keys.columns, "left_anti")


def managed_reconcile(expected: DataFrame, stored: DataFrame, edges: DataFrame, allow_delete: bool = False) -> DataFrame:
    """(key, action, reason) over expected(key, name) and stored(key, name, managed); edges(key) lists connected rows.

    Deletes only rows that are managed, no longer expected, unconnected, and only when allowed; a key stored under another name is a conflict.
    """
    s = stored.select("key", F.col("name").alias("stored_name"), "managed", F.lit(True).alias("s"))
    e = expected.select("key", "name", F.lit(True).alias("e"))
    linked = edges.select("key").distinct().withColumn("linked", F.lit(True))
    j = e.join(s, "key", "full_outer").join(linked, "key", "left")
    here, there = F.col("e").isNotNull(), F.col("s").isNotNull()
    action = (
        F.when(here & ~there, F.struct(F.lit("create").alias("action"), F.lit("missing").alias("reason")))
        .when(here & there & ~F.col("name").eqNullSafe(F.col("stored_name")), F.struct(F.lit("conflict").alias("action"), F.lit("name_differs").alias("reason")))
        .when(here, F.struct(F.lit("keep").alias("action"), F.lit("expected").alias("reason")))
        .when(~F.coalesce("managed", F.lit(False)), F.struct(F.lit("keep").alias("action"), F.lit("unmanaged").alias("reason")))
        .when(F.coalesce("linked", F.lit(False)), F.struct(F.lit("keep").alias("action"), F.lit("connected").alias("reason")))
        .when(F.lit(allow_delete), F.struct(F.lit("delete").alias("action"), F.lit("stale").alias("reason")))
        .otherwise(F.struct(F.lit("keep").alias("action"), F.lit("delete_not_allowed").alias("reason")))
    )
    return j.select("key", action.alias("a")).select("key", "a.*")


def capture_errors(manifest: DataFrame, captures: DataFrame) -> DataFrame:
    """manifest(page_id, sha256) against captures(page_id, capture_sha256): (page_id, error)."""
    row = lambda df, e: df.select("page_id", F.lit(e).alias("error"))
    both = manifest.select("page_id", "sha256").join(captures.select("page_id", "capture_sha256"), "page_id")
    parts = [
        row(manifest.join(captures, "page_id", "left_anti"), "not_captured"),
        row(captures.join(manifest, "page_id", "left_anti"), "not_listed"),
        row(captures.groupBy("page_id").count().where("count > 1"), "duplicate"),
        row(both.where(~F.col("sha256").eqNullSafe(F.col("capture_sha256"))), "digest"),
    ]
    return reduce(DataFrame.unionByName, parts)


def corpus_errors(manifest: DataFrame, artifacts: DataFrame, fields: Sequence[str], key: str = "canonical_id") -> DataFrame:
    """(key, field) where an artifact differs from its manifest row; ``row`` where one is missing."""
    m = manifest.select(key, F.struct(*fields).alias("m"))
    a = artifacts.select(key, F.struct(*fields).alias("a"))
    j = m.join(a, key, "full_outer")
    one = F.col("m").isNull() | F.col("a").isNull()
    bad = F.array_compact(F.array(F.when(one, "row"), *(F.when(~one & ~F.col(f"m.{f}").eqNullSafe(F.col(f"a.{f}")), f) for f in fields)))
    return j.select(key, F.explode(bad).alias("field"))


STATES = ("pending", "cached", "parsed", "loaded", "failed", "inactive")


def fold_states(events: DataFrame) -> DataFrame:
    """events(target_id, state, ts, error, url) -> the last state of each target, its attempts, last error and whether it came back.

    ``reactivated``: the target had been inactive, and a later event gives it another address.
    """
    last = F.max(F.struct("ts", "state", "url")).alias("l")
    err = F.max(F.when(F.col("error").isNotNull(), F.struct("ts", "error"))).alias("x")
    gone = F.max(F.when(F.col("state") == "inactive", F.struct("ts", "url"))).alias("g")
    out = events.groupBy("target_id").agg(last, err, gone, F.count_if(F.col("state").isin("cached", "failed")).alias("attempts"), F.count("*").alias("n_events"))
    back = F.coalesce((F.col("l.ts") > F.col("g.ts")) & ~F.col("l.url").eqNullSafe(F.col("g.url")), F.lit(False))
    return out.select("target_id", F.col("l.state").alias("state"), F.col("l.url").alias("url"), "attempts", F.col("x.error").alias("last_error"), back.alias("reactivated"), "n_events")


def select_stale(targets: DataFrame, artifacts: DataFrame, version: str) -> DataFrame:
    """targets(target_id, url, state) to parse again, with the reason: missing, stale_version, failed or url_changed."""
    a = artifacts.select("target_id", F.col("url").alias("_u"), "schema_version", F.lit(True).alias("_a"))
    why = F.when(F.col("_a").isNull(), "missing").when(~F.col("schema_version").eqNullSafe(version), "stale_version").when(F.col("state") == "failed", "failed").when(~F.col("url").eqNullSafe(F.col("_u")), "url_changed")
    return targets.join(a, "target_id", "left").withColumn("reason", why).where("reason IS NOT NULL").drop("_u", "_a", "schema_version")


def derive_targets(index_rows: DataFrame, scope: dict[str, int], placeholders: Sequence[str] = (), base: str = "") -> DataFrame:
    """index_rows(kind, name, url?, position) -> (target_id, kind, url): no placeholders, one row an id, at most the scope's number of each kind (all without one)."""
    from factloom.functions import expr

    rows = index_rows.where(~F.lower(F.trim("name")).isin(*[p.lower() for p in placeholders])) if placeholders else index_rows
    url = F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.concat(F.lit(base), F.lit("/"), expr.slug("name")))
    rows = rows.select(F.concat_ws(":", "kind", expr.slug("name")).alias("target_id"), "kind", url.alias("url"), "position")
    one = rows.groupBy("target_id", "kind").agg(F.min(F.struct("position", "url")).alias("x"))
    limit = F.lit(None).cast("int")
    for k, n in scope.items():
        limit = F.when(F.col("kind") == k, n).otherwise(limit)
    r = F.row_number().over(W.partitionBy("kind").orderBy("x.position", "target_id"))
    return one.withColumns({"_r": r, "_l": limit}).where("_l IS NULL OR _r <= _l").select("target_id", "kind", F.col("x.url").alias("url"))
