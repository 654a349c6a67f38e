"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut per source.

Every row gets a hash-random key; the first hex digits of the key range-partition each source into even slices, so a
hot source is many slices. Slice totals give each slice its offset, a window inside a slice gives each row its prefix
sum, and a row takes what its source's budget leaves after that prefix; whole epochs come first.

Edge cases: a null or empty text has size 0 and takes nothing. A null source is a source of its own, the last. Repeated
rows take each for itself (ordered by size; rows equal in both are interchangeable).
An empty table gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.storage import Scratch, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sizes(source, size)`` summed to one row per source: source, source_size, target.

    Water-filling: sources in the order of the level at which they fill up; the level of the rest follows from the
    sums before and after. One row per source goes through one task, none of the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    at = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % n
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).cast("double"))
    full = F.col("source_size") * F.lit(float(max_epochs))
    per = per.withColumn("full", full).withColumn("level", F.col("full") / F.col("w"))
    done = W.orderBy("level", F.col("source").asc_nulls_last())
    per = per.withColumn("total", F.sum("source_size").over(W.partitionBy(F.lit(1))) * F.lit(share))
    per = per.withColumn("full_before", F.coalesce(F.sum("full").over(done.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("w_from", F.sum("w").over(done.rowsBetween(0, W.unboundedFollowing)))
    # A source fills up while the level of those not yet full reaches its own.
    per = per.withColumn("rest", (F.col("total") - F.col("full_before")) / F.col("w_from"))
    per = per.withColumn("open", F.col("rest") < F.col("level"))
    water = F.min(F.when(F.col("open"), F.struct("level", "rest"))).over(W.partitionBy(F.lit(1)))["rest"]
    target = F.when(F.col("open"), F.least("full", water * F.col("w"))).otherwise(F.col("full"))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, slice_digits: int = 3, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``.

    ``slice_digits`` hex digits of the key give 16**slice_digits slices a source; it sets the grain, not the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim = scratch.save(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key.alias("key")), "sizes")
    slim = slim.withColumn("slice", F.substring("key", 1, slice_digits))
    slices = slim.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    offsets = slices.select("source", "slice", (F.sum("n").over(W.partitionBy("source").orderBy("slice")) - F.col("n")).alias("offset"))
    goal = targets(slices.select("source", F.col("n").alias("size")), weights, share, max_epochs)
    plan = offsets.withColumnsRenamed({"source": "s", "slice": "k"}).join(goal, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    order = W.partitionBy("source", "slice").orderBy("key", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = slim.withColumn("before", F.sum("size").over(order) - F.col("size"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("offset") - F.col("before")))
    rows = rows.withColumn("epochs", epochs).withColumn("left", left)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    return rf"""
    WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
        md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
    p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    q AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, source_size * 2.0::DOUBLE AS f FROM p),
    r AS (SELECT *, f / w AS lev, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total FROM q),
    s AS (SELECT *, coalesce(sum(f) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fb, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wf
      FROM r WINDOW o AS (ORDER BY lev, source NULLS LAST)),
    u AS (SELECT *, (total - fb) / wf AS rest, (total - fb) / wf < lev AS op FROM s),
    t AS (SELECT source, source_size, CASE WHEN op THEN least(f, (SELECT rest FROM u WHERE op ORDER BY lev, source NULLS LAST LIMIT 1) * w) ELSE f END AS target FROM u),
    x AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    y AS (SELECT *, floor(target) AS b, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS e FROM x)
    SELECT doc_id, size, source_size, target, CAST(e * size + greatest(0, least(size, b - e * source_size - before)) AS BIGINT) AS taken FROM y"""
