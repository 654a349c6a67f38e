"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of ``documents``; the last returns what the token files hold.

- Language ID learns from the documents' own languages and rejects texts that are too far from all of their profiles
  (``language_id.FURTHEST``) or have no letter. When nothing was learned, all texts with a letter stay.
- SimHash near-dedup keeps one document of each group, the one with the smallest id.
- Decontamination drops documents with a benchmark window.
- Mixing repeats or leaves out whole documents: a document cut by its source's budget stays if at least half of it is taken.
- Token files are written and read back.

Edge cases: null and empty texts go in the first stage. Rows equal in id and text count once after the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, language_id, mixing, simhash, token_files
from factloom.storage import Scratch, table, unused

#: Words that a worker of language ID remembers: half of the operator's own number, for the pipeline's memory.
CACHE = 300_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language_id.learn(docs)
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, profiles, furthest=language_id.FURTHEST, cache=CACHE)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    k = unused(docs, "k")
    keyed = docs.withColumn(k, F.xxhash64("doc_id", "text"))
    found = decontaminate.digest(decontaminate.search(keyed, table(spark, sf_dir, "benchmark"), doc_id=k))
    return keyed.join(found.where("contaminated").select(F.col("doc_id").alias(k)), k, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    k, n = unused(docs, "k"), unused(docs, "n")
    keyed = docs.withColumn(k, F.xxhash64("doc_id", "text"))
    taken = mixing.mix(keyed, doc_id=k).groupBy("doc_id").agg(F.max("size").alias("size"), F.max("taken").alias("taken"))
    copies = taken.where("taken > 0").select(F.col("doc_id").alias(k), F.round(F.col("taken") / F.col("size")).cast("int").alias(n)).where(F.col(n) > 0)
    return keyed.join(copies, k).select(*docs.columns, F.explode(F.sequence(F.lit(1), n)).alias(k)).drop(k)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.roundtrip(docs, token_files.vocabulary_file())


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token files", write_tokens),
]

#: No SQL: language profiles, SimHash and the tokenizer are not expressible; tests check each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{k}")
    return docs
