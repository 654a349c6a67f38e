import duckdb

from factloom.llm import quality_rules


def test_texts_without_words_get_a_verdict(spark, tmp_path):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    texts = [None, "", "   \n\t ", "\n\n\n", "one", "the house and the garden with that thing is on this hill as it was for the old man in the boat and"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = c.sql(quality_rules.oracle())
    got = quality_rules.op9_quality_rules(spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())
    assert [r["kept"] for r in sorted(got)] == [False] * 5 + [True]


def test_a_rule_that_divides_by_zero_does_not_fail(spark):
    rules = [quality_rules.Rule("a", "n_words / n_upper", None, 1.0), quality_rules.Rule("b", "n_words / (n_upper + n_symbols)", None, 1.0), quality_rules.Rule("c", "n_words / greatest(n_upper, 1) / 2.0", None, 1.0)]
    docs = spark.createDataFrame([(1, "a b c"), (2, "A b c"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["failed_rules"] for r in quality_rules.rate(docs, rules).collect()}
    assert got == {1: ["c"], 2: ["a", "b", "c"], 3: []}
