import duckdb

from factloom.llm import decontaminate


def test_items_without_an_id_contaminate(spark, tmp_path):
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(14))
    docs = [(1, "before " + line(1)), (2, line(2) + " " + line(1)), (3, line(3)), (4, None)]
    items = [(None, line(1)), (7, line(2)), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = decontaminate.digest(decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    got = sorted((r["doc_id"], r["n_hit"], r["items"], r["n_items"], r["contaminated"]) for r in d.collect())
    assert got == [(1, 14, [], 0, True), (2, 28, ["7"], 1, True), (3, 0, [], 0, False), (4, 0, [], 0, False)]
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rel = c.sql(decontaminate.oracle())
    out = decontaminate.op2_decontaminate(spark, str(tmp_path)).select(*rel.columns)
    assert sorted(map(tuple, out.collect())) == sorted(rel.fetchall())
