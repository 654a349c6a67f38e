import zlib

import numpy as np

import corpus_pipeline
from factloom.llm import token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_a_small_corpus(spark, tmp_path):
    from tokenizers import Tokenizer

    sentence = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    rows = [(i, sentence(i), "en", f"s{i % 3}", 1) for i in range(12)] + [(50, sentence(3), "en", "s0", 1), (51, "12 34 !!", "en", "s1", 1), (52, None, "en", "s1", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(sentence(5).split()[:12]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, out = str(tmp_path), []
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, sf).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns
        out.append(sorted(r["doc_id"] for r in now.select("doc_id").collect()))
    assert out[0] == [*range(12), 50]
    assert 50 not in out[1] and 3 in out[1]
    assert set(out[1]) - set(out[2]) == {5}
    assert set(out[3]) <= set(out[2])
    tok = Tokenizer.from_file(token_files.vocabulary_file())
    got = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    want = sorted((r["doc_id"], zlib.crc32(np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in now.collect())
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in got) == want


def test_pipeline_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
