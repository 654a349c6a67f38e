import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(rows)], SCHEMA)
    out = corpus_pipeline.identify_language(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(r["doc_id"] for r in out.collect())


def test_language_stage_rejects_by_distance(spark):
    r = random.Random(4)
    texts = {
        "en": "the house and the garden with that thing are where the people of the town have been walking all the morning",
        "de": "das haus und der garten mit dem ding sind dort wo die leute der stadt den ganzen morgen gegangen sind",
    }
    rows = [(" ".join(r.sample(t.split(), 15)), lang) for lang, t in texts.items() for _ in range(5)]
    good = [("the people have been walking in the garden all morning", None), ("die leute sind den ganzen morgen im garten", None)]
    noise = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(30))
    bad = [("съешь же ещё этих мягких французских булок да выпей чаю", None), (noise, None), ("12 !!", None), ("", None), (None, None)]
    assert kept(spark, rows + good + bad) == list(range(len(rows) + len(good)))


def test_language_stage_keeps_letters_when_nothing_was_learned(spark):
    assert kept(spark, [("some words", None), ("слова", None), ("12 !!", None), ("", None), (None, None)]) == [0, 1]
