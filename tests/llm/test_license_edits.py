import random
import time

import numpy as np

from factloom.llm import license_scan as L


def found(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {}
    for r in L.scan(d).collect():
        out.setdefault(r["doc_id"], set()).add(r["license"])
    return [out.get(i, set()) for i in range(len(texts))]


def test_short_notices_with_one_edit_are_found(spark):
    got = found(spark, ["Licensed under the Apache Licence, Version 2.0.", "Released under the MIT Licence.", "Released under the old house."])
    assert got == [{"Apache-2.0-notice"}, {"MIT-notice"}, set()]


def test_neighbouring_licenses_are_told_apart(spark):
    t = L.TEMPLATES
    names = ["CC-BY-4.0-notice", "CC-BY-SA-4.0-notice", "CC-BY-NC-4.0-notice", "BSD-2-Clause", "BSD-3-Clause"]
    assert found(spark, ["word " * 20 + t[n] + " more" * 20 for n in names]) == [{n} for n in names]


def test_seeds_lose_nothing_against_alignment_on_every_diagonal():
    r, index = random.Random(7), L.Index(L.TEMPLATES)
    for t, known in enumerate(index.words):
        for _ in range(6):
            text = known.tolist()
            for at in r.sample(range(len(text)), int(len(text) * (1 - L.COVERAGE) + 1e-9)):
                text[at] = -1
            doc, band = np.array([-1] * 9 + text + [-1] * 9, np.int32), index.band(t)
            need = L.COVERAGE * len(known) - 1e-9
            every = np.arange(-len(known), len(doc))
            whole = L.align(known, [doc] * len(every), every, band)[0].max()
            seeds = [d for x, d in index.candidates(doc) if x == t]
            assert whole < need or seeds and L.align(known, [doc] * len(seeds), np.array(seeds), band)[0].max() >= need


def test_windows_leave_a_fingerprint():
    """Whatever rows the edits break, one kept fingerprint of a template is kept in the document too."""
    r = random.Random(4)
    for n in (5, 9, 14, 24, 60, 130):
        index = L.Index({"t": " ".join(f"w{k}" for k in range(n))})
        for _ in range(60):
            words = [f"w{k}" for k in range(n)]
            for k in r.sample(range(n), int(n - L.COVERAGE * n + 1e-9)):
                words[k] = r.choice(["other", f"w{r.randrange(n)}"])
            text = ["before", *words, "after"]
            assert 1 in [d for _, d in index.candidates(np.array([index.vocabulary.get(w, -1) for w in text]))] or index.hits(np.array([index.vocabulary.get(w, -1) for w in text])).size


def test_long_text_takes_time_in_proportion(spark):
    """A megabyte of one notice after the other: every one is found, in seconds."""
    notice = L.TEMPLATES["MIT-notice"] + " "
    n = 1_000_000 // len(notice)
    began = time.time()
    rows = L.scan(spark.createDataFrame([(1, notice * n)], "doc_id int, text string")).collect()
    assert time.time() - began < 60
    assert sorted((r["from_char"], r["to_char"]) for r in rows if r["license"] == "MIT-notice") == [(k * len(notice), (k + 1) * len(notice) - 2) for k in range(n)]
