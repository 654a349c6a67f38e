"""Operators against plain versions of their methods, held-out labels and malformed input."""

import random
import time
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import html_extraction, language_id, license_scan, toxicity

SF = Path("/root/testdata/sf0.01")


# Licenses


def test_spans_are_of_the_text_as_given(spark):
    t = license_scan.TEMPLATES["MIT"]
    text = "İİ İstanbul x̂ " + t.replace("charge", "cost") + " tail"
    [row] = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert text[row["from_char"] : row["to_char"]].startswith("Permission") and text[row["from_char"] : row["to_char"]].endswith("Software")


def test_lower_case_keeps_words_where_length_is_kept():
    for c in map(chr, range(0x110000)):
        if len(c.lower()) == 1:
            assert bool(license_scan.WORD.match(c)) == bool(license_scan.WORD.match(c.lower()))


def plain_alignment(template, doc):
    """Matched words of the best local alignment without a band: (score, matched)."""
    best, above = (0, 0), [(0, 0)] * (len(doc) + 1)
    for w in template:
        row = [(0, 0)]
        for j, d in enumerate(doc):
            x = max((above[j][0] + (2 if w == d else -1), above[j][1] + (w == d)), (above[j + 1][0] - 1, above[j + 1][1]), (row[j][0] - 1, row[j][1]))
            row.append(x if x[0] > 0 else (0, 0))
        best, above = max(best, *row), row
    return best


def test_matches_equal_plain_alignment(spark):
    r, rows = random.Random(11), []
    names = ["MIT-notice", "Apache-2.0-notice", "GPL-3.0-notice", "ISC", "MPL-2.0", "CC-BY-4.0"]
    for k in range(60):
        w = license_scan.words_of(license_scan.TEMPLATES[names[k % 6]])
        for _ in range(r.randrange(0, len(w) // 4 + 2)):
            at = r.randrange(len(w))
            w[at : at + r.randrange(2)] = [r.choice(["other", "word", "the"])] * r.randrange(2)
        rows.append((k, " ".join(["pad"] * r.randrange(9) + w + ["pad"] * 5)))
    got = {(x["doc_id"], x["license"]): x["n_matched"] for x in license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for k, text in rows:
        known = license_scan.words_of(license_scan.TEMPLATES[names[k % 6]])
        matched = plain_alignment(known, license_scan.words_of(text))[1]
        assert ((k, names[k % 6]) in got) == (matched >= license_scan.COVERAGE * len(known))
        assert got.get((k, names[k % 6]), matched) == matched


# HTML


def test_pages_with_clashing_columns_and_no_rows(spark):
    schema = "page_id int, text string, html string, n_chars int"
    got = html_extraction.extract(spark.createDataFrame([(1, "old", "<article><p>The text of the page, long enough to stay.</p></article>", 3)], schema)).collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [(1, "The text of the page, long enough to stay.", 3)]
    assert html_extraction.extract(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("page", ["<font>x" * 70_000 + "</i>" * 70_000, '<a href="x' * 100_000, "<p>some words here" * 60_000, "<div>" * 200_000, "<ul><li>" * 60_000 + "<td></td>" * 60_000, "<td><table>" + "<font>" * 60_000 + "<td></td>" * 60_000, "<nav>a b</nav><p>A sentence that is long enough to stay. " * 18_000], ids=range(7))
def test_malformed_pages_of_a_megabyte_take_seconds(page):
    start = time.time()
    html_extraction.main_text(page)
    assert time.time() - start < 15


def test_inline_parts_formulas_and_linked_items():
    page = '<body><span class="ad">Buy the best thing that money can get you now.</span><article><h1>Title</h1><p>The formula <math>E</math> is good <span class=ad>deal</span> and long enough.</p><ul><li><a href=x>Linked item one</a></li><li>short</li></ul></article></body>'
    assert html_extraction.main_text(page) == "Title\nThe formula E is good and long enough.\nLinked item one\nshort"
    assert html_extraction.main_text("<article><p>Kept text of a page, with an end.</p><!-- not closed <p>gone</p> > x") == "Kept text of a page, with an end."
    assert html_extraction.main_text("<article><p>Kept text of a page, with an end.</p><script>a > b; <p>gone</p> x") == "Kept text of a page, with an end."


def test_generated_pages_give_their_article():
    r = random.Random(8)
    sentence = lambda n: " ".join(r.choice(["river", "stone", "house", "green", "under", "walks", "seven"]) for _ in range(n)).capitalize() + "."
    for _ in range(40):
        want, body = [], []
        for _ in range(r.randrange(2, 9)):
            want.append(sentence(r.randrange(8, 40)))
            body.append(r.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<blockquote>{}</blockquote>", "<p><b>{}</b></p>"]).format(want[-1].replace("stone", "<i>stone</i>")))
            if r.random() < 0.3:
                body.append(f'<div class="{r.choice(["ad-box", "related", "share social"])}">{sentence(6)}</div>')
        noise = [f"<nav><ul><li><a href=x>{sentence(2)}</a></ul></nav>", f'<div class="cookie-notice"><p>{sentence(12)}</p></div>', f"<aside>{sentence(9)}</aside>", f"<footer><p>{sentence(9)}</p></footer>", f'<div id="comments"><p>{sentence(20)}</p></div>', f"<form>{sentence(5)}</form>"]
        r.shuffle(noise)
        page = "<html><body>" + "".join(noise[:3]) + "<article>" + "".join(body) + "</article>" + "".join(noise[3:]) + "</body></html>"
        assert html_extraction.main_text(page) == "\n".join(want)


# Languages


def grams(text):
    for w in language_id.WORDS.findall(text.lower()):
        for n in range(1, language_id.N_MAX + 1):
            for k in range(len(w) + 3 - n):
                if (g := f" {w} "[k : k + n]) != " ":
                    yield g


def code(g):
    """The hash of one n-gram, from a word that has it."""
    word = g.strip(" ")
    flat, _ = language_id._grams([word], language_id.N_MAX)
    return dict(zip(grams(word), sorted_like(word, flat), strict=True))[g]


def sorted_like(word, flat):
    """_grams lists the n-grams of a word by n and place, as grams() does."""
    return [int(x) for x in flat]


def test_out_of_place_distance_equals_a_plain_version(spark):
    r, rows = random.Random(3), []
    voc = {"aa": ["haus", "garten", "über", "x", "straße", "ding"], "bb": ["house", "garden", "thing", "x", "under"], "cc": ["maison", "été", "jardin", "sous"]}
    for i in range(60):
        lang = r.choice(list(voc))
        rows.append((i, " ".join(r.choice(voc[lang]) for _ in range(r.randrange(1, 30))), lang))
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    size = 40
    profiles = {}
    for lang in voc:
        sums = Counter(g for _, t, x in rows if x == lang for g in grams(t))
        profiles[lang] = sorted(sums, key=lambda g: (-sums[g], code(g)))[:size]
    learned = language_id.learn(df, profile_size=size)
    assert learned == {k: [code(g) for g in v] for k, v in profiles.items()}
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.identify(df, learned, profile_size=size).collect()}
    for i, t, _ in rows:
        sums = Counter(grams(t))
        top = sorted(sums, key=lambda g: (-sums[g], code(g)))[:size]
        far = {k: sum(abs(v.index(g) - j) if g in v else size for j, g in enumerate(top)) for k, v in profiles.items()}
        best, second = sorted(far.values())[:2]
        assert got[i][0] == min(far, key=lambda k: (far[k], k)) and abs(got[i][1] - (second / (second + best) if second else 0.5)) < 1e-12


@pytest.mark.skipif(not SF.exists(), reason="no driver tables here")
def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", language_id.held_out())
    profiles = language_id.learn(docs.where("NOT held_out"))
    seen = language_id.identify(docs.where("held_out AND lang IS NOT NULL AND text RLIKE '[a-z]'"), profiles)
    right, n = seen.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.98


# Toxicity


def test_kernel_equals_a_direct_sum():
    def phi(w):
        w, out = f"\x02{w}\x03", Counter()
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    words = ["idiot", "i d", "idxiot", "ab", "mississippi", "ünï"]
    at, codes, values = toxicity.features(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = phi(a), phi(b)
            want = sum(x[c] * y[c] for c in x) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            p, q = (dict(zip(codes[at == n].tolist(), values[at == n].tolist(), strict=True)) for n in (i, j))
            assert abs(sum(p[c] * q.get(c, 0) for c in p) - want) < 1e-12


def test_short_pieces_are_joined():
    assert "moron" in toxicity.strings("you mo ro n there") and "idiot" in toxicity.strings("i.d i o t")
    assert toxicity.strings("it is the house") == ["the", "house"]


@pytest.mark.skipif(not SF.exists(), reason="no driver tables here")
def test_toxicity_of_held_out_documents(spark):
    from pyspark.sql.functions import col

    out = toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic").where(col("toxic").isNotNull())
    rows = out.join(labels, "doc_id").select("toxic", "score", "predicted").collect()
    bad, good = ([r for r in rows if r["toxic"] == x] for x in (1, 0))
    above = sum((b["score"] > g["score"]) + 0.5 * (b["score"] == g["score"]) for b in bad for g in good) / len(bad) / len(good)
    assert above > 0.9 and sum(r["predicted"] for r in bad) > 0.8 * len(bad) and sum(r["predicted"] for r in good) < 0.03 * len(good)


def test_user_columns_survive_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, k string, n string, first string, _k string, _n string, _i string"
    docs = spark.createDataFrame([(i, f"the house number {i} stands near the river where people walk " * 3, "en", "s", 1, *"abcdef") for i in range(6)], schema)
    spark.createDataFrame([(1, "nothing of the sort")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated, corpus_pipeline.mix_sources):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {tuple("abcdef")}
