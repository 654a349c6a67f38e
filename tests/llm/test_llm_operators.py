"""The operators against brute force, on small texts with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import decontaminate, html_extraction, language_id, license_scan, mixing, quality_rules, simhash, suffix_dedup, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, key string, score string, lang_pred string, slice string"


def words(seed, n, vocabulary=60):
    r = random.Random(seed)
    return " ".join(r.choice(["ba", "ko", "ri", "ta", "mu", "le"]) + r.choice(["n", "s", "rt", "lo"]) + str(r.randrange(vocabulary)) for _ in range(n))


def texts():
    base = words(1, 120)
    near = base.replace(" ", "  ", 1)
    edited = base.split()
    edited[60] = "changed"
    long = words(2, 9000, 5000)
    return [
        (1, base), (2, base), (3, near), (4, " ".join(edited)), (5, None), (6, ""), (7, "   \n\t "), (8, "Word"), (9, "ünï cödé 漢字   \xa0x"), (10, long), (10, long),
        (None, words(3, 40)), (None, None), (11, "tie " * 200), (12, "tie " * 200 + "x"), (13, "<|endoftext|> don't we're\r\n 12 ½"), (14, words(5, 30) + " " + base + " " + words(6, 30)), (15, "a" * 3000),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i != 6 else None, ["s1", None, "s2"][(i or 0) % 3], "k", "s", "p", "x") for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def bench(spark):
    base = words(1, 120).split()
    return spark.createDataFrame([(1, " ".join(base[10:40])), (2, " ".join(base[50:54])), (3, None), (4, ""), (5, "TIE tie"), (6, "never seen words here at all in any of the given documents")], "item_id long, text string")


def contaminated(items):
    """(id, words, words hit, items found) of texts(); null names count for hits only."""
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = token(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = []
    for i, t in texts():
        w, hit, names = token(t), set(), set()
        for g, ids in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    names |= ids
        want.append((i, len(w), len(hit), sorted(str(x) for x in names if x is not None)))
    return want


def test_decontamination_equals_brute_force(spark, docs, empty):
    index = decontaminate.build_index(docs, decontaminate.Scratch(spark, "t"), segment=100)
    more = spark.createDataFrame([(9, "漢字 \xa0X"), (None, words(3, 40)), (None, "tie tie tie"), (12, "Tie tie tie"), (9, words(2, 60, 5000))], "item_id long, text string")
    for items in (bench(spark), more):  # two benchmarks over one index
        want = contaminated([tuple(r) for r in items.collect()])
        assert sum(r[2] > 0 for r in want) > 3
        for block in (decontaminate.BLOCK, 15):  # phrases sent to all segments, and met by them
            got = decontaminate.digest(decontaminate.find(index, decontaminate.phrases(items), block=block)).select("doc_id", "n_words", "n_hit", "items")
            same(got.collect(), want)
    assert decontaminate.digest(decontaminate.search(empty, bench(spark))).count() == 0
    assert decontaminate.digest(decontaminate.search(docs, bench(spark).limit(0))).where("contaminated").count() == 0


def test_proximity_allows_words_in_between(spark):
    d = spark.createDataFrame([(1, "one two x three"), (2, "one x y z two three"), (3, "three two one")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    hits = lambda slop: sorted(r["doc_id"] for r in decontaminate.digest(decontaminate.search(d, q, slop=slop)).where("contaminated").collect())
    assert hits(0) == [] and hits(1) == [1] and 2 in hits(3)


def test_mixing_fills_budgets(spark, docs, empty):
    got = mixing.mix(docs).collect()
    per = {}
    for r in got:
        per.setdefault(r["source"], []).append(r)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in per.items()}
    total, w = sum(sizes.values()), {"s1": 3, "s2": 1, None: 2}
    target = dict.fromkeys(sizes, 0.0)
    open_, rest = set(sizes), 1.5 * total
    while True:
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_ -= full
    for s, rs in per.items():
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 2 * r["size"] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - target[s]) <= 1
    same(mixing.mix(docs, slice_digits=1).collect(), got)
    assert mixing.mix(empty).count() == 0


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(docs, empty):
    t = texts()
    prints = [fingerprint(x) for _, x in t]
    roots = components(prints)
    least = {}
    for r, (i, _) in zip(roots, t, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    got = simhash.groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    same(got, [(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(t, prints, roots, strict=True)])
    assert simhash.groups(empty).count() == 0
    kept = simhash.keep_one(docs).select("doc_id", "text").collect()
    assert len(kept) == len(set(roots))


def test_simhash_links_in_dense_groups(spark):
    r = random.Random(4)
    prints = []
    for _ in range(6):
        centre = r.getrandbits(64)
        prints += [centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for _ in range(150)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3
        root[find(a)] = find(b)
    want = components(prints)
    pairs = lambda ids: {frozenset(i for i, x in enumerate(ids) if x == y) for y in set(ids)}
    assert pairs([find(p) for p in signed]) == pairs(want)


def gone_bytes(t):
    """Of (id, bytes) rows: (id, size, runs, bytes left)."""
    n, seen = suffix_dedup.LENGTH, Counter()
    for _, b in t:
        seen.update(b[k : k + n] for k in range(len(b) - n + 1))
    out = []
    for i, b in t:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        out.append((i, len(b), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def shared_words(t):
    """Words under runs of WORDS words that a row of another id or text has."""
    n, owners, split = suffix_dedup.WORDS, {}, [(i, b, b.split()) for i, b in t]
    for i, b, w in split:
        for k in range(len(w) - n + 1):
            owners.setdefault(tuple(w[k : k + n]), set()).add((i, b))
    out = []
    for i, _, w in split:
        hit = set()
        for k in range(len(w) - n + 1):
            if len(owners[tuple(w[k : k + n])]) > 1:
                hit |= set(range(k, k + n))
        out.append((i, len(hit)))
    return out


def check_suffixes(spark, rows, limits=suffix_dedup.Limits()):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    t = [(i, (x or "").encode()) for i, x in rows]
    got = suffix_dedup.repeats(df, limits=limits).collect()
    same([(r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in got], gone_bytes(t))
    same([(r["doc_id"], sum(s["to"] - s["from"] for s in r["passages"])) for r in got], shared_words(t))


def test_suffix_dedup_equals_brute_force(spark, empty):
    check_suffixes(spark, texts())
    assert suffix_dedup.repeats(empty).count() == 0


def test_suffix_dedup_without_passages(spark):
    df = spark.createDataFrame(edited_copies(), "doc_id long, text string")
    key = lambda r: (r["doc_id"], r["n_bytes"], tuple(r["spans"]), bytes(r["kept"]))
    both = [suffix_dedup.repeats(df, passages=p).collect() for p in (True, False)]
    assert sorted(map(key, both[0]), key=repr) == sorted(map(key, both[1]), key=repr)
    assert any(r["passages"] for r in both[0]) and not any(r["passages"] for r in both[1])


def edited_copies():
    """Near copies with edits of their own, copies of some, a line with ever other words around it, and repeats within a text."""
    r, base, line = random.Random(9), words(21, 400, 900).split(), words(22, 45, 900)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(1, 9)):
            w[r.randrange(len(w))] = f"edit{r.randrange(40)}"
        rows.append((i, " ".join(w[: r.choice([400, 400, 250])])))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 40, 3)] + [(5, rows[5][1])]
    rows += [(2000 + i, f"{words(100 + i, 12, 10**6)} {line} {words(300 + i, 12, 10**6)}") for i in range(120)]
    rows += [(3000, f"{line} {words(31, 30)} {line} {words(31, 30)}"), (3001, "ab " * 200), (3002, "ab " * 90 + "c"), (3003, " ".join(words(40, 55))), (3004, "x  " + words(41, 70) + "\n\t y"), (3005, words(41, 70))]
    return rows


@pytest.mark.parametrize("limits", [{}, {"sorted": 30, "largest": 40}, {"sorted": 5, "largest": 3, "held": 500}, {"heavy": 8, "heavy_all": 20}, {"largest": 4, "heavy": 8, "heavy_all": 20, "parts": 3}], ids=["sorted", "split", "split often", "heavy", "heavy and split often"])
def test_anchors_of_many_contexts_are_split(spark, limits):
    check_suffixes(spark, edited_copies(), suffix_dedup.Limits(**limits))


def test_suffix_sort_orders_and_verifies():
    for unit in suffix_dedup.UNITS:
        r = random.Random(3)
        width = 1 if unit is suffix_dedup.BYTES else 8
        symbols = lambda n: b"".join(r.randrange(97, 99).to_bytes(width, "little") for _ in range(n))  # noqa: B023, E731
        shared = symbols(unit.k)
        left = [symbols(r.randrange(0, 7)) for _ in range(60)]
        texts_ = [x + shared + symbols(r.randrange(0, 10)) for x in left]
        group = np.sort(np.array([i % 3 for i in range(60)]))
        c = suffix_dedup._Contexts(texts_, np.array(list(map(len, left))) // width, suffix_dedup._BASES[0], unit)
        cells = lambda x: [x[i : i + width] for i in range(0, len(x), width)]  # noqa: B023, E731
        for right in (True, False):
            order = c.sort(group, right)
            side = [cells(x[len(l) + unit.k * width :]) if right else cells(l)[::-1] for x, l in zip(texts_, left, strict=True)]
            for g in range(3):
                at = np.flatnonzero(group == g)
                assert [side[i] for i in order[at]] == sorted(side[i] for i in at)
            assert c.neighbours(group, order, right) is not None


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = token_files.vocabulary_file()
    tok = Tokenizer.from_file(path)
    spec = open(path, encoding="utf-8").read()
    ids = token_files.Scratch(spark, "t").save(token_files.tokenize(docs, spec), "ids")
    token_files.write(ids, str(tmp_path / "f"), token_files.encoder(spec).size, block=500)
    got = sorted(token_files.read(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys)
    start = 0
    for r in got:
        assert r["start"] == start
        start += len(r["ids"])
    encode = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 0]
    same([(r["doc_id"], list(r["ids"])) for r in got], [(i, encode(t)) for i, t in texts()])
    sums = token_files.checksums(spark, str(tmp_path / "f")).select("doc_id", "n_tokens", "ids_crc32").collect()
    same(sums, [(i, len(encode(t)), zlib.crc32(np.array(encode(t), "<u4").tobytes())) for i, t in texts()])
    assert token_files.roundtrip(empty, path).count() == 0


@pytest.mark.parametrize("counts", [[5], [1, 1], [0, 3, 9, 0, 1, 1, 2, 700], [2**k for k in range(30)]])
def test_huffman_lengths_are_a_limited_prefix_code(counts):
    n = token_files.code_lengths(np.array(counts), 8)
    used = n[n > 0]
    assert n.max() <= 8 and (len(used) < 2 or sum(2.0**-x for x in used) == 1.0)
    ids = np.random.default_rng(1).choice(np.flatnonzero(counts), 1000)
    bits, marks = token_files.pack(ids, token_files.canonical(n), n)
    assert np.array_equal(token_files.Decoder(n)(bits, marks, 1000), ids)


def test_quality_rules_repeats_equal_brute_force(docs, empty):
    def repeat(w):
        grams, hit = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
        for k in range(len(w) - 7):
            if grams[tuple(w[k : k + 8])] > 1:
                hit |= set(range(k, k + 8))
        return len(hit)

    want = []
    for i, t in texts():
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeat(w), len(w) < 20 or 100 * repeat(w) > 30 * len(w)))
    got = quality_rules.rate(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same(got, want)
    assert quality_rules.rate(empty).count() == 0


def test_language_id(spark, docs, empty):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden with that thing", "en"), ("das haus und der garten mit dem ding", "de")] * 10)]
    p = language_id.learn(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in language_id.identify(spark.createDataFrame([("the garden and a house",), ("der garten und ein haus",), (None,), ("12 !!",), ("",)], "text string"), p).collect()}
    assert got["the garden and a house"][0] == "en" and got["der garten und ein haus"][0] == "de"
    assert got[None] == got["12 !!"] == got[""] == ("und", 0.0)
    every = language_id.identify(docs, p)
    assert every.count() == len(texts()) and every.where("score < 0 OR score > 1").count() == 0
    assert set(r["lang_pred"] for r in language_id.identify(docs, language_id.learn(empty)).collect()) == {"und"}


def test_ngrams_equal_brute_force():
    flat, size = language_id._grams(["ab", "ünd", "x"], 3)
    assert list(size) == [2 + 3 + 2, 3 + 4 + 3, 1 + 2 + 1]
    again, _ = language_id._grams(["x"], 3)
    assert list(flat[-4:]) == list(again)


def test_toxicity_learns_and_tolerates_insertions(spark, docs, empty):
    r = random.Random(2)
    clean = lambda: " ".join(r.choice(["garden", "house", "tree", "window", "table", "river", "mountain"]) for _ in range(8))
    rows = [(i, clean() + (" you " + r.choice(["grumblewort", "snotlinger"]) + " " + clean() if i % 3 == 0 else "") + ".", int(i % 3 == 0)) for i in range(150)]
    m = toxicity.learn(spark.createDataFrame(rows, "doc_id int, text string, label int"))
    bad, odd, good = m(["grumblewort", "grumxblewort", "garden"])
    assert bad > 0.5 and odd > 0 and good < 0
    t = spark.createDataFrame([(1, "a g r u m b l e w o r t here"), (2, "the garden"), (3, None), (4, "")], "doc_id int, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(t, m).collect()}
    assert got[1] > got[2] and got[3] == got[4] and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(docs, m).count() == len(texts())
    assert toxicity.learn(empty.withColumn("label", F.lit(1))) is None
    assert {r["score"] for r in toxicity.score(t, None).collect()} == {0.0}


def test_html_extraction(spark):
    page = (
        "<html><head><title>t</title><script>if (a<b) x('<p>no</p>')</script></head><body><header><p>The site of all sites, welcome to it.</p></header><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies to serve you.</div>"
        "<article><h1>Head &amp; line</h1><p>First   paragraph,\n which is long enough to read and ends.</p><div class=ad>Buy the best thing that money can buy now.</div><p>Short one.</p></article>"
        "<div id=comments><p>I really liked this article, thank you so much for it.</p></div><form>Mail <input></form><footer>&copy; us</footer></body></html>"
    )
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "no markup, but a sentence that is long enough to be kept."), (4, "u", "<p>unclosed <!-- x")], "page_id int, url string, html string")
    got = sorted(((r["page_id"], r["text"]) for r in html_extraction.extract(df).collect()), key=repr)
    assert (1, "Head & line\nFirst paragraph, which is long enough to read and ends.\nShort one.") in got
    assert (2, "") in got and (3, "") in got and len(got) == 5


def test_cut_equals_exhaustive_search():
    r = random.Random(5)
    for _ in range(60):
        n = r.randrange(1, 8)
        odds = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 1.5)) for a in range(n) for b in range(a) if r.random() < 0.5]
        cost = lambda s: sum(max(0, o) for o, x in zip(odds, s, strict=True) if not x) + sum(max(0, -o) for o, x in zip(odds, s, strict=True) if x) + sum(w for a, b, w in edges if s[a] != s[b])  # noqa: B023, E731
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert abs(cost(html_extraction.cut(odds, edges)) - best) < 1e-9


def test_license_scan(spark, docs, empty):
    t = license_scan.TEMPLATES
    d = spark.createDataFrame([(1, "x " * 30 + t["MIT"].replace("charge", "cost") + " y"), (2, "nothing here"), (3, None), (4, t["MIT-notice"] + " and then " + t["MIT-notice"].upper())], "doc_id int, text string")
    got = sorted((r["doc_id"], r["license"], r["from_char"] > 0) for r in license_scan.scan(d).collect())
    assert got == [(1, "MIT", True), (4, "MIT-notice", False), (4, "MIT-notice", True)]
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(empty).count() == 0


def test_hashing_of_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
