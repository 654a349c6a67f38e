"""Selection by counting, breadth-first search with packed roots, exact quotes and bounded references against plain versions."""

import random

import pytest

from factloom.operators import aggregate, refgraph


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_quantiles_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr(aggregate, "BINS", 4)
    r = random.Random(2)
    groups = {"a": [r.gauss(0, 1e6) for _ in range(300)], "ties": [5.0] * 99 + [7.0] * 2, "one": [3.0], "two": [-1.0, 4.0], None: [float(r.randrange(4)) for _ in range(50)], "wide": [-1.7e308, 1e-300, 0.0, 1.7e308, 2.0], "gone": []}
    data = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None), ("gone", None), ("one", float("nan")), ("two", float("inf"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    got = {(x["g"], x["prob"]): x["value"] for x in aggregate.quantiles(df, ["g"], "v", [0.0, 0.5, 0.95]).collect()}
    want = {}
    for g, xs in groups.items():
        xs = sorted(xs)
        for p in (0.0, 0.5, 0.95) if xs else ():
            k = int(p * (len(xs) - 1))
            part = p * (len(xs) - 1) - k
            want[g, p] = (1 - part) * xs[k] + part * xs[min(k + 1, len(xs) - 1)]
    assert got == want


def test_distributions(spark):
    df = spark.createDataFrame([(1, None), (5, None), (2, None)], "a int, b double")
    assert rows(aggregate.distributions(df, ["a", "b"])) == [("a", 1.0, 2.0, 5.0), ("b", None, None, None)]


@pytest.mark.parametrize("seed,ceiling", [(1, 32), (2, 32), (3, 2)])
def test_topology_of_cyclic_graphs(spark, seed, ceiling):
    r = random.Random(seed)
    edges = {(r.randrange(120), r.randrange(120)) for _ in range(150)}
    roots = r.sample(range(140), 100)  # more than a word of roots, some outside the graph
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    depth, pages = 0, 0
    for root in roots:
        seen = front = {root}
        for d in range(1, ceiling + 1):
            front = {b for a in front for b in near.get(a, ())} - seen
            if not front:
                break
            seen, depth = seen | front, max(depth, d)
        pages = max(pages, len(seen))
    e = spark.createDataFrame(sorted(edges) + sorted(edges)[:5], "src int, dst int")
    got = refgraph.topology(spark.createDataFrame([(x,) for x in roots * 2], "root int").repartition(3), e, ceiling)
    assert rows(got, "n_edges", "depth", "pages", "out_degree") == [(len(edges), depth, pages, max(map(len, near.values())))]


def test_topology_without_edges_or_roots(spark):
    none = spark.createDataFrame([], "src int, dst int")
    assert rows(refgraph.topology(spark.createDataFrame([(1,)], "root int"), none)) == [(0, 0, 1, 0)]
    assert rows(refgraph.topology(spark.createDataFrame([], "root int"), none)) == [(0, 0, None, 0)]


def places(text, quote):
    t, q = (x.lower() if len(x.lower()) == len(x) else x for x in (text, quote))
    return [i for i in range(len(t)) if t.startswith(q, i)]


def test_quotes_equal_brute_force(spark):
    r = random.Random(9)
    words = ["aa", "a", "Fire", "fire", "x\\Eb", "$1.", "ünï", "(up)", "+50%", "it's", "漢字", "İz"]
    blocks = [(f"u{r.randrange(4)}", k, r.choice([" ", "  ", ""]).join(r.choice(words) for _ in range(r.randrange(0, 30)))) for k in range(40)] + [("u0", 90, None), ("u1", 91, "")]
    quotes = []
    for k in range(200):
        u, _, t = r.choice([b for b in blocks if b[2]])
        i = r.randrange(len(t))
        quotes.append((k, r.choice([u, "u0"]), t[i : i + r.randrange(1, 25)].swapcase() if r.random() < 0.3 else t[i : i + r.randrange(1, 25)]))
    quotes += [(300, "u0", ""), (301, "u0", "   "), (302, "u0", None), (303, "nowhere", "aa"), (304, "u0", "aaa")]
    want = []
    for k, u, q in quotes:
        q = " ".join((q or "").split())
        if not q:
            continue
        found = [(n, i) for v, n, t in blocks if v == u and t for i in places(t, q)]
        one = len(found) == 1
        want.append((k, found[0][0] if one else None, found[0][1] if one else None, found[0][1] + len(q) if one else None, len(found)))
    b, q = spark.createDataFrame(blocks, "unit_id string, block_ord int, text string"), spark.createDataFrame(quotes, "anchor_id int, unit_id string, quote string")
    assert rows(refgraph.quote_ranges(b, q), "anchor_id", "block_ord", "from", "to", "n") == sorted(want, key=repr)


def test_quotes_around_icons(spark):
    tokens = [("u", 1, 1, "text", "Gain"), ("u", 1, 2, "icon", "Fire Icon"), ("u", 1, 3, "reference", "fire zone"), ("u", 1, 4, "line_break", ""), ("u", 1, 5, "text", "for two turns"), ("u", 2, 1, "text", "for one turn")]
    t = spark.createDataFrame(tokens, "unit_id string, block_ord int, tok_ord int, kind string, text string")
    q = spark.createDataFrame([("whole", "u", "Fire Icon fire"), ("around", "u", "gain fire zone for"), ("twice", "u", "for"), ("part", "u", "o turns"), ("none", "u", "water")], "anchor_id string, unit_id string, quote string")
    got = {r["anchor_id"]: (r["block_ord"], r["from"], r["to"], r["tok_start"], r["tok_end"]) for r in refgraph.quote_anchors(t, q).collect()}
    #  Gain Fire Icon fire zone for two turns
    assert got == {"whole": (1, 5, 19, 2, 3), "around": (1, 0, 28, 1, 5), "twice": (None,) * 5, "part": (1, 31, 38, 5, 5), "none": (None,) * 5}


@pytest.mark.parametrize("seed", range(3))
def test_bounded_references_of_cyclic_graphs(spark, seed):
    r = random.Random(seed)
    units = [f"n{k}" for k in range(12)]
    refs = [(r.choice(units), f"o{k:03d}", f"http://x/{r.choice([*units, 'lost'])}") for k in range(60)]
    classes = [(u, r.choice(["combat", "combat", "excluded"])) for u in units]
    roots, limits = ["n0", "n1", "n5"], {"max_depth": 3, "max_pages": 5, "max_frontier": 6}
    kind, want = dict(classes), []
    for root in roots:
        seen, front = {root}, [root]
        for d in range(1, limits["max_depth"] + 2):
            here, count, new = sorted((u, o, url) for u, o, url in refs if u in front), 0, []
            for u, o, url in here:
                count += 1
                target = url.removeprefix("http://x/")
                target = target if target in units else None
                if d > limits["max_depth"]:
                    status = "depth_exhausted"
                elif target is None:
                    status = "unresolved"
                elif kind[target] == "excluded":
                    status = "excluded"
                elif target in seen or target in [t for t, _ in new]:
                    status = "visited"
                elif count > limits["max_frontier"]:
                    status = "frontier_exhausted"
                    new.append((target, False))
                elif len(seen) + sum(ok for _, ok in new) >= limits["max_pages"]:
                    status = "page_exhausted"
                    new.append((target, False))
                else:
                    status = "resolved"
                    new.append((target, True))
                want.append((root, o, d, target, status))
            front = [t for t, ok in new if ok]
            seen |= set(front)
    got = refgraph.resolve_bounded(spark.createDataFrame([(x,) for x in roots], "root string"), spark.createDataFrame(refs, "unit_id string, occurrence string, url string"), spark.createDataFrame([(f"http://x/{u}", u) for u in units], "url string, unit_id string"), spark.createDataFrame(classes, "unit_id string, class string"), **limits)
    assert rows(got, "root", "occurrence", "depth", "target", "status") == sorted(want, key=repr)
