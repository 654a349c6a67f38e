"""Pages with nested lists, several and nested tables, unclosed tags and character references."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from factloom.sources import markup, pages


def frame(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id int, html string")


def rows(df, *columns):
    return sorted((tuple(list(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect()), key=repr)


def test_text_after_an_inner_list_is_its_own_item_s(spark):
    t = pages.structural_blocks(frame(spark, "<ul><li>A<ul><li>B</li></ul>tail</li></ul><p>one</p>loose<ol><li>x<li>y</ol>"))
    assert rows(t, "block_ord", "tok_ord", "text", "depth", "parent_block", "ancestry", "block_tag") == sorted(
        [
            (1, 1, "A", 1, None, ["unordered_list[0]"], "li"), (2, 1, "B", 2, 1, ["unordered_list[0]", "unordered_list[0]"], "li"), (1, 2, "tail", 1, None, ["unordered_list[0]"], "li"), (3, 1, "one", 0, None, [], "p"),
            (0, 1, "loose", 0, None, [], "root"), (4, 1, "x", 1, None, ["ordered_list[0]"], "li"), (5, 1, "y", 1, None, ["ordered_list[1]"], "li"),
        ],
        key=repr,
    )


def test_references_icons_and_empty_units(spark):
    html = '<div class="d big">See <a href="/w/X#y" title="X &amp; co">the <b>X</b></a><img alt="Fire" src=f.png><br>caf&eacute; &#8212; &#x1F642;</div><div class=d></div><p>out</p>'
    t = pages.structural_blocks(frame(spark, html), unit="d")
    assert rows(t, "unit_no", "block_ord", "tok_ord", "kind", "text", "href", "title") == [
        (0, 0, 1, "text", "See", None, None), (0, 0, 2, "reference", "the X", "/w/X#y", "X & co"), (0, 0, 3, "icon", "Fire", None, None), (0, 0, 4, "line_break", "", None, None), (0, 0, 5, "text", "café — 🙂", None, None),
        (1, 0, 1, "diagnostic", "empty structural description", None, None),
    ]
    assert rows(pages.structural_blocks(frame(spark, None, "", "<p></p>")), "unit_id", "kind") == [(0, "diagnostic"), (1, "diagnostic"), (2, "diagnostic")]


def test_units_begin_anew(spark):
    html = "<ul><li>before<div class=u>in<ul><li>a</li></ul></div>after</li></ul>"
    t = pages.structural_blocks(frame(spark, html), unit="u")
    assert rows(t, "text", "block_tag", "depth", "ancestry", "parent_block") == [("a", "li", 1, ["unordered_list[0]"], None), ("in", "root", 0, [], None)]


def test_grid_units_and_their_diagnostics(spark):
    grid = lambda x: f'<div class="g">{x}</div>'
    html = "<h2>Skills <i>now</i></h2>" + grid('<div class="n">Slash</div><div class="t">Hits <a href=x>hard</a>.</div>') + grid('<div class="n">Broken</div>') + grid('<div class="t">no name</div>') + '<article title="Stellar">' + grid('<span class="n">Burn</span><p class="t">Fire</p>') + "</article>" + grid('<div class="n">Skill Name</div><div class="t">Text</div>')
    assert rows(pages.grid_units(frame(spark, html), "g", "n", "t"), "entry_no", "title", "description", "section", "reason") == [
        (0, "Slash", "Hits hard .", "Skills now", None), (1, "Broken", "", "Skills now", "missing_description"), (2, "", "no name", "Skills now", "missing_title"), (3, "Burn", "Fire", "Stellar", None), (4, "Skill Name", "Text", "Skills now", "missing_description"),
    ]


def test_headers_hold_for_their_own_table(spark):
    html = "<table><tr><th>Name</th><th>HP</th></tr><tr><td>cup</td><td>1</td></tr></table><table><tr><th>HP</th><th>Name</th></tr><tr><td>2</td><td>tea</td></tr></table>"
    fields = [pages.Field("name", header="name"), pages.Field("hp", header="hp", type="int")]
    assert rows(pages.extract_rows(frame(spark, html), fields), "row_no", "name", "hp", "diagnostics") == [(1, "cup", 1, []), (3, "tea", 2, [])]


def test_inner_tables_stay_in_their_cell(spark):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>outer <table><tr><th>A</th></tr><tr><td>in</td></tr></table> end</td><td>second</td></tr></table>"
    fields = [pages.Field("a", header="a"), pages.Field("b", header="b")]
    assert rows(pages.extract_rows(frame(spark, html), fields), "a", "b") == [("in", None), ("outer A in end", "second")]


def test_spans(spark):
    html = '<table><tr><th>Kind</th><th colspan=2>Stats</th><th>Note</th></tr><tr><td rowspan="2">sword</td><td>1</td><td>2</td><td>x</td></tr><tr><td>3</td><td>4</td><td>y</td></tr><tr><td>axe</td><td>5</td><td>6</td><td rowspan=9>z</td></tr></table>'
    fields = [pages.Field("kind", header="kind"), pages.Field("stats", header="stats"), pages.Field("note", header=["remark", "note"]), pages.Field("third", position=2)]
    assert rows(pages.extract_rows(frame(spark, html), fields), "kind", "stats", "note", "third") == [("axe", "5", "z", "6"), ("sword", "1", "x", "2"), ("sword", "3", "y", "4")]


def test_unclosed_tags_and_header_fallback(spark):
    html = "<table><tr><th>Weapon type<th>Lv.<tr data-id=7><td>bow<td>12<tr><td>rod<td>n/a</table>"
    fields = [pages.Field("id", attr="data-id"), pages.Field("type", header=("category", "type")), pages.Field("lv", header="lv", type="int")]
    assert rows(pages.extract_rows(frame(spark, html), fields), "id", "type", "lv", "diagnostics") == [("7", "bow", 12, []), (None, "rod", None, ["lv"])]
    assert rows(pages.extract_rows(frame(spark, "<li data-id=4>x<li>y"), [pages.Field("id", attr="data-id", type="int")], row="li"), "row_no", "id") == [(0, 4)]


def test_repeated_pages_keep_their_rows(spark):
    html = "<table><tr><td>1</td></tr></table>"
    df = spark.createDataFrame([(1, html), (1, html), (None, html)], "page_id int, html string")
    assert rows(pages.extract_rows(df, [pages.Field("v", position=0)]), "page_id", "v") == [(1, "1"), (1, "1"), (None, "1")]


def test_character_references_in_blocks(spark):
    b = pages.page_blocks(frame(spark, "<p>caf&eacute; &#8212; &amp;lt; &nbsp; x</p>"))
    assert rows(b, "text") == [("café — &lt; x",)]


class Stack(HTMLParser):
    """What stands where, by a plain stack; for pages that close what they open."""

    def __init__(self):
        super().__init__()
        self.open, self.out, self.blocks, self.place = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.place += 1
        if tag == "br":
            return self.add("line_break", "")
        if tag in markup.BLOCK_TAGS:
            self.blocks += 1
        number = None
        if tag == "li":
            holder = next(x for x in reversed(self.open) if x["tag"] in ("ul", "ol"))
            number, holder["n"] = f"{'un' * (holder['tag'] == 'ul')}ordered_list[{holder['n']}]", holder["n"] + 1
        self.open.append({"tag": tag, "block": self.blocks if tag in markup.BLOCK_TAGS else None, "n": 0, "name": number})

    def handle_endtag(self, tag):
        assert self.open.pop()["tag"] == tag

    def handle_data(self, data):
        if data.strip():
            self.add("text", data.strip())

    def add(self, kind, text):
        block = next((x for x in reversed(self.open) if x["block"]), None)
        outside = self.open[: self.open.index(block)] if block else []
        item = next((x["block"] for x in reversed(outside) if x["tag"] == "li"), None)
        self.out.append((kind, text, block["block"] if block else 0, block["tag"] if block else "root", sum(x["tag"] in ("ul", "ol") for x in self.open), item, [x["name"] for x in self.open if x["name"]]))


@pytest.mark.parametrize("seed", range(3))
def test_random_nested_pages_against_a_plain_stack(spark, seed):
    r, word = random.Random(seed), iter(range(10**6))

    def inside(depth):
        parts = []
        for _ in range(r.randrange(1, 4)):
            k = r.random()
            if depth > 5 or k < 0.35:
                parts.append(f"w{next(word)}")
            elif k < 0.6:
                tag = r.choice(["ul", "ol"])
                parts.append(f"<{tag}>" + "".join(f"<li>{inside(depth + 1)}</li>" for _ in range(r.randrange(1, 4))) + f"</{tag}>")
            elif k < 0.9:
                tag = r.choice(["div", "section", "b", "blockquote", "span"])
                parts.append(f"<{tag}>{inside(depth + 1)}</{tag}>")
            else:
                parts.append("<br>")
        return " ".join(parts)

    html = [inside(0) for _ in range(40)]
    want = []
    for k, h in enumerate(html):
        p = Stack()
        p.feed(h)
        p.close()
        want += [(k, *x) for x in p.out]
    got = rows(pages.structural_blocks(frame(spark, *html)).where("kind != 'diagnostic'"), "unit_id", "kind", "text", "block_ord", "block_tag", "depth", "parent_block", "ancestry")
    assert got == sorted(want, key=repr)


def test_intervals_nest(spark):
    n = markup.nodes(frame(spark, "<div><p>a<b>b</b></p><p>c<ul><li>d</ul></div>")).where("kind = 'element'").collect()
    by = {r["node"]: r for r in n}
    assert all(r["parent"] == 0 or by[r["parent"]]["node"] < r["node"] and r["until"] <= by[r["parent"]]["until"] for r in n)


def test_long_flat_and_deep_pages(spark):
    flat, deep = "<p>x<td>" * 20_000, "<div><ul><li>" * 300 + "x"
    t = pages.structural_blocks(frame(spark, flat, deep))
    assert t.where("unit_id = 0").count() == 20_000 and [r["depth"] for r in t.where("unit_id = 1").collect()] == [300]


def test_references_without_a_semicolon_stay(spark):
    b = pages.page_blocks(frame(spark, "<h1>R &amp; D &eacute; &#65; &amp;lt; &nosuch; &ampx; cut&amp</h1>"))
    assert rows(b, "text") == [("R & D é A &lt; &nosuch; &ampx; cut&amp",)]


def test_parsing_shuffles_nothing_within_a_page(spark):
    df = frame(spark, "<table><tr><th>A<tr><td rowspan=2>x<td>y<tr><td>z</table><p>t")
    for got in (pages.extract_rows(df, [pages.Field("a", header="a")]), pages.structural_blocks(df)):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan and "Repartition" not in plan


def test_nodes_make_the_asked_columns_alone(spark):
    n = markup.nodes(frame(spark, "<div class=u>a<p>b</p></div>"), ("u",), elements="marked", columns=("node", "kind", "text"))
    assert n.columns == ["page_id", "page", "node", "kind", "text"]
    assert rows(n, "node", "kind", "text") == [(1, "element", None), (2, "text", "a"), (4, "text", "b")]


def test_pages_of_one_template_are_walked_once(spark):
    """Texts, attributes and icons are each page's own; a cell that is empty, or has another span, is another structure."""
    made = []
    read = markup._Reader((), None, lambda said, shapes: made.append(shapes) or len(made))
    row = "<table><tr data-x={}><td colspan={}>{}</td><td>b</table>"
    got = [read(row.format(*x))[0] for x in [(1, 1, "a"), (2, 1, "c &amp; d"), (1, 2, "a"), (1, 1, ""), (1, 1, "&nbsp;"), (3, 1, "<img alt=i>"), (3, 1, "<img alt=''>")]]
    assert got == [1, 1, 2, 3, 3, 4, 5] and len(made) == 5
    html = ["<p>{} <a href=/{}>{}</a><img alt={}><h2>{}</h2>t".format(*f"abcde{k}" if k else "vwxyz") for k in range(3)]
    n = markup.nodes(frame(spark, *html).coalesce(1), elements="", columns=("kind", "attrs", "text", "section"))
    assert rows(n, "page_id", "kind", "text", "section") == sorted(
        [(p, "icon", d, None) for p, d in enumerate("ydd")] + [(p, "reference", c, None) for p, c in enumerate("xcc")] + [(p, "text", t, None) for p, a in enumerate("vaa") for t in (a,)]
        + [(p, "text", e, None) for p, e in enumerate("zee")] + [(p, "text", "t", e) for p, e in enumerate("zee")]
    )


def test_cells_are_found_past_gaps_and_ties(spark):
    """Spans leave columns without a cell, and overlapping ones put two cells in one column: the first by text counts."""
    html = "<table><tr><th>a<th>b<th>c<tr><td colspan=2>wide<td>x</table><table><tr><th>a<th>b<th>c<tr><td>1<td rowspan=3>low<td>3<tr><td colspan=2>over<tr><td>5<td>in<td>6</table>"
    fields = [pages.Field(c, header=c) for c in "abc"]
    assert rows(pages.extract_rows(frame(spark, html), fields), "row_no", "a", "b", "c") == [(1, "wide", None, "x"), (3, "1", "low", "3"), (4, "over", "low", None), (5, "5", "in", "6")]


def test_record_types_read_pages_once(spark):
    html = "<table><tr><th>Name<th>MP<tr data-lv=3><td>N1<td>7 MP<tr data-lv=x><td>N2<td>none</table>"
    specs = {"active": [pages.Field("name", header="name"), pages.Field("mp", header="mp", type="int")], "passive": [pages.Field("level", attr="data-lv", type="int"), pages.Field("name", header="name")]}
    out = pages.skill_rows(frame(spark, html), specs)
    assert out.columns == ["page_id", "row_no", "name", "mp", "diagnostics", "record_type", "level", "gated"]
    assert rows(out.withColumn("d", F.concat_ws(",", "diagnostics")), "row_no", "record_type", "name", "mp", "level", "d") == [(1, "active", "N1", 7, None, ""), (1, "passive", "N1", None, 3, ""), (2, "active", "N2", None, None, "mp"), (2, "passive", "N2", None, None, "level")]
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_single_attributes_are_columns(spark):
    n = markup.nodes(frame(spark, "<a href='/x?a=1&amp;b=2' title=''>t</a> u<img alt=i href=z>"), elements="", columns=("kind", "@href", "@title"))
    assert n.columns == ["page_id", "page", "kind", "@href", "@title"]
    assert rows(n, "kind", "@href", "@title") == [("icon", "z", None), ("reference", "/x?a=1&b=2", ""), ("text", None, None)]
