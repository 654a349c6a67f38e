"""Queries on row entries, sections, coercions, packages, anchors and streams that are written out of the order tables.

Pages, blocks and texts are made from rows of the given tables, so that SQL can say from the rows alone what parsing them has to give.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import expr
from factloom.operators import aggregate, assemble, evaluate, ranked, reconcile, refgraph, resolve, rules, scoring, validate
from factloom.plans.common import Registry
from factloom.plans.contest import _CAPS, _FACT_SQL, _ROLES_SQL, _facts, _scores
from factloom.plans.web import REGIONS_SQL, _edges
from factloom.sources import pages, tables
from factloom.storage import Scratch, listed, table
from factloom.streaming import jobs

R = Registry()


def _q() -> Column:
    return F.col("l_quantity").cast("int")


def _flag() -> Column:
    return F.col("l_returnflag")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``n``: their place in the order, from 1."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w))


_LINES = "li AS (SELECT *, CAST(l_quantity AS INTEGER) AS q, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS n FROM lineitem)"


def _strung(df: DataFrame, key: str, order: str, *parts: Column) -> DataFrame:
    """(page_id, s0, s1, ...): for each of ``parts``, a key's values in order, put together; nulls are left out."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *(p.alias(f"p{k}") for k, p in enumerate(parts)))))
    g = df.groupBy(F.col(key).alias("page_id")).agg(lines.alias("x"))
    return g.select("page_id", *(F.concat_ws("", F.col("x")[f"p{k}"]).alias(f"s{k}") for k in range(len(parts))))


def _joined(df: DataFrame, key: str, order: str, part: Column, start: str, end: str) -> DataFrame:
    """(page_id, html): the parts of a key in order between a start and an end."""
    return _strung(df, key, order, part).select("page_id", F.concat(F.lit(start), "s0", F.lit(end)).alias("html"))


# Sources


@R.add(f"""WITH {_LINES} SELECT l_orderkey AS page_id, n AS row_no, l_linenumber AS line, CASE WHEN l_returnflag != 'R' THEN q * 1000 END AS price, CASE WHEN l_linestatus = 'F' THEN CAST(q AS DOUBLE) END AS share,
  l_returnflag = 'A' AS open, 'a & b ' || l_partkey AS part, CASE WHEN l_returnflag = 'R' AND l_linestatus != 'F' THEN 'price,share' WHEN l_returnflag = 'R' THEN 'price' WHEN l_linestatus != 'F' THEN 'share' ELSE '' END AS diagnostics FROM li""")
def extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables: an attribute, cells under headers and cells by place; prices and shares may be junk."""
    row = F.concat(F.lit('<TR class=x data-line="'), "l_linenumber", F.lit('"><td> a &amp;\n <b>b</b> '), "l_partkey", F.lit("</td><td>"), F.when(_flag() == "R", "n/a").otherwise(F.concat(_q(), F.lit(",000 G"))), F.lit("</td><td>"), F.when(F.col("l_linestatus") == "F", F.concat(_q(), F.lit("%"))).otherwise("much"), F.lit("</td><td>"), F.when(_flag() == "A", "Yes").otherwise("no"), F.lit("</td></TR>"))
    p = _joined(_lines(spark, sf_dir), "l_orderkey", "n", row, "<table><tr><th>Part</th><th> Price </th><th>Share</th><th>Open</th></tr>", "</table>")
    fields = [pages.Field("line", attr="data-line", header="share", type="int"), pages.Field("part", header="part"), pages.Field("price", attr="data-price", header="price", type="int"), pages.Field("share", position=2, type="double"), pages.Field("open", header="OPEN", type="bool")]
    return pages.extract_rows(p, fields).withColumn("diagnostics", F.concat_ws(",", "diagnostics"))


@R.add(f"""WITH {_LINES}, b AS (SELECT l_orderkey AS page_id, n AS ord, CASE WHEN q > 35 THEN 1 WHEN q > 20 THEN 2 END AS rank, l_returnflag AS t FROM li), a AS (SELECT page_id, ord AS a0, rank AS r FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS k FROM b WHERE rank IS NOT NULL AND t = 'R') WHERE k = 1),
  s AS (SELECT b.page_id, a0, min(CASE WHEN t = 'N' OR rank <= r THEN ord END) AS stop FROM a JOIN b ON a.page_id = b.page_id AND ord > a0 GROUP BY 1, 2)
  SELECT b.page_id, 'body' AS section_id, ord, t AS text, stop IS NOT NULL AS bounded FROM s JOIN b ON b.page_id = s.page_id AND ord > a0 AND (stop IS NULL OR ord < stop)""")
def bounded_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of headings and blocks: from the first heading R to the next N, or heading of its rank or above."""
    b = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("page_id"), F.col("n").alias("ord"), F.lit("p").alias("tag"), F.when(_q() > 35, 1).when(_q() > 20, 2).alias("rank"), F.concat(F.lit(" "), _flag()).alias("text"))
    anchors = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit("body").alias("section_id"), F.lit("r").alias("start"), F.lit("n ").alias("end"))
    return pages.bounded_sections(b, anchors).select("page_id", "section_id", "ord", F.trim("text").alias("text"), "bounded")


@R.add(f"""WITH {_LINES}, f AS (SELECT l_orderkey AS section_id, CASE l_returnflag WHEN 'A' THEN 'attack' WHEN 'N' THEN 'title' END AS field, CAST(q AS VARCHAR) AS value, n FROM li WHERE q > 10 AND l_returnflag != 'R')
  SELECT section_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY section_id, field ORDER BY n) AS k FROM f) WHERE k = 1""")
def labeled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(_flag() == "A", " ATK :").when(_flag() == "N", "Name").otherwise("unknown label")
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("section_id"), F.col("n").alias("ord"), label.alias("label"), F.when(_q() > 10, _q().cast("string")).when(_q() > 5, " ").alias("value"))
    return pages.labeled_fields(rows, listed(spark, [("atk", "attack"), ("name", "title")], "label string, field string"))


@R.add("""WITH t AS (SELECT conv_id AS section_id, string_agg(text, chr(10) ORDER BY turn, text) AS t FROM conversations WHERE length(text) >= 20 AND regexp_matches(lower(text), 'the|que|und') GROUP BY 1)
  SELECT section_id, substr(t, 1, 400) AS text, length(t) > 400 AS truncated FROM t""")
def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("section_id"), F.col("turn").alias("ord"), "text")
    return pages.section_text(b, ["the", "que", "und"], 20, 400)


@R.add(f"""WITH {_LINES}, t AS (SELECT o_orderkey AS section_id, unnest([1, 2, 3]) AS idx, unnest(['weak', 'resist', 'weak']) AS status FROM orders), c AS (SELECT l_orderkey AS section_id, l_linenumber AS idx, CASE WHEN q < 5 THEN 'unknown' WHEN l_returnflag = 'A' THEN 'fire' WHEN l_returnflag = 'R' THEN 'water' END AS v FROM li)
  SELECT t.section_id, status, coalesce(string_agg(DISTINCT v, ',' ORDER BY v), '') AS values, CASE WHEN count(c.section_id) = 0 OR bool_or(coalesce(v = 'unknown', false)) THEN 'unknown' WHEN count(v) = 0 THEN 'confirmed_empty' ELSE 'confirmed_values' END AS state FROM t LEFT JOIN c ON c.section_id = t.section_id AND c.idx = t.idx GROUP BY 1, 2""".replace(" AS values,", ' AS "values",'))
def affinity_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id"), F.explode(F.expr("array(struct(1 AS idx, 'weak' AS status), struct(2 AS idx, 'resist' AS status), struct(3 AS idx, 'weak' AS status))")).alias("x")).select("section_id", "x.*")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id"), F.col("l_linenumber").alias("idx"), F.when(_q() < 5, "Unknown").when(_flag() == "A", " Fire").when(_flag() == "R", "WATER").when(_q() > 30, "None").otherwise(" - ").alias("value"))
    return pages.affinity_observations(titles, cells).withColumn("values", F.concat_ws(",", "values"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages: a paragraph, a list with a link and an inner list with an icon and a line break for every line, and a table of the lines."""
    part = F.concat(F.lit("<li>L"), "l_linenumber", F.lit(' <a href="/p'), "l_partkey", F.lit('">'), _flag(), F.lit('</a><ol><li><img src=x alt="'), "l_linestatus", F.lit('"><br></li></ol></li>'))
    row = F.concat(F.lit("<tr><th>"), "l_linenumber", F.lit("</th><td>q"), _q(), F.lit("</td></tr>"))
    p = _strung(_lines(spark, sf_dir), "l_orderkey", "n", part, row)
    return p.select("page_id", F.concat(F.lit("<script>var a = '<p>';</script><p>All  <b>lines</b></p><ul>"), "s0", F.lit("</ul><table>"), "s1", F.lit("</table>")).alias("html"))


@R.add(f"""WITH {_LINES}, m AS (SELECT *, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS k FROM li),
  t AS (SELECT DISTINCT l_orderkey AS unit_id, 1 AS block_ord, 1 AS tok_ord, 'text' AS kind, 0 AS depth, 'All' AS text, NULL AS href, 'p' AS block_tag, NULL AS parent_block, NULL AS row, NULL AS col FROM li UNION ALL SELECT DISTINCT l_orderkey, 1, 2, 'text', 0, 'lines', NULL, 'p', NULL, NULL, NULL FROM li
    UNION ALL SELECT l_orderkey, 2 * n, 1, 'text', 1, 'L' || l_linenumber, NULL, 'li', NULL, NULL, NULL FROM li UNION ALL SELECT l_orderkey, 2 * n, 2, 'reference', 1, l_returnflag, '/p' || l_partkey, 'li', NULL, NULL, NULL FROM li
    UNION ALL SELECT l_orderkey, 2 * n + 1, 1, 'icon', 2, l_linestatus, NULL, 'li', 2 * n, NULL, NULL FROM li UNION ALL SELECT l_orderkey, 2 * n + 1, 2, 'line_break', 2, '', NULL, 'li', 2 * n, NULL, NULL FROM li
    UNION ALL SELECT l_orderkey, 2 * k + 2 * n, 1, 'text', 0, CAST(l_linenumber AS VARCHAR), NULL, 'th', NULL, n, 1 FROM m UNION ALL SELECT l_orderkey, 2 * k + 2 * n + 1, 1, 'text', 0, 'q' || q, NULL, 'td', NULL, n, 2 FROM m) SELECT * FROM t""")
def structural_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pages.structural_blocks(_nested(spark, sf_dir))
    number = lambda c: F.col(c).cast("int").alias(c)
    return t.select("unit_id", number("block_ord"), "tok_ord", "kind", number("depth"), "text", "href", "block_tag", number("parent_block"), number("row"), number("col"))


@R.add(f"""WITH {_LINES}, k AS (SELECT *, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS k FROM li),
  t AS (SELECT l_orderkey AS unit_id, n AS block_ord, 1 AS tok_ord, 'L' || l_partkey AS text, n AS depth, n AS d, k FROM k UNION ALL SELECT l_orderkey, n, 2, 'T' || l_partkey, n, n, k FROM k WHERE n < k
    UNION ALL SELECT DISTINCT l_orderkey, 0, 1, 'before', 0, 0, k FROM k UNION ALL SELECT DISTINCT l_orderkey, 0, 2, 'after &', 0, 0, k FROM k)
  SELECT unit_id, block_ord, tok_ord, text, depth, CASE WHEN d > 1 THEN d - 1 END AS parent_block, array_to_string(list_transform(range(1, d + 1), lambda i: CASE WHEN i % 2 = 1 THEN 'unordered_list[0]' ELSE 'ordered_list[1]' END), ' ') AS ancestry FROM t""")
def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lists in lists, a line an item of the line before's inner list, with text of the item after that list; list items and lists aren't all closed."""
    lines = _lines(spark, sf_dir)
    last = F.col("n") == F.count("*").over(W.partitionBy("l_orderkey"))
    lines = lines.withColumns({"last": last, "down": F.when(F.col("n") % 2 == 1, "<ul><li>").otherwise("<ol><li></li><li>"), "up": F.when(F.col("n") % 2 == 1, "</li></ul>").otherwise("</ol>")})
    opened = _joined(lines, "l_orderkey", "n", F.concat("down", F.lit("<b>L"), "l_partkey", F.lit("</b>")), "<div>before", "")
    closed = _joined(lines.withColumn("back", -F.col("n")), "l_orderkey", "back", F.concat(F.when(~F.col("last"), F.concat(F.lit("<i>T"), "l_partkey", F.lit("</i>"))).otherwise(""), F.col("up")), "", "</div>after &#38;").withColumnRenamed("html", "rest")
    t = pages.structural_blocks(opened.join(closed, "page_id").select("page_id", F.concat("html", "rest").alias("html")))
    # Empty list items count as blocks: those of ordered lists come before the item with the line.
    order = F.dense_rank().over(W.partitionBy("unit_id").orderBy("block_ord")) - 1
    place = lambda c: (F.col(c) - F.floor(F.col(c) / 3)).cast("int")
    return t.select("unit_id", order.alias("block_ord"), "tok_ord", "text", "depth", place("parent_block").alias("parent_block"), F.concat_ws(" ", "ancestry").alias("ancestry"))


@R.add(f"""WITH {_LINES} SELECT l_orderkey AS page_id, n AS line, 'k' || CAST(ceil(n / 2) AS INTEGER) AS kind, 'n' || l_partkey || ' in' || l_linenumber || ' end' AS name, q FROM li WHERE n < 7
  UNION ALL SELECT l_orderkey, n, NULL, 'in' || l_linenumber, NULL FROM li WHERE n < 7""")
def table_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as two tables of at most six lines, the second with its columns turned round: cells over two rows, an inner table in a cell, rows and cells that aren't closed."""
    lines = _lines(spark, sf_dir).where("n < 7")
    inner = F.concat(F.lit("<td>n"), "l_partkey", F.lit(" <table><tr><td>in"), "l_linenumber", F.lit("</td></tr></table> end"))
    kind = F.when(F.col("n") % 2 == 1, F.concat(F.lit("<td rowspan=2>k"), F.ceil(F.col("n") / 2).cast("int"))).otherwise("")
    number = F.concat(F.lit("<td>"), _q())
    first, second = F.when(F.col("n") < 5, F.concat(F.lit("<tr>"), kind, inner, number)), F.when(F.col("n") > 4, F.concat(F.lit("<tr>"), number, kind, inner))
    more = F.when(F.col("s1") != "", F.concat(F.lit("<table><tr><th>Qty<th>Kind<th>Name"), "s1", F.lit("</table>"))).otherwise("")
    both = _strung(lines, "l_orderkey", "n", first, second).select("page_id", F.concat(F.lit("<table><tr><th>Kind<th>Name<th>Qty"), "s0", F.lit("</table>"), more).alias("html"))
    out = pages.extract_rows(both, [pages.Field("kind", header="kind"), pages.Field("name", header="name"), pages.Field("any", position=0), pages.Field("q", header=["quantity", "qty"], type="int")])
    line = F.row_number().over(W.partitionBy("page_id", F.col("kind").isNull()).orderBy("row_no"))
    return out.select("page_id", line.alias("line"), "kind", F.when(F.col("kind").isNull(), F.col("any")).otherwise(F.col("name")).alias("name"), "q")


@R.add(f"""WITH {_LINES} SELECT l_orderkey AS page_id, n - 1 AS entry_no, CASE WHEN q > 5 THEN 'Skill ' || l_partkey ELSE '' END AS title, CASE WHEN l_returnflag != 'A' THEN 'Hits for ' || q || ' — twice' ELSE '' END AS description, 'Order ' || CASE WHEN n % 3 = 0 THEN 'special' ELSE 'lines' END AS section,
  CASE WHEN q <= 5 THEN 'missing_title' WHEN l_returnflag = 'A' THEN 'missing_description' END AS reason FROM li""")
def grid_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as grids of entries, some without a title or a description, every third in an article with a title of its own."""
    title = F.when(_q() > 5, F.concat(F.lit("<div class='skill-name'><a href=x>Skill "), "l_partkey", F.lit("</a></div>"))).otherwise("")
    text = F.when(_flag() != "A", F.concat(F.lit('<div class="x skill-description">Hits for '), _q(), F.lit(" &mdash; <b>twice</b></div>"))).otherwise("")
    entry = F.concat(F.when(F.col("n") % 3 == 0, '<article title="Order  special">').otherwise(""), F.lit('<div class="grid entry">'), title, text, F.lit("</div>"), F.when(F.col("n") % 3 == 0, "</article>").otherwise(""))
    return pages.grid_units(_joined(_lines(spark, sf_dir), "l_orderkey", "n", entry, "<h2>Order lines</h2>", ""), "entry", "skill-name", "skill-description")


@R.add(f"""WITH {_LINES} SELECT l_orderkey AS page_id, n AS row_no, 'active' AS record_type, 'N' || l_partkey || CASE WHEN q > 40 THEN ' (Stellar Awakened)' ELSE '' END AS name, q AS mp, NULL AS level, q > 40 AS gated FROM li
  UNION ALL SELECT l_orderkey, n, 'passive', 'N' || l_partkey || CASE WHEN q > 40 THEN ' (Stellar Awakened)' ELSE '' END, NULL, l_linenumber, q > 40 FROM li""")
def skill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("<tr data-lv='"), "l_linenumber", F.lit("'><td>N"), "l_partkey", F.when(_q() > 40, " (Stellar Awakened)").otherwise(""), F.lit("</td><td>"), _q(), F.lit(" MP</td></tr>"))
    p = _joined(_lines(spark, sf_dir), "l_orderkey", "n", row, "<table><tr><th>Name</th><th>MP</th></tr>", "</table>")
    name = pages.Field("name", header="name")
    out = pages.skill_rows(p, {"active": [name, pages.Field("mp", header="mp", type="int")], "passive": [name, pages.Field("level", attr="data-lv", type="int")]})
    return out.select("page_id", "row_no", "record_type", "name", "mp", "level", "gated")


@R.add(f"""WITH {_LINES}, k AS (SELECT l_orderkey AS page_id, n AS ord, CASE WHEN l_returnflag = 'A' THEN CASE WHEN q > 25 THEN 'aura' ELSE 'charge' END WHEN l_returnflag = 'N' THEN CASE WHEN q > 25 THEN 'charge' ELSE 'auto' END ELSE 'unknown' END AS kind FROM li) SELECT *, CASE WHEN kind = 'unknown' THEN 'unclassified_block' END AS diagnostic FROM k""")
def sidekick_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when((_flag() == "A") & (_q() > 25), F.concat(F.lit("Aura: power +"), _q())).when(_flag() == "A", F.concat(F.lit("Heals, consumes "), _q(), F.lit(" charge"))).when((_flag() == "N") & (_q() > 25), "Charge skill").when(_flag() == "N", "An auto skill").otherwise("Autonomous surcharge")
    b = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("page_id"), F.col("n").alias("ord"), t.alias("text"))
    return pages.sidekick_rows(b).drop("text")


@R.add(f"""WITH {_LINES}, b AS (SELECT l_orderkey AS unit_id, n, l_returnflag = 'A' AS c, CASE WHEN l_returnflag = 'A' THEN 'When hit ' ELSE 'Effect ' END || q AS t FROM li), a AS (SELECT unit_id, min(CASE WHEN c THEN n END) AS a0 FROM b GROUP BY 1),
  g AS (SELECT unit_id, max(CASE WHEN n = a0 THEN t END) AS condition, coalesce(string_agg(t, chr(10) ORDER BY n) FILTER (WHERE a0 IS NULL OR n > a0), '') AS effect FROM a JOIN b USING (unit_id) GROUP BY 1)
  SELECT *, CASE WHEN condition IS NULL THEN 'no_condition' WHEN effect = '' THEN 'no_effect' ELSE 'ok' END AS status FROM g""")
def aura_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.when(_flag() == "A", "When hit ").otherwise("Effect "), _q())
    return pages.aura_fields(_lines(spark, sf_dir).select(F.col("l_orderkey").alias("unit_id"), F.col("n").alias("ord"), t.alias("text")))


@R.add(f"""WITH {_LINES} SELECT l_orderkey * 100 + n AS fact_id, CAST(q AS VARCHAR) || '.5' AS magnitude_value, 'percent' AS magnitude_unit, CASE WHEN l_linenumber = 3 THEN CAST(n AS VARCHAR) ELSE '' END AS activation_count, CASE WHEN l_returnflag = 'A' THEN CAST(n AS VARCHAR) ELSE '' END AS duration_turns,
  CASE WHEN l_returnflag = 'R' THEN 'on_hit' WHEN l_linestatus = 'F' THEN 'battle_start' ELSE 'none' END AS "trigger", CASE WHEN q > 40 THEN 'overwrites' WHEN q <= 20 THEN 'stackable' ELSE 'not_applicable' END AS stacking_behavior,
  CASE WHEN q > 10 AND q <= 20 THEN '5' WHEN q <= 10 THEN '10' ELSE '' END AS max_stacks, CASE WHEN q % 2 = 0 THEN 'fire' ELSE 'fire,water' END AS element, CASE WHEN l_linenumber = 1 THEN 'bow' ELSE '' END AS equipment_class,
  concat_ws(',', CASE WHEN l_linenumber = 1 THEN 'weapon_class' END, 'element', CASE WHEN l_linenumber = 2 THEN 'personality' END, CASE WHEN q <= 20 THEN 'stack' END) AS eligibility FROM li""")
def qualifier_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as effect texts that name every qualifier, or don't."""
    said = lambda when, *text: F.when(when, F.concat(*text)).otherwise("")
    line = lambda k: F.col("l_linenumber") == k
    text = F.concat(
        F.lit("X9% no; deals "), _q(), F.lit(".5 % Fire damage"), said(_q() % 2 == 1, F.lit(" or WATER damage")), said(line(3), F.lit(", "), "n", F.lit(" times")), said(_flag() == "A", F.lit(" for "), "n", F.lit(" turns")), said(_flag() == "R", F.lit(" on hit")),
        said((_flag() != "R") & (F.col("l_linestatus") == "F"), F.lit(" at Battle Start")), said(line(1), F.lit(" with a bow")), said(line(2), F.lit(" by Quick personality")), said(_q() > 40, F.lit(", replaces others")), said((_q() > 10) & (_q() <= 20), F.lit(", max 5 stacks")), said(_q() <= 10, F.lit(", up to 10 stacks")), F.lit("."),
    )
    q = expr.qualifiers("text", {"element": ["fire", "water"], "equipment_class": ["bow", "sword"]}, ["none", "on_hit", "battle_start"])
    # The text is a column of its own, so that it is made once a row, not once for each expression.
    li = _lines(spark, sf_dir).select((F.col("l_orderkey") * 100 + F.col("n")).alias("fact_id"), text.alias("text")).select("fact_id", q.alias("q"))
    return li.select("fact_id", "q.*").withColumns({c: F.concat_ws(",", c) for c in ("element", "equipment_class", "eligibility")})


@R.add("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderstatus != 'P' AS accepted FROM orders")
def artifact_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a report and read back under a version gate."""
    path = f"{Scratch(spark, 'artifacts').root}/orders"
    tables.write_report(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") == "F", "2").when(F.col("o_orderstatus") == "O", "2").alias("schema_version")), path)
    return tables.read_artifacts(spark, path, "id long, status string, schema_version string", "2").select("id", "status", "accepted")


@R.add("""SELECT 'curated' AS origin, n_nationkey AS id, n_name AS name, NULL AS note FROM nation WHERE n_regionkey IN (1, 3) UNION ALL SELECT 'review', n_nationkey, n_name, CASE WHEN n_regionkey != 2 THEN 'a "b", c' END FROM nation""")
def curated_and_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as one curated JSON list, and as a sheet of review rows."""
    n, root = table(spark, sf_dir, "nation"), Scratch(spark, "curated").root
    row = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey").isin(1, 3), "confirmed").otherwise("draft").alias("status"))
    n.agg(F.to_json(F.sort_array(F.collect_list(row))).alias("value")).write.text(f"{root}/json")  # the nations, a fixed list
    sheet = n.select(F.concat(F.lit(" "), "n_nationkey").alias("id"), F.concat("n_name", F.lit("  ")).alias("name"), F.when(F.col("n_regionkey") != 2, 'a "b", c').otherwise(" ").alias("note"))
    sheet.write.csv(f"{root}/csv", header=True, escape='"', quoteAll=True)
    a = tables.read_curated(spark, f"{root}/json", "id int, name string, status string", ["confirmed"]).select(F.lit("curated").alias("origin"), "id", "name", F.lit(None).cast("string").alias("note"))
    return a.unionByName(tables.read_review_csv(spark, f"{root}/csv", ["id", "name", "note"]).select(F.lit("review").alias("origin"), F.col("id").cast("int").alias("id"), "name", "note"))


# Column expressions


@R.add(f"""WITH {_LINES} SELECT l_orderkey * 100 + n AS id, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'not_equipable' WHEN l_returnflag = 'A' THEN 'not_equipable' WHEN l_returnflag = 'N' AND q > 30 THEN 'not_equipable' WHEN l_returnflag = 'N' THEN 'basic_attack_replacement' WHEN q > 30 THEN 'ordinary_basic_attack' ELSE 'active_equipable' END AS slot FROM li""")
def slot_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, n, big = _flag() == "A", _flag() == "N", _q() > 30
    name = F.when(n & big, "Another  Zone + ").otherwise("Slash")
    section = F.when(a & (F.col("l_linestatus") == "O"), "Passive skills").otherwise("Skills")
    kind = F.when(a, "Passive")
    text = F.when(n, "It replaces Basic Attack here").when(big, "  Basic attack: strikes").otherwise("Strikes the basic attack")
    return _lines(spark, sf_dir).select((F.col("l_orderkey") * 100 + F.col("n")).alias("id"), expr.slot_eligibility(name, section, kind, text).alias("slot"))


@R.add("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 1234 WHEN 1 THEN -p_size WHEN 2 THEN p_size END AS whole, CASE p_size % 4 WHEN 0 THEN 1234 WHEN 1 THEN p_size WHEN 2 THEN p_size END AS positive, CASE p_size % 4 WHEN 2 THEN p_size + 0.5 WHEN 1 THEN CAST(-p_size AS DOUBLE) END AS number,
  p_size % 3 = 0 AS yes, CASE p_size % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN '' ELSE 'x' END AS pieces, p_name || CASE p_size % 3 WHEN 0 THEN ' (' || p_brand || ')' WHEN 1 THEN ' (t)' ELSE '' END AS label, CASE WHEN p_size < 5 THEN 'small' ELSE p_type END AS type FROM part""")
def coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, truth, lists, labels and overrides out of the texts of parts."""
    s = F.col("p_size")
    number = F.when(s % 4 == 0, "about 1,234 of 9").when(s % 4 == 1, F.concat(F.lit("-"), s)).when(s % 4 == 2, F.concat(s, F.lit(".5%"))).otherwise("none")
    word = F.when(s % 3 == 0, F.when(s % 2 == 0, " YES ").otherwise("1")).when(s % 3 == 1, "maybe")
    text = F.when(s % 3 == 0, " a, b ; none, a").when(s % 3 == 2, "x/-/N/A")
    p = table(spark, sf_dir, "part")
    table_ = p.where("p_size < 5").select("p_partkey", F.lit("small").alias("p_type"))
    label = expr.display_label("p_name", F.when(s % 3 == 0, F.col("p_brand")).otherwise(" "), F.when(s % 3 == 1, "t"))
    out = expr.override(p, table_, "p_partkey", "p_type")
    return out.select(F.col("p_partkey").alias("id"), expr.to_int(number).alias("whole"), expr.abs_int(number).alias("positive"), expr.to_float(number).alias("number"), expr.truthy(word).alias("yes"), F.concat_ws("|", F.filter(expr.split_list(text), lambda x: ~x.isin("N", "A"))).alias("pieces"), label.alias("label"), F.col("p_type").alias("type"))


@R.add("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'stance' WHEN 1 THEN 'valor_chant' WHEN 2 THEN 'ability' ELSE 'passive' END AS kind, CASE WHEN p_size % 2 = 0 THEN p_size END AS level, CASE WHEN p_size % 5 = 0 THEN p_size END AS cost, CASE WHEN p_size % 4 = 0 THEN 'stellar' WHEN p_size % 4 = 1 THEN 'manifest' WHEN p_size % 4 = 2 THEN 'form' ELSE 'base' END AS variant, CASE WHEN p_size % 3 = 0 THEN 'level_' || p_size ELSE 'unknown' END AS key, CASE WHEN p_size % 3 = 0 THEN p_size END AS ordinal FROM part""")
def skill_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passive type, level, charge cost and variant key."""
    s = F.col("p_size")
    pick = lambda *x: F.when(s % 4 == 0, x[0]).when(s % 4 == 1, x[1]).when(s % 4 == 2, x[2]).otherwise(x[3])
    text = F.concat(pick("Stance ability", "VALOR CHANT of", "An ability", "A trait"), F.when(s % 2 == 0, F.concat(F.lit(" Lv. "), s)).otherwise(" level up 3"), F.when(s % 5 == 0, F.concat(F.lit(", Consumes "), s, F.lit(" charge"))).otherwise(" charge 4"))
    v = expr.variant_key(pick("Stellar awakening", "Skills", "Skills", "Skills"), F.concat(pick("", "", "", ""), F.when(s % 3 == 0, F.concat(F.lit(" Level "), s)).otherwise(" ")))
    v2 = expr.variant_key(pick("Stellar awakening", "Manifest weapons", "Second form", "Skills"), F.lit("x"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), expr.passive_type(text).alias("kind"), expr.level(text).alias("level"), expr.charge_cost(text).alias("cost"), v2["kind"].alias("variant"), v["key"].alias("key"), v["ordinal"].alias("ordinal"))


@R.add("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN CASE WHEN p_size > 25 THEN 'all_enemies' ELSE 'single_enemy' END WHEN 1 THEN CASE WHEN p_size > 40 THEN 'enemy' WHEN p_size > 25 THEN 'all_enemies' ELSE 'single_enemy' END ELSE CASE WHEN p_size > 40 THEN 'given' WHEN p_size > 25 THEN 'party' ELSE 'self' END END AS scope FROM part""")
def target_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    selector = F.when(s % 3 == 0, "enemy_attack_scope").when(s % 3 == 1, "enemy_scope").otherwise("fixed_response_scope")
    text = F.when(s % 3 == 0, F.when(s > 25, "Attack on All enemies").otherwise("Attack on an enemy")).when(s % 3 == 1, F.when(s > 40, "Attack").when(s > 25, "Hits ALL ENEMIES now").otherwise("Hits a single enemy")).otherwise(F.when(s > 40, "Restores").when(s > 25, "Heals all allies and self").otherwise("Restores own HP"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), expr.target_scope(selector, text, F.lit("given")).alias("scope"))


@R.add("""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'percent' WHEN 'O' THEN 'flat' ELSE '__clear__' END AS unit, CASE WHEN o_orderpriority = '1-URGENT' THEN 'on_hit' ELSE trim(o_orderpriority) END AS trigger, CASE WHEN o_orderstatus = 'F' THEN 'Pct' ELSE 'x' END AS note FROM orders""")
def review_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, status = table(spark, sf_dir, "orders"), F.col("o_orderstatus")
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(status == "F", " PCT").when(status == "O", "flat ").otherwise("Clear").alias("unit"), F.concat(F.lit(" "), "o_orderpriority").alias("trigger"), F.when(status == "F", "Pct").otherwise("x").alias("note"))
    aliases = spark.createDataFrame([("unit", "pct", "percent"), ("unit", "%", "percent"), ("trigger", "1-urgent", "on_hit"), ("absent", "a", "b")], "column string, alias string, value string")
    return expr.normalize_review(rows, aliases)


# Gates, picks and sets


@R.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IS NULL OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def delete_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return reconcile.delete_by_keys(table(spark, sf_dir, "orders"), gone).select("o_orderkey", "o_orderstatus")


@R.add(f"""WITH c AS (SELECT l_orderkey AS id, unnest({_CAPS}) AS cap, CASE l_linestatus WHEN 'O' THEN 'approve' ELSE 'reject' END AS d, l_quantity > 49 AS block FROM lineitem), g AS (SELECT id, bool_or(block) AS block FROM c GROUP BY 1), p AS (SELECT DISTINCT id, cap FROM c WHERE d = 'approve' AND cap != 'shield')
  SELECT g.id, CASE WHEN block THEN '' ELSE coalesce(string_agg(cap, ',' ORDER BY cap), '') END AS proven FROM g LEFT JOIN p USING (id) GROUP BY g.id, block""")
def proven_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts: the lines' flags are capabilities, open lines approve them; shields have evidence of another kind."""
    cap = F.when(_flag() == "A", F.array(F.lit("direct_damage"), F.lit("shield"))).when(_flag() == "N", F.array(F.lit("recover_mp"), F.lit("heal_hp"))).otherwise(F.array(F.lit("deploy_zone")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(cap).alias("c"), F.when(F.col("l_linestatus") == "O", "approve").otherwise("reject").alias("d"), F.when(F.col("l_quantity") > 49, "rejected").otherwise("note").alias("diag"))
    e = F.struct(F.when(F.col("c") == "shield", "dependency").otherwise("capability").alias("kind"), F.col("c").alias("value"), F.col("d").alias("decision"))
    facts = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set("c")).alias("caps"), F.collect_set(e).alias("evidence"), F.collect_set("diag").alias("diags"))
    return facts.select("id", F.concat_ws(",", validate.proven_capabilities(F.col("caps"), F.col("evidence"), F.col("diags"))).alias("proven"))


_SLOTS = "CASE WHEN l_returnflag = 'A' THEN 'active_equipable' WHEN l_returnflag = 'N' THEN 'ordinary_basic_attack' WHEN l_linestatus = 'O' THEN 'basic_attack_replacement' END"


@R.add(f"""WITH f AS (SELECT l_orderkey AS fact_id, {_SLOTS} AS slot, l_quantity > 25 AS gated, repeat('x', l_linenumber) || l_partkey AS description FROM lineitem)
  SELECT fact_id, slot, gated, description FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY CASE slot WHEN 'active_equipable' THEN 1 WHEN 'basic_attack_replacement' THEN 2 WHEN 'ordinary_basic_attack' THEN 3 ELSE 9 END, gated, length(description) DESC, description) AS r FROM f) WHERE r = 1""")
def richest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.expr(_SLOTS).alias("slot_eligibility"), (F.col("l_quantity") > 25).alias("gated"), F.concat(F.expr("repeat('x', l_linenumber)"), "l_partkey").alias("description"))
    return ranked.richest_row(f).select("fact_id", F.col("slot_eligibility").alias("slot"), "gated", "description")


@R.add("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders")
def stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and price, with the place that the order gives them: partitions of the sorted table are counted, then their rows."""
    o = ranked.stable_order(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority", F.desc("o_totalprice")], "o_orderkey")
    o = Scratch(spark, "order").save(o.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")), "sorted")
    before = o.groupBy("p").agg(F.count("*").alias("n")).select("p", (F.sum("n").over(W.orderBy("p")) - F.col("n")).alias("before"))  # one row a partition
    return o.join(before, "p").select("o_orderkey", "o_orderpriority", (F.row_number().over(W.partitionBy("p").orderBy("i")) + F.col("before")).alias("place"))


@R.add("""WITH a AS (SELECT l_orderkey AS k, list_distinct(list(l_returnflag)) AS x, list_distinct(list(CASE WHEN l_quantity > 20 THEN l_returnflag ELSE l_linestatus END)) AS y FROM lineitem GROUP BY 1)
  SELECT k AS id, array_to_string(list_sort(list_filter(x, lambda v: list_contains(y, v))), ',') AS both, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ',') AS only_first FROM a""")
def capability_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("x"), F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_returnflag")).otherwise(F.col("l_linestatus"))).alias("y"))
    return g.select("id", F.concat_ws(",", ranked.cap_intersect("x", "y")).alias("both"), F.concat_ws(",", ranked.cap_except("x", "y")).alias("only_first"))


@R.add("""SELECT 'item' AS record_type, p_partkey AS id, p_name AS name, p_size AS size, CAST(NULL AS DOUBLE) AS balance FROM part UNION ALL SELECT 'owner', s_suppkey, s_name, NULL, s_acctbal FROM supplier UNION ALL SELECT 'guest', c_custkey, c_name, NULL, c_acctbal FROM customer UNION ALL SELECT 'place', n_nationkey, n_name, NULL, NULL FROM nation""")
def record_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, c, n = (table(spark, sf_dir, t) for t in ("part", "supplier", "customer", "nation"))
    return ranked.union_facts(
        item=p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")),
        owner=s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        guest=c.select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        place=n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")),
    )


# Joins


@R.add("""WITH f AS (SELECT l_orderkey, array_to_string(list(l_suppkey ORDER BY l_linenumber, l_suppkey), ',') AS m, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey), ',') AS s FROM lineitem GROUP BY 1), c AS (SELECT o_orderkey * 2 AS candidate, m, CASE WHEN o_orderstatus = 'F' THEN s || ',0' ELSE s END AS s FROM f JOIN orders ON o_orderkey = l_orderkey)
  SELECT f.l_orderkey AS id, c.candidate FROM f LEFT JOIN c ON f.m = c.m AND f.s = c.s""")
def exact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' suppliers and parts in order, looked up among the same with one part more for finished orders."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c))), lambda x: x[c])
    final = li.groupBy("l_orderkey").agg(listed("l_suppkey").alias("member_ids"), listed("l_partkey").alias("skill_ids"))
    c = final.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("member_ids", F.when(F.col("o_orderstatus") == "F", F.array_append("skill_ids", F.lit(0))).otherwise(F.col("skill_ids")).alias("skill_ids"), (F.col("o_orderkey") * 2).alias("candidate"))
    return resolve.exact_candidate(final, c).select(F.col("l_orderkey").alias("id"), "candidate")


@R.add("""WITH o AS (SELECT s_suppkey AS owner, 'w' || s_nationkey % 3 AS weapon FROM supplier WHERE s_suppkey % 7 != 0), t AS (SELECT s_suppkey AS owner, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS traits FROM supplier JOIN part ON p_size = s_suppkey % 50 WHERE s_suppkey % 2 = 0 GROUP BY 1)
  SELECT l_orderkey AS lineup_id, l_suppkey AS owner, l_partkey AS item_id, weapon, coalesce(traits, '') AS traits, CASE WHEN p_size % 2 = 1 THEN p_size END AS "limit" FROM lineitem LEFT JOIN o ON l_suppkey = o.owner LEFT JOIN t ON l_suppkey = t.owner AND o.owner IS NOT NULL LEFT JOIN part ON p_partkey = l_partkey AND p_size % 2 = 1""")
def legality_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s, p = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    owners = s.where("s_suppkey % 7 != 0").select(F.col("s_suppkey").alias("owner"), F.concat(F.lit("w"), F.col("s_nationkey") % 3).alias("weapon"))
    edges = s.where("s_suppkey % 2 = 0").join(p.select("p_size", "p_brand").distinct(), F.col("p_size") == F.col("s_suppkey") % 50).select(F.col("s_suppkey").alias("owner"), F.col("p_brand").alias("trait")).distinct()
    limits = p.where("p_size % 2 = 1").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("limit"))
    lineups = li.select(F.col("l_orderkey").alias("lineup_id"), F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("item_id"))
    out = resolve.legality_context(lineups, owners, edges, limits)
    return out.select("lineup_id", "owner", "item_id", "weapon", F.concat_ws(",", F.sort_array("traits")).alias("traits"), "limit")


@R.add("""WITH r AS (SELECT c_custkey AS request_id, 'Brand#' || (11 + c_custkey % 3) AS weapon FROM customer UNION SELECT c_custkey, 'Brand#21' FROM customer WHERE c_custkey % 2 = 0), i AS (SELECT p_partkey AS item_id, CASE WHEN p_size < 3 THEN 'armor' WHEN p_size < 10 THEN 'weapon' ELSE 'other' END AS slot, p_brand AS weapon FROM part)
  SELECT request_id, item_id FROM r JOIN i USING (weapon) WHERE slot = 'weapon' UNION SELECT request_id, item_id FROM (SELECT DISTINCT request_id FROM r), i WHERE slot = 'armor' AND weapon IN ('Brand#11', 'Brand#12')""")
def request_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    k = F.col("c_custkey")
    requests = c.select(k.alias("request_id"), F.concat(F.lit("Brand#"), 11 + k % 3).alias("weapon")).unionByName(c.where(k % 2 == 0).select(k.alias("request_id"), F.lit("Brand#21").alias("weapon")))
    slot = F.when((F.col("p_size") < 3) & F.col("p_brand").isin("Brand#11", "Brand#12"), "armor").when((F.col("p_size") >= 3) & (F.col("p_size") < 10), "weapon").otherwise("other")
    return resolve.items_for(requests, p.select(F.col("p_partkey").alias("item_id"), slot.alias("slot"), F.col("p_brand").alias("weapon")))


@R.add("""WITH a AS (SELECT l_suppkey, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS skills FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT s_suppkey, string_agg(n_name, ',' ORDER BY n_name) AS auras FROM supplier JOIN nation ON n_regionkey = s_suppkey % 7 GROUP BY 1)
  SELECT s.s_suppkey AS sidekick, coalesce(skills, '') AS skills, coalesce(auras, '') AS auras FROM supplier s LEFT JOIN a ON l_suppkey = s.s_suppkey LEFT JOIN b ON b.s_suppkey = s.s_suppkey""")
def sidekick_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, li, n = (table(spark, sf_dir, t) for t in ("supplier", "lineitem", "nation"))
    skills = li.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("sidekick"), F.col("l_partkey").cast("string").alias("skill")).distinct()
    auras = s.join(n, F.col("n_regionkey") == F.col("s_suppkey") % 7).select(F.col("s_suppkey").alias("sidekick"), F.col("n_name").alias("aura"))
    out = resolve.with_children(s.select(F.col("s_suppkey").alias("sidekick")), {"skills": (skills, ["skill"]), "auras": (auras, ["aura"])}, "sidekick")
    return out.select("sidekick", F.concat_ws(",", "skills.skill").alias("skills"), F.concat_ws(",", "auras.aura").alias("auras"))


@R.add("""WITH o AS (SELECT DISTINCT c_custkey AS owner FROM customer), u AS (SELECT o_custkey AS owner, count(*) AS n FROM orders WHERE o_orderstatus != 'P' GROUP BY 1), f AS (SELECT o_custkey AS owner, count(*) AS n, count(CASE WHEN l_quantity > 20 THEN 1 END) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
  SELECT o.owner, coalesce(u.n, 0) AS captured, coalesce(f.n, 0) AS parsed, coalesce(f.b, 0) AS bound, coalesce(f.n, 0) - coalesce(f.b, 0) AS unresolved FROM o LEFT JOIN u USING (owner) LEFT JOIN f USING (owner)""")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), _lines(spark, sf_dir)
    facts = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("owner"), F.concat_ws("-", "l_orderkey", "n").alias("fact_id"), "l_quantity")
    return aggregate.source_coverage(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner")), o.where("o_orderstatus != 'P'").select(F.col("o_custkey").alias("owner")), facts.drop("l_quantity"), facts.where("l_quantity > 20").select("fact_id"))


# Rules and review


@R.add("""SELECT CAST(o_orderkey AS VARCHAR) AS proposal_id, CASE WHEN o_totalprice > 200000 THEN 'correct' ELSE 'approve' END AS decision FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000""")
def applied_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = lambda where, decision: o.where(where).select(F.col("o_orderkey").cast("string").alias("proposal_id"), F.lit(decision).alias("decision"))
    return rules.apply_review(rows("o_orderstatus = 'F'", "approve"), rows("o_totalprice > 200000", "correct"))


@R.add("""WITH r AS (SELECT p_brand || p_type AS rule_id, p_size, p_name FROM part), n AS (SELECT rule_id FROM r GROUP BY 1 HAVING count(*) > 1) SELECT rule_id, 'duplicate_id' AS error FROM n UNION SELECT rule_id, 'blank_pattern' FROM r WHERE p_size = 1 UNION SELECT rule_id, 'no_record_type' FROM r WHERE p_size = 2 UNION SELECT rule_id, 'kind_vocabulary' FROM r WHERE p_size > 45""")
def rule_table_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    r = table(spark, sf_dir, "part").select(F.concat("p_brand", "p_type").alias("rule_id"), F.when(s == 1, "  ").otherwise(F.col("p_name")).alias("pattern"), F.when(s == 2, F.array().cast(expr.STRINGS)).otherwise(F.array(F.lit("en"))).alias("record_types"), F.when(s > 45, "guess").otherwise("capability").alias("kind"))
    return rules.rule_table_errors(r, {"kind": ["capability", "dependency"]})


@R.add(f"""WITH {_LINES}, o AS (SELECT l_orderkey AS unit_id, n AS block_ord, 'consumption' AS operation, q AS amount, 'When hit,' AS condition FROM li WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, n, 'gain', 2, NULL FROM li WHERE l_returnflag != 'R' UNION ALL SELECT l_orderkey, n, 'availability_threshold', q, NULL FROM li WHERE l_returnflag = 'N') SELECT * FROM o""")
def resource_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(_flag() == "A", F.concat(F.lit("When hit,  consumes "), _q(), F.lit(" charge. Gain two charge, then rest"))).when(_flag() == "N", F.concat(F.lit("Requires "), _q(), F.lit(" charge; stack +2 Charge"))).otherwise(F.concat(F.lit("Charges "), _q(), F.lit(" times")))
    out = rules.resource_operations(_lines(spark, sf_dir).select(F.col("l_orderkey").alias("unit_id"), F.col("n").alias("block_ord"), t.alias("text")))
    return out.withColumn("condition", F.when(F.col("operation") == "consumption", F.col("condition")))


@R.add("""SELECT o_orderkey AS fact_id, CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN o_totalprice > 300000 THEN 'changed' END AS kind FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 300000 UNION ALL SELECT -c_custkey - 1, 'unexpected' FROM customer""")
def materialization_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    one = lambda x: F.array(F.lit(x))
    new = o.select(F.col("o_orderkey").alias("fact_id"), one("a").alias("capabilities"), one("d").alias("dependencies"), F.when(F.col("o_totalprice") > 300000, "proven").otherwise("candidate").alias("state"))
    old = o.where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("fact_id"), one("a").alias("capabilities"), one("d").alias("dependencies"), F.lit("candidate").alias("state"))
    extra = c.select((-F.col("c_custkey") - 1).alias("fact_id"), one("a").alias("capabilities"), one("d").alias("dependencies"), F.lit("candidate").alias("state"))
    return rules.materialization_drift(old.unionByName(extra), new)


# Scores and packages


@R.add(f"WITH {_FACT_SQL} SELECT request_id, owner, role, fact_id, capability FROM (SELECT request_id, owner, fact_id, unnest(caps) AS capability FROM f) JOIN {_ROLES_SQL} USING (capability)")
def role_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.role_evidence(_facts(spark, sf_dir), scoring.role_map(spark))


_WEIGHTS = {r: i % 4 + 1 for i, r in enumerate(scoring.ROLE_CAPABILITIES)}


@R.add(f"WITH {_FACT_SQL} SELECT request_id, owner, CAST(sum(score * w) AS INTEGER) AS score FROM rs JOIN (VALUES {', '.join(f"('{r}', {w})" for r, w in _WEIGHTS.items())}) AS t(role, w) USING (role) GROUP BY 1, 2")
def contextual_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = scoring.role_struct(_scores(spark, sf_dir))
    return wide.select("request_id", "owner", scoring.contextual_score("scores", _WEIGHTS).cast("int").alias("score"))


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as owners, their parts as items of two slots, by quantity."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("owner"), F.col("l_partkey").cast("string").alias("item_id")).agg(F.max("l_quantity").cast("int").alias("score"))
    slot = F.when(F.expr("CAST(item_id AS BIGINT) % 3 = 0"), "weapon").otherwise("item")
    best = li.withColumn("slot", slot).withColumn("rank", F.row_number().over(W.partitionBy("owner", "slot").orderBy(F.desc("score"), "item_id"))).withColumn("kind", F.lit("choice"))
    generic = best.select("owner", "slot").distinct().select("owner", F.concat(F.lit("generic:"), "slot").alias("item_id"), F.lit(0).alias("score"), "slot", F.lit(99).alias("rank"), F.lit("generic").alias("kind"))
    return best.unionByName(generic)


_CHOICES = """c AS (SELECT *, row_number() OVER (PARTITION BY owner, slot ORDER BY score DESC, item_id) AS rank FROM (SELECT l_suppkey AS owner, CAST(l_partkey AS VARCHAR) AS item_id, CAST(max(l_quantity) AS INTEGER) AS score, CASE WHEN l_partkey % 3 = 0 THEN 'weapon' ELSE 'item' END AS slot FROM lineitem GROUP BY l_suppkey, l_partkey))"""


@R.add(f"""WITH {_CHOICES}, i AS (SELECT * FROM c WHERE slot = 'item' AND rank <= 6), s AS (SELECT a.owner, a.item_id || ',' || b.item_id || ',' || d.item_id AS items, [a.item_id, b.item_id, d.item_id] AS l, a.score + b.score + d.score AS score FROM i a JOIN i b ON a.owner = b.owner AND b.rank > a.rank JOIN i d ON d.owner = a.owner AND d.rank > b.rank)
  SELECT owner, CAST(r AS INTEGER) AS option, items, score FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, l) AS r FROM s) WHERE r <= 6 UNION ALL SELECT DISTINCT owner, 7, 'generic:item', 0 FROM c""")
def build_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.build_options(_choices(spark, sf_dir), "item").select("owner", "option", F.concat_ws(",", "item_ids").alias("items"), "score")


@R.add(f"""WITH {_LINES}, x AS (SELECT l_orderkey AS package_id, CASE WHEN l_returnflag = 'A' THEN 'weapon' ELSE 'item' END AS slot, CAST(l_partkey AS VARCHAR) AS item_id, l_partkey AS p FROM li), k AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_size > 25 THEN 'weapon' ELSE 'item' END AS real FROM part WHERE p_size > 3)
  SELECT package_id, 'too_many:' || slot AS error FROM x GROUP BY package_id, slot HAVING count(*) > CASE slot WHEN 'weapon' THEN 1 ELSE 3 END UNION ALL SELECT package_id, 'unknown_item:' || item_id FROM x WHERE item_id NOT IN (SELECT item_id FROM k) UNION ALL SELECT package_id, 'foreign_slot:' || item_id FROM x JOIN k USING (item_id) WHERE real != slot""")
def package_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.when(_flag() == "A", "weapon").otherwise("item").alias("slot"), F.col("l_partkey").cast("string").alias("item_id"))
    generic = F.array(F.struct(F.lit("weapon").alias("slot"), F.lit("generic:weapon").alias("item_id")))
    packages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("package_id")).agg(F.concat(F.collect_list(item), generic).alias("items"))
    catalog = table(spark, sf_dir, "part").where("p_size > 3").select(F.col("p_partkey").cast("string").alias("item_id"), F.when(F.col("p_size") > 25, "weapon").otherwise("item").alias("slot"))
    return assemble.package_errors(packages, catalog, {"weapon": 1, "item": 3})


@R.add("""WITH e AS (SELECT n_regionkey AS request_id, 's' || s_suppkey AS k, s_nationkey % 4 AS base, CAST(s_acctbal * 100 AS BIGINT) AS a, CAST(round(s_acctbal * 10) AS BIGINT) AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey),
  p AS (SELECT m.request_id, m.k AS main, s.k AS sub, m.a + s.b AS score FROM e m JOIN e s ON m.request_id = s.request_id AND m.base != s.base)
  SELECT request_id, main, sub, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, main, sub) AS r FROM p) WHERE r <= 12""")
def sidekick_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    e = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_regionkey").alias("request_id"), F.concat(F.lit("s"), "s_suppkey").alias("sidekick"), (F.col("s_nationkey") % 4).alias("base"), F.explode(F.array(F.struct(F.lit("main").alias("placement"), F.round(F.col("s_acctbal") * 100).cast("long").alias("score")), F.struct(F.lit("sub").alias("placement"), F.round(F.col("s_acctbal") * 10).cast("long").alias("score")))).alias("x"))
    return assemble.sidekick_pairs(e.select("request_id", "sidekick", "base", "x.*"))


@R.add("""WITH p AS (SELECT o_custkey AS owner, o_orderkey AS package_id, CAST(round(o_totalprice * 100) AS BIGINT) AS score, o_orderstatus = 'F' AS a, o_totalprice < 50000 AS b FROM orders)
  SELECT 'best' AS part, CAST(owner AS VARCHAR) AS name, package_id AS id, r AS n FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, package_id) AS r FROM p WHERE NOT a AND NOT b) WHERE r <= 3
  UNION ALL SELECT 'reason', 'finished', NULL, count(*) FROM p WHERE a UNION ALL SELECT 'reason', 'small', NULL, count(*) FROM p WHERE b""")
def package_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("package_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("score"), "o_orderstatus", "o_totalprice")
    best, reasons = assemble.package_frontier(p, {"finished": F.col("o_orderstatus") != "F", "small": F.col("o_totalprice") >= 50000})
    a = best.select(F.lit("best").alias("part"), F.col("owner").cast("string").alias("name"), F.col("package_id").alias("id"), F.col("rank").cast("long").alias("n"))
    return a.unionByName(reasons.select(F.lit("reason").alias("part"), F.col("reason").alias("name"), F.lit(None).cast("long").alias("id"), "n"))


# Evaluation


@R.add("""WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS pred_id, l_linenumber AS ord, l_partkey AS anchor, l_suppkey AS owner FROM lineitem WHERE l_returnflag != 'A'), e AS (SELECT l_orderkey * 10 + l_linenumber AS exp_id, l_linenumber AS ord, l_partkey AS anchor, CASE WHEN l_quantity > 5 THEN l_suppkey END AS owner FROM lineitem WHERE l_returnflag != 'N'),
  a AS (SELECT *, row_number() OVER (PARTITION BY anchor, owner ORDER BY ord, pred_id) AS r, count(*) OVER (PARTITION BY anchor, owner) AS n FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY anchor, owner ORDER BY ord, exp_id) AS r, count(*) OVER (PARTITION BY anchor, owner) AS n FROM e WHERE owner IS NOT NULL)
  SELECT pred_id, exp_id FROM a JOIN b USING (anchor, owner) WHERE a.r <= least(a.n, b.n) AND b.r = least(a.n, b.n) + 1 - a.r""")
def match_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    key, common = F.col("l_orderkey") * 10 + F.col("l_linenumber"), (F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("anchor"))
    return evaluate.match_gaps(li.where("l_returnflag != 'A'").select(key.alias("pred_id"), *common, F.col("l_suppkey").alias("owner")), li.where("l_returnflag != 'N'").select(key.alias("exp_id"), *common, F.when(F.col("l_quantity") > 5, F.col("l_suppkey")).alias("owner")))


@R.add("""WITH c AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus != 'P'), p AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A'), e AS (SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_returnflag != 'A'), d AS (SELECT DISTINCT k FROM e)
  SELECT 'pred_missing' AS error, CAST(k AS VARCHAR) AS witness_id FROM c WHERE k NOT IN (SELECT k FROM p) UNION ALL SELECT 'exp_missing', CAST(k AS VARCHAR) FROM c WHERE k NOT IN (SELECT k FROM d) UNION ALL SELECT 'pred_foreign', CAST(k AS VARCHAR) FROM p WHERE k NOT IN (SELECT k FROM c)
  UNION ALL SELECT 'exp_foreign', CAST(k AS VARCHAR) FROM d WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT DISTINCT 'anchor_incomplete', CAST(k AS VARCHAR) FROM e WHERE q > 45 OR q < 3""")
def cohort_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    exp = li.where("l_returnflag != 'A'").select(F.col("l_orderkey").alias("witness_id"), F.lit(2).alias("start"), F.when(q <= 45, q.cast("int")).alias("end"))
    return evaluate.cohort_errors(li.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("witness_id")), exp, table(spark, sf_dir, "orders").where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("witness_id")))


@R.add(f"""WITH {_LINES}, u AS (SELECT o_orderkey AS unit_id, o_custkey AS owner, o_orderpriority AS title, o_orderstatus AS sha FROM orders), n AS (SELECT owner, title, count(*) AS n, min(unit_id) AS unit_id, min(sha) AS sha FROM u GROUP BY 1, 2),
  t AS (SELECT l_orderkey AS unit_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS refs, sha256(string_agg('L' || l_linenumber || chr(31) || 'q' || q, chr(31) ORDER BY n)) AS d FROM li GROUP BY 1),
  w AS (SELECT c_custkey AS witness_id, c_custkey AS owner, t AS title, 'F' AS sha FROM customer, (VALUES ('1-URGENT'), ('5-LOW')) AS x(t))
  SELECT witness_id, w.title, CASE WHEN n.n = 1 THEN n.unit_id END AS unit_id, CASE WHEN n.n IS NULL THEN 'missing' WHEN n.n > 1 THEN 'ambiguous' WHEN n.sha != w.sha THEN 'capture_changed' ELSE 'resolved' END AS status, CASE WHEN n.n = 1 THEN coalesce(refs, '') END AS refs, CASE WHEN n.n = 1 THEN d END AS digest FROM w LEFT JOIN n ON n.owner = w.owner AND n.title = w.title LEFT JOIN t ON t.unit_id = n.unit_id""")
def witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    units = o.select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("capture_sha256"))
    pair = F.explode(F.array(F.struct(F.lit(1).alias("tok_ord"), F.concat(F.lit("L"), "l_linenumber").alias("text")), F.struct(F.lit(2).alias("tok_ord"), F.concat(F.lit("q"), _q()).alias("text"))))
    tokens = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("unit_id"), F.col("n").alias("block_ord"), pair.alias("x"), F.col("l_returnflag").alias("href")).select("unit_id", "block_ord", "x.*", "href")
    asked = c.withColumn("t", F.explode(F.array(F.lit("1-URGENT"), F.lit("5-LOW")))).select(F.concat_ws("|", "c_custkey", "t").alias("witness_id"), F.col("c_custkey").alias("owner"), F.col("t").alias("title"), F.lit("F").alias("sha256"))
    out = evaluate.resolve_witnesses(asked, units, tokens)
    known = F.col("unit_id").isNotNull()
    return out.select(F.substring_index("witness_id", "|", 1).cast("long").alias("witness_id"), F.substring_index("witness_id", "|", -1).alias("title"), "unit_id", "status", F.when(known, F.concat_ws(",", "references")).alias("refs"), F.when(known, F.col("order_digest")).alias("digest"))


# References and anchors


@R.add("""WITH u AS (SELECT page_id AS unit_id, rtrim(split_part(split_part(url, '#', 1), '?', 1), '/') AS url FROM pages UNION SELECT page_id + 1000000, rtrim(split_part(split_part(url, '#', 1), '?', 1), '/') FROM pages WHERE page_id % 3 = 0) SELECT unit_id, url FROM u WHERE url != ''""")
def destination_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by address; every third has a second unit under an address with a query and a fragment."""
    p = table(spark, sf_dir, "pages")
    more = p.where("page_id % 3 = 0").select((F.col("page_id") + 1000000).alias("unit_id"), F.concat("url", F.lit("/?a=1#top")).alias("url"))
    return refgraph.destination_index(p.select(F.col("page_id").alias("unit_id"), "url"), more)


_EDGES = "e AS (SELECT r_name AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON r_regionkey = n_regionkey UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"


@R.add(f"{REGIONS_SQL} SELECT CAST(least(depth + 1, 3) AS INTEGER) AS max_depth, CAST(least(pages + 1, 8) AS INTEGER) AS max_pages, CAST(least(out_degree + 1, 64) AS INTEGER) AS max_frontier FROM top")
def traversal_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refgraph.limits(refgraph.topology(table(spark, sf_dir, "region").select(F.col("r_name").alias("root")), _edges(spark, sf_dir)))


@R.add(f"""WITH {_LINES}, b AS (SELECT l_orderkey AS u, n, 'Line ' || l_linenumber || ' (' || l_returnflag || ') has ' || q || ' of a\\Eb aaa, it''s ' || l_linestatus AS t FROM li), a AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n) AS k FROM b),
  q AS (SELECT u * 10 + 1 AS anchor_id, u, lower(') HAS ' || q || ' of') AS q FROM (SELECT l_orderkey AS u, q FROM li WHERE n = 1) UNION ALL SELECT o_orderkey * 10 + 2, o_orderkey, x FROM orders, (SELECT 'a\\eb' AS x) UNION ALL SELECT o_orderkey * 10 + 3, o_orderkey, 'aa' FROM orders UNION ALL SELECT o_orderkey * 10 + 4, o_orderkey, 'line 1 (' FROM orders UNION ALL SELECT o_orderkey * 10 + 5, o_orderkey, 'not in it' FROM orders),
  h AS (SELECT anchor_id, n AS block_ord, i FROM (SELECT anchor_id, n, lower(t) AS t, q, unnest(range(0, length(t))) AS i FROM q JOIN b USING (u)) WHERE substr(t, i + 1, length(q)) = q),
  g AS (SELECT anchor_id, count(*) AS n, max(block_ord) AS block_ord, max(i) AS i FROM h GROUP BY 1)
  SELECT q.anchor_id, CASE WHEN n = 1 THEN block_ord END AS block_ord, CASE WHEN n = 1 THEN CAST(i AS INTEGER) END AS "from", CASE WHEN n = 1 THEN CAST(i + length(q) AS INTEGER) END AS "to", coalesce(n, 0) AS n FROM q LEFT JOIN g USING (anchor_id)""")
def quote_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five quotes of every order in the texts of its lines: of several words, with a backslash, overlapping, with a part of a word, and absent."""
    li, o = _lines(spark, sf_dir), table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Line "), "l_linenumber", F.lit(" ("), "l_returnflag", F.lit(") has "), _q(), F.lit(" of a\\Eb aaa, it's "), "l_linestatus")
    b = li.select(F.col("l_orderkey").alias("unit_id"), F.col("n").alias("block_ord"), text.alias("text"))
    quote = lambda k, q: o.select((F.col("o_orderkey") * 10 + k).alias("anchor_id"), F.col("o_orderkey").alias("unit_id"), F.lit(q).alias("quote"))
    first = li.where("n = 1").select((F.col("l_orderkey") * 10 + 1).alias("anchor_id"), F.col("l_orderkey").alias("unit_id"), F.concat(F.lit(") HAS  "), _q(), F.lit(" of")).alias("quote"))
    quotes = reduce(DataFrame.unionByName, [first, quote(2, "a\\Eb"), quote(3, "aa"), quote(4, "line 1 ("), quote(5, "not in it")])
    return refgraph.quote_ranges(b, quotes)


@R.add(f"""WITH {_LINES} SELECT l_orderkey * 100 + n AS anchor_id, q >= 10 AND l_returnflag != 'R' AS ok FROM li""")
def anchor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors over three tokens of every line, stored, and checked where small quantities have changed and lines R were stored one token short."""
    li = _lines(spark, sf_dir).withColumn("anchor_id", F.col("l_orderkey") * 100 + F.col("n"))

    def tokens(quantity: Column) -> DataFrame:
        texts = F.posexplode(F.array(F.concat(F.lit("line"), "l_linenumber"), F.lpad(quantity.cast("string"), 4, "0"), F.lit("end")))
        return li.select(F.col("l_orderkey").alias("unit_id"), F.col("n").alias("block_ord"), texts.alias("tok_ord", "text"))

    ranges = li.select("anchor_id", F.col("l_orderkey").alias("unit_id"), F.col("n").alias("block_ord"), F.lit(2).alias("from"), F.lit(9).alias("to"), _flag().alias("f"))
    stored = refgraph.anchors(tokens(_q()), ranges)
    stored = stored.withColumn("tok_end", F.when(F.col("f") == "R", F.col("tok_start")).otherwise(F.col("tok_end"))).drop("f")
    return refgraph.validate_anchors(stored, tokens(F.when(_q() < 10, _q() + 1000).otherwise(_q())))


# Streams


@R.add("SELECT page_id, url, sha256(html) AS sha256 FROM pages")
def parsed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a stream of captures, parsed and upserted in micro-batches of the table's files, twice: the second run finds nothing new."""
    root = Scratch(spark, "captures").root
    pages_ = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    pages_.repartition(4, "page_id").write.parquet(f"{root}/in")
    for _ in range(2):
        stream = spark.readStream.schema(pages_.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        jobs.start_incremental_parse(stream, lambda b: b.select("page_id", "url", F.sha2("html", 256).alias("sha256")), f"{root}/store", ["page_id"], f"{root}/checkpoint").awaitTermination()
    return jobs.Store(spark, f"{root}/store").read().select("page_id", "url", "sha256")


_STATE = "CASE event_type WHEN 'view' THEN 'cached' WHEN 'click' THEN 'parsed' WHEN 'purchase' THEN 'loaded' WHEN 'error' THEN 'failed' ELSE 'pending' END"


@R.add(f"""WITH s AS (SELECT user_id AS target_id, ts, {_STATE} AS state, CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error FROM events)
  SELECT target_id, (list(state ORDER BY ts DESC, state DESC))[1] AS state, CAST(sum(CASE WHEN state IN ('cached', 'failed') THEN 1 ELSE 0 END) AS INTEGER) AS attempts, (list(error ORDER BY ts DESC, error DESC) FILTER (WHERE error IS NOT NULL))[1] AS last_error FROM s GROUP BY 1""")
def tracked_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream into the target-state tracker; the newest row of a target in a table by micro-batch is its state."""
    root = Scratch(spark, "targets").root
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("target_id"), F.col("ts").cast("timestamp").alias("ts"), F.expr(_STATE).alias("state"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), "event_id")).alias("error"))
    e.repartition(4).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/b{n}")

    jobs.track_targets(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ranked.top(spark.read.parquet(f"{root}/out/*"), ["target_id"], [F.desc("batch")]).drop("batch")


@R.add("""SELECT conv_id AS run_id, turn AS call_number, CAST(length(text) AS BIGINT) AS tokens, CAST(sum(length(text)) OVER w AS BIGINT) AS used, CAST(greatest(0, 800 - sum(length(text)) OVER w) AS BIGINT) AS "left", sum(length(text)) OVER w > 800 AS "over" FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def streamed_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream of calls, dealt to files out of order; a last call of no run, days later, lets the watermark pass them all."""
    root = Scratch(spark, "budget").root
    at = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(c))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("call_number"), F.length("text").cast("long").alias("tokens"), at("turn").alias("ts"))
    c.repartition(4, "call_number").write.parquet(f"{root}/in/a")
    spark.range(864_000, 864_001).select(F.lit(None).cast("long").alias("run_id"), F.lit(1).cast("long").alias("call_number"), F.lit(0).cast("long").alias("tokens"), at("id").alias("ts")).write.parquet(f"{root}/in/b")
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 3).parquet(f"{root}/in/*")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/b{n}")

    jobs.running_budget(stream, 800, "1 day").writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out/*").where("run_id IS NOT NULL")
