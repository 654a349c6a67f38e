"""Pages as tables: captures, row entries, sections and blocks. Row entries and tokens come from the nodes of ``markup``; malformed rows go to diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import expr
from factloom.sources import markup
from factloom.sources.markup import BLOCK_TAGS


def read_captures(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """(page_id, url, html, capture_sha256) from a table of pages, or from a folder of html files."""
    if format == "parquet":
        pages = spark.read.parquet(path).select("page_id", "url", "html")
    else:
        pages = spark.read.text(path, wholetext=True).select(expr.stable_id("page", F.input_file_name()).alias("page_id"), F.input_file_name().alias("url"), F.col("value").alias("html"))
    return pages.withColumn("capture_sha256", F.sha2("html", 256))


class Field(NamedTuple):
    """A field of a row entry: a data attribute, else the cell under a header (of several names: the first column called so, else the first whose header has one in it), else the cell at a position."""

    name: str
    attr: str | None = None
    header: str | Sequence[str] | None = None
    position: int | None = None
    type: str = "string"


def plain(html: Column | str) -> Column:
    """Text of a fragment: without tags, character references decoded, white space collapsed."""
    t = F.regexp_replace(expr.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return F.trim(F.regexp_replace(markup.unescaped(t), r"[\s\u00a0]+", " "))


def _headed(pages: DataFrame) -> DataFrame:
    """Tables (page_id, page, table, heads(col, text), rows): the header cells of the first row that has any, one for each column below them."""
    heads = lambda r: F.filter(r["cells"], lambda c: c["th"])
    first = F.get(F.filter("rows", lambda r: F.exists(r["cells"], lambda c: c["th"])), F.lit(0))
    wide = F.flatten(F.transform(heads(first), lambda h: F.transform(F.sequence(h["col"], h["col"] + h["across"] - 1), lambda k: F.named_struct(F.lit("col"), k, F.lit("text"), h["text"]))))
    return markup.tables(pages).select("page_id", "page", "table", wide.alias("heads"), "rows")


def table_rows(pages: DataFrame) -> DataFrame:
    """Rows of all tables: (page_id, page, table, row, node, row_no, attrs, cells(col, th, text), heads(col, text)).

    A cell's text is all that stands in it, tables inside included; their rows are rows of their own. A cell that reaches down is in each of
    its rows. ``heads`` are the header cells of the first row of the same table that has any. ``row_no`` counts the page's rows, from 0.
    """
    return _headed(pages).select("page_id", "page", "table", "heads", F.explode("rows").alias("r")).select("page_id", "page", "table", "r.row", "r.node", "r.row_no", "r.attrs", "r.cells", "heads")


def _cell_at(col: Column) -> Column:
    """The text of the first cell in a column. Cells are sorted: mostly the column's number is the cell's; the others are looked for."""
    cell, before = (F.get("cells", col - k) for k in (1, 2))
    return F.when((cell["col"] == col) & ~before["col"].eqNullSafe(col), cell["text"]).when(col.isNotNull(), F.get(F.filter("cells", lambda c: c["col"] == col), F.lit(0))["text"])


def _head_at(f: Field) -> Column:
    """The column that a field's header stands over, of a table's ``heads``."""
    if not f.header:
        return F.lit(None).cast("int")
    names = [h.lower() for h in ([f.header] if isinstance(f.header, str) else f.header)]
    called = lambda test: F.get(F.filter("heads", lambda h: test(F.lower(h["text"]))), F.lit(0))["col"]
    return F.coalesce(called(lambda t: t.isin(*names)), called(lambda t: reduce(Column.__or__, (t.contains(n) for n in names))))


def _texts(pages: DataFrame, fields: Sequence[Field], row: str) -> DataFrame:
    """(page_id, row_no, t0, t1, ...): the rows that have data, and each field's text. Headers are looked for once a table."""
    if row == "tr":
        t = _headed(pages).select("page_id", "rows", *(_head_at(f).alias(f"c{k}") for k, f in enumerate(fields) if f.header))
        r = t.select("page_id", *(c for c in t.columns if c not in ("page_id", "rows")), F.explode("rows").alias("r")).select("*", "r.row_no", "r.attrs", "r.cells").drop("r")
        data = F.array_contains(F.col("cells")["th"], False)
    else:
        n = markup.nodes(pages, elements=row, columns=("node", "kind", "tag", "attrs")).where((F.col("kind") == "element") & (F.col("tag") == row))
        none = F.array().cast("array<struct<col:int,th:boolean,text:string,across:int>>")
        r = n.select("page_id", (F.row_number().over(W.partitionBy("page").orderBy("node")) - 1).alias("row_no"), "attrs", none.alias("cells"), *(F.lit(None).cast("int").alias(f"c{k}") for k, f in enumerate(fields) if f.header))
        data = F.lit(False)
    r = r.where(data | F.exists(F.map_keys("attrs"), lambda k: k.startswith("data-")))
    texts = []
    for k, f in enumerate(fields):
        sources = []
        if f.attr:
            sources.append(F.nullif(F.element_at("attrs", f.attr.lower()), F.lit("")))
        if f.header:
            sources.append(_cell_at(F.col(f"c{k}")))
        if f.position is not None:
            sources.append(F.get("cells", F.lit(f.position))["text"])
        texts.append(F.coalesce(*sources).alias(f"t{k}"))
    return r.select("page_id", "row_no", *texts)


def _value(f: Field, text: Column) -> Column:
    return text if f.type == "string" else expr.to_int(text) if f.type == "int" else expr.to_float(text) if f.type == "double" else expr.truthy(text)


def _diagnostics(fields: Sequence[tuple[Field, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(text.isNotNull() & _value(f, text).isNull(), F.lit(f.name)) for f, text in fields)))


def extract_rows(pages: DataFrame, fields: Sequence[Field], row: str = "tr") -> DataFrame:
    """(page_id, row_no, the fields, diagnostics) of every table row with a data cell or a data attribute; or, with another ``row``, of every element of
    that name, which has attributes only. Text that doesn't cast to the field's type is null and named in ``diagnostics``.
    """
    read = [(f, F.col(f"t{k}")) for k, f in enumerate(fields)]
    return _texts(pages, fields, row).select("page_id", "row_no", *(_value(f, text).alias(f.name) for f, text in read), _diagnostics(read).alias("diagnostics"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks(page_id, ord, tag, rank, text) in page order: elements of BLOCK_TAGS up to the next one; rank is a heading's level, else null."""
    tags = "|".join(BLOCK_TAGS)
    found = F.regexp_extract_all("html", F.lit(rf"(?is)<(?:{tags})(?=[\s>])[^>]*>.*?(?=<(?:{tags})(?=[\s>])|</(?:{tags}|ul|ol|table|article|section|body)>|$)"), 0)
    b = pages.select("page_id", F.posexplode(found).alias("ord", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([a-zA-Z0-9]+)", 1))
    return b.select("page_id", "ord", tag.alias("tag"), F.nullif(F.regexp_extract(tag, r"^h([1-6])$", 1), F.lit("")).cast("int").alias("rank"), plain("raw").alias("text"), F.regexp_extract("raw", r"(?i)href\s*=\s*[\"']([^\"']*)", 1).alias("href")).where("text != ''")


def bounded_sections(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(page_id, section_id, ord, text, bounded): blocks after the start heading, before the end anchor or the next heading of its rank or above.

    anchors(page_id, section_id, start, end): a page without the start has no section; a section to the page's end isn't bounded.
    """
    b = blocks.join(anchors, "page_id")
    same = lambda c: expr.folded("text") == expr.folded(c)
    w = W.partitionBy("page_id", "section_id")
    b = b.withColumn("at", F.min(F.when(F.col("rank").isNotNull() & same("start"), F.struct("ord", "rank"))).over(w)).where("at IS NOT NULL AND ord > at.ord")
    stop = F.when(same("end") | (F.col("rank") <= F.col("at.rank")), F.col("ord"))
    b = b.withColumn("stop", F.min(stop).over(w))
    return b.where("stop IS NULL OR ord < stop").select("page_id", "section_id", "ord", "tag", "text", F.col("stop").isNotNull().alias("bounded"))


def labeled_fields(section_rows: DataFrame, label_map: DataFrame) -> DataFrame:
    """section_rows(section_id, ord, label, value), label_map(label, field) -> the first value of each field."""
    known = label_map.select(expr.folded("label").alias("_l"), "field")
    j = section_rows.withColumn("_l", F.regexp_replace(expr.folded("label"), r"\s*:$", "")).join(known, "_l")
    return j.where("value IS NOT NULL AND trim(value) != ''").groupBy("section_id", "field").agg(F.min_by("value", "ord").alias("value"))


def section_text(section_blocks: DataFrame, terms: Sequence[str], min_len: int = 20, limit: int = 5000, key: Sequence[str] = ("section_id",)) -> DataFrame:
    """(section_id, text, truncated): blocks of ``min_len`` characters or more with one of the terms, joined in order and cut."""
    hit = F.lower("text").rlike("|".join(terms))
    b = section_blocks.where((F.length("text") >= min_len) & hit)
    t = b.groupBy(*key).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])).alias("t"))
    return t.select(*key, F.substring("t", 1, limit).alias("text"), (F.length("t") > limit).alias("truncated"))


def affinity_observations(titles: DataFrame, cells: DataFrame) -> DataFrame:
    """titles(section_id, idx, status) x cells(section_id, idx, value): column i's title classes row i -> (section_id, status, values, state)."""
    v = F.when(F.lower(F.trim("value")).isin("", "none", "-"), None).otherwise(F.lower(F.trim("value")))
    j = titles.join(cells.withColumn("v", v).withColumn("seen", F.lit(True)), ["section_id", "idx"], "left")
    per = j.groupBy("section_id", "status").agg(F.sort_array(F.collect_set("v")).alias("values"), F.max("seen").alias("seen"))
    return per.select("section_id", "status", "values", F.when(F.col("seen").isNull(), "unknown").otherwise(expr.value_state("values")).alias("state"))


def structural_blocks(pages: DataFrame, unit: str | None = None) -> DataFrame:
    """Tokens (unit_id, unit_no, block_ord, tok_ord, kind, depth, text, href, title, block_tag, parent_block, ancestry, row, col) of a page's blocks.

    A page is a unit, or with a ``unit`` class each element that has it, numbered in ``unit_no``. A token belongs to the innermost block around it: a list item, paragraph,
    heading or cell, numbered as they open; what stands in none is block 0, the root. Kinds are text, reference (a link, with href and title), icon (an image's alt
    or title), line_break, and diagnostic for a unit without any. ``depth`` is the number of open lists, ``ancestry`` the list items and cells around with
    their numbers, ``parent_block`` the list item around the block; row and col are a table cell's place in its table, from 1, and null elsewhere.
    """
    n = markup.nodes(pages, unit=unit, elements="", columns=("kind", "@href", "@title", "text", "block", "block_tag", "ancestry", "depth", "item", "unit", "tok", "spot")).where("unit IS NOT NULL")
    spot = lambda c: F.when(F.col("block_tag").isin("td", "th"), F.col("spot")[c])
    attr = lambda a: F.when(F.col("kind") == "reference", F.nullif(F.col(f"@{a}"), F.lit("")))
    return n.select(F.col("page_id").alias("unit_id"), F.col("unit").alias("unit_no"), F.col("block").alias("block_ord"), F.col("tok").alias("tok_ord"), "kind", "depth", "text", attr("href").alias("href"), attr("title").alias("title"), "block_tag", F.col("item").alias("parent_block"), "ancestry", spot("row").alias("row"), spot("col").alias("col"))


def grid_units(pages: DataFrame, entry: str, title: str, description: str, placeholder: str = "skill name") -> DataFrame:
    """(page_id, entry_no, title, description, section, reason) of the elements of the ``entry`` class: the text of the first element of each of the other classes in it.

    An entry without a title, or with the table head's ``placeholder`` for one, or without a description, has a ``reason``: missing_title or missing_description.
    """
    n = markup.nodes(pages, (entry, title, description), elements="marked", columns=("node", "kind", "text", "section", "within")).where(F.element_at("within", entry).isNotNull()).repartition("page")
    e = n.select("page_id", "page", "node", "kind", "text", "section", F.element_at("within", entry).alias("entry"), F.element_at("within", title).alias("t"), F.element_at("within", description).alias("d"))
    first = lambda c: F.min(F.when(F.col(c) > F.col("entry"), F.col(c))).over(W.partitionBy("page", "entry"))
    e = e.withColumns({"t0": first("t"), "d0": first("d")})
    said = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin("text", "reference") & (F.col(c) == F.col(f"{c}0")), F.struct("node", "text")))), lambda x: x["text"]), " ")
    g = e.groupBy("page", "entry").agg(F.first("page_id").alias("page_id"), F.max(F.when(F.col("node") == F.col("entry"), F.col("section"))).alias("section"), said("t").alias("title"), said("d").alias("description"), F.max("d0").alias("d0"))
    reason = F.when(F.col("title") == "", "missing_title").when(F.col("d0").isNull() | (F.lower("title") == placeholder), "missing_description")
    return g.select("page_id", (F.row_number().over(W.partitionBy("page").orderBy("entry")) - 1).alias("entry_no"), "title", "description", F.coalesce("section", F.lit("Unsectioned combat source")).alias("section"), reason.alias("reason"))


def skill_rows(pages: DataFrame, specs: Mapping[str, Sequence[Field]], row: str = "tr") -> DataFrame:
    """Rows of each record type's fields as one stream; ``gated`` where the section or row speaks of an awakening."""
    from factloom.operators.ranked import union_facts

    types: dict[str, set[str]] = {}
    for fields in specs.values():
        for f in fields:
            types.setdefault(f.name, set()).add(f.type)
    if len(specs) < 2 or any(len(t) > 1 for t in types.values()):
        out = union_facts(**{kind: extract_rows(pages, fields, row) for kind, fields in specs.items()})
    else:
        # Pages are read once for all record types.
        asked: list[Field] = []
        for fields in specs.values():
            asked += [f for f in fields if f not in asked]
        each = F.explode(F.array(*(F.lit(k) for k in range(len(specs))))).alias("_k")
        r = _texts(pages, asked, row).select("*", each)
        reads = [{f.name: (f, F.col(f"t{asked.index(f)}")) for f in fields} for fields in specs.values()]
        by_kind = lambda made: reduce(lambda c, x: c.when(F.col("_k") == x[0], x[1]), [(k, x) for k, x in enumerate(made) if x is not None], F)
        fields = {n: by_kind([_value(*read[n]) if n in read else None for read in reads]).alias(n) for n in types}
        first = [n for n in fields if n in reads[0]]
        out = r.select("page_id", "row_no", *(fields[n] for n in first), by_kind([_diagnostics(list(read.values())) for read in reads]).alias("diagnostics"), by_kind(list(map(F.lit, specs))).alias("record_type"), *(c for n, c in fields.items() if n not in first))
    text = F.lower(F.concat_ws(" ", *(F.col(c) for c, t in out.dtypes if t == "string" and c not in ("page_id", "record_type"))))
    return out.withColumn("gated", text.rlike(r"stellar|awakened"))


def sidekick_rows(blocks: DataFrame) -> DataFrame:
    """blocks(page_id, ord, text) -> kind auto, charge or aura; others are ``unknown`` with a diagnostic."""
    t = F.lower("text")
    kind = F.when(t.rlike(r"^aura\b|\baura:"), "aura").when(t.rlike(r"^charged?\b|\bconsumes?\s+\d+\s+charge\b"), "charge").when(t.rlike(r"^auto\b|\bauto skill\b"), "auto").otherwise("unknown")
    return blocks.withColumn("kind", kind).withColumn("diagnostic", F.when(F.col("kind") == "unknown", "unclassified_block"))


def aura_fields(blocks: DataFrame) -> DataFrame:
    """blocks(unit_id, ord, text) -> the first block that states a condition, and the later ones as effect."""
    w = W.partitionBy("unit_id")
    cond = F.lower("text").rlike(r"^(?:when|while|if)\b|activation condition")
    b = blocks.withColumn("c", F.min(F.when(cond, F.col("ord"))).over(w))
    per = b.groupBy("unit_id").agg(F.max(F.when(F.col("ord") == F.col("c"), F.col("text"))).alias("condition"), F.array_sort(F.collect_list(F.when(F.col("c").isNull() | (F.col("ord") > F.col("c")), F.struct("ord", "text")))).alias("x"))
    effect = F.concat_ws("\n", F.transform("x", lambda y: y["text"]))
    return per.select("unit_id", "condition", effect.alias("effect"), F.when(F.col("condition").isNull(), "no_condition").when(effect == "", "no_effect").otherwise("ok").alias("status"))
