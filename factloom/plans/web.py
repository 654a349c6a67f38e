"""Queries on pages, reference graphs and event states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import aggregate, ranked, reconcile, refgraph
from factloom.plans.common import Registry
from factloom.sources import pages
from factloom.storage import table
from factloom.streaming import jobs

R = Registry()


@R.add("SELECT page_id, url, sha256(html) AS capture_sha256 FROM pages")
def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.read_captures(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", "capture_sha256")


@R.add("SELECT page_id, CAST(row_no AS INTEGER) AS row_no, regexp_extract(raw, 'href=\"([^\"]*)\"', 1) AS href, regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g') AS label FROM (SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS row_no FROM (SELECT page_id, regexp_extract_all(html, '<li><a href=\"[^\"]*\">[^<]*</a></li>') AS l FROM pages))")
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.posexplode(F.regexp_extract_all("html", F.lit(r'<li><a href="[^"]*">[^<]*</a></li>'), 0))
    rows = table(spark, sf_dir, "pages").select("page_id", found.alias("row_no", "raw"))
    return rows.select("page_id", "row_no", F.regexp_extract("raw", r'href="([^"]*)"', 1).alias("href"), F.regexp_replace(F.regexp_replace("raw", r"<[^>]*>", ""), r"\s+", " ").alias("label"))


_BLOCKS = """b AS (SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS ord FROM (SELECT page_id, regexp_extract_all(replace(replace(html, '<p>', chr(1) || '<p>'), '<h1>', chr(1) || '<h1>'), chr(1) || '<(?:p|h1)>[^' || chr(1) || ']*') AS l FROM (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS html FROM pages)))"""


@R.add(f"""WITH {_BLOCKS}, c AS (SELECT page_id, ord, CASE WHEN starts_with(raw, chr(1) || '<h1>') THEN 'h1' ELSE 'p' END AS tag, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\\s\\x01]+', ' ', 'g')) AS t FROM b)
  SELECT page_id, tag, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM c WHERE t != '' GROUP BY 1, 2""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("html", F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1))
    b = pages.page_blocks(p)
    return b.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


_CLEAN = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\\s\\x01]+', ' ', 'g'))"


@R.add(f"""WITH {_BLOCKS}, c AS (SELECT page_id, ord, starts_with(raw, chr(1) || '<h1>') AS h, {_CLEAN} AS t FROM b), a AS (SELECT page_id, min(ord) AS a0 FROM c WHERE h AND t != '' GROUP BY 1), s AS (SELECT a.page_id, a0, min(CASE WHEN h OR lower(t) = 'references' THEN ord END) AS stop FROM a LEFT JOIN c ON c.page_id = a.page_id AND ord > a0 GROUP BY 1, 2),
  j AS (SELECT c.page_id, string_agg(t, chr(10) ORDER BY ord) AS t FROM s JOIN c ON c.page_id = s.page_id AND ord > a0 AND (stop IS NULL OR ord < stop) WHERE length(t) >= 20 AND regexp_matches(lower(t), 'th|en') GROUP BY 1)
  SELECT page_id, 'body' AS section_id, substr(t, 1, 5000) AS text, length(t) > 5000 AS truncated FROM j""")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each page below its title's heading."""
    b = pages.page_blocks(table(spark, sf_dir, "pages"))
    anchors = b.where("rank = 1").groupBy("page_id").agg(F.min_by("text", "ord").alias("start")).select("page_id", F.lit("body").alias("section_id"), "start", F.lit("references").alias("end"))
    s = pages.bounded_sections(b, anchors)
    return pages.section_text(s, ["th", "en"], 20, 5000, ["page_id", "section_id"])


_TOKENS = r"(?is)<a\b[^>]*>.*?</a>|<img\b[^>]*>|<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>|[^<]+"


@R.add(f"""WITH k AS (SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '{_TOKENS}') AS l FROM pages)), r AS (SELECT *, lower(raw) AS x FROM k),
  t AS (SELECT *, CASE WHEN regexp_matches(x, '^<a[ >]') THEN 'reference' WHEN starts_with(x, '<img') THEN 'icon' WHEN regexp_matches(x, '^<br[ />]') THEN 'line_break' WHEN NOT starts_with(x, '<') THEN 'text' END AS kind,
    sum(CASE WHEN regexp_matches(x, '^<(ul|ol)[ >]') THEN 1 WHEN regexp_matches(x, '^</(ul|ol)') THEN -1 ELSE 0 END) OVER w AS depth, sum(CASE WHEN regexp_matches(x, '^<(h[1-6]|p|li|td|th|dt|dd|blockquote|figcaption|title)[ >]') THEN 1 ELSE 0 END) OVER w AS block FROM r WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
  SELECT page_id AS unit_id, kind, count(*) AS n, CAST(max(greatest(0, depth)) AS BIGINT) AS depth, CAST(max(block) AS BIGINT) AS blocks FROM t WHERE kind IS NOT NULL AND (kind = 'line_break' OR CASE WHEN kind = 'icon' THEN regexp_extract(raw, 'alt=\"([^\"]*)', 1) ELSE trim(replace(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), '&nbsp;', ' ')) END != '') GROUP BY 1, 2""")
def structural_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pages.structural_blocks(table(spark, sf_dir, "pages"))
    return t.groupBy("unit_id", "kind").agg(F.count("*").alias("n"), F.max("depth").cast("long").alias("depth"), F.max("block_ord").cast("long").alias("blocks"))


@R.add(f"""WITH RECURSIVE k AS (SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '{_TOKENS}') AS l FROM pages)), x AS (SELECT *, lower(regexp_extract(raw, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS n, starts_with(raw, '</') AS shut FROM k),
  y AS (SELECT *, n != '' AND NOT shut AND n NOT IN ('br', 'meta', 'img', 'a', 'script', 'style') AS opens, NOT shut AND regexp_matches(n, '^(h[1-6]|p|li|td|th|dt|dd|blockquote|figcaption|title)$') AS block, NOT shut AND n IN ('p', 'div', 'ul', 'ol', 'nav', 'article', 'footer', 'h1', 'section', 'table') AS ends_p FROM x),
  w AS (SELECT page_id, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS names, CAST([] AS INTEGER[]) AS blocks, 0 AS nb FROM pages
    UNION ALL SELECT page_id, pos, CASE WHEN opens THEN list_append(names[1:d], n) ELSE names[1:d] END, CASE WHEN opens THEN list_append(blocks[1:d], CASE WHEN block THEN nb + 1 ELSE 0 END) ELSE blocks[1:d] END, CASE WHEN block THEN nb + 1 ELSE nb END
    FROM (SELECT w.page_id, y.pos, names, blocks, nb, n, opens, block, CASE WHEN shut AND list_contains(names, n) THEN len(names) - list_position(list_reverse(names), n) WHEN ends_p AND list_contains(names, 'p') THEN len(names) - list_position(list_reverse(names), 'p') ELSE len(names) END AS d FROM w JOIN y ON y.page_id = w.page_id AND y.pos = w.pos + 1)),
  t AS (SELECT y.page_id, coalesce(list_last(list_filter(blocks, lambda b: b > 0)), 0) AS block_ord, CASE WHEN n = 'a' AND NOT shut THEN 'reference' WHEN n = 'img' THEN 'icon' WHEN n = 'br' THEN 'line_break' ELSE 'text' END AS kind FROM y JOIN w ON w.page_id = y.page_id AND w.pos = y.pos
    WHERE n IN ('br', 'img') OR n = 'a' AND NOT shut AND trim(regexp_replace(raw, '<[^>]*>', '', 'g')) != '' OR NOT starts_with(raw, '<') AND trim(replace(regexp_replace(raw, '\\s+', ' ', 'g'), '&nbsp;', ' ')) != '')
  SELECT page_id AS unit_id, CAST(block_ord AS INTEGER) AS block_ord, kind, count(*) AS n FROM t GROUP BY ALL""")
def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of each kind each block of the pages has; some of their paragraphs and inline elements aren't closed."""
    return pages.structural_blocks(table(spark, sf_dir, "pages")).groupBy("unit_id", "block_ord", "kind").agg(F.count("*").alias("n"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    a = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    b = s.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    return a.unionByName(b)


#: Reach of roots r(root) over edges e(src, dst) by recursion, and its measures.
TOPOLOGY_SQL = """s AS (SELECT root, root AS node, 0 AS d FROM r UNION SELECT s.root, e.dst, s.d + 1 FROM s JOIN e ON s.node = e.src WHERE s.d < {ceiling}),
  f AS (SELECT root, node, min(d) AS d FROM s GROUP BY 1, 2), top AS (SELECT (SELECT count(*) FROM e) AS n_edges, CAST((SELECT max(d) FROM f) AS INTEGER) AS depth, (SELECT max(n) FROM (SELECT count(*) AS n FROM f GROUP BY root)) AS pages, (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY src)) AS out_degree)"""
REGIONS_SQL = "WITH RECURSIVE e AS (SELECT r_name AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON r_regionkey = n_regionkey UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), r AS (SELECT r_name AS root FROM region), " + TOPOLOGY_SQL.format(ceiling=32)


@R.add(f"{REGIONS_SQL} SELECT * FROM top")
def reference_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refgraph.topology(table(spark, sf_dir, "region").select(F.col("r_name").alias("root")), _edges(spark, sf_dir))


@R.add("""WITH e AS (SELECT r_name AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON r_regionkey = n_regionkey UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), r AS (SELECT src, dst, CASE WHEN dst = 's7' THEN 'unresolved' WHEN dst LIKE '%3' THEN 'excluded' END AS base FROM e),
  a AS (SELECT src AS root, src, dst, base, 1 AS depth, 1 AS seen FROM r JOIN region ON r_name = src), a2 AS (SELECT *, CASE WHEN base IS NULL AND count(*) OVER w > 64 THEN 'frontier_exhausted' ELSE base END AS f FROM a WINDOW w AS (PARTITION BY root ORDER BY src, src || '>' || dst ROWS UNBOUNDED PRECEDING)),
  a3 AS (SELECT *, CASE WHEN f IS NOT NULL THEN f WHEN seen + count(CASE WHEN f IS NULL THEN 1 END) OVER w > 8 THEN 'page_exhausted' ELSE 'resolved' END AS status FROM a2 WINDOW w AS (PARTITION BY root ORDER BY src, src || '>' || dst ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT a3.root, r.src, r.dst, r.base, 2 AS depth, 1 + (SELECT count(*) FROM a3 z WHERE z.root = a3.root AND z.status = 'resolved') AS seen FROM a3 JOIN r ON r.src = a3.dst WHERE a3.status = 'resolved'), b2 AS (SELECT *, CASE WHEN base IS NULL AND count(*) OVER w > 64 THEN 'frontier_exhausted' ELSE base END AS f FROM b WINDOW w AS (PARTITION BY root ORDER BY src, src || '>' || dst ROWS UNBOUNDED PRECEDING)),
  b3 AS (SELECT *, CASE WHEN f IS NOT NULL THEN f WHEN seen + count(CASE WHEN f IS NULL THEN 1 END) OVER w > 8 THEN 'page_exhausted' ELSE 'resolved' END AS status FROM b2 WINDOW w AS (PARTITION BY root ORDER BY src, src || '>' || dst ROWS UNBOUNDED PRECEDING))
  SELECT root, CAST(depth AS INTEGER) AS depth, status, count(*) AS n FROM (SELECT root, depth, status FROM a3 UNION ALL SELECT root, depth, status FROM b3) GROUP BY 1, 2, 3""")
def bounded_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each region reaches over nations and suppliers within three levels, eight pages and 64 references."""
    e = _edges(spark, sf_dir)
    refs = e.select(F.col("src").alias("unit_id"), F.concat_ws(">", "src", "dst").alias("occurrence"), F.concat(F.lit("http://x/"), "dst").alias("url"))
    nodes = e.select(F.col("dst").alias("unit_id")).distinct()
    index = refgraph.destination_index(nodes.where("unit_id != 's7'").withColumn("url", F.concat(F.lit("http://x/"), "unit_id")))
    classes = nodes.select("unit_id", F.when(F.col("unit_id").endswith("3"), "excluded").otherwise("combat").alias("class"))
    out = refgraph.resolve_bounded(table(spark, sf_dir, "region").select(F.col("r_name").alias("root")), refs, index, classes)
    return out.groupBy("root", "depth", "status").agg(F.count("*").alias("n"))


def _sold_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each part to the parts on the lines after its first and its last sale: a graph with cycles."""
    li = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("at"), F.col("l_partkey").alias("src"))
    # The line after a line of an order: its number plus one.
    after = li.select(F.struct(F.col("at.l_orderkey").alias("l_orderkey"), (F.col("at.l_linenumber") - 1).alias("l_linenumber")).alias("at"), F.col("src").alias("dst"))
    pairs = li.join(after, "at").groupBy("src").agg(F.min_by("dst", F.struct("at", "dst")).alias("a"), F.max_by("dst", F.struct("at", "dst")).alias("b"))
    return pairs.select("src", F.explode(F.array("a", "b")).alias("dst")).distinct()


_SOLD_SQL = """p AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, a.l_orderkey AS o, a.l_linenumber AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
  e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY o, n, dst) AS x, row_number() OVER (PARTITION BY src ORDER BY o DESC, n DESC, dst DESC) AS y FROM p) WHERE x = 1 OR y = 1 GROUP BY 1, 2), r AS (SELECT DISTINCT min(p_partkey) AS root FROM part GROUP BY p_type, p_size)"""


@R.add(f"WITH RECURSIVE {_SOLD_SQL}, {TOPOLOGY_SQL.format(ceiling=12)} SELECT * FROM top")
def cyclic_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first part of each type and size leads to within twelve sales."""
    roots = table(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.min("p_partkey").alias("root")).select("root")
    return refgraph.topology(roots, _sold_next(spark, sf_dir), 12)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "view", "cached").when(F.col("event_type") == "click", "parsed").when(F.col("event_type") == "purchase", "loaded").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return e.select(F.col("user_id").alias("target_id"), "ts", "event_id", state.alias("state"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), "event_id")).alias("error"), F.lit("u").alias("url"))


_STATE_SQL = "s AS (SELECT user_id AS target_id, ts, event_id, CASE event_type WHEN 'view' THEN 'cached' WHEN 'click' THEN 'parsed' WHEN 'purchase' THEN 'loaded' WHEN 'error' THEN 'failed' ELSE 'pending' END AS state, CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error FROM events)"


@R.add(f"WITH {_STATE_SQL} SELECT target_id, (list(state ORDER BY ts DESC, state DESC))[1] AS state, count_if(state IN ('cached', 'failed')) AS attempts, (list(error ORDER BY ts DESC, error DESC) FILTER (WHERE error IS NOT NULL))[1] AS last_error, count(*) AS n_events FROM s GROUP BY 1")
def target_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.fold_states(_events(spark, sf_dir)).select("target_id", "state", "attempts", "last_error", "n_events")


@R.add(f"""WITH {_STATE_SQL}, f AS (SELECT target_id, (list(state ORDER BY ts DESC, state DESC))[1] AS state FROM s GROUP BY 1), g AS (SELECT count(*) AS total, count_if(state = 'loaded') AS loaded, count_if(state = 'failed') AS failed, count_if(state IN ('pending', 'cached', 'parsed')) AS pending FROM f)
  SELECT *, round_even(100 * loaded / total, 1) AS loaded_pct, round_even(100 * failed / total, 1) AS failed_pct, round_even(100 * pending / total, 1) AS pending_pct FROM g""")
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.crawl_summary(reconcile.fold_states(_events(spark, sf_dir)))


@R.add("""WITH o AS (SELECT user_id AS run_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), w AS (SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY ts) AS k FROM o)
  SELECT run_id, epoch_us(min(ts)) AS started, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS latency_s, count(*) AS stages, date_diff('microsecond', min(ts), max(ts)) / 1e6 > 3600 AS breach FROM w GROUP BY run_id, k""")
def run_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return jobs.run_latency(e.select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts")), 3600, "6 hours").withColumn("started", F.unix_micros("started"))


@R.add("""WITH o AS (SELECT user_id AS run_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), w AS (SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY ts) AS k FROM o),
  r AS (SELECT min(ts) AS a, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS l FROM w GROUP BY run_id, k)
  SELECT epoch_us(time_bucket(INTERVAL 1 DAY, a)) AS "from", count(*) AS runs, round(quantile_cont(l, 0.5), 4) AS p50, round(quantile_cont(l, 0.95), 4) AS p95, count(*) FILTER (l > 3600) AS breaches FROM r GROUP BY time_bucket(INTERVAL 1 DAY, a)""")
def latency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = jobs.latency_rollup(jobs.run_latency(e.select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts")), 3600, "6 hours"))
    return out.select(F.unix_micros("from").alias("from"), "runs", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "breaches")


@R.add("SELECT conv_id AS run_id, turn AS call_number, length(text) AS tokens, CAST(sum(length(text)) OVER w AS BIGINT) AS used, CAST(greatest(0, 800 - sum(length(text)) OVER w) AS BIGINT) AS left, sum(length(text)) OVER w > 800 AS over FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)".replace(" AS left,", ' AS "left",').replace(" AS over ", ' AS "over" '))
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return jobs.running_budget(c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("call_number"), F.length("text").cast("long").alias("tokens")), 800)


@R.add("SELECT 'page:' || trim(regexp_replace(lower(regexp_extract(url, '//([^/]*)', 1)), '[^a-z0-9]+', '_', 'g'), '_') AS target_id, 'page' AS kind, min(page_id) AS first_page FROM pages GROUP BY 1")
def derive_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"//([^/]*)", 1)
    rows = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), host.alias("name"), F.col("page_id").cast("string").alias("url"), F.col("page_id").alias("position"))
    return reconcile.derive_targets(rows, {}).select("target_id", "kind", F.col("url").cast("long").alias("first_page"))


@R.add("SELECT lower(lang) AS side, CAST(count(DISTINCT doc_id) AS BIGINT) AS n FROM documents GROUP BY 1")
def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return aggregate.status_distribution(d.select(F.lower("lang").alias("side")), "side")


@R.add("SELECT page_id, 'left' AS side FROM (SELECT page_id FROM pages WHERE page_id % 3 != 0 EXCEPT SELECT page_id FROM pages WHERE page_id % 2 = 0) UNION ALL SELECT page_id, 'right' FROM (SELECT page_id FROM pages WHERE page_id % 2 = 0 EXCEPT SELECT page_id FROM pages WHERE page_id % 3 != 0)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return ranked.set_difference(p.where("page_id % 3 != 0"), p.where("page_id % 2 = 0"), "page_id")
