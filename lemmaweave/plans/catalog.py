"""Queries of the relational and graph operators over the driver tables, each with its SQL.

Roles: documents stand for papers, conversations for ordered source blocks, page
links for citation keys, labels for resolution states, events for a checkpoint
log, and the order tables for generic relations and edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import graph, relational
from ..session import reach_workers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Tables of one folder by attribute."""

    def __init__(self, spark: SparkSession, folder: str, **own: DataFrame):
        reach_workers(spark)
        self.spark, self._folder, self._own = spark, folder, own

    def replaced(self, **own: DataFrame) -> Tables:
        """The same folder with other tables under some names."""
        return Tables(self.spark, self._folder, **own)

    def __getattr__(self, name: str) -> DataFrame:
        if name in self._own:
            return self._own[name]
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def hrefs(pages: DataFrame) -> DataFrame:
    """page_id, key: one row per link, the key behind the slash."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("key"))


_HREFS = """h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS key FROM pages)"""
_FIRST_WORD = "w AS (SELECT doc_id, split_part(text, ' ', 1) AS key FROM documents)"


def first_words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.split("text", " ").getItem(0).alias("key"))


@query("SELECT p_partkey, p_type, p_brand, p_size FROM part WHERE p_type LIKE 'STANDARD%' OR p_brand = 'Brand#11' ORDER BY p_type, p_partkey LIMIT 50 OFFSET 20")
def list_results_page(t: Tables) -> DataFrame:
    rows = t.part.where(F.col("p_type").startswith("STANDARD") | (F.col("p_brand") == "Brand#11"))
    return relational.page(rows.select("p_partkey", "p_type", "p_brand", "p_size"), ["p_type", "p_partkey"], 50, 20)


@query("SELECT doc_id, lang, substring(text, 1, 240) AS excerpt FROM documents WHERE contains(lower(text), 'the')")
def substring_search(t: Tables) -> DataFrame:
    return relational.substring_search(t.documents, F.lit(None).cast("string"), F.col("text"), "the").select("doc_id", "lang", "excerpt")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def get_by_key(t: Tables) -> DataFrame:
    key = t.orders.agg(F.min("o_orderkey").alias("o_orderkey"))
    return t.orders.join(F.broadcast(key), "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@query(f"WITH {_HREFS} SELECT page_id, key, count(*) AS n FROM h GROUP BY page_id, key")
def citations_outgoing(t: Tables) -> DataFrame:
    return hrefs(t.pages).groupBy("page_id", "key").agg(F.count("*").alias("n"))


@query(f"WITH {_HREFS} SELECT key, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM h GROUP BY key")
def citations_incoming(t: Tables) -> DataFrame:
    return hrefs(t.pages).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query(f"""WITH {_HREFS}, {_FIRST_WORD}, k AS (SELECT key, count(*) AS c, min(doc_id) AS m FROM w GROUP BY key)
SELECT page_id, h.key, CASE WHEN c = 1 THEN 'resolved_unique' WHEN c > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution_status, CASE WHEN c = 1 THEN m END AS target FROM h LEFT JOIN k ON h.key = k.key""")
def left_resolve_tristate(t: Tables) -> DataFrame:
    return relational.tristate(hrefs(t.pages), "key", first_words(t.documents), "doc_id").select("page_id", "key", "resolution_status", "target")


@query(f"WITH {_HREFS}, {_FIRST_WORD}, k AS (SELECT key, min(doc_id) AS target FROM w GROUP BY key) SELECT page_id, h.key, target FROM h LEFT JOIN k ON h.key = k.key")
def late_bound_target(t: Tables) -> DataFrame:
    """Targets are bound when read, so a later document resolves an older reference."""
    return hrefs(t.pages).join(first_words(t.documents).groupBy("key").agg(F.min("doc_id").alias("target")), "key", "left").select("page_id", "key", "target")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def mention_containment(t: Tables) -> DataFrame:
    return relational.containment(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("needle"))).select("doc_id", "item_id")


@query("SELECT o_orderkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unresolved_anti(t: Tables) -> DataFrame:
    return relational.unresolved(t.orders.select("o_orderkey", "o_orderpriority"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def selected_semi(t: Tables) -> DataFrame:
    back = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(back, "o_orderkey", "left_semi")


@query("SELECT p_brand, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def inner_results_papers(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS positions FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def link_positions(t: Tables) -> DataFrame:
    rows = relational.chain(t.lineitem, [(t.orders, "l_orderkey", "o_orderkey")]).select("l_orderkey", F.col("l_linenumber").alias("position"))
    return relational.listed(rows, "l_orderkey", "position")


@query("SELECT a.conv_id, a.role AS first_role, b.role AS next_role FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = 1 WHERE a.turn = 0")
def first_child_left(t: Tables) -> DataFrame:
    c = t.conversations
    return relational.first_child(c.where("turn = 0").select("conv_id", F.col("role").alias("first_role")), c.where("turn = 1"), "conv_id", ["turn"], {"role": "next_role"})


@query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_lines, count(*) FILTER (l_returnflag = 'R') AS n_returned
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def paper_counts(t: Tables) -> DataFrame:
    """Per-parent counts of several child tables, zero where there are none."""
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_returnflag")
    return relational.zero_filled_counts(t.customer.select("c_custkey"), "c_custkey", {
        "n_orders": (t.orders, "o_custkey", None), "n_lines": (lines, "o_custkey", None), "n_returned": (lines, "o_custkey", F.col("l_returnflag") == "R")})


@query("SELECT p_type AS kind, count(*) AS n FROM part GROUP BY p_type")
def kind_counts(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (quality = 0 AND toxic = 1) AS n_both FROM labels")
def status_counts(t: Tables) -> DataFrame:
    return t.labels.agg(F.count("*").alias("n"), F.count_if(F.expr("quality = 1")).alias("n_good"), F.count_if(F.expr("toxic = 1")).alias("n_toxic"), F.count_if(F.expr("quality = 0 and toxic = 1")).alias("n_both"))


@query(f"WITH {_HREFS} SELECT key, sha256(key) AS group_id, count(*) AS n, string_agg(DISTINCT CAST(page_id AS VARCHAR), ',' ORDER BY CAST(page_id AS VARCHAR)) AS members FROM h GROUP BY key")
def blocker_groups(t: Tables) -> DataFrame:
    return relational.groups(hrefs(t.pages), "key", "page_id").select("key", "group_id", "n", "members")


@query("SELECT md5(text) AS work, max(source) AS chosen, count(DISTINCT source) > 1 AS conflicting, count(*) AS n FROM documents GROUP BY md5(text)")
def version_conflicts(t: Tables) -> DataFrame:
    """The chosen version is the last in text order."""
    return relational.chosen_version(t.documents.select(F.md5(F.col("text").cast("binary")).alias("work"), "source"), "work", "source")


@query("SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def distinct_evidence(t: Tables) -> DataFrame:
    return relational.distinct_count(t.events, ["user_id", "event_type"])


@query("""SELECT conv_id, string_agg(substring(text, 1, 160), '|' ORDER BY f) AS texts FROM
(SELECT conv_id, text, min(turn) AS f, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS r FROM conversations GROUP BY conv_id, text) WHERE r <= 5 GROUP BY conv_id""")
def first_k_texts(t: Tables) -> DataFrame:
    return relational.first_texts(t.conversations, "conv_id", "text", "turn")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY user_id, event_type")
def dedupe_last_wins(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents d WHERE doc_id = (SELECT min(doc_id) FROM documents e WHERE e.text = d.text)")
def dedupe_first_wins(t: Tables) -> DataFrame:
    return relational.first_wins(t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("k")), ["k"], ["doc_id"]).select("doc_id", "lang")


@query("""SELECT p_partkey, CAST(CASE WHEN p_size < 10 THEN 4 ELSE 0 END + CASE WHEN p_type LIKE '%BRASS' THEN 3 ELSE 0 END + CASE WHEN p_brand = 'Brand#11' THEN 2 ELSE 0 END AS BIGINT) AS score FROM part""")
def score_sum(t: Tables) -> DataFrame:
    reasons = F.array(F.when(F.col("p_size") < 10, 4), F.when(F.col("p_type").endswith("BRASS"), 3), F.when(F.col("p_brand") == "Brand#11", 2))
    return t.part.select("p_partkey", F.aggregate(reasons, F.lit(0), lambda a, w: a + F.coalesce(w, F.lit(0))).cast("long").alias("score"))


@query("""SELECT conv_id, turn, CASE WHEN turn < lo THEN 'before' WHEN turn > hi THEN 'after' ELSE 'anchor' END AS role_in_slice FROM
(SELECT *, min(CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN n END) OVER (PARTITION BY conv_id) AS lo_n, max(CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN n END) OVER (PARTITION BY conv_id) AS hi_n,
 min(CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN turn END) OVER (PARTITION BY conv_id) AS lo, max(CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN turn END) OVER (PARTITION BY conv_id) AS hi
 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)) WHERE n BETWEEN lo_n - 2 AND hi_n + 2""")
def source_slice(t: Tables) -> DataFrame:
    anchor = (F.col("role") == "assistant") & (F.col("turn") % 3 == 0)
    return relational.around(t.conversations, ["conv_id"], ["turn"], anchor, 2).select("conv_id", "turn", "role_in_slice")


@query("SELECT conv_id, turn, lead(turn, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def read_blocks_next(t: Tables) -> DataFrame:
    return relational.following(t.conversations.select("conv_id", "turn"), "conv_id", "turn", 2, "next_turn")


@query("""SELECT conv_id, turn, sec AS section, CAST(row_number() OVER (PARTITION BY conv_id, sec ORDER BY turn) AS BIGINT) AS number FROM
(SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sec FROM conversations)""")
def running_counter(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = t.conversations.select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("section"))
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("conv_id", "section").orderBy("turn")).cast("long"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'F') WHERE r <= 3")
def early_signal(t: Tables) -> DataFrame:
    return relational.top_k(t.orders.where("o_orderstatus <> 'F'"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("""SELECT p_type, count(*) AS n_near, count(*) > 1 AS ambiguous FROM (SELECT p_type, CAST(round(p_retailprice * 100) AS BIGINT) AS c, max(CAST(round(p_retailprice * 100) AS BIGINT)) OVER (PARTITION BY p_type) AS top FROM part) WHERE c >= top - 5 GROUP BY p_type""")
def near_top_ambiguous(t: Tables) -> DataFrame:
    cents = t.part.select("p_type", F.round(F.col("p_retailprice") * 100).cast("long").alias("c"))
    top = cents.groupBy("p_type").agg(F.max("c").alias("top"))
    return cents.join(top, "p_type").where("c >= top - 5").groupBy("p_type").agg(F.count("*").alias("n_near")).withColumn("ambiguous", F.col("n_near") > 1)


@query("SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
def topk_candidates(t: Tables) -> DataFrame:
    return relational.top_k(t.orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 5).select("o_custkey", "o_orderkey", "rank")


@query("SELECT * FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM conversations) WHERE role = 'assistant'")
def adjacent_owner(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role")
    return relational.owner_before(rows, "conv_id", "turn", F.col("role") == "user", "owner").where("role = 'assistant'")


@query("SELECT DISTINCT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size < 25")
def set_difference(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("k")).subtract(t.part.where("p_size < 25").select("p_partkey"))


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def set_intersection(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).intersect(t.lineitem.where("l_returnflag = 'A'").select("l_suppkey"))


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def union_dedupe(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("k")).union(t.customer.select("c_nationkey")).distinct()


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem")
def direct_dependencies(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


@query("SELECT l_suppkey AS target, count(DISTINCT l_partkey) AS n_users FROM lineitem GROUP BY l_suppkey")
def where_used(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("target")).agg(F.countDistinct("l_partkey").alias("n_users"))


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS src, (p_partkey - 1) // 2 AS dst, 1 AS depth FROM part WHERE p_partkey > 1
UNION ALL SELECT src, (dst - 1) // 2, depth + 1 FROM r WHERE dst > 1) SELECT src, dst, CAST(depth AS BIGINT) AS depth FROM r WHERE dst > 0""")
def recursive_reachability(t: Tables) -> DataFrame:
    """All ancestors in a heap-shaped tree, by doubling the reach of every edge: log(depth) joins."""
    parents = t.part.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("(p_partkey - 1) div 2").alias("dst")).where("dst > 0")
    return graph.reach_in_tree(parents, t.part.select(F.col("p_partkey").alias("src")))


#: From the customer of an urgent order to that of the next one, in the order of keys: one walk that crosses itself.
_WALK = "w AS (SELECT o_custkey AS src, lead(o_custkey) OVER (ORDER BY o_orderkey) AS dst FROM orders WHERE o_orderpriority = '1-URGENT'), e AS (SELECT DISTINCT src, dst FROM w WHERE dst IS NOT NULL AND (src + dst) % 3 > 0)"


def urgent_walk(t: Tables) -> DataFrame:
    """src, dst of a graph with cycles over all customers.  The next order is found by its rank, which range partitions give in parts."""
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    ranked = relational.ranked(urgent, "o_orderkey")
    following = ranked.select((F.col("rank") - 1).alias("rank"), F.col("o_custkey").alias("dst"))
    return ranked.join(following, "rank").select(F.col("o_custkey").alias("src"), "dst").where("(src + dst) % 3 > 0").distinct()


@query("""WITH RECURSIVE n AS (SELECT n_nationkey AS k, (7 * n_nationkey + 3) % 25 AS d FROM nation), r AS (SELECT k, d FROM n UNION SELECT r.k, n.d FROM r JOIN n ON r.d = n.k) SELECT CAST(k AS BIGINT) AS node FROM r WHERE k = d""")
def cycle_members(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.lit("p").alias("paper_id"), F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    return graph.on_cycles(nodes).select(F.col("node").cast("long").alias("node"))


@query(f"WITH RECURSIVE {_WALK}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), m AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS comp FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) SELECT node, coalesce(comp, node) AS comp FROM n LEFT JOIN m USING (node)")
def strong_components(t: Tables) -> DataFrame:
    return graph.strong_components(urgent_walk(t))


@query("SELECT l_orderkey, c_name, n_name, r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def evidence_trace(t: Tables) -> DataFrame:
    out = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    out = relational.chain(out, [(t.orders, "l_orderkey", "o_orderkey"), (t.customer, "o_custkey", "c_custkey"), (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey")])
    return out.select("l_orderkey", "c_name", "n_name", "r_name", "n")


@query("""SELECT user_id, count(*) AS n_targets, count(*) FILTER (value > 50) AS n_done, count(*) FILTER (value <= 50) AS n_open FROM (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL) GROUP BY user_id""")
def checkpoint_progress(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.groupBy("user_id").agg(F.count("*").alias("n_targets"), F.count_if(F.expr("value > 50")).alias("n_done"), F.count_if(F.expr("value <= 50")).alias("n_open"))


@query("""SELECT o_orderkey, item, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY s, item) AS BIGINT) AS position FROM (SELECT o_orderkey, item, min(s) AS s FROM (
SELECT o_orderkey, o_custkey AS item, 0 AS s FROM orders UNION ALL SELECT l_orderkey, l_partkey, 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT l_orderkey, l_suppkey, 2 FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY ALL)""")
def queue_plan(t: Tables) -> DataFrame:
    """Sections in order, first place of an item wins, positions run through."""
    lines = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    items = t.orders.select("o_orderkey", F.col("o_custkey").alias("item"), F.lit(0).alias("s")).unionByName(lines.select(F.col("l_orderkey").alias("o_orderkey"), F.inline(F.array(F.struct(F.col("l_partkey").alias("item"), F.lit(1).alias("s")), F.struct(F.col("l_suppkey").alias("item"), F.lit(2).alias("s"))))))
    items = items.groupBy("o_orderkey", "item").agg(F.min("s").alias("s"))
    return items.select("o_orderkey", "item", F.row_number().over(Window.partitionBy("o_orderkey").orderBy("s", "item")).cast("long").alias("position"))


@query("SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'external_blocked' WHEN quality IS NULL THEN 'proofs_missing' WHEN n_chars < 500 THEN 'sparse' WHEN quality = 1 THEN 'usable' ELSE 'manual' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def triage_status(t: Tables) -> DataFrame:
    status = F.when(F.col("toxic") == 1, "external_blocked").when(F.col("quality").isNull(), "proofs_missing").when(F.col("n_chars") < 500, "sparse").when(F.col("quality") == 1, "usable").otherwise("manual")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", status.alias("status"))


@query("SELECT 'r' || r_regionkey AS node, 0::BIGINT AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def crawl_depth(t: Tables) -> DataFrame:
    edges = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).unionByName(
        t.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")))
    return graph.depths(t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("node")), edges, 10)


@query("""WITH RECURSIVE k AS (SELECT DISTINCT user_id AS id, event_type || (user_id // 7) AS x FROM events), e AS (SELECT DISTINCT a.id AS u, b.id AS v FROM k a JOIN k b ON a.x = b.x),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u) SELECT u AS id, min(v) AS root FROM r GROUP BY u""")
def connected_components(t: Tables) -> DataFrame:
    """Users that share an identifier, grouped through any chain of identifiers."""
    rows = t.events.select(F.col("user_id").alias("id"), F.concat("event_type", F.expr("cast(user_id div 7 as string)")).alias("x")).distinct()
    hub = rows.groupBy("x").agg(F.min("id").alias("v"))
    return graph.components(rows.join(hub, "x").select(F.col("id").alias("u"), "v"))


@query(r"SELECT doc_id, CASE WHEN length(s) > 240 THEN substring(s, 1, 237) || '...' ELSE s END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)")
def excerpt(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scalar.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT p_partkey, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)")
def slug(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", scalar.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query("SELECT doc_id, 'source-block:' || sha256(CAST(doc_id AS VARCHAR) || chr(31) || text) AS locator FROM documents")
def sha_locator(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scalar.locator(F.col("doc_id"), F.col("text")).alias("locator"))
