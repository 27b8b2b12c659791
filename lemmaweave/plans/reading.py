"""Queries of spans, mentions, sessions, cross-paper plans, searches and expansions, each with its SQL.

The tables hold no papers, so each query first shapes them into what the operator reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import crosspaper, expansion, extract, mentions, review, search, sessions, spans
from .catalog import ORACLE_SQL, QUERIES, Tables, query
from .extraction import BIBLIOGRAPHY, in_blocks, projects

__all__ = ["ORACLE_SQL", "QUERIES"]

#: a document's part of its paper: what stands before the statement, the statement, the proof
_PARTS = """b AS (SELECT source, doc_id, coalesce(lang, '') AS lang, row_number() OVER w AS number,
  '% \\begin{thm} no \\end{thm}' || chr(10) AS pre, '\\begin{thm}[' || coalesce(lang, '') || ']\\label{t:' || doc_id || '} Size ' || n_chars || ', \\ref{t:' || (doc_id - 20) || '}. \\end{thm}' AS st,
  '\\begin{proof} By \\ref{t:' || (doc_id - 20) || '} and \\cite[see]{' || coalesce(lang, 'x') || ', none}. \\end{proof}' AS pf FROM documents WHERE source IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
p AS (SELECT *, CAST(sum(length(pre) + length(st) + length(pf) + 2) OVER (PARTITION BY source ORDER BY doc_id) - (length(pre) + length(st) + length(pf) + 2) AS BIGINT) AS off FROM b)"""
_HAS = "EXISTS (SELECT 1 FROM documents e WHERE e.source = p.source AND e.doc_id = p.doc_id - 20)"


@query(f"WITH {_PARTS} SELECT 'local:' || source AS paper_id, 'local:' || source || '::t:' || doc_id AS evidence_id, 'body.tex' AS path, off + length(pre) AS file_start, off + length(pre) + length(st) AS file_end, 'complete' AS coverage FROM p")
def tex_fragments(t: Tables) -> DataFrame:
    """Where each statement lies in its file, by an overlap join of merged ranges and parts."""
    docs = extract.documents(projects(t))
    rows = spans.fragments(spans.own_spans(docs).where("kind = 'result'"), spans.segments(docs))
    return rows.select("paper_id", "evidence_id", "path", "file_start", "file_end", "coverage")


@query(f"WITH {_PARTS} SELECT 'local:' || source || '::mention:' || number || ':0' AS evidence_id, 'local:' || source || '::proof:' || number AS last, 'body.tex' AS path, off + length(pre) + length(st) + 1 AS file_start, off + length(pre) + length(st) + 1 + length(pf) AS file_end FROM p")
def tex_mention_trail(t: Tables) -> DataFrame:
    """A mention's way to its source: over its proof, into a file."""
    rows = spans.trail(extract.documents(projects(t))).where("kind = 'mention'")
    return rows.select("evidence_id", F.element_at("via", -1).alias("last"), "path", "file_start", "file_end")


@query(f"""SELECT 'local:' || source || '::entry:' || regexp_extract(e, '\\{{(\\w+),', 1) AS evidence_id, 1 AS n_via, 'r.bib' AS path, strpos(b, e) - 1 AS file_start, strpos(b, e) - 1 + length(e) AS file_end
FROM (SELECT source, b, unnest(string_split(rtrim(b, chr(10)), chr(10))) AS e FROM (SELECT DISTINCT source, '{BIBLIOGRAPHY}' AS b FROM documents WHERE source IS NOT NULL))""")
def tex_entry_trail(t: Tables) -> DataFrame:
    """A bibliography entry lies in its own file."""
    rows = spans.trail(extract.documents(projects(t))).where("kind = 'entry' and path is not null")
    return rows.select("evidence_id", F.size("via").alias("n_via"), "path", "file_start", "file_end")


@query(f"WITH {_PARTS} SELECT 'local:' || source AS paper_id, number AS proof, key, key IN ('en', 'de', 'fr') AS known FROM (SELECT source, number, unnest([CASE WHEN lang = '' THEN 'x' ELSE lang END, 'none']) AS key FROM p)")
def tex_citation_mentions(t: Tables) -> DataFrame:
    rows = mentions.citation_mentions(extract.documents(projects(t)))
    return rows.select("paper_id", "proof", "key", (F.col("resolution_status") == "resolved_unique").alias("known"))


@query(f"""WITH {_PARTS}, r AS (SELECT 'local:' || source AS paper_id, 't:' || doc_id AS owner, CASE WHEN {_HAS} THEN 'known_local' ELSE 'unresolved_local' END AS class, 't:' || (doc_id - 20) AS target FROM p
UNION ALL SELECT 'local:' || source, 't:' || doc_id, CASE WHEN key IN ('en', 'de', 'fr') THEN 'known_citation' ELSE 'unresolved_citation' END, key FROM (SELECT source, doc_id, unnest([CASE WHEN lang = '' THEN 'x' ELSE lang END, 'none']) AS key FROM p)
UNION ALL SELECT 'local:' || source, 't:' || doc_id, 'inferred', 'immediately_follows_result' FROM p
UNION ALL SELECT 'local:' || source, 't:' || doc_id, 'warning', 'no dependency was found in the proof; independence is not established' FROM p WHERE NOT {_HAS}) SELECT * FROM r""")
def tex_classified(t: Tables) -> DataFrame:
    """What the proof of each result is known, and not known, to depend on."""
    return mentions.classified(extract.documents(projects(t))).select("paper_id", "owner", "class", "target")


@query(f"""WITH {_PARTS} SELECT 'local:' || source AS paper_id, count(*) FILTER ({_HAS}) AS n_edges, count(*) FILTER (NOT {_HAS}) + count(*) + count(*) FILTER (lang NOT IN ('en', 'de', 'fr')) AS n_unresolved,
CAST(count(*) FILTER (NOT EXISTS (SELECT 1 FROM documents e WHERE e.source = p.source AND e.doc_id = p.doc_id + 20)) AS INTEGER) AS n_isolated, 'low' AS self_containment FROM p GROUP BY source""")
def tex_completeness(t: Tables) -> DataFrame:
    return mentions.completeness(extract.documents(projects(t))).select("paper_id", "n_edges", "n_unresolved", F.size("isolated").alias("n_isolated"), "self_containment")


def _reading(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users as sessions, their events as checkpoints, and the last kind of event as notes."""
    e = t.events.withColumn("session_id", F.col("user_id").cast("string"))
    status = F.when(F.col("value") > 80, "reviewed").when(F.col("value") > 50, "queued").when(F.col("value") > 45, "blocked").otherwise("skipped")
    log = e.select("session_id", F.lit("result").alias("target_kind"), F.col("event_type").alias("target_id"), status.alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    notes = e.where("value < 5").select("session_id", F.when(F.col("value") < 1, "question").otherwise("note").alias("note_type"), F.col("event_id").cast("string").alias("text"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    listed = e.groupBy("session_id").agg(F.min("ts").alias("at")).select("session_id", F.lit("local:p").alias("paper_id"), F.lit("click").alias("target_id"), "at")
    return listed, log, notes


_STATUS = "CASE WHEN value > 80 THEN 'reviewed' WHEN value > 50 THEN 'queued' WHEN value > 45 THEN 'blocked' ELSE 'skipped' END"


@query(f"""WITH c AS (SELECT user_id, event_type, arg_max({_STATUS}, (ts, event_id)) AS s FROM events GROUP BY ALL),
p AS (SELECT user_id, count(*) FILTER (s = 'reviewed') AS n_reviewed, count(*) FILTER (s = 'queued') AS n_queued, count(*) FILTER (s = 'blocked') AS n_blocked, bool_or(event_type = 'click') AS seen FROM c GROUP BY user_id),
n AS (SELECT user_id, count(*) FILTER (value < 1) AS q FROM events WHERE value < 5 GROUP BY user_id),
l AS (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts DESC, event_id DESC) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value < 5) WHERE r <= 5 GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS session_id, n_reviewed, n_queued, n_blocked, coalesce(q, 0) AS n_questions, coalesce(latest, '') AS latest,
concat_ws(',', CASE WHEN n_blocked > 0 THEN 'review_blocked_targets' END, CASE WHEN n_queued > 0 THEN 'continue_queued_targets' END, CASE WHEN NOT seen THEN 'review_target_result' END, CASE WHEN coalesce(q, 0) > 0 THEN 'answer_or_retire_open_questions' END) AS next_actions
FROM p LEFT JOIN n USING (user_id) LEFT JOIN l USING (user_id)""")
def session_summaries(t: Tables) -> DataFrame:
    rows = sessions.summaries(*_reading(t))
    latest = F.coalesce(F.array_join(F.transform("latest", lambda x: x["text"]), ","), F.lit(""))
    return rows.select("session_id", "n_reviewed", "n_queued", "n_blocked", "n_questions", latest.alias("latest"), F.array_join("next_actions", ",").alias("next_actions"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS session_id, CAST(o_orderkey AS VARCHAR) AS target_id, CASE WHEN o_custkey % 2 = 0 THEN 'queued' END AS status, CASE WHEN o_custkey % 2 = 1 THEN 'other_paper' END AS refused FROM orders WHERE o_custkey % 2 = 0
UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), NULL, NULL, 'other_paper' FROM orders WHERE o_custkey % 2 = 1""")
def queue_applied(t: Tables) -> DataFrame:
    """A customer's orders as a queue, put into a session of the same paper; odd customers have one of another."""
    key = F.col("o_custkey").cast("string")
    items = t.orders.select(key.alias("queue_id"), F.lit(0).alias("section"), F.col("o_orderkey").alias("ord"), F.lit("result").alias("target_kind"), F.col("o_orderkey").cast("string").alias("target_id"))
    one = t.orders.select(key.alias("queue_id"), F.lit("a").alias("paper_id"), F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("_s")).distinct()
    wanted = one.select("queue_id", F.col("queue_id").alias("session_id"), F.lit("2024-01-01").cast("timestamp").alias("at"), F.lit(0).cast("long").alias("seq"))
    out = sessions.applied(items, one.drop("_s"), one.select(F.col("queue_id").alias("session_id"), F.col("_s").alias("paper_id")), wanted)
    return out.select("session_id", "target_id", "status", "refused")


def _plans(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as plans over their orders; lines are candidates; a finished order cites the next lower one."""
    o = t.orders.select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("paper_id"), "o_orderstatus")
    plans = o.select("plan_id", "paper_id", F.col("paper_id").alias("input"), F.when(F.col("o_orderstatus") == "F", "usable").when(F.col("o_orderstatus") == "P", "sparse").otherwise("limited").alias("status"))
    lines = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("result_id"), F.col("l_quantity").cast("int").alias("score"), F.col("l_linenumber").alias("position"), (F.col("l_linenumber") <= 2).alias("focus"))
    before = F.lag("paper_id").over(Window.partitionBy("plan_id").orderBy("paper_id"))
    edges = o.withColumn("target", before).where("target is not null and o_orderstatus = 'F'").select("plan_id", F.col("paper_id").alias("source"), "target", F.col("paper_id").alias("ord"))
    return plans, lines.join(o.select("paper_id", "plan_id"), "paper_id"), edges


_PLAN = """o AS (SELECT o_custkey AS plan_id, o_orderkey AS paper_id, o_orderstatus AS st, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders),
e AS (SELECT plan_id, paper_id AS source, prev AS target FROM o WHERE prev IS NOT NULL AND st = 'F'),
c AS (SELECT plan_id, paper_id, l_linenumber AS result_id, CAST(l_quantity AS INTEGER) AS score, l_linenumber <= 2 AS focus FROM lineitem JOIN o ON l_orderkey = paper_id WHERE l_returnflag = 'R'),
s AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.plan_id ORDER BY focus DESC, CASE WHEN e.source IS NULL THEN 1 ELSE 0 END, score DESC, paper_id, result_id) AS r FROM c LEFT JOIN e ON e.plan_id = c.plan_id AND e.source = c.paper_id) WHERE r = 1)"""


@query(f"""WITH {_PLAN}, own AS (SELECT plan_id, paper_id, arg_min(result_id, (-score, result_id)) AS own FROM c GROUP BY ALL),
u AS (SELECT plan_id, paper_id, 0 AS sec, 0 AS ord, CAST(result_id AS VARCHAR) AS result_id, 'start' AS role FROM s UNION ALL SELECT plan_id, target, 1, min(source), NULL, 'context' FROM e GROUP BY ALL
UNION ALL SELECT o.plan_id, o.paper_id, 2, o.paper_id, CAST(own AS VARCHAR), CASE WHEN own IS NULL THEN 'review' ELSE 'continue' END FROM o LEFT JOIN own USING (plan_id, paper_id)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, paper_id ORDER BY sec, ord) AS r FROM u) WHERE r = 1)
SELECT plan_id, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY sec, ord, paper_id) AS BIGINT) AS position, paper_id, result_id, role FROM f""")
def plan_sequence(t: Tables) -> DataFrame:
    rows = crosspaper.sequence(*_plans(t))
    return rows.select("plan_id", F.col("position").cast("long").alias("position"), "paper_id", "result_id", "role")


@query(f"""WITH {_PLAN}, k AS (SELECT o.plan_id, count(*) FILTER (x.t IS NOT NULL) AS n_external, count(*) FILTER (x.t IS NULL) AS n_blocked FROM o JOIN (SELECT paper_id, prev AS t FROM o) x USING (paper_id)
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.plan_id = o.plan_id AND e.source = o.paper_id AND e.target = x.t) GROUP BY o.plan_id),
h AS (SELECT plan_id, count(*) AS n_papers, CASE WHEN bool_or(st = 'F') THEN 'usable' WHEN bool_or(st = 'P') THEN 'sparse' ELSE 'limited' END AS evidence_status FROM o GROUP BY plan_id)
SELECT h.plan_id, n_papers, evidence_status, coalesce(nc, 0) AS n_candidates, coalesce(ne, 0) AS n_edges, coalesce(n_external, 0) AS n_external, coalesce(n_blocked, 0) AS n_blocked, s.paper_id AS start_paper,
concat_ws(',', CASE WHEN coalesce(ne, 0) = 0 THEN 'no_cross_paper_edges' END, CASE WHEN coalesce(nc, 0) = 0 THEN 'no_main_candidate' END, CASE WHEN coalesce(n_external, 0) > 0 THEN 'external_dependencies' END, CASE WHEN coalesce(n_blocked, 0) > 0 THEN 'unresolved_references' END, CASE WHEN evidence_status <> 'usable' THEN 'sparse_evidence' END) AS warnings
FROM h LEFT JOIN (SELECT plan_id, count(*) AS nc FROM c GROUP BY plan_id) USING (plan_id) LEFT JOIN (SELECT plan_id, count(*) AS ne FROM e GROUP BY plan_id) USING (plan_id) LEFT JOIN k USING (plan_id) LEFT JOIN s USING (plan_id)""")
def plan_summary(t: Tables) -> DataFrame:
    """Every order's next lower one as what it imports: a risk unless the plan cites it."""
    plans, candidates, edges = _plans(t)
    imports = plans.select("paper_id", F.lag("paper_id").over(Window.partitionBy("plan_id").orderBy("paper_id")).alias("target"), F.lit(0).alias("group_key"))
    risk = crosspaper.risks(plans, imports, edges)
    rows = crosspaper.summary(plans, candidates, edges, risk)
    facts = plans.select("plan_id").distinct().select("plan_id", F.lit(False).alias("focus_asked"), F.lit(False).alias("focus_matched"), F.lit(0).alias("n_cyclic"), F.lit(0).alias("n_missing_proof"))
    said = crosspaper.warnings(rows, facts)
    return rows.join(said, "plan_id").select("plan_id", "n_papers", "evidence_status", "n_candidates", "n_edges", "n_external", "n_blocked", "start_paper", F.array_join("warnings", ",").alias("warnings"))


def _searches(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Parts as blocked references; suppliers of a part as providers that know the work, with or without a DOI."""
    key = F.col("p_partkey").cast("string")
    blocked = t.part.select(key.alias("blocked_id"), F.lit(0).alias("ord"), F.lit("bibliography_entry").alias("kind"), F.lit("k").alias("citation_key"), F.concat(F.lit("[1] Lee. Studies in "), F.regexp_replace("p_name", "[^a-z ]", ""), F.lit(". Press, 1999")).alias("raw_text"))
    named = F.concat(F.lit("Studies in "), F.regexp_replace("p_name", "[^a-z ]", ""))
    record = lambda n, provider, year, doi: t.part.where(n).select(key.alias("blocked_id"), F.lit(0).alias("ord"), F.lit(provider).alias("provider"), named.alias("title"), F.array(F.lit("Lee"), F.lit("A")).alias("authors"), F.lit(year).alias("year"), doi.cast("string").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.lit(None).cast("string").alias("url"))
    doi = F.concat(F.lit("10.1000/"), key)
    rows = record("true", "x", "1999", doi).unionByName(record("p_size % 2 = 0", "y", "1999", doi)).unionByName(record("p_size % 3 = 0", "z", "1998", F.concat(doi, F.lit("z")))).unionByName(record("p_size % 5 = 0", "w", "1997", F.lit(None)))
    return search.hints(blocked), rows


@query("""WITH r AS (SELECT p_partkey, 'doi:10.1000/' || p_partkey AS key, round(4.0 + 1.2 + 1.2 + 1.5 + CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0 END, 3) AS score, 'strong' AS conf, p_size FROM part
UNION ALL SELECT p_partkey, 'doi:10.1000/' || p_partkey || 'z', round(4.0 + 1.2 + 1.5, 3), 'plausible', p_size FROM part WHERE p_size % 3 = 0)
SELECT CAST(p_partkey AS VARCHAR) AS blocked_id, key, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 7.0 THEN 'strong' ELSE conf END AS confidence, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC) AS INTEGER) AS rank FROM r
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'metadata:studies ' || array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(p_name, '[^a-z ]', '', 'g')), '[a-z0-9]+'), lambda w: w NOT IN ('a', 'an', 'and', 'by', 'in', 'of', 'on', 'the')), ' ') || ':lee:1997', CAST(4.0 + 1.2 AS DOUBLE), 'unavailable', CASE WHEN p_size % 3 = 0 THEN 3 ELSE 2 END FROM part WHERE p_size % 5 = 0""")
def search_ranked(t: Tables) -> DataFrame:
    rows = search.ranked(search.candidates(*_searches(t)))
    return rows.select("blocked_id", "key", "score", "confidence", F.col("rank").cast("int").alias("rank"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS blocked_id, 1 + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS n_candidates, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS n_boundaries FROM part""")
def search_summaries(t: Tables) -> DataFrame:
    hint, records = _searches(t)
    rows = search.summaries(search.ranked(search.candidates(hint, records)), hint.where("false").select("blocked_id"))
    return rows.select("blocked_id", F.col("n_candidates").cast("int").alias("n_candidates"), F.col("n_boundaries").cast("int").alias("n_boundaries"))


@query("SELECT CAST(user_id AS VARCHAR) AS blocked_id, event_type AS target, 'resolution:' || sha256(user_id || chr(31) || 'doi' || chr(31) || event_type) AS resolution_id, arg_max(s, (ts, s)) AS status, count(*) AS n FROM (SELECT *, CASE WHEN value > 50 THEN 'imported' ELSE 'confirmed' END AS s FROM events) GROUP BY user_id, event_type")
def resolutions_upserted(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").cast("string").alias("blocked_id"), F.lit("doi").alias("target_kind"), F.col("event_type").alias("target"), F.when(F.col("value") > 50, "imported").otherwise("confirmed").alias("status"), F.col("ts").alias("at"), "value")
    out = search.resolved(rows.where("value <= 30"), rows.where("value > 30 or value is null"))
    return out.select("blocked_id", "target", "resolution_id", "status", "n")


@query("SELECT user_id AS run_id, event_id AS ord, CAST((r - 1) // 25 AS INTEGER) AS page, least(((r - 1) // 25 + 1) * 25, n) AS cursor FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)")
def expansion_pages(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("run_id"), F.lit("n").alias("node"), F.col("event_id").alias("ord"))
    return expansion.paged(rows).select("run_id", "ord", "page", "cursor")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'gone' WHEN o_orderkey % 5 = 0 THEN 'stale' ELSE 'current' END AS state FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def stale_sources(t: Tables) -> DataFrame:
    """Lines of an order as its source; some orders changed a line since, some went."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey").join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi")
    now = lines.where("o_orderkey % 7 <> 0").withColumn("l_partkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")))
    prints = lambda df: expansion.fingerprints(df, "o_orderkey", ["l_linenumber", "l_partkey"])
    return expansion.staleness(prints(lines), prints(now), "o_orderkey")


_LEASES = """n AS (SELECT event_id, user_id AS run_id, ts AS tm, value, event_type, CAST(sum(CASE WHEN value < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n FROM events),
g AS (SELECT run_id, tm, CASE WHEN value < 40 THEN n ELSE n - event_id % 2 END AS token FROM n WHERE value < 40 OR event_type = 'error'),
w AS (SELECT event_id, run_id, tm, CASE WHEN event_id % 5 = 0 THEN n + 1 WHEN event_id % 3 = 0 THEN n - 1 ELSE n END AS token, event_id % 7 = 0 AS other FROM n WHERE value >= 40)"""


@query(f"WITH {_LEASES}, l AS (SELECT event_id, arg_max(g.token, (g.token, g.tm)) AS token, arg_max(g.tm, (g.token, g.tm)) AS tm FROM w JOIN g ON g.run_id = w.run_id AND g.tm <= w.tm GROUP BY event_id) SELECT event_id, coalesce(w.token = l.token AND NOT other AND w.tm < l.tm + INTERVAL 12 HOUR, false) AS accepted FROM w LEFT JOIN l USING (event_id)")
def fenced_writes(t: Tables) -> DataFrame:
    """Cheap events grant a run to one of two holders in turn, errors renew it or, too late, the lease before; the others write:
    most under the lease of their time, some under the last or the next one, some as another holder."""
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    grant = F.col("value") < 40
    rows = t.events.select("event_id", F.col("user_id").alias("run_id"), F.col("ts").alias("at"), grant.alias("grant"), "event_type", F.sum(grant.cast("long")).over(so_far).alias("n"))
    holder = lambda token: F.concat(F.lit("h"), (token % 2).cast("string"))
    token = F.when(F.col("grant"), F.col("n")).otherwise(F.col("n") - F.col("event_id") % 2)
    log = rows.where("grant or event_type = 'error'").select("run_id", "at", token.alias("token"), holder(token).alias("holder"))
    token = F.when(F.col("event_id") % 5 == 0, F.col("n") + 1).when(F.col("event_id") % 3 == 0, F.col("n") - 1).otherwise(F.col("n"))
    writes = rows.where("not grant").select("event_id", "run_id", "at", token.alias("token"), F.when(F.col("event_id") % 7 == 0, "x").otherwise(holder(token)).alias("holder"))
    return expansion.fenced(writes, log, seconds=12 * 3600).select("event_id", "accepted")


@query("SELECT o_custkey AS run_id, o_orderkey AS attempt_id, CASE WHEN o_orderstatus <> 'F' THEN 'retry' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'committed' ELSE 'lost' END AS outcome FROM orders")
def attempts_reconciled(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("attempt_id"), F.col("o_orderkey").alias("paper_id"), "o_orderstatus")
    out = expansion.reconciled(o, o.where("o_orderstatus = 'F'"), t.lineitem.select(F.col("l_orderkey").alias("paper_id")))
    return out.select("run_id", "attempt_id", "outcome")


@query("""SELECT 'r' || r_regionkey AS run_id, 0 AS depth, 'r' || r_regionkey AS node, '' AS mark FROM region UNION ALL SELECT 'r' || n_regionkey, 1, 'n' || n_nationkey, '' FROM nation UNION ALL SELECT 'r' || n_regionkey, 2, 'r' || n_regionkey, 'cycle' FROM nation
UNION ALL SELECT 'r' || n_regionkey, 2, 's' || (s_suppkey % 10), CASE WHEN row_number() OVER (PARTITION BY n_regionkey, s_suppkey % 10 ORDER BY 'n' || n_nationkey) = 1 THEN '' ELSE 'shared' END FROM (SELECT DISTINCT n_regionkey, n_nationkey, s_suppkey % 10 AS s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def expansion_tree(t: Tables) -> DataFrame:
    """Regions unfold into nations, and these into groups of suppliers that several nations share, and back."""
    run, nation = F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey")
    down = t.nation.select(run.alias("run_id"), run.alias("source"), nation.alias("target"))
    both = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).select(run.alias("run_id"), nation.alias("source"), F.concat(F.lit("s"), (F.col("s_suppkey") % 10).cast("string")).alias("target")).distinct()
    back = t.nation.select(run.alias("run_id"), nation.alias("source"), run.alias("target"))
    roots = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("run_id"), F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return expansion.tree(roots, down.unionByName(both).unionByName(back), 2).select("run_id", "depth", "node", "mark")


@query("SELECT CAST(l_suppkey AS VARCHAR) AS evidence_id, CASE WHEN l_suppkey <= 4 THEN 'region' WHEN l_suppkey <= 24 THEN 'nation' WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = l_suppkey) THEN 'customer' END AS type, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def evidence_lookup(t: Tables) -> DataFrame:
    """One id over several tables: the first that has it says its type."""
    key = lambda df, c: df.withColumn("k", F.col(c).cast("string")).select("k")
    wanted = t.lineitem.groupBy(F.col("l_suppkey").cast("string").alias("evidence_id")).agg(F.count("*").alias("n"))
    tables = {"region": (key(t.region, "r_regionkey"), "k"), "nation": (key(t.nation, "n_nationkey"), "k"), "customer": (key(t.customer, "c_custkey"), "k")}
    return spans.lookup(tables, wanted).select("evidence_id", "type", "n")


@query("""WITH e AS (SELECT l_suppkey AS g, l_partkey AS r, l_orderkey AS p, l_returnflag AS k, l_linestatus AS t, CAST(l_orderkey AS VARCHAR) || ':' || l_linenumber AS id FROM lineitem WHERE l_suppkey IS NOT NULL),
n AS (SELECT g, count(DISTINCT r) AS r, count(DISTINCT p) AS p, string_agg(DISTINCT k, ', ' ORDER BY k) AS k FROM e GROUP BY g),
f AS (SELECT g, string_agg(t, '; ' ORDER BY m) AS t FROM (SELECT g, t, min(id) AS m FROM e WHERE t IS NOT NULL GROUP BY ALL) GROUP BY g)
SELECT g AS l_suppkey, 'Needed by ' || r || ' local result' || CASE WHEN r = 1 THEN '' ELSE 's' END || ' through ' || p || ' proof' || CASE WHEN p = 1 THEN '' ELSE 's' END || coalesce('; citation keys: ' || k, '') || coalesce('; cited result evidence: ' || t, '') AS evidence_summary FROM n LEFT JOIN f USING (g)""")
def import_reviews(t: Tables) -> DataFrame:
    """Suppliers as works to import, order lines as the evidence that needs them."""
    e = t.lineitem.select(F.col("l_suppkey").alias("group_key"), F.lit("line").alias("kind"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.lit("").alias("source"), F.col("l_partkey").alias("result_id"), F.col("l_orderkey").alias("proof_id"), F.col("l_returnflag").alias("citation_key"), F.col("l_linestatus").alias("raw_text"))
    return review.import_reviews(e).select(F.col("group_key").alias("l_suppkey"), "evidence_summary")


@query("SELECT conv_id, turn, CASE WHEN n = 1 THEN m END AS raw_id, n AS n_containers FROM (SELECT a.conv_id, a.turn, count(b.turn) AS n, min(b.turn) AS m FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn % 2 = 0 AND b.turn <= a.turn AND a.turn <= b.turn + 1 GROUP BY ALL)")
def unique_containers(t: Tables) -> DataFrame:
    """Turns as fragments of raw blocks that hold two turns each."""
    c = t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("conv_id").alias("source"), F.lit(1).alias("page"), F.lit(1).alias("block"), F.col("turn").alias("start"), F.col("turn").alias("end"), "conv_id", "turn")
    raw = t.conversations.where("turn % 2 = 0").select(F.col("turn").alias("id"), F.col("conv_id").alias("source"), F.lit(1).alias("page"), F.lit(1).alias("block"), F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"))
    return spans.containers(c, raw).select("conv_id", "turn", "raw_id", "n_containers")


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a', 'an', 'and', 'by', 'in', 'of', 'on', 'the')), ' ') AS words, CASE WHEN length(s) > 160 THEN rtrim(substring(s, 1, 157)) || '...' ELSE s END AS preview FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)")
def title_words_and_preview(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scalar.title_words(F.col("text")).alias("words"), scalar.preview(F.col("text")).alias("preview"))


ORACLE_SQL.update({name: in_blocks(sql) for name, sql in ORACLE_SQL.items() if name.startswith("tex_") and "REPLACE (" not in sql})


@query("SELECT 'c' || o_custkey AS run_id, least(count(*), 10) AS n_searches, greatest(count(*) - 10, 0) AS n_refused, CASE WHEN count(*) > 10 THEN 'paused' ELSE 'running' END AS state FROM orders GROUP BY o_custkey")
def expansion_runs(t: Tables) -> DataFrame:
    """A run per customer whose references are the orders, with a budget of ten edges: the stateful stream over a table of events."""
    from ..streaming import expansion as runs

    run, start = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.timestamp_seconds(F.lit(1_700_000_000))
    once = t.orders.select(run.alias("run_id")).distinct()
    event = lambda rows, second, **columns: rows.withColumns({"at": start + F.expr(f"interval {second} seconds"), **columns})
    limits = F.create_map(F.lit("edges"), F.lit(10))
    found = t.orders.select(run.alias("run_id"), F.col("o_orderkey").cast("string").alias("key"))
    events = t.orders.sparkSession.createDataFrame([], runs.EVENT)
    for rows in (
        event(once, 0, kind=F.lit("create"), event_id=F.lit("0"), papers=F.array("run_id"), limits=limits),
        event(once, 1, kind=F.lit("advance"), event_id=F.lit("1"), steps=F.lit(100), seconds=F.lit(60)),
        event(found, 2, kind=F.lit("found"), event_id=F.col("key"), paper_id=F.col("run_id")),
        event(once, 3, kind=F.lit("page_end"), event_id=F.lit("3"), paper_id=F.col("run_id"), outcome=F.lit("done")),
    ):
        events = events.unionByName(rows, allowMissingColumns=True)
    count = lambda name, action: F.count_if(F.col("action") == action).alias(name)
    return runs.actions(events).groupBy("run_id").agg(count("n_searches", "search"), count("n_refused", "refused"), F.max_by("state", "n").alias("state"))
