"""Extraction, matching and graph queries over TeX projects and page blocks made from the driver tables.

The tables hold no TeX, so each query first writes projects from them by column
expressions; what must come back is then known, and SQL can say it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, crawl, extract, graph, relational, report, scholarly, state
from .catalog import ORACLE_SQL, QUERIES, Tables, query

__all__ = ["ORACLE_SQL", "QUERIES"]


#: ids that share a paper
BLOCK = 2000


def in_blocks(sql: str) -> str:
    """SQL over documents whose source names the paper that projects() puts them in."""
    return re.sub(r"\bdocuments\b", f"(SELECT * REPLACE (source || '-' || (doc_id // {BLOCK}) AS source) FROM documents)", sql)


#: The bibliography of every paper.
BIBLIOGRAPHY = "@misc{en, title={E}, eprint={2001.00001v1}, archiveprefix={arXiv}}\n@misc{de, title={D}, doi={10.1000/D}}\n@misc{fr, url={https://arxiv.org/abs/math/0101001}}\n"


def projects(t: Tables) -> DataFrame:
    """A paper per source and block of ids, so that papers stay small: its documents as theorems in order, each with a
    proof, and a bibliography of languages."""
    t = t.replaced(documents=t.documents.withColumn("source", F.concat("source", F.lit("-"), F.expr(f"cast(doc_id div {BLOCK} as string)"))))
    n = F.col("doc_id").cast("string")
    before = (F.col("doc_id") - 20).cast("string")
    body = F.concat(F.lit("% \\begin{thm} no \\end{thm}\n\\begin{thm}["), F.coalesce("lang", F.lit("")), F.lit("]\\label{t:"), n, F.lit("} Size "), F.col("n_chars").cast("string"), F.lit(", \\ref{t:"), before,
                    F.lit("}. \\end{thm}\n\\begin{proof} By \\ref{t:"), before, F.lit("} and \\cite[see]{"), F.coalesce("lang", F.lit("x")), F.lit(", none}. \\end{proof}\n"))
    rows = t.documents.where("source is not null").groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", body.alias("b")))), lambda x: x["b"]), "").alias("b"))
    main = F.concat(F.lit("\\newtheorem{thm}{Theorem}\n\\title{"), "source", F.lit("}\n\\input{body}\n"))
    bib = F.lit(BIBLIOGRAPHY)
    return rows.select(F.concat(F.lit("local:"), "source").alias("paper_id"), F.lit("main.tex").alias("main"), F.create_map(F.lit("main.tex"), main, F.lit("body.tex"), F.col("b"), F.lit("r.bib"), bib).alias("files"))


_HAS = "EXISTS (SELECT 1 FROM documents e WHERE e.source = d.source AND e.doc_id = d.doc_id - 20)"


@query("SELECT 'local:' || source AS paper_id, 't:' || doc_id AS local_id, 'theorem' AS normalized_kind, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR) AS visible_number, lang AS title, 'body.tex' AS source_file FROM documents")
def tex_statements(t: Tables) -> DataFrame:
    return extract.results(extract.documents(projects(t))).select("paper_id", "local_id", "normalized_kind", "visible_number", "title", "source_file")


@query(f"SELECT 'local:' || source AS paper_id, 't:' || doc_id AS source, 't:' || (doc_id - 20) AS ref_label, CASE WHEN {_HAS} THEN 't:' || (doc_id - 20) END AS target, CASE WHEN {_HAS} THEN 'resolved_unique' ELSE 'unresolved' END AS resolution_status FROM documents d")
def tex_statement_refs(t: Tables) -> DataFrame:
    return extract.statement_refs(extract.documents(projects(t))).select("paper_id", "source", "ref_label", "target", "resolution_status")


@query("SELECT 'local:' || source AS paper_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS number, 't:' || doc_id AS owner, 'immediately_follows_result' AS basis FROM documents")
def tex_proof_owners(t: Tables) -> DataFrame:
    return extract.documents(projects(t)).select("paper_id", F.inline("proofs")).select("paper_id", "number", "owner", "basis")


@query("""SELECT 'local:' || source AS paper_id, key, CASE key WHEN 'en' THEN '2001.00001' WHEN 'fr' THEN 'math/0101001' END AS arxiv_id, CASE WHEN key = 'de' THEN '10.1000/d' END AS doi,
CASE WHEN key IN ('en', 'fr') THEN 'resolved_candidate' WHEN key = 'de' THEN 'unsupported_identifier' ELSE 'missing_bib_entry' END AS resolution_status, count(*) AS n FROM (SELECT source, unnest([lang, 'none']) AS key FROM documents) GROUP BY ALL""")
def tex_citations(t: Tables) -> DataFrame:
    c = extract.citation_records(extract.documents(projects(t)))
    return c.groupBy("paper_id", "key", "arxiv_id", "doi", "resolution_status").agg(F.count("*").alias("n"))


@query(f"SELECT 'local:' || source AS paper_id, 't:' || doc_id AS src, 't:' || (doc_id - 20) AS dst FROM documents d WHERE {_HAS}")
def tex_dependency_edges(t: Tables) -> DataFrame:
    return extract.dependency_edges(extract.documents(projects(t))).select("paper_id", "src", "dst")


@query("""WITH RECURSIVE r AS (SELECT source, doc_id AS root, doc_id AS node FROM documents UNION ALL SELECT r.source, root, d.doc_id FROM r JOIN documents d ON d.source = r.source AND d.doc_id = r.node - 20)
SELECT 'local:' || source AS paper_id, 't:' || root AS root, count(*) AS n, 't:' || min(node) AS first, 'dependency_first' AS order_status FROM r GROUP BY source, root HAVING count(*) > 1""")
def tex_reading_paths(t: Tables) -> DataFrame:
    paths = graph.reading_paths(extract.dependency_edges(extract.documents(projects(t))))
    return paths.select("paper_id", "root", F.size("bottom_up").cast("long").alias("n"), F.get("bottom_up", F.lit(0)).alias("first"), "order_status")


@query("""SELECT CASE key WHEN 'en' THEN 'arxiv:2001.00001' WHEN 'fr' THEN 'arxiv:math/0101001' WHEN 'de' THEN 'doi:10.1000/d' ELSE 'local:' || source || '::' || key END AS group_key, count(*) AS n_uses, count(DISTINCT source) AS n_papers,
CASE WHEN key IN ('en', 'fr') THEN 'candidate' ELSE 'blocked' END AS status, CASE WHEN key = 'de' THEN 'missing_arxiv_id' WHEN key NOT IN ('en', 'fr') THEN 'missing_bib_entry' END AS reason FROM (SELECT source, unnest([lang, 'none']) AS key FROM documents) GROUP BY ALL""")
def tex_import_plan(t: Tables) -> DataFrame:
    plan = extract.import_plan(extract.documents(projects(t)))
    return plan.select("group_key", "n_uses", F.size("needed_by").cast("long").alias("n_papers"), "status", "reason")


@query("SELECT 'local:' || source AS paper_id, count(*) AS n_results, count(*) AS n_proofs, 'external_blocked' AS status FROM documents GROUP BY source")
def tex_triage(t: Tables) -> DataFrame:
    return report.triage(extract.documents(projects(t))).select("paper_id", "n_results", "n_proofs", "status")


@query("SELECT 'local:' || source AS paper_id, CAST(r AS INTEGER) AS rank, 't:' || doc_id AS local_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY early + used DESC, doc_id) AS r FROM (SELECT source, doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3 THEN 1 ELSE 0 END AS early, CASE WHEN EXISTS (SELECT 1 FROM documents e WHERE e.source = d.source AND e.doc_id = d.doc_id + 20) THEN 1 ELSE 0 END AS used FROM documents d)) WHERE r <= 5")
def tex_main_results(t: Tables) -> DataFrame:
    return report.main_results(extract.documents(projects(t))).select("paper_id", "rank", "local_id")


def turns_as_blocks(t: Tables) -> DataFrame:
    """A page per conversation: user turns are lemmas, assistant turns proofs, others plain."""
    text = F.when(F.col("role") == "user", F.concat(F.lit("Lemma "), (F.col("turn") + 1).cast("string"), F.lit(". x"))).when(F.col("role") == "assistant", F.lit("Proof. Clear.")).otherwise(F.lit("Words."))
    y = F.col("turn").cast("double") * 20
    return t.conversations.select(F.col("conv_id").cast("string").alias("paper_id"), F.lit("f").alias("source_ref"), F.lit(1).alias("page"), (F.col("turn") + 1).cast("int").alias("block_index"), F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(9.0).alias("x1"), (y + 10).alias("y1"), text.alias("text"))


@query("SELECT CAST(conv_id AS VARCHAR) AS paper_id, 'pdf:lemma:' || (turn + 1) AS local_id FROM conversations WHERE role = 'user'")
def block_statements(t: Tables) -> DataFrame:
    return blocks.statements(turns_as_blocks(t)).select("paper_id", "local_id")


@query("""SELECT CAST(conv_id AS VARCHAR) AS paper_id, turn AS position, CASE WHEN prev = 'user' THEN 'pdf:lemma:' || turn END AS owner, CASE WHEN prev = 'user' THEN 'immediately_follows_result' ELSE 'unresolved' END AS basis
FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE role = 'assistant'""")
def block_proofs(t: Tables) -> DataFrame:
    pages = turns_as_blocks(t)
    return blocks.proofs(pages, blocks.statements(pages)).select("paper_id", F.col("position").cast("long").alias("position"), "owner", "basis")


@query("SELECT CAST(p_partkey AS VARCHAR) AS blocked_id, '2001.' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') AS arxiv_id FROM part WHERE p_size % 3 <> 0")
def scholarly_selection(t: Tables) -> DataFrame:
    """Each part asks for a work; two providers answer alike, or one in three contradicts and nothing is selected."""
    key, arxiv = F.col("p_partkey").cast("string"), F.concat(F.lit("2001."), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"))
    people = F.array(F.lit("Ann Lee"))
    base = t.part.select(key.alias("blocked_id"), F.col("p_name").alias("title"), people.alias("authors"), F.lit("2001").alias("year"), F.lit(None).cast("string").alias("doi"), arxiv.alias("arxiv_id"), "p_size")
    asked = base.drop("p_size", "arxiv_id").withColumn("arxiv_id", F.lit(None).cast("string"))
    first = base.withColumns({"provider": F.lit("x"), "outcome": F.lit("ok")})
    second = base.withColumns({"provider": F.lit("y"), "outcome": F.lit("ok"), "year": F.when(F.col("p_size") % 3 == 0, "1999").otherwise("2001")})
    return scholarly.selected(scholarly.candidates(asked, first.unionByName(second).drop("p_size")))


@query("SELECT 'n' || n_nationkey AS paper_id, 1 AS depth, 'visited' AS state FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'r0', 0, 'visited' UNION ALL SELECT DISTINCT 's' || s_suppkey, 2, 'boundary' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0")
def bounded_expansion(t: Tables) -> DataFrame:
    edges = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("paper_id"), F.concat(F.lit("n"), "n_nationkey").alias("target")).unionByName(t.supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("paper_id"), F.concat(F.lit("s"), "s_suppkey").alias("target")))
    root = t.region.where("r_regionkey = 0").select(F.lit("r0").alias("paper_id"))
    inside = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("paper_id"))
    return crawl.advance(crawl.start(root, crawl.Policy(depth=3, papers=100, edges=10_000)), edges, inside, 20).nodes


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS n_targets, count(*) FILTER (s = 'understood') AS n_understood, count(*) FILTER (s = 'todo') AS n_todo FROM (SELECT user_id, event_type, arg_max(CASE WHEN value > 50 THEN 'understood' ELSE 'todo' END, (ts, event_id)) AS s FROM events GROUP BY ALL) GROUP BY user_id")
def session_progress(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").cast("string").alias("session_id"), F.lit("result").alias("target_kind"), F.col("event_type").alias("target_id"), F.when(F.col("value") > 50, "understood").otherwise("todo").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return state.progress(log).select("session_id", "n_targets", "n_understood", "n_todo")


@query("SELECT CAST(o_custkey AS VARCHAR) AS queue_id, CAST(o_orderkey AS VARCHAR) AS target_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderkey, CAST(o_orderkey AS VARCHAR)) AS INTEGER) AS position FROM orders")
def queue_positions(t: Tables) -> DataFrame:
    items = t.orders.select(F.col("o_custkey").cast("string").alias("queue_id"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("section"), F.col("o_orderkey").alias("ord"), F.lit("result").alias("target_kind"), F.col("o_orderkey").cast("string").alias("target_id"))
    return state.queue(items).select("queue_id", "target_id", "position")


@query("SELECT doc_id, instr(lower(text), 'the') > 0 AND instr(lower(text), 'and') > 0 AS hit FROM documents")
def focus_filter(t: Tables) -> DataFrame:
    from ..functions import scalar

    return t.documents.select("doc_id", scalar.focus_match(F.col("text"), F.lit("the a and of")).alias("hit"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3) ORDER BY n_nationkey LIMIT 5")
def first_page(t: Tables) -> DataFrame:
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where("r_regionkey in (1, 3)")
    return relational.page(rows, ["n_nationkey"], 5).select("n_name", "r_name")


ORACLE_SQL.update({name: in_blocks(sql) for name, sql in ORACLE_SQL.items() if name.startswith("tex_")})
