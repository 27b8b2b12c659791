"""Extraction, graph and state operators on small fixtures."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from lemmaweave.functions import identity, tex
from lemmaweave.operators import extract, graph, relational, state
from lemmaweave.plans import extraction as catalog
from lemmaweave.sources import store

MAIN = r"""\documentclass{article}
\newtheorem{thm}{Theorem}[section]
\newtheorem{lem}[thm]{Lemma}
\title{A small paper}
\begin{document}
\section{One}
% \begin{lem} hidden \end{lem}
\begin{lem}[First] \label{lem:a} All is well. \end{lem}
\begin{proof} Clear, see \cite[Thm 2]{known,other}. \end{proof}
\input{part/two}
\verb|\begin{thm}|
\begin{proof}[Proof of Theorem~\ref{thm:b}] By \ref{lem:a} and \cref{lem:none}. \end{proof}
\end{document}
"""
TWO = r"""\begin{thm} \label{thm:b} More, by \ref{lem:a}, \ref{lem:a}. \end{thm}
Between.
\begin{proof} Whose? \end{proof}
"""
BIB = r"""@article{known, title = {A {Known} Thing}, author = "Ann Lee and Bo Ek", year = 2001, archivePrefix={arXiv}, eprint = {2001.01234v2}}
@book{other, title={Other}, doi = {https://doi.org/10.1000/ABC}}"""


@pytest.fixture(scope="module")
def docs(spark):
    files = {"main.tex": MAIN, "part/two.tex": TWO, "refs.bib": BIB}
    rows = [("local:p", "main.tex", files), ("local:bad", "main.tex", {"main.tex": r"\input{main}"}), ("arxiv:2001.01234", "main.tex", {"main.tex": "empty"})]
    return extract.documents(spark.createDataFrame(rows, "paper_id string, main string, files map<string,string>")).cache()


def test_statements_numbers_and_files(docs):
    rows = {r.local_id: r for r in extract.results(docs).collect()}
    assert {k: (r.normalized_kind, r.visible_number, r.title, r.source_file) for k, r in rows.items()} == {
        "lem:a": ("lemma", "1.1", "First", "main.tex"), "thm:b": ("theorem", "1.2", None, "part/two.tex")}
    assert docs.where("paper_id = 'local:bad'").first().error.startswith("ValueError: include loop")


def test_proofs_and_edges(docs):
    p = docs.where("paper_id = 'local:p'").first().proofs
    assert [(x.owner, x.basis) for x in p] == [("lem:a", "immediately_follows_result"), (None, "unresolved"), ("thm:b", "proof_heading_names_result")]
    m = {(r.proof, r.ref_label): (r.target, r.resolution_status) for r in extract.proof_mentions(docs).collect()}
    assert m == {(3, "lem:a"): ("lem:a", "resolved_unique"), (3, "lem:none"): (None, "unresolved")}
    assert [(r.src, r.dst) for r in extract.dependency_edges(docs).collect()] == [("thm:b", "lem:a")]
    assert [(r.source, r.ref_label) for r in extract.statement_refs(docs).collect()] == [("thm:b", "lem:a")]


def test_citations_bind_late(docs):
    got = {r.key: (r.resolution_status, r.arxiv_id, r.target_paper_id) for r in extract.citation_records(docs).collect()}
    assert got == {"known": ("resolved_candidate", "2001.01234", "arxiv:2001.01234"), "other": ("unsupported_identifier", None, None)}
    plan = [(r.group_key, r.status, r.reason) for r in extract.import_plan(docs).collect()]
    assert plan == [("doi:10.1000/abc", "blocked", "missing_arxiv_id")]


def test_mask_keeps_length():
    for text in (MAIN, r"50\% of $x$ % note", r"\\% gone", "\\verb+%+ x", "\\begin{verbatim}\n%x\n\\end{verbatim}", "%", "\\"):
        assert len(tex.mask(text)) == len(text) and tex.mask(text).count("\n") == text.count("\n")
    assert tex.mask(r"50\% x") == r"50\% x" and tex.mask(r"a\\% x") == "a\\\\   "


def test_counters_that_change_hide_numbers():
    text = r"\newtheorem{t}{Theorem}\setcounter{t}{4}\begin{t}x\end{t}"
    assert tex.statements(text)[0].visible_number is None


def test_identifiers():
    assert identity.identifier("https://doi.org/10.1000/X", "doi")["identity"] == "doi:10.1000/x"
    assert identity.identifier("arXiv:2001.01234v3", "arxiv", "v2")["warnings"] == ["version_conflict"]
    assert not identity.identifier("10.1/x", "doi")["valid"]
    assert identity.folded("  STRAẞE ﬁ ") == "strasse fi"


def edges(spark, pairs):
    return spark.createDataFrame([("p", a, b, i) for i, (a, b) in enumerate(pairs)], "paper_id string, src string, dst string, ord int")


def test_reading_orders(spark):
    diamond = edges(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")])
    r = {x.root: x for x in graph.reading_paths(diamond).collect()}["A"]
    assert r.top_down == ["A", "B", "D", "C"] and r.bottom_up == ["D", "B", "C", "A"] and r.order_status == "dependency_first"
    loop = {x.root: x for x in graph.reading_paths(edges(spark, [("A", "B"), ("B", "A"), ("A", "C")])).collect()}["A"]
    assert loop.order_status == "cycle_blocked" and loop.bottom_up == [] and loop.cycles == [["A", "B", "A"]]


def test_long_chain_returns_to_its_root(spark):
    chain = edges(spark, [(f"n{i}", f"n{(i + 1) % 1101}") for i in range(1101)])
    rows = [r.node for r in graph.dependencies(chain).where("root = 'n0'").orderBy("position").collect()]
    assert rows == [f"n{i}" for i in range(1, 1101)] + ["n0"]
    assert graph.on_cycles(chain).count() == 1101


def test_tristate_keeps_unknowns(spark):
    m = spark.createDataFrame([("x",), ("y",), ("z",)], "key string")
    t = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3)], "key string, id int")
    assert {r.key: (r.resolution_status, r.target) for r in relational.tristate(m, "key", t, "id").collect()} == {"x": ("resolved_unique", 1), "y": ("ambiguous", None), "z": ("unresolved", None)}
    with pytest.raises(ValueError):
        relational.page(m, ["key"], True)


def test_state_folds(spark):
    log = spark.createDataFrame([("s", "result", "a", "todo", 1, 1), ("s", "result", "a", "understood", 2, 2), ("s", "result", "b", "skipped", 1, 3), ("s", "result", "gone", "todo", 1, 4)], "session_id string, target_kind string, target_id string, status string, at int, seq int")
    row = state.progress(log).first()
    assert (row.n_targets, row.n_understood, row.n_skipped) == (3, 1, 1)
    targets = spark.createDataFrame([("result", "a"), ("result", "b")], "target_kind string, target_id string")
    assert {r.target_id: r.status for r in state.after_reimport(log, targets).collect()} == {"a": "blocked", "b": "skipped"}


def test_store_replaces_one_paper_and_rejects_bad_rows(spark, tmp_path):
    out = str(tmp_path / "results")
    store.replace_papers(spark.createDataFrame([("a", 1), ("b", 2)], "paper_id string, x int"), out)
    store.replace_papers(spark.createDataFrame([("a", 5)], "paper_id string, x int"), out)
    assert {(r.paper_id, r.x) for r in spark.read.parquet(out).collect()} == {("a", 5), ("b", 2)}
    with pytest.raises(store.InvalidEvidence):
        store.check_unique(spark.createDataFrame([("a", 1), ("a", 1)], "paper_id string, x int"), ["paper_id", "x"], "results")


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL)))
def test_catalogue_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    want = con.execute(catalog.ORACLE_SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_mention_containment_at_any_place(spark, tmp_path):
    item = "a passage of more than twenty-four characters"
    rows = [(1, f'"{item}"'), (2, f"({item})"), (3, f"\t{item}"), (4, f"pre{item}post"), (5, "a short one and more on its line"), (6, "nothing"), (7, None), (8, f"two\nlines {item}")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "two\nlines")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["mention_containment"](spark, str(tmp_path)).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (8, 1), (8, 4)]
