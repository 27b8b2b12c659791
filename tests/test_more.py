"""Scholarly matching, page blocks, expansion and reports."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from lemmaweave.operators import blocks, crawl, extract, report, scholarly

A = {"provider": "x", "title": "On Things", "authors": ["Ann B. Lee", "Bo Ek"], "year": "2001", "doi": "10.1000/a", "arxiv_id": None}
B = {"provider": "y", "title": "On things", "authors": ["Lee, A. B.", "Ek, Bo"], "year": "2001", "doi": "https://doi.org/10.1000/A", "arxiv_id": "2001.01234v1"}
C = {"provider": "y", "title": "Other", "authors": ["Cy Dee"], "year": "1999", "doi": None, "arxiv_id": None}


def test_grouping_does_not_depend_on_order():
    keys = {tuple(sorted(scholarly.key_of(sorted(map(scholarly.key_of, g))) for g in scholarly.grouped(list(p)))) for p in itertools.permutations((A, B, C))}
    assert len(keys) == 1 and len(scholarly.grouped([A, B, C])) == 2


def test_selection_fails_closed():
    asked = {"title": "On Things", "authors": ["Ann B. Lee", "Bo Ek"], "year": "2001", "doi": "10.1000/a", "arxiv_id": None}
    best = scholarly.ranked(asked, [A, B], ["ok", "ok"])[0]
    assert best["confidence"] == "strong" and best["eligible"] and best["arxiv_id"] == "2001.01234"
    other = B | {"doi": "10.1000/b", "title": "Another"}
    assert not any(c["eligible"] for c in scholarly.ranked(asked, [A, B, other], ["ok"]))
    assert scholarly.ranked(asked, [], ["timeout"]) == []
    assert not scholarly.same_people(["Ann Lee"], ["Anna Lee"]) and scholarly.same_people(["A. Lee"], ["Lee, Ann"])


def test_candidates_on_tables(spark):
    fields = "title string, authors array<string>, year string, doi string, arxiv_id string"
    asked = spark.createDataFrame([("b1", "On Things", ["Ann B. Lee", "Bo Ek"], "2001", "10.1000/a", None), ("b2", "Nothing", None, None, None, None)], f"blocked_id string, {fields}")
    rows = spark.createDataFrame([("b1", r["provider"], "ok", *[r[k] for k in ("title", "authors", "year", "doi", "arxiv_id")]) for r in (A, B)], f"blocked_id string, provider string, outcome string, {fields}")
    found = scholarly.candidates(asked, rows)
    assert [(r.blocked_id, r.arxiv_id) for r in scholarly.selected(found).collect()] == [("b1", "2001.01234")]


def test_blocks(spark):
    text = ["1 Intro", "Lemma 1. All is", "well. ", "Proof. Clear.", "Theorem 2 (Main). Let x.", "Then y.", "Proof of Lemma 1. Again.", "Proof of Lemma 1 and Theorem 2. Both.", "Theorem 2 shows that", "References", "[1] A. Lee, arXiv:2001.01234v2.\n[2] B, doi:10.1/x."]
    rows = [("p", "f", 1, i, 0.0, 20.0 * i, 100.0, 20.0 * i + 15, t) for i, t in enumerate(text)]
    df = spark.createDataFrame(rows, "paper_id string, source_ref string, page int, block_index int, x0 double, y0 double, x1 double, y1 double, text string")
    found = blocks.statements(df)
    assert {r.local_id: r.positions for r in found.collect()} == {"pdf:lemma:1": [1, 2], "pdf:theorem:2": [4, 5]}
    assert [(r.position, r.owner, r.basis) for r in blocks.proofs(df, found).orderBy("position").collect()] == [
        (3, "pdf:lemma:1", "immediately_follows_result"), (6, "pdf:lemma:1", "proof_heading_names_result"), (7, None, "unresolved")]
    assert [(r.label, r.arxiv_id, r.doi) for r in blocks.bibliography(df).orderBy("part").collect()] == [("1", "2001.01234", None), ("2", None, "10.1/x")]


def test_expansion_is_bounded_and_resumes(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "d")], "paper_id string, target string")
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string")
    run = crawl.start(papers.where("paper_id = 'a'"), crawl.Policy(depth=3))
    run = crawl.advance(run, edges, papers, 1)
    assert run.state == "running" and run.edges.count() == 2
    run = crawl.advance(run, edges, papers)
    assert run.state == "completed" and run.edges.count() == 6
    assert {r.paper_id: (r.depth, r.state) for r in run.nodes.collect()} == {"a": (0, "visited"), "b": (1, "visited"), "c": (1, "visited"), "d": (2, "boundary")}
    assert crawl.advance(crawl.start(papers.limit(1), crawl.Policy(edges=1)), edges, papers).reason == "edge_budget"
    with pytest.raises(ValueError):
        crawl.Policy(depth=True)


def test_reports(spark):
    text = r"\title{T}\begin{lemma}\label{l}x\end{lemma}\begin{proof}y\end{proof}\begin{theorem}[Main]\label{t}z\end{theorem}\begin{proof}\ref{l}, \ref{no}, \cite{k}\end{proof}"
    docs = extract.documents(spark.createDataFrame([("local:p", "m.tex", {"m.tex": text})], "paper_id string, main string, files map<string,string>"))
    assert [r.local_id for r in report.main_results(docs).orderBy("rank").collect()] == ["t", "l"]
    assert report.triage(docs).first().status == "external_blocked"
    out = report.reading_report(docs, "local:p")
    assert "t: dependency\\_first" in out.replace("dependency_first", "dependency\\_first") and "no (unresolved)" in out and "citation k (missing_bib_entry)" in out
    assert docs.select(F.size("proofs")).first()[0] == 2


def test_archives_are_bounded():
    import gzip
    import io
    import tarfile

    from lemmaweave.sources import archive

    def tar(*names: str) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for n in names:
                info = tarfile.TarInfo(n)
                body = b"\\documentclass{a}\\begin{document}\\end{document}"
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
        return out.getvalue()

    files = archive.unpack(tar("x/a.tex", "main.tex"))
    assert sorted(files) == ["main.tex", "x/a.tex"] and archive.main_file(files) == "main.tex"
    with pytest.raises(archive.Unsafe):
        archive.unpack(tar("../a.tex"))
    with pytest.raises(archive.Unsafe):
        archive.unpack(tar("a.tex", "b.tex"), members=1)
    assert list(archive.unpack(gzip.compress(b"\\documentclass{a}"))) == ["main.tex"]
    with pytest.raises(ValueError):
        archive.main_file(archive.unpack(tar("a.tex", "b.tex")))


def test_provider_answers(spark):
    import json

    from lemmaweave.sources import providers

    item = {"DOI": "10.1/X", "title": ["T"], "author": [{"given": "A", "family": "B"}], "issued": {"date-parts": [[1999, 1]]}, "published-online": {"date-parts": [[2000]]}}
    rows = [("b", "crossref", 200, json.dumps({"message": {"items": [item]}})), ("c", "crossref", 429, None), ("d", "crossref", 200, "{"), ("e", "crossref", 200, json.dumps({"message": {"items": []}}))]
    got = {r.blocked_id: r for r in providers.crossref(spark.createDataFrame(rows, "blocked_id string, provider string, status int, body string")).collect()}
    assert (got["b"].title, got["b"].authors, got["b"].year, got["b"].doi) == ("T", ["A B"], "2000", "10.1/x")
    assert [got[k].outcome for k in "bcde"] == ["ok", "rate_limited", "invalid_response", "empty"]
    work = {"doi": "https://doi.org/10.1/Y", "title": "W", "authorships": [{"author": {"display_name": "C D"}}], "publication_year": 2001, "is_retracted": True, "locations": [{"landing_page_url": "https://arxiv.org/abs/2001.01234v1"}]}
    one = providers.openalex(spark.createDataFrame([("b", "openalex", 200, json.dumps({"results": [work]}))], "blocked_id string, provider string, status int, body string")).first()
    assert (one.doi, one.arxiv_id, one.year, one.is_retracted) == ("10.1/y", "2001.01234v1", "2001", True)


def test_proof_entries(spark):
    from lemmaweave.operators import correspondence

    rows = [("a", "theorem", "1", "Theorem 1 (= Theorem 4). x"), ("b", "theorem", "4", "Theorem 4. y"), ("c", "lemma", "2", "Lemma 2 (= Lemma 3) z"), ("d", "lemma", "3", "Lemma 3. (= Lemma 2)"), ("e", "claim", "7", "Claim 7 (= Claim 9)"), ("f", "claim", "8", "plain")]
    rows += [(f"h{i}", "corollary", str(i), f"Corollary {i} (= Corollary {i + 1})") for i in range(10, 20)]
    st = spark.createDataFrame([("p", *r) for r in rows], "paper_id string, local_id string, kind string, visible_number string, statement string")
    proofs = spark.createDataFrame([("p", "b"), ("p", None)], "paper_id string, owner string")
    got = {r.local_id: (r.status, r.proof_of) for r in correspondence.proof_entries(st, proofs).collect()}
    assert got["a"] == ("corresponding_proof", "b") and got["b"] == ("direct", "b") and got["f"] == ("not_found", None)
    assert got["c"][0] == got["d"][0] == "correspondence_cycle" and got["e"][0] == "missing_correspondence_target"
    assert got["h10"][0] == "correspondence_hop_limit" and got["h19"][0] == "missing_correspondence_target"


def test_roadmaps_and_inline_bibliographies(spark):
    from lemmaweave.functions import tex

    assert [x[:2] for x in tex.roadmap("Now it remains to prove Lemmas 1.2 and 3. Lemma 4. We next prove Corollaries A, B;")] == [("lemma", "1.2"), ("lemma", "3"), ("corollary", "A"), ("corollary", "B")]
    text = r"\begin{lemma}x\end{lemma}\begin{proof}We prove Lemma 1 and Lemma 2.\end{proof}\begin{thebibliography}{9}\bibitem[K]{k} A, arXiv:2001.01234v2. \bibitem{l} doi: 10.1/ab.\end{thebibliography}\cite{k}"
    docs = extract.documents(spark.createDataFrame([("p", "m.tex", {"m.tex": text})], "paper_id string, main string, files map<string,string>"))
    assert [(r.ref_label, r.target, r.resolution_status) for r in extract.roadmap_mentions(docs).orderBy("ref_label").collect()] == [("1", "lemma:1", "resolved_unique"), ("2", None, "unresolved")]
    assert [(e.key, e.arxiv_id) for e in docs.first().entries] == [("k", "2001.01234"), ("l", None)]
    assert extract.citation_records(docs).first().resolution_status == "resolved_candidate"
