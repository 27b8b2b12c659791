"""The workspace and its command line over three papers that cite each other."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from lemmaweave.__main__ import main
from lemmaweave.api import Workspace


def paper(cites: dict[str, str], refs: str = "") -> dict[str, str]:
    body = "\\documentclass{a}\\begin{document}\\title{P}\\begin{lemma}\\label{l}Low\\end{lemma}\\begin{theorem}\\label{main}Deep " + refs + "\\end{theorem}\\begin{proof}\\ref{l}, \\ref{gone} \\cite{" + ",".join(cites) + "}\\end{proof}\\end{document}"
    return {"main.tex": body, "r.bib": "".join(f"@misc{{{k}, eprint={{{v}}}, archiveprefix={{arXiv}}}}" for k, v in cites.items() if v)}


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    w = Workspace(spark, str(tmp_path_factory.mktemp("work")))
    w.add_files("arxiv:2001.00001", paper({"b": "2001.00002", "absent": ""}, "\\ref{l}"))
    w.add_files("arxiv:2001.00002", paper({"c": "2001.00003"}))
    w.add_files("arxiv:2001.00003", paper({"a": "2001.00001", "far": "2001.99999"}))
    return w


def test_papers_and_results(work):
    assert work.list_papers().count() == 3
    assert [r.global_id for r in work.list_results(kind="theorem", limit=2, offset=1).collect()] == ["arxiv:2001.00002::main", "arxiv:2001.00003::main"]
    assert work.search("DEEP").count() == 3 and work.get_result("arxiv:2001.00001::l")["content"].endswith("Low")
    assert work.get_proof("arxiv:2001.00001::main").count() == 1
    with pytest.raises(KeyError):
        work.get_result("arxiv:2001.00001::nothing")


def test_dependencies(work):
    a = "arxiv:2001.00001::main"
    assert [r.target for r in work.dependencies(a).collect()] == ["l"] and [r.node for r in work.dependencies(a, True).collect()] == ["l"]
    assert [r.source for r in work.where_used("arxiv:2001.00001::l").collect()] == ["main"]
    assert work.diagnostics("arxiv:2001.00002::main")["warning"] and work.reading_path(a).first().bottom_up == ["l", "main"]


def test_citations_and_plans(work):
    assert {r.key: r.target_paper_id for r in work.citations("arxiv:2001.00001").collect()} == {"b": "arxiv:2001.00002", "absent": None}
    assert [r.paper_id for r in work.citations("arxiv:2001.00001", "incoming").collect()] == ["arxiv:2001.00003"]
    assert {(r.group_key, r.status) for r in work.import_plan().collect()} == {("arxiv:2001.99999", "candidate"), ("arxiv:2001.00001::absent", "blocked")}
    assert work.cross_paper_edges(["arxiv:2001.00001", "arxiv:2001.00002"]).count() == 1
    assert work.paper_map("arxiv:2001.00001").first().local_id == "main" and work.triage().count() == 3


def test_state(work):
    work.record("s", "result", "x", "todo", at=datetime(2024, 1, 1))
    work.record("s", "result", "x", "understood", at=datetime(2024, 1, 2))
    assert [(r.target_id, r.status) for r in work.checkpoints("s").collect()] == [("x", "understood")]
    work.create_queue("q", "arxiv:2001.00001::main")
    assert [(r.target_kind, r.target_id) for r in work.queue("q").collect()] == [("result", "arxiv:2001.00001::main"), ("result", "arxiv:2001.00001::l"), ("unresolved_stop", "gone")]


def test_replacing_a_paper_keeps_the_others(work, capsys):
    with pytest.raises(ValueError):
        work.add_files("arxiv:2001.00002", {"main.tex": "\\documentclass{a}\\begin{document}\\begin{lemma}\\label{x}1\\end{lemma}\\begin{lemma}\\label{x}2\\end{lemma}\\end{document}"})
    assert work.list_results("arxiv:2001.00002").count() == 2
    main([work.folder, "list_results", "arxiv:2001.00001", "lemma", "limit=5"])
    assert [json.loads(x)["local_id"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")] == ["l"]
