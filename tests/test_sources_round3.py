"""Bibliographies with their positions, answers of three providers in one shape."""

from __future__ import annotations

import json

from lemmaweave.operators import extract, spans
from lemmaweave.sources import providers

ENTRY = '<entry><id>http://arxiv.org/abs/{}</id><title>On\n  sets</title><published>2020-01-02T00:00:00Z</published><author><name>Ann Lee</name></author><author><name> </name></author></entry>'
FEED = '<?xml version="1.0"?>\n<!-- a --><feed xmlns="http://www.w3.org/2005/Atom"><title>q</title>{}</feed>'


def test_entries_have_their_range_in_their_file(spark):
    main = "\\cite{A,b,c,d,i}\n\\begin{thebibliography}{9}\n\\bibitem{i} Text of i.\n\\end{thebibliography}\n"
    one, two = "% x\n@article{A, title={Same {T}}}\n@misc{b, eprint={2001.00001}, archiveprefix={arXiv}}\n@misc{d, title={D}}\n@misc{D, title={D}}", "@article{a,\n title = {Same {T}} }\n@misc{b, title={Other}}\n@misc{ü, title={Ü}}"
    rows = [("local:p", "m.tex", {"m.tex": main, "1.bib": one, "2.bib": two}), ("local:none", "m.tex", {"m.tex": ""}), ("local:bad", "m.tex", {"m.tex": "\\input{x}"})]
    docs = extract.documents(spark.createDataFrame(rows, "paper_id string, main string, files map<string,string>"))
    got = {r.evidence_id: r for r in spans.bibliography(docs).collect()}
    files = {"m.tex": main, "1.bib": one, "2.bib": two}
    text = {i.rsplit(":", 1)[1]: files[r.path][r.file_start : r.file_end] for i, r in got.items() if r.path}
    assert text == {"A": "@article{A, title={Same {T}}}", "ü": "@misc{ü, title={Ü}}", "i": "\\bibitem{i} Text of i.\n"} or text["i"].startswith("\\bibitem{i} Text of i.")
    assert {i.rsplit(":", 1)[1]: r.status for i, r in got.items()} == {"A": "located", "ü": "located", "i": "located", "b": "conflicting_key", "d": "repeated_key"}
    assert {r.key: (r.resolution_status, r.arxiv_id) for r in extract.citation_records(docs).collect()}["b"] == ("conflicting_bib_entries", None)
    trail = {r.evidence_id: r for r in spans.trail(docs).where("kind = 'entry'").collect()}
    assert trail["local:p::entry:A"].path == "1.bib" and trail["local:p::entry:b"].coverage == "conflicting_key"


def test_atom_answers(spark):
    good, bad = ENTRY.format("2001.00001v2"), ENTRY.format("nothing")
    cases = {"ok": FEED.format(good), "partial": FEED.format(good + bad), "none": FEED.format(bad), "empty": FEED.format(""), "broken": "<feed", "page": "<html></html>", "other": FEED.format(good).replace("2005/Atom", "x"), "null": None}
    rows = [(k, "arxiv", 200, b) for k, b in cases.items()] + [("late", "arxiv", None, None), ("many", "arxiv", 429, FEED.format(good))]
    got = {r.blocked_id: r for r in providers.arxiv(spark.createDataFrame(rows, "blocked_id string, provider string, status int, body string")).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"ok": "ok", "partial": "partial", "none": "invalid_response", "empty": "empty", "broken": "invalid_response", "page": "invalid_response", "other": "invalid_response", "null": "invalid_response", "late": "timeout", "many": "rate_limited"}
    r = got["partial"]
    assert (r.title, r.authors, r.year, r.arxiv_id) == ("On sets", ["Ann Lee"], "2020", "2001.00001v2") and got["many"].title is None


def test_a_scan_keeps_failures_as_rows(spark):
    hints = spark.createDataFrame([("x", "Sets & maps", ""), ("y", None, "A. Lee. slow"), ("z", None, None)], "blocked_id string, title_hint string, bibliography_text string")
    feed, work = FEED.format(ENTRY.format("math/0101001")), json.dumps({"results": [{"title": "T", "doi": "https://doi.org/10.1/X"}]})

    def fetch(url):
        if "slow" in url:
            raise TimeoutError
        if "crossref" in url:
            raise ValueError("secret")
        return (200, feed) if "arxiv" in url else (200, work)

    asked = providers.requests(hints)
    assert {r.url for r in asked.where("provider = 'arxiv'").collect()} >= {providers.SEARCH["arxiv"] + "all%3A%22Sets+%26+maps%22", providers.SEARCH["arxiv"] + "all%3A*"}
    got = {(r.blocked_id, r.provider): (r.outcome, r.arxiv_id or r.doi) for r in providers.records(providers.fetched(asked, fetch)).collect()}
    assert got == {(i, p): ("timeout", None) if i == "y" else {"crossref": ("unavailable", None), "openalex": ("ok", "10.1/x"), "arxiv": ("ok", "math/0101001")}[p] for i in "xyz" for p in providers.SEARCH}
