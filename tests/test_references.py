"""Hints of bibliography texts and their spans; assessments of candidates as rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lemmaweave.operators import assessment, references

BLOCKED = "blocked_id string, ord int, kind string, evidence_id string, citation_key string, raw_text string"
CASES = {
    "quoted": ('A. Author and B. Writer. "Maps and proofs". 2020.', "Maps and proofs", ["A. Author", "B. Writer"], "2020", []),
    "command": (r"A. Author. \emph{Maps {and} $X^2$}. 2020.", "Maps {and} $X^2$", ["A. Author"], "2020", []),
    "sentences": ("[17] A. Author. Published target. Journal of Examples 2020.", "Published target", ["A. Author"], "2020", []),
    "letters": ("É. Auteur (2020). \"Étale 映射\".", "Étale 映射", ["É. Auteur"], "2020", []),
    "astral": ("𝔸. Author. \"Maps\". 2020.", "Maps", ["𝔸. Author"], "2020", []),
    "two": ('A. Author. "Maps" or "Proofs". 2019; revised 2021.', None, [], None, ["conflicting_titles", "conflicting_years", "uncertain_title"]),
    "ids": ("doi:10.2020/thing arXiv:2001.12345v2", None, [], None, ["uncertain_title"]),
    "open": (r"A. Author. \emph{Unclosed title. 2020.", None, [], "2020", ["uncertain_title"]),
    "deep": (r"A. B. Author; C. Writer. \textbf{a {b {c {d}}} e} in 1999", "a {b {c {d}}} e", ["A. B. Author", "C. Writer"], "1999", []),
    "twice": ('A. Author. "Maps", "Maps". 2001', "Maps", ["A. Author"], "2001", []),
    "long": ("x " * 30_000 + '"Maps" 1999', "Maps", ["x " * 29_999 + "x"], "1999", []),
}


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(name, 0, "bibliography_entry", f"bib:{name}", "k", text) for name, (text, *_) in CASES.items()]
    rows += [("null", 0, "bibliography_entry", "e", None, None), ("blank", 0, None, "e", " ", " \n")]
    rows += [("several", 0, "bibliography_entry", "e0", "b", 'A. Lee. "One". 1999.'), ("several", 1, "bibliography_entry", "e1", "a", 'B. Lee. "Two". 1999.'), ("several", 2, "citation", "c", "a", 'see "Three" (1800) 10.1000/x')]
    rows += [("alike", i, "bibliography_entry", f"e{i}", "a", 'A. Lee. "One". 1999.') for i in (0, 1, 1)]
    return spark.createDataFrame(rows, BLOCKED).withColumn("value", F.lit(1)).cache()


def test_hints_of_texts(entries):
    got = {r.blocked_id: r for r in references.hints(references.parsed(entries), entries).collect()}
    for name, (text, title, people, year, warnings) in CASES.items():
        r = got[name]
        assert (r.title_hint, r.author_hints, r.year_hint, r.warnings) == (title, people, year, warnings), name
        assert r.bibliography_text == text.strip()
    assert [i.identity for i in got["ids"].identifier_hints] == ["arxiv:2001.12345", "doi:10.2020/thing"] and got["ids"].identifier_hints[0].version == "v2"
    r = got["several"]
    assert (r.title_hint, r.author_hints, r.year_hint, r.warnings) == (None, [], "1999", ["conflicting_authors", "conflicting_titles", "uncertain_title"])
    assert (r.citation_keys, r.citation_texts, [i.identity for i in r.identifier_hints]) == (["a", "b"], ['see "Three" (1800) 10.1000/x'], ["doi:10.1000/x"])
    assert (got["alike"].title_hint, got["alike"].warnings) == ("One", [])
    assert all((got[n].title_hint, got[n].author_hints, got[n].warnings, got[n].identifier_hints) == (None, [], [], []) for n in ("null", "blank"))


def test_spans_point_into_the_text(entries):
    texts = {(r.blocked_id, r.evidence_id): r.raw_text for r in entries.collect()}
    rows = references.spans(references.parsed(entries)).collect()
    for r in rows:
        inside = texts[r.blocked_id, r.evidence_id][r.start:r.end]
        assert inside == r.value or (r.rule in ("quoted_title", "tex_title") and r.value in inside and inside[0] in '"“\\'), r
    assert {r.field for r in rows if r.blocked_id == "ids"} == {"doi", "arxiv"}
    assert sorted(r.value for r in rows if r.blocked_id == "two" and r.field == "title") == ["Maps", "Proofs"]
    assert {(r.rule, r.confidence) for r in rows if r.blocked_id == "sentences" and r.field == "title"} == {("delimited_title", "heuristic")}
    assert references.spans(references.parsed(entries.where("false"))).collect() == []


RECORDS = "blocked_id string, provider string, title string, authors array<string>, year string, doi string, arxiv_id string, arxiv_version string, url string, is_retracted boolean"


def test_assessment_as_rows(spark):
    lee = ["Ann Lee", "Bo Chen"]
    text = {"exact": 'A. Lee and B. Chen. "Maps". 1999. arXiv:2001.00001', "vouched": 'A. Lee and B. Chen. "Maps". 1999.', "tied": "10.1000/a 10.1000/b", "year": 'A. Lee and B. Chen. "Maps". 1998.', "version": "arXiv:2001.00001v2",
            "two": 'A. Lee. "Maps". "Sets". 1999.', "near": 'A. Lee and B. Chen. "Maps of surfaces and knots". 1999.', "none": 'A. Lee and B. Chen. "Maps". 1999.', "down": 'A. Lee and B. Chen. "Maps". 1999.', "chain": 'A. Lee and B. Chen. "Maps". 1999.', "gone": "arXiv:2001.00001", "part": 'A. Lee and C. Wu. "Maps". 1999.'}
    blocked = spark.createDataFrame([(n, 0, "bibliography_entry", f"e:{n}", "k", t) for n, t in text.items()], BLOCKED)
    one = lambda name, provider, title="Maps", people=lee, year="1999", doi=None, arxiv=None, version=None, gone=None: (name, provider, title, people, year, doi, arxiv, version, None, gone)
    rows = [one("exact", "x", arxiv="2001.00001v1"), one("exact", "x", arxiv="2001.00001v1"), one("vouched", "x", title="MAPS", arxiv="2001.00001"), one("vouched", "y", people=["Lee, A.", "Chen, B."], arxiv="2001.00001"),
            one("tied", "x", doi="10.1000/a"), one("tied", "y", doi="10.1000/b"), one("year", "x", arxiv="2001.00001"), one("version", "x", arxiv="2001.00001v1"), one("two", "x"), one("near", "x", title="Maps of surfaces and knot"),
            one("down", "x", doi="10.1000/c"), one("down", "x", title=None, people=None, year=None), one("chain", "x", doi="10.1000/d"), one("chain", "y", doi="10.1000/D", arxiv="2001.00002"), one("chain", "z", arxiv="2001.00002"), one("gone", "x", arxiv="2001.00001", gone=True), one("part", "x")]
    answers = spark.createDataFrame([(n, p, "timeout" if n == "down" and p == "y" else "ok") for n in text for p in "xy"], "blocked_id string, provider string, outcome string")
    parsed = references.parsed(blocked)
    hints = references.hints(parsed, blocked)
    facts = assessment.facts_of(hints, spark.createDataFrame(rows, RECORDS))
    found = assessment.candidates(facts, answers).cache()
    got = {}
    for r in found.orderBy("position").collect():
        got.setdefault(r.blocked_id, []).append(r)
    level = {n: [(r.confidence, r.identity_status, r.score) for r in rs] for n, rs in got.items()}
    assert level["exact"] == [("strong", "exact_identifier", 14.0)] and level["vouched"] == [("strong", "corroborated_metadata", 6.0)]
    assert level["tied"] == [("ambiguous", "conflict", 8.0)] * 2 and level["year"] == [("ambiguous", "conflict", 5.0)] and level["near"] == [("plausible", "partial_match", 4.0)]
    assert level["chain"] == [("strong", "corroborated_metadata", 6.0)] and got["chain"][0].providers == ["x", "y", "z"]
    assert {n: rs[0].denied for n, rs in got.items()} == {"exact": None, "vouched": None, "chain": None, "tied": "ambiguous_candidates", "year": "ambiguous_candidates", "version": "ambiguous_candidates", "two": "ambiguous_candidates",
                                                        "near": "insufficient_identity_evidence", "down": "insufficient_identity_evidence", "gone": "ambiguous_candidates", "part": "ambiguous_candidates"}
    assert sorted(tuple(r) for r in assessment.selected(found).collect()) == [("chain", "2001.00002"), ("exact", "2001.00001v1"), ("vouched", "2001.00001")]
    fields = {(r.blocked_id, r.field): r for r in assessment.fields(facts).collect()}
    assert [fields["vouched", f].relation for f in ("title", "authors", "year")] == ["normalized_equivalent", "normalized_equivalent", "exact"]
    assert (fields["part", "authors"].relation, fields["part", "authors"].n_matched, fields["year", "year"].relation, fields["near", "title"].relation) == ("partial_overlap", 1, "conflicting", "fuzzy")
    assert fields["tied", "title"].relation == "missing_query" and fields["exact", "identifiers"].candidate_values == ["arxiv:2001.00001"]
    against = {}
    for r in assessment.conflicts(facts, references.spans(parsed)).collect():
        against.setdefault(r.blocked_id, set()).add((r.code, r.field))
        if r.blocked_id == "two":
            assert (r.values, r.evidence) == (["Maps", "Sets"], ["e:two"])
    assert against == {"tied": {("identifier_conflict", "identifiers")}, "year": {("metadata_conflict", "year")}, "version": {("version_conflict", "source_version")}, "two": {("metadata_conflict", "source_title")},
                       "gone": {("retraction_or_withdrawal", "status")}, "part": {("metadata_conflict", "authors")}}
    ends = {}
    for r in assessment.boundaries(hints, found, answers).collect():
        assert r.next_actions == list(assessment.ACTIONS[r.kind])
        ends.setdefault(r.blocked_id, set()).add(r.kind)
    assert ends["none"] == {"no_candidates"} and ends["down"] == {"partial_provider_failure", "no_importable_source"} and ends["version"] == {"ambiguous_candidates", "version_conflict"} and "exact" not in ends
    assert assessment.candidates(assessment.facts_of(hints, spark.createDataFrame([], RECORDS)), answers).collect() == []
