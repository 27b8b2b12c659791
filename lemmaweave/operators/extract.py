"""Extraction of evidence tables from TeX projects: one grouped pass per paper, then relational resolution.

projects: paper_id, main, files map<path, text>.  The lexical pass runs per
paper in Arrow batches; keys are resolved by joins, so several targets stay
ambiguous and none stays unresolved, as rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, tex
from .relational import tristate

STATEMENT = "struct<local_id:string,kind:string,display_kind:string,normalized_kind:string,label:string,visible_number:string,title:string,content:string,refs:array<string>,position:bigint,source_file:string,end_position:bigint>"
PROOF = "struct<number:bigint,text:string,position:bigint,owner:string,basis:string,confidence:double,refs:array<string>,cites:array<string>,end_position:bigint>"
CITATION = "struct<command:string,key:string,position:bigint,source_file:string,end_position:bigint>"
SEGMENT = "struct<path:string,start:bigint,end:bigint,at:bigint>"
ENTRY = "struct<key:string,type:string,title:string,authors:array<string>,year:int,arxiv_id:string,arxiv_version:string,doi:string,bib_file:string,bib_start:bigint,bib_end:bigint,method:string,fingerprint:string>"
DOCUMENT = f"paper_id string, error string, title string, statements array<{STATEMENT}>, proofs array<{PROOF}>, citations array<{CITATION}>, entries array<{ENTRY}>, segments array<{SEGMENT}>"


def _entry(e: dict, path: str, start: int | None, end: int | None, method: str = "bibtex_entry") -> dict:
    """An entry with its range in its own file; entries with equal fingerprints say the same."""
    f = e["fields"]
    in_note = re.search(r"(?i)\barxiv:\s*([a-z0-9./-]*[a-z0-9])", f.get("note", ""))
    tries = [f.get("eprint") if f.get("archiveprefix", "").lower() == "arxiv" else None, f.get("arxiv"), f.get("url"), in_note[1] if in_note else None]
    name, version = next(((a, v) for a, v in map(identity.arxiv, tries) if a), (None, None))
    doi = identity.identifier(f["doi"], "doi") if f.get("doi") else {}
    year = f.get("year", "")
    return {"key": e["key"], "type": e["type"], "title": f.get("title"), "authors": [a.strip() for a in f.get("author", "").split(" and ") if a.strip()],
            "year": int(year) if year.isdigit() and len(year) < 6 else None, "arxiv_id": name, "arxiv_version": version, "doi": doi.get("canonical"), "bib_file": path,
            "bib_start": start, "bib_end": end, "method": method, "fingerprint": hashlib.sha256(json.dumps([e["type"], f], sort_keys=True).encode()).hexdigest()}


def read_project(paper_id: str, main: str, files: dict[str, str]) -> dict:
    """All evidence of one paper; what makes the project unreadable becomes its error."""
    none: list = []
    try:
        merged = tex.merge(files, main)
        inline = tex.inline_bibliography(merged.text)
        listed = [(path, e) for path, content in sorted(files.items()) if path.endswith(".bib") for e in tex.bibtex(content)]
        if {e["key"].casefold() for e in inline} & {e["key"].casefold() for _, e in listed}:
            raise ValueError("a bibliography key in two sources")
    except (ValueError, FileNotFoundError) as problem:
        return {"paper_id": paper_id, "error": f"{type(problem).__name__}: {problem}", "title": None, "statements": none, "proofs": none, "citations": none, "entries": none, "segments": none}
    text, scan = merged.text, tex.mask(merged.text)
    home = lambda at: next((p for p, a, b, _ in merged.parts if a <= at < b), None)
    found = tex.statements(text)

    def inline_entry(e: dict) -> dict:
        path, a, b, at = next(((p, a, b, at) for p, a, b, at in merged.parts if a <= e["start"] < b), (None, 0, -1, 0))
        whole = e["end"] <= b  # an entry over several files has no single range
        return _entry(e, path, at + e["start"] - a if whole else None, at + e["end"] - a if whole else None, "latex_bibitem")

    title = next((g[0].strip() for _, _, _, e in tex.commands(scan, ("title",)) if (g := tex.group(text, e))), None)
    proofs = [{"number": p.number, "text": p.text, "position": p.position, "owner": p.owner, "basis": p.basis, "confidence": p.confidence, "refs": tex.references(p.text),
               "cites": [k for _, k, _, _ in tex.keys(tex.mask(p.text), tex.CITATIONS)], "end_position": p.end} for p in tex.proofs(text, found)]
    return {
        "paper_id": paper_id, "error": None, "title": title, "proofs": proofs,
        "statements": [{k: getattr(s, k) for k in ("local_id", "kind", "display_kind", "normalized_kind", "label", "visible_number", "title", "content", "refs", "position")} | {"source_file": home(s.position), "end_position": s.end} for s in found],
        "citations": [{"command": c, "key": k, "position": a, "source_file": home(a), "end_position": b} for c, k, a, b in tex.keys(scan, tex.CITATIONS)],
        "segments": [{"path": path, "start": a, "end": b, "at": at} for path, a, b, at in merged.parts],
        "entries": [_entry(e, path, e["start"], e["end"]) for path, e in listed] + [inline_entry(e) for e in inline],
    }


def documents(projects: DataFrame) -> DataFrame:
    """One nested row per paper; everything below unnests it."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [read_project(p, m, dict(f)) for p, m, f in zip(batch["paper_id"], batch["main"], batch["files"], strict=True)]
            yield pd.DataFrame(read, columns=["paper_id", "error", "title", "statements", "proofs", "citations", "entries", "segments"])

    return projects.select("paper_id", "main", "files").mapInPandas(rows, DOCUMENT)


def results(docs: DataFrame) -> DataFrame:
    return docs.select("paper_id", F.inline("statements")).withColumn("global_id", F.concat_ws("::", "paper_id", "local_id"))


def statement_refs(docs: DataFrame) -> DataFrame:
    """paper_id, source, ord, ref_label, target, resolution_status: labels resolve within their paper."""
    rows = docs.select("paper_id", F.inline("statements"))
    refs = rows.select("paper_id", F.col("local_id").alias("source"), F.posexplode_outer("refs").alias("ord", "ref_label")).where("ref_label is not null")
    return _resolved(refs, rows)


def _resolved(refs: DataFrame, statements: DataFrame) -> DataFrame:
    key = lambda c: F.concat_ws("\x1f", "paper_id", c)
    labels = statements.where("label is not null").select(key("label").alias("_key"), "local_id")
    return tristate(refs.withColumn("_key", key("ref_label")), "_key", labels, "local_id").drop("_key")


def proof_mentions(docs: DataFrame) -> DataFrame:
    """paper_id, proof, owner, ord, ref_label, target, resolution_status."""
    rows = docs.select("paper_id", F.inline("proofs")).select("paper_id", F.col("number").alias("proof"), "owner", F.posexplode_outer("refs").alias("ord", "ref_label")).where("ref_label is not null")
    return _resolved(rows, docs.select("paper_id", F.inline("statements")))


def roadmap_mentions(docs: DataFrame) -> DataFrame:
    """paper_id, proof, kind, ref_label (a number), target, resolution_status of results that a proof announces to prove."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(p, n, k, v) for p, n, t in zip(batch["paper_id"], batch["number"], batch["text"], strict=True) for k, v, _ in tex.roadmap(tex.mask(t))]
            yield pd.DataFrame(out, columns=["paper_id", "proof", "kind", "ref_label"])

    said = docs.select("paper_id", F.inline("proofs")).select("paper_id", "number", "text").mapInPandas(rows, "paper_id string, proof bigint, kind string, ref_label string")
    key = lambda kind, number: F.concat_ws("\x1f", "paper_id", kind, F.lower(number))
    known = docs.select("paper_id", F.inline("statements"))
    # one unknown number of a kind makes all numbers of that kind useless
    unknown = known.where("visible_number is null").select("paper_id", "normalized_kind").distinct()
    named = known.where("visible_number is not null").join(unknown, ["paper_id", "normalized_kind"], "left_anti").select(key("normalized_kind", "visible_number").alias("_key"), "local_id")
    return tristate(said.withColumn("_key", key("kind", "ref_label")), "_key", named, "local_id").drop("_key")


def citation_records(docs: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """paper_id, key, command, position, arxiv_id, doi, resolution_status, target_paper_id.

    Targets are bound when read: a paper imported later resolves older citations.  Entries of one key that say different
    things bind nothing.
    """
    uses = docs.select("paper_id", F.inline("citations"))
    entries = docs.select("paper_id", F.inline("entries")).groupBy("paper_id", "key").agg(F.min("arxiv_id").alias("arxiv_id"), F.min("doi").alias("doi"), F.count_distinct("fingerprint").alias("n_entries"))
    entries = entries.withColumns({c: F.when(F.col("n_entries") == 1, F.col(c)) for c in ("arxiv_id", "doi")})
    out = uses.join(entries, ["paper_id", "key"], "left")
    status = F.when(F.col("n_entries").isNull(), "missing_bib_entry").when(F.col("n_entries") > 1, "conflicting_bib_entries").when(F.col("arxiv_id").isNotNull(), "resolved_candidate").otherwise("unsupported_identifier")
    papers = (docs if papers is None else papers).select(F.col("paper_id").alias("target_paper_id")).distinct()
    out = out.withColumn("resolution_status", status).join(papers, F.concat(F.lit("arxiv:"), "arxiv_id") == F.col("target_paper_id"), "left")
    return out.select("paper_id", "key", "command", "position", "source_file", "arxiv_id", "doi", "resolution_status", "target_paper_id")


def dependency_edges(docs: DataFrame) -> DataFrame:
    """edges(paper_id, src, dst, ord) between statements through the proofs they own, for graph operators."""
    m = proof_mentions(docs).where("resolution_status = 'resolved_unique' and owner is not null")
    return m.groupBy("paper_id", F.col("owner").alias("src"), F.col("target").alias("dst")).agg(F.min("ord").alias("ord"))


def import_plan(docs: DataFrame) -> DataFrame:
    """One row per cited work outside the workspace: candidates with an arXiv id, the rest blocked with a reason."""
    c = citation_records(docs).where("target_paper_id is null")
    c = c.withColumn("group_key", F.coalesce(F.concat(F.lit("arxiv:"), "arxiv_id"), F.concat(F.lit("doi:"), "doi"), F.concat_ws("::", "paper_id", "key")))
    return c.groupBy("group_key").agg(
        F.max("arxiv_id").alias("arxiv_id"), F.max("doi").alias("doi"), F.array_sort(F.collect_set("paper_id")).alias("needed_by"),
        F.count("*").alias("n_uses"), F.min(F.when(F.col("resolution_status") == "missing_bib_entry", 1).otherwise(0)).alias("_m"),
    ).select("group_key", "arxiv_id", "doi", "needed_by", "n_uses", F.when(F.col("arxiv_id").isNotNull(), "candidate").otherwise("blocked").alias("status"),
             F.when(F.col("arxiv_id").isNotNull(), None).when(F.col("_m") == 1, "missing_bib_entry").otherwise("missing_arxiv_id").alias("reason"))
