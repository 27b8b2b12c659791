"""Spans of evidence in its sources: where each id lies, in which file, and over which other evidence it got there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import relational

SPAN = ("paper_id", "kind", "evidence_id", "start", "end")


def _id(kind: str, *parts: Column | str) -> Column:
    return F.concat_ws("::", "paper_id", F.concat_ws(":", F.lit(kind), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]))


def own_spans(docs: DataFrame) -> DataFrame:
    """paper_id, kind, evidence_id, start, end in the merged text of results, proofs and citations."""
    span = lambda rows, kind, key: rows.select("paper_id", F.lit(kind).alias("kind"), key.alias("evidence_id"), F.col("position").alias("start"), F.col("end_position").alias("end"))
    results = span(docs.select("paper_id", F.inline("statements")), "result", F.concat_ws("::", "paper_id", "local_id"))
    proofs = span(docs.select("paper_id", F.inline("proofs")), "proof", _id("proof", "number"))
    cites = span(docs.select("paper_id", F.inline("citations")), "citation", _id("citation", "position", "key"))
    return results.unionByName(proofs).unionByName(cites)


def segments(docs: DataFrame) -> DataFrame:
    """paper_id, path, seg_start, seg_end, at: parts of the merged text and where they begin in their file."""
    return docs.select("paper_id", F.inline("segments")).select("paper_id", "path", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), "at")


def fragments(spans: DataFrame, parts: DataFrame) -> DataFrame:
    """paper_id, kind, evidence_id, ord, path, file_start, file_end, coverage (complete or gap).

    An interval join by bins of the merged text; a span that its parts do not cover wholly is a gap, not a guess.
    """
    lo, hi = F.greatest("start", "seg_start"), F.least("end", "seg_end")
    rows = relational.overlapping(spans, parts, ["paper_id"]).select(*SPAN, "path", (F.col("at") + lo - F.col("seg_start")).alias("file_start"), (F.col("at") + hi - F.col("seg_start")).alias("file_end"), lo.alias("_lo"))
    whole = rows.groupBy(*SPAN).agg(F.sum(F.col("file_end") - F.col("file_start")).alias("_n"), F.array_sort(F.collect_list(F.struct("_lo", "path", "file_start", "file_end"))).alias("_f"))
    whole = spans.join(whole, list(SPAN), "left").withColumn("coverage", F.when(F.col("_n") == F.col("end") - F.col("start"), "complete").otherwise("gap"))
    return whole.select("paper_id", "kind", "evidence_id", "coverage", F.posexplode_outer("_f").alias("ord", "_p")).select("paper_id", "kind", "evidence_id", "ord", "_p.path", "_p.file_start", "_p.file_end", "coverage")


def propagated(docs: DataFrame) -> DataFrame:
    """paper_id, kind, evidence_id, via (the ids that lead to the span), start, end of results, proofs, citations and mentions.

    A mention has the span of its proof, the rest their own.  Bibliography entries lie in their own files: bibliography().
    """
    own = own_spans(docs).withColumn("via", F.array("evidence_id"))
    proofs = docs.select("paper_id", F.inline("proofs")).withColumn("_proof", _id("proof", "number"))
    place = ["paper_id", "evidence_id", "via", F.col("position").alias("start"), F.col("end_position").alias("end")]
    said = proofs.select("paper_id", "_proof", "position", "end_position", "number", F.posexplode_outer("refs").alias("ord", "ref")).where("ref is not null")
    said = said.withColumn("evidence_id", _id("mention", "number", "ord")).withColumn("via", F.array("evidence_id", "_proof"))
    mentions = said.select(*place).withColumn("kind", F.lit("mention"))
    return own.unionByName(mentions)


def bibliography(docs: DataFrame) -> DataFrame:
    """paper_id, key, evidence_id, path, file_start, file_end, method, status: each key's entry in its own source.

    Keys meet in lower case.  Entries of several files that say the same count once, by the first file.  Only a located
    entry has a range: repeated_key (twice in one file), conflicting_key (two contents) and gap (over several files) have
    none, and stay as rows.
    """
    rows = docs.select("paper_id", F.inline("entries"))
    first = F.min_by(F.struct("key", "bib_file", "bib_start", "bib_end", "method"), F.struct("bib_file", "bib_start"))
    per = rows.groupBy("paper_id", F.lower("key").alias("_key")).agg(first.alias("e"), F.count("*").alias("n"), F.count_distinct("bib_file").alias("n_files"), F.count_distinct("fingerprint").alias("n_contents"))
    status = F.when(F.col("n") > F.col("n_files"), "repeated_key").when(F.col("n_contents") > 1, "conflicting_key").when(F.col("e.bib_start").isNull(), "gap").otherwise("located")
    per = per.select("paper_id", "e.*", status.alias("status"))
    only = lambda c: F.when(F.col("status") == "located", F.col(c))
    return per.select("paper_id", "key", _id("entry", "key").alias("evidence_id"), only("bib_file").alias("path"), only("bib_start").alias("file_start"), only("bib_end").alias("file_end"), "method", "status")


def trail(docs: DataFrame) -> DataFrame:
    """Each evidence id with the ids on the way to its source and the file fragments there; none stays a row without a file."""
    docs = checkpointed(docs)  # parsed once, read by every branch
    spans = propagated(docs)
    where = fragments(spans.where("start is not null").select(*SPAN), segments(docs))
    found = spans.select("paper_id", "kind", "evidence_id", "via").join(where, ["paper_id", "kind", "evidence_id"], "left")
    coverage = F.when(F.col("status") == "located", "complete").otherwise(F.col("status"))
    entries = bibliography(docs).withColumns({"kind": F.lit("entry"), "via": F.array("evidence_id"), "ord": F.when(F.col("path").isNotNull(), 0), "coverage": coverage})
    return found.unionByName(entries.select(found.columns))


def lookup(tables: dict[str, tuple[DataFrame, str]], wanted: DataFrame) -> DataFrame:
    """wanted(evidence_id) with type and payload (JSON): the first table, in the given order, that has the id."""
    out = None
    for rank, (kind, (table, key)) in enumerate(tables.items()):
        rows = table.select(F.col(key).alias("evidence_id"), F.lit(rank).alias("_rank"), F.lit(kind).alias("type"), F.to_json(F.struct(*table.columns)).alias("payload"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no table to look into")
    best = out.join(wanted.select("evidence_id").distinct(), "evidence_id", "left_semi").groupBy("evidence_id").agg(F.min(F.struct("_rank", "payload", "type")).alias("x"))
    return wanted.join(best, "evidence_id", "left").select(*wanted.columns, "x.type", "x.payload")


def containers(fragments_: DataFrame, blocks: DataFrame) -> DataFrame:
    """fragments(id, source, page, block, start, end) with the one raw block (raw_id) that holds each; none or several: null."""
    key = ["source", "page", "block"]
    raw = blocks.select(*key, F.col("id").alias("raw_id"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    hit = fragments_.join(raw, key).where("_a <= start and end <= _b").groupBy("id").agg(F.count("*").alias("n_containers"), F.min("raw_id").alias("raw_id"))
    out = fragments_.join(hit, "id", "left").fillna(0, ["n_containers"])
    return out.withColumn("raw_id", F.when(F.col("n_containers") == 1, F.col("raw_id")))


def pdf_coverage(rows: DataFrame, spans: Column) -> DataFrame:
    """Adds text_coverage where a span comes from a PDF: what such text may have lost is said, not hidden."""
    note = F.struct(F.lit("pdf_text").alias("status"), F.lit("Text comes from PDF blocks; formulas and layout may be incomplete.").alias("warning"))
    return rows.withColumn("text_coverage", F.when(F.exists(spans, lambda s: s["source_type"] == "pdf"), note))
