"""Mentions in proofs and what follows from them: citations, external results, classified dependencies, completeness.

A pass per proof only emits candidates with their places; what is excluded, known,
ambiguous or missing is decided by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prose, tex
from ..session import checkpointed
from . import extract, graph
from .relational import tristate

#: Said where a proof shows no dependency (fixed value of this engine).
EMPTY = "no dependency was found in the proof; independence is not established"


def _proofs(docs: DataFrame) -> DataFrame:
    return docs.select("paper_id", F.inline("proofs")).select("paper_id", F.col("number").alias("proof"), "owner", "text")


def _scanned(docs: DataFrame, read: Callable[[str], list[dict]], fields: str) -> DataFrame:
    """paper_id, proof, owner and the fields that read(text) gives."""
    names = ["paper_id", "proof", "owner", *[f.split()[0] for f in fields.split(",")]]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [{"paper_id": p, "proof": n, "owner": o, **found} for p, n, o, t in zip(batch["paper_id"], batch["proof"], batch["owner"], batch["text"], strict=True) for found in read(t or "")]
            yield pd.DataFrame(out, columns=names)

    return _proofs(docs).mapInPandas(rows, f"paper_id string, proof bigint, owner string, {fields}")


def citation_mentions(docs: DataFrame) -> DataFrame:
    """paper_id, proof, owner, method, key, raw, start, end, kind, number, entry_key, resolution_status.

    Keys meet entries in lower case; a bracket without a locator counts only if an entry has its key.
    """
    found = _scanned(docs, prose.citations, "method string, key string, raw string, start bigint, end bigint, kind string, number string, sure boolean")
    key = lambda c: F.concat_ws("\x1f", "paper_id", F.lower(c))
    entries = docs.select("paper_id", F.inline("entries")).select(key("key").alias("_key"), F.col("key").alias("entry_key"))
    out = tristate(found.withColumn("_key", key("key")), "_key", entries, "entry_key").withColumnRenamed("target", "entry_key")
    return out.where("sure or resolution_status <> 'unresolved'").drop("_key", "sure")


def external_mentions(docs: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """Citations with a locator: the result of another paper that they name; target_paper_id if that paper is here."""
    rows = citation_mentions(docs).where("kind is not null and number is not null")
    ids = docs.select("paper_id", F.inline("entries")).where("arxiv_id is not null").groupBy("paper_id", F.col("key").alias("entry_key")).agg(F.min("arxiv_id").alias("arxiv_id"))
    here = (docs if papers is None else papers).select(F.col("paper_id").alias("target_paper_id")).distinct()
    rows = rows.join(ids, ["paper_id", "entry_key"], "left").join(here, F.concat(F.lit("arxiv:"), "arxiv_id") == F.col("target_paper_id"), "left")
    status = F.when(F.col("target_paper_id").isNotNull(), "resolved_paper").when(F.col("entry_key").isNotNull(), "resolved_bibliography_entry").otherwise("unresolved")
    return rows.withColumn("resolution_status", status)


def number_mentions(docs: DataFrame) -> DataFrame:
    """paper_id, proof, owner, kind, number, raw, start, end, target, resolution_status of results named in prose.

    Names inside citations are other papers' results: an anti join on overlapping ranges takes them out.
    """
    found = _scanned(docs, lambda t: [{k: v for k, v in x.items() if k != "place"} for x in prose.named(tex.mask(t))], "kind string, number string, start bigint, end bigint, raw string")
    cited = _scanned(docs, prose.citations, "method string, key string, raw string, start bigint, end bigint, kind string, number string, sure boolean")
    cited = cited.select("paper_id", "proof", F.col("start").alias("_a"), F.col("end").alias("_b")).distinct()
    on = [found.paper_id == cited.paper_id, found.proof == cited.proof, cited._a < found.end, found.start < cited._b]
    found = found.join(cited, on, "left_anti")
    key = lambda kind, number: F.concat_ws("\x1f", "paper_id", kind, F.lower(number))
    known = docs.select("paper_id", F.inline("statements"))
    # one unknown number of a kind makes all numbers of that kind useless
    unknown = known.where("visible_number is null").select("paper_id", "normalized_kind").distinct()
    usable = known.where("visible_number is not null").join(unknown, ["paper_id", "normalized_kind"], "left_anti").select(key("normalized_kind", "visible_number").alias("_key"), "local_id")
    return tristate(found.withColumn("_key", key("kind", "number")), "_key", usable, "local_id").drop("_key")


def local_mentions(docs: DataFrame) -> DataFrame:
    """paper_id, proof, owner, method (ref, number, roadmap), raw, target, resolution_status."""
    cols = ["paper_id", "proof", "owner", "method", "raw", "target", "resolution_status"]
    refs = extract.proof_mentions(docs).withColumns({"method": F.lit("ref"), "raw": F.col("ref_label")}).select(cols)
    owners = _proofs(docs).select("paper_id", "proof", "owner")
    ahead = extract.roadmap_mentions(docs).join(owners, ["paper_id", "proof"]).withColumns({"method": F.lit("roadmap"), "raw": F.concat_ws(" ", "kind", "ref_label")}).select(cols)
    numbers = number_mentions(docs).withColumn("method", F.lit("number")).select(cols)
    # what a roadmap announces is also a name in prose: once is enough
    numbers = numbers.join(ahead.select("paper_id", "proof", "target").where("target is not null").distinct(), ["paper_id", "proof", "target"], "left_anti").select(cols)
    return refs.unionByName(numbers).unionByName(ahead)


def classified(docs: DataFrame) -> DataFrame:
    """paper_id, owner, class, target, via (what was said, in order), n of each result with a proof.

    Classes: known_local, known_citation, known_external, resolved_external, and unresolved_ local,
    citation and external; one inferred row names how the proof got its owner, one warning row says
    that nothing was found.  The documents are parsed once: every branch reads a checkpoint of them.
    """
    return _classified(checkpointed(docs))


def _classified(docs: DataFrame) -> DataFrame:
    local = local_mentions(docs).select("paper_id", "owner", F.when(F.col("resolution_status") == "resolved_unique", "known_local").otherwise("unresolved_local").alias("class"), "target", "raw")
    cites = citation_mentions(docs).select("paper_id", "owner", F.when(F.col("resolution_status") == "resolved_unique", "known_citation").otherwise("unresolved_citation").alias("class"), F.coalesce("entry_key", "key").alias("target"), "raw")
    external = external_mentions(docs)
    kind = F.when(F.col("target_paper_id").isNotNull(), "resolved_external").when(F.col("entry_key").isNotNull(), "known_external").otherwise("unresolved_external")
    external = external.select("paper_id", "owner", kind.alias("class"), F.coalesce("target_paper_id", "entry_key").alias("target"), "raw")
    said = local.unionByName(cites).unionByName(external).where("owner is not null").withColumn("target", F.coalesce("target", "raw"))
    out = said.groupBy("paper_id", "owner", "class", "target").agg(F.array_sort(F.collect_set("raw")).alias("via"), F.count("*").alias("n"))
    proofs = docs.select("paper_id", F.inline("proofs")).where("owner is not null")
    one, none = F.lit(1).cast("long"), F.array().cast("array<string>")
    inferred = proofs.select("paper_id", "owner", F.lit("inferred").alias("class"), F.col("basis").alias("target"), none.alias("via"), one.alias("n"))
    known = out.where(F.col("class").isin("known_local", "known_external", "resolved_external")).select("paper_id", "owner").distinct()
    empty = proofs.select("paper_id", "owner").distinct().join(known, ["paper_id", "owner"], "left_anti").select("paper_id", "owner", F.lit("warning").alias("class"), F.lit(EMPTY).alias("target"), none.alias("via"), one.alias("n"))
    return out.unionByName(inferred).unionByName(empty)


def completeness(docs: DataFrame) -> DataFrame:
    """paper_id, n_edges, n_external, n_unresolved, n_cyclic, isolated (results no known dependency uses), self_containment.

    low: something is unresolved or cyclic; medium: only other papers are needed; high: neither.
    """
    docs = checkpointed(docs)
    rows = checkpointed(_classified(docs))
    per = rows.groupBy("paper_id").agg(
        F.count_if(F.col("class") == "known_local").alias("n_edges"), F.coalesce(F.sum(F.when(F.col("class").isin("known_external", "resolved_external"), F.col("n"))), F.lit(0)).alias("n_external"),
        F.coalesce(F.sum(F.when(F.col("class").startswith("unresolved"), F.col("n"))), F.lit(0)).alias("n_unresolved"))
    edges = rows.where(F.col("class") == "known_local").select("paper_id", F.col("owner").alias("src"), F.col("target").alias("dst"))
    cyclic = graph.on_cycles(edges).groupBy("paper_id").agg(F.count("*").alias("n_cyclic"))
    used = edges.select("paper_id", F.col("dst").alias("local_id")).distinct()
    alone = docs.select("paper_id", F.inline("statements")).select("paper_id", "local_id").join(used, ["paper_id", "local_id"], "left_anti")
    alone = alone.groupBy("paper_id").agg(F.array_sort(F.collect_set("local_id")).alias("isolated"))
    out = docs.select("paper_id").join(per, "paper_id", "left").join(cyclic, "paper_id", "left").join(alone, "paper_id", "left").fillna(0, ["n_edges", "n_external", "n_unresolved", "n_cyclic"])
    level = F.when((F.col("n_unresolved") > 0) | (F.col("n_cyclic") > 0), "low").when(F.col("n_external") > 0, "medium").otherwise("high")
    return out.withColumns({"isolated": F.coalesce("isolated", F.array().cast("array<string>")), "self_containment": level})


def dependency_reading(docs: DataFrame) -> DataFrame:
    """paper_id, root, statement_refs, proof_local, path, external: what a result needs, kept apart by how it is known."""
    docs = checkpointed(docs)
    refs = extract.statement_refs(docs).groupBy("paper_id", F.col("source").alias("root")).agg(F.array_sort(F.collect_set(F.struct(F.col("ref_label"), F.col("resolution_status")))).alias("statement_refs"))
    rows = checkpointed(_classified(docs))
    proof = rows.where(F.col("class").isin("known_local", "unresolved_local")).groupBy("paper_id", F.col("owner").alias("root")).agg(F.array_sort(F.collect_set(F.struct("target", "class"))).alias("proof_local"))
    outside = rows.where(F.col("class").contains("external") | F.col("class").contains("citation")).groupBy("paper_id", F.col("owner").alias("root")).agg(F.array_sort(F.collect_set(F.struct("target", "class"))).alias("external"))
    path = graph.reading_paths(extract.dependency_edges(docs)).select("paper_id", "root", F.col("bottom_up").alias("path"), "order_status")
    out = docs.select("paper_id", F.inline("statements")).select("paper_id", F.col("local_id").alias("root"))
    for part in (refs, proof, path, outside):
        out = out.join(part, ["paper_id", "root"], "left")
    return out


def compact(reading: DataFrame, k: int = 5) -> DataFrame:
    """The same with at most k entries a list and how many there were."""
    lists = ("statement_refs", "proof_local", "external")
    sizes = {f"n_{c}": F.coalesce(F.size(c), F.lit(0)) for c in lists}
    return reading.withColumns(sizes).withColumns({c: F.when(F.col(c).isNotNull(), F.slice(c, 1, k)) for c in lists}).withColumn("path", F.slice("path", 1, 20))


def first_mentions(docs: DataFrame, k: int = 3) -> DataFrame:
    """The first k citations of each proof, in order of place."""
    order = Window.partitionBy("paper_id", "proof").orderBy("start", "key")
    return citation_mentions(docs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
