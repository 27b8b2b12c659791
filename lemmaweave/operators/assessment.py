"""Assessment of scholarly records against the hints of a reference, as rows: what agrees, what conflicts, what is missing.

A group is all records of a reference that exact identifiers join, through any chain; records without one belong
together by equal title, authors and year.  References of at most MANY records are grouped one by one from sorted
rows; those of more are components over all of them at once, so no such reference is put into one task.
Names of people and the likeness of titles go through Arrow, row by row.  Joins are never planned as broadcasts:
the sizes that the engine estimates behind small files are far below the rows that come.
Scores order candidates and never authorise one.

Defined results: records that say nothing are left out; repeated records count once; a reference without records has
no candidate and a boundary that says so; null values are missing, not different.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, scalar
from ..session import checkpointed
from . import graph, references, scholarly

#: Words of the contract and the likeness that supports a title (fixed values).
ALIKE = scholarly.ALIKE
LEVELS = ("strong", "plausible", "ambiguous", "weak")
ANSWERED = ("ok", "empty")
ACTIONS = {
    "no_candidates": ("provide_identifier", "refresh_search"), "provider_failure": ("refresh_search",), "partial_provider_failure": ("refresh_search", "review_candidates"),
    "insufficient_metadata": ("provide_identifier",), "identifier_conflict": ("review_candidates",), "version_conflict": ("review_candidates",),
    "ambiguous_candidates": ("review_candidates",), "no_importable_source": ("provide_local_pdf", "skip_reference"),
}
FIELDS = ("title", "authors", "year")
#: Most records of a reference that one task groups (fixed value).
MANY = 1000
#: Columns of a record, in the order in which its key names them.
RECORD = ("provider", "title", "authors", "year", "doi", "arxiv_id", "arxiv_version", "url", "is_retracted")


def apart(side: DataFrame) -> DataFrame:
    """A side of a join that is dealt by its keys, whatever size the engine guesses."""
    return side.hint("merge")


def folded(text: Column) -> Column:
    @F.pandas_udf("string")
    def fold(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else identity.folded(x)).astype(object)

    return fold(text)


def people_in_common(left: Column, right: Column) -> Column:
    """Most names of two lists that can be paired one to one; null if a list is."""
    @F.pandas_udf("int")
    def paired(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else scholarly.matched_people(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return paired(left, right)


def _said(values: Column) -> Column:
    """An empty list says nothing."""
    return F.when(F.size(values) > 0, values)


def keyed(records: DataFrame) -> DataFrame:
    """The records that say something, each once, with record_key, ids and folded title and year."""
    rows = records.select("blocked_id", *RECORD).withColumn("authors", _said(F.col("authors")))
    for c in ("title", "year", "doi", "arxiv_id", "arxiv_version", "url"):
        rows = rows.withColumn(c, F.nullif(F.trim(F.col(c).cast("string")), F.lit("")))
    rows = rows.where(F.coalesce("doi", "arxiv_id", "title", "url").isNotNull())
    rows = rows.withColumn("record_key", F.sha2(F.to_json(F.struct(*RECORD)), 256)).dropDuplicates(["blocked_id", "record_key"])
    named = lambda c, kind, version: references.identified(F.col(c), F.lit(kind), version)
    rows = rows.withColumns({"_doi": named("doi", "doi", F.lit(None).cast("string")), "_arxiv": named("arxiv_id", "arxiv", F.col("arxiv_version")), "f_title": folded(F.col("title")), "f_year": folded(F.col("year"))})
    return rows.withColumn("ids", F.array_compact(F.array("_doi", "_arxiv"))).drop("_doi", "_arxiv")


def _named(records: list[tuple[str, list[str]]]) -> list[str]:
    """The name of the group of each record (key, marks): a hash of the keys of all its records."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for key, marks in records:
        for mark in marks:
            a, b = find(f"r:{key}"), find(mark)
            root[max(a, b)] = min(a, b)
    members: dict[str, set[str]] = {}
    for key, _ in records:
        members.setdefault(find(f"r:{key}"), set()).add(key)
    names = {top: hashlib.sha256(",".join(sorted(keys)).encode()).hexdigest() for top, keys in members.items()}
    return [names[find(f"r:{key}")] for key, _ in records]


def _by_reference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by reference, whose last column holds marks: it gets the name of the row's group instead."""
    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        for _, own in groupby(zip(*[rows[c].to_pylist() for c in ("blocked_id", "record_key", "group_key")], strict=True), key=lambda x: x[0]):
            names += _named([(key, marks) for _, key, marks in own])
        yield from rows.set_column(rows.num_columns - 1, "group_key", pa.array(names, pa.string())).to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        names = batch["blocked_id"].to_pylist()
        n = next((i for i in range(len(names), 0, -1) if names[i - 1] != names[-1]), 0)  # the last reference may go on
        if n or (held and held[-1]["blocked_id"][-1].as_py() != names[-1]):
            whole = [*held, batch.slice(0, n)]
            held = []
            yield from done(pa.Table.from_batches(whole))
        held.append(batch.slice(n))
    if held:
        yield from done(pa.Table.from_batches(held))


def grouped(rows: DataFrame) -> DataFrame:
    """The keyed records with group_key, a name for the records of the group that does not depend on their order."""
    exact = F.transform(F.filter("ids", lambda i: i["exact_eligible"]), lambda i: F.concat(F.lit("i:"), i["identity"]))
    meta = F.when(F.col("title").isNotNull() & F.col("authors").isNotNull() & F.col("year").isNotNull(), F.array(F.concat(F.lit("m:"), F.to_json(F.struct("f_title", F.transform("authors", lambda a: F.lower(scalar.collapsed(a))), "f_year")))))
    own = F.concat(F.lit("r:"), "record_key")
    rows = rows.where("blocked_id is not null").withColumn("group_key", F.when(F.size(exact) > 0, exact).otherwise(F.coalesce(meta, F.array(own))))
    large = checkpointed(rows.groupBy("blocked_id").agg(F.count("*").alias("_n")).where(F.col("_n") > MANY).select("blocked_id"))
    hot = not large.isEmpty()
    few = rows.join(apart(large), "blocked_id", "left_anti").select(*rows.columns) if hot else rows
    found = few.repartition("blocked_id").sortWithinPartitions("blocked_id").mapInArrow(_by_reference, few.withColumn("group_key", F.lit("")).schema)
    if not hot:
        return found
    many = rows.join(apart(large), "blocked_id", "left_semi")
    node = lambda mark: F.sha2(F.to_json(F.struct(F.col("blocked_id"), mark.alias("m"))), 256)
    links = many.select(node(own).alias("u"), F.explode(F.transform("group_key", node)).alias("v"))
    roots = graph.components(links).select(F.col("id").alias("_id"), "root")
    many = many.drop("group_key").withColumn("_id", node(own)).join(apart(roots), "_id").drop("_id")
    names = many.groupBy("blocked_id", "root").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("record_key")), ","), 256).alias("group_key"))
    return found.unionByName(many.join(apart(names), ["blocked_id", "root"]).drop("root"))


def _facts(members: DataFrame, hints: DataFrame) -> DataFrame:
    """One row a group: what its records say, what is asked, and how they compare."""
    asked = hints.select("blocked_id", F.col("title_hint").alias("q_title"), _said(F.col("author_hints")).alias("q_authors"), F.col("year_hint").cast("string").alias("q_year"), F.col("identifier_hints").alias("q_ids"), F.col("warnings").alias("q_warnings"))
    asked = asked.withColumns({"qf_title": folded(F.col("q_title")), "qf_year": folded(F.col("q_year"))})
    group = Window.partitionBy("blocked_id", "group_key").orderBy("record_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = members.withColumn("_first", F.first("authors", ignorenulls=True).over(group)).join(apart(asked), "blocked_id", "left")
    rows = rows.withColumns({"_paired": people_in_common(F.col("q_authors"), F.col("authors")), "_own": people_in_common(F.col("_first"), F.col("authors")),
                             "_ratio": F.when(F.col("qf_title") == F.col("f_title"), F.lit(1.0)).otherwise(scalar.similarity(F.col("qf_title"), F.col("f_title")))})
    same = lambda n, left: (F.col(n) == F.size("authors")) & (F.size(left) == F.size("authors"))
    spelled = F.transform("ids", lambda i: F.struct(i["identity"].alias("identity"), i["kind"].alias("kind"), i["version"].alias("version"), i["canonical"].alias("canonical"), i["exact_eligible"].alias("exact_eligible"), i["valid"].alias("valid"), i["warnings"].alias("warnings")))
    asked_columns = ("q_title", "q_authors", "q_year", "q_ids", "q_warnings")
    out = rows.groupBy("blocked_id", "group_key").agg(
        *[F.first(c).alias(c) for c in asked_columns], F.array_sort(F.collect_set("record_key")).alias("evidence"), F.array_sort(F.collect_set("provider")).alias("providers"),
        F.array_distinct(F.flatten(F.array_sort(F.collect_set(spelled)))).alias("ids"), F.max(F.coalesce(F.col("is_retracted"), F.lit(False))).alias("retracted"),
        F.array_sort(F.collect_set("title")).alias("titles"), F.array_sort(F.collect_set(F.array_join("authors", "; "))).alias("people"), F.array_sort(F.collect_set("year")).alias("years"),
        F.min_by("title", "record_key").alias("title"), F.min("_ratio").alias("ratio"), F.min("_paired").alias("n_people"),
        (F.min("f_title") != F.max("f_title")).alias("x_title"), (~F.min(same("_own", "_first"))).alias("x_authors"), (F.min("f_year") != F.max("f_year")).alias("x_year"),
        F.min(F.col("f_title") == F.col("qf_title")).alias("e_title"), F.min(same("_paired", "q_authors")).alias("e_authors"), F.min(F.col("f_year") == F.col("qf_year")).alias("e_year"),
        F.min(F.col("title") == F.col("q_title")).alias("s_title"), F.min(F.col("authors") == F.col("q_authors")).alias("s_authors"), F.min(F.col("year") == F.col("q_year")).alias("s_year"))
    flags = [f"{x}_{f}" for x in "xes" for f in FIELDS]
    out = out.fillna(False, flags).withColumns({"q_ids": F.coalesce("q_ids", F.array().cast(f"array<{references.IDENTIFIER}>")), "q_warnings": F.coalesce("q_warnings", F.array().cast("array<string>")), "ratio": F.coalesce("ratio", F.lit(0.0))})
    wanted = F.array_distinct(F.transform(F.filter("q_ids", lambda i: i["exact_eligible"]), lambda i: i["identity"]))
    here = F.array_sort(F.array_distinct(F.transform(F.filter("ids", lambda i: i["exact_eligible"]), lambda i: i["identity"])))
    return out.withColumns({"wanted": F.array_sort(wanted), "here": here}).withColumn("exact", F.size(F.array_intersect("wanted", "here")) > 0)


_VALUES = {"title": "titles", "authors": "people", "year": "years"}


def _asked(field: str) -> Column:
    return F.array_join("q_authors", "; ") if field == "authors" else F.col(f"q_{field}")


def _both(field: str) -> Column:
    return F.col(f"q_{field}").isNotNull() & (F.size(_VALUES[field]) > 0)


def _against(field: str) -> Column:
    """Asked and found, but not alike."""
    return _both(field) & ~F.col(f"e_{field}") & (~(F.col("ratio") >= ALIKE) if field == "title" else F.lit(True))


def fields(facts: DataFrame) -> DataFrame:
    """blocked_id, group_key, field, relation, query_value, candidate_values, n_matched, evidence.

    relation: exact, normalized_equivalent, fuzzy, partial_overlap or conflicting; missing_query and missing_candidate
    where a side says nothing.
    """
    rows = []
    row = lambda field, relation, query, values, n: F.struct(F.lit(field).alias("field"), relation.alias("relation"), query.alias("query_value"), values.alias("candidate_values"), n.alias("n_matched"))
    no_number, no_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    for f in FIELDS:
        relation = F.when(F.col(f"s_{f}"), "exact").when(F.col(f"e_{f}"), "normalized_equivalent")
        relation = relation.when(F.col("ratio") >= ALIKE, "fuzzy") if f == "title" else relation.when(F.col("n_people") > 0, "partial_overlap") if f == "authors" else relation
        values = F.col(_VALUES[f])
        rows += [F.when(_both(f), row(f, relation.otherwise("conflicting"), _asked(f), values, F.col("n_people") if f == "authors" else no_number)),
                 F.when(F.col(f"q_{f}").isNull(), row(f, F.lit("missing_query"), no_text, values, no_number)), F.when(F.size(values) == 0, row(f, F.lit("missing_candidate"), _asked(f), values, no_number))]
    rows.append(F.when(F.col("exact"), row("identifiers", F.lit("exact"), F.array_join("wanted", "; "), F.col("here"), no_number)))
    return facts.select("blocked_id", "group_key", "evidence", F.inline(F.array_compact(F.array(*rows)))).select("blocked_id", "group_key", "field", "relation", "query_value", "candidate_values", "n_matched", "evidence")


def _versions(ids: Column, name: Column) -> Column:
    """Versions the group knows of an identifier; none is a version of its own."""
    return F.array_distinct(F.transform(F.filter(ids, lambda i: i["identity"] == name), lambda i: F.coalesce(i["version"], F.lit("none"))))


def _conflict_list() -> Column:
    row = lambda code, field, values: F.struct(F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), F.lit(field).alias("field"), values.alias("values"))
    several = lambda kind: F.array_sort(F.array_distinct(F.transform(F.filter("ids", lambda i: i["valid"] & (i["kind"] == kind)), lambda i: i["identity"])))
    known = F.array_sort(F.array_distinct(F.array_compact(F.transform("ids", lambda i: i["version"]))))
    doubted = F.array_distinct(F.transform(F.filter("q_ids", lambda i: F.size(i["warnings"]) > 0), lambda i: i["raw"]))
    other = F.filter("q_ids", lambda i: i["version"].isNotNull() & F.array_contains("here", i["identity"]) & (_versions(F.col("ids"), i["identity"]) != F.array(i["version"])))
    none = F.array().cast("array<string>")
    rows = [F.when(F.array_contains("q_warnings", warning), row("metadata_conflict", f"source_{field}", none)) for warning, field in ((references.TITLES, "title"), (references.YEARS, "year"), (references.PEOPLE, "authors"))]
    rows += [F.when(F.size(several(kind)) > 1, row("identifier_conflict", kind, several(kind))) for kind in ("arxiv", "doi")]
    rows += [
        F.when(F.size(known) > 1, row("version_conflict", "arxiv_version", known)),
        F.when(F.size(F.array_except("wanted", "here")) > 0, row("identifier_conflict", "identifiers", F.array_sort(F.array_union("wanted", "here")))),
        F.when(F.size(doubted) > 0, row("identifier_conflict", "source_identifier", doubted)),
        F.when(F.size(other) > 0, row("version_conflict", "source_version", F.array_sort(F.array_distinct(F.transform(other, lambda i: i["version"]))))),
        F.when(F.col("retracted"), row("retraction_or_withdrawal", "status", F.array(F.lit("reported")))),
    ]
    rows += [F.when(F.col(f"x_{f}"), row("metadata_conflict", f"candidate_{f}", F.col(_VALUES[f]))) for f in FIELDS]
    rows += [F.when(_against(f), row("metadata_conflict", f, F.concat(F.array(_asked(f)), F.col(_VALUES[f])))) for f in FIELDS]
    warned = F.array_distinct(F.flatten(F.transform("ids", lambda i: i["warnings"])))
    warned = F.transform(warned, lambda w: F.struct(w.alias("code"), F.lit("identifiers").alias("field"), F.col("here").alias("values")))
    return F.concat(F.array_compact(F.array(*rows)), warned)


def conflicts(facts: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """blocked_id, group_key, code, field, values, evidence: record keys, or the texts where the sources themselves disagree."""
    rows = facts.select("blocked_id", "group_key", "evidence", F.inline(_conflict_list()))
    if spans is None:
        return rows.select("blocked_id", "group_key", "code", "field", "values", "evidence")
    own = spans.groupBy("blocked_id", F.concat(F.lit("source_"), "field").alias("field")).agg(F.array_sort(F.collect_set("value")).alias("_values"), F.array_sort(F.collect_set("evidence_id")).alias("_texts"))
    rows = rows.join(apart(own), ["blocked_id", "field"], "left")
    return rows.select("blocked_id", "group_key", "code", "field", F.coalesce("_values", "values").alias("values"), F.coalesce("_texts", "evidence").alias("evidence"))


def facts_of(hints: DataFrame, records: DataFrame) -> DataFrame:
    """The comparison of every group with what is asked, cut off from its lineage: fields, conflicts and candidates read it.

    hints: as references.hints gives them; records: blocked_id, provider, title, authors, year, doi, arxiv_id, arxiv_version, url, is_retracted.
    """
    return checkpointed(_facts(grouped(checkpointed(keyed(records))), hints))


def candidates(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """blocked_id, position, group_key, confidence, identity_status, source_status, score, arxiv_id, version, doi, title, providers, reasons, eligible, denied, evidence.

    answers: blocked_id, provider, outcome.  Ambiguity is settled before any limit: two strong candidates, or any conflict, leave none eligible.
    """
    health = answers.groupBy("blocked_id").agg(F.max(~F.coalesce(F.col("outcome"), F.lit("")).isin(*ANSWERED)).alias("_failed"))
    rows = facts.withColumn("_codes", F.array_sort(F.array_distinct(F.transform(_conflict_list(), lambda c: c["code"])))).withColumn("_against", F.size("_codes") > 0)
    agree = F.col("e_title") & F.col("e_authors") & F.col("e_year")
    alike = F.col("ratio") >= ALIKE
    vouched = agree & (F.size(F.array_except("providers", F.array(F.lit("source")))) > 1)
    partly = F.col("e_title") | (alike & (F.col("e_authors") | F.col("e_year")))
    status = F.when(F.col("_against"), "conflict").when(F.col("exact"), "exact_identifier").when(vouched, "corroborated_metadata").when(partly, "partial_match").otherwise("insufficient_evidence")
    rows = rows.withColumn("identity_status", status)
    level = F.when(F.col("_against"), "ambiguous").when(F.col("identity_status").isin("exact_identifier", "corroborated_metadata"), "strong").when(F.col("identity_status") == "partial_match", "plausible").otherwise("weak")
    pick = lambda kind, part: F.when(~F.col("_against"), F.get(F.transform(F.filter("ids", lambda i: i["exact_eligible"] & (i["kind"] == kind)), lambda i: i[part]), F.lit(0)))
    points = F.when(F.col("exact"), 8.0).otherwise(0.0) + F.when(F.col("e_title"), 4.0).when(alike, 2.0).otherwise(0.0) + F.col("e_authors").cast("double") + F.col("e_year").cast("double")
    rows = rows.withColumns({"_level": level, "score": points, "arxiv_id": pick("arxiv", "canonical"), "version": pick("arxiv", "version"), "doi": pick("doi", "canonical")})
    per = Window.partitionBy("blocked_id")
    rows = rows.withColumns({"_strong": F.count_if(F.col("_level") == "strong").over(per), "_any": F.max("_against").over(per)}).join(apart(health), "blocked_id", "left")
    tied = (F.col("_level") == "strong") & (F.col("_strong") > 1)
    reasons = F.when(F.col("_against"), F.col("_codes")).otherwise(F.array("identity_status"))
    source = F.when(F.col("_against"), "review_required").when(F.col("arxiv_id").isNotNull(), "arxiv_importable").otherwise("metadata_only")
    denied = (F.when((F.col("_strong") > 1) | F.col("_any"), "ambiguous_candidates").when(F.col("_level") != "strong", "insufficient_identity_evidence")
              .when(~F.col("exact") & F.coalesce(F.col("_failed"), F.lit(False)), "partial_provider_failure").when(F.col("arxiv_id").isNull(), "no_importable_source"))
    rows = rows.withColumns({"confidence": F.when(tied, "ambiguous").otherwise(F.col("_level")), "reasons": F.when(tied, F.array_sort(F.array_union(reasons, F.array(F.lit("ambiguous_candidates"))))).otherwise(reasons), "source_status": source, "denied": denied})
    order = F.array_position(F.lit(list(LEVELS)), F.col("confidence"))
    place = F.row_number().over(per.orderBy(order, *[F.desc(c) for c in ("exact", "e_title", "e_authors", "e_year", "ratio")], "group_key"))
    return rows.select("blocked_id", place.alias("position"), "group_key", "confidence", "identity_status", "source_status", "score", "arxiv_id", "version", "doi", "title", "providers", "reasons", F.col("denied").isNull().alias("eligible"), "denied", "evidence")


def selected(found: DataFrame) -> DataFrame:
    """blocked_id, arxiv_id with its version, where exactly one candidate is eligible."""
    one = found.where("eligible").groupBy("blocked_id").agg(F.count("*").alias("n"), F.min(F.concat("arxiv_id", F.coalesce("version", F.lit("")))).alias("arxiv_id"))
    return one.where("n = 1").select("blocked_id", "arxiv_id")


def boundaries(hints: DataFrame, found: DataFrame, answers: DataFrame) -> DataFrame:
    """blocked_id, kind, group_key, evidence, next_actions: why a search does not settle its reference."""
    none = F.array().cast("array<string>")
    health = answers.groupBy("blocked_id").agg(F.count_if(~F.coalesce(F.col("outcome"), F.lit("")).isin(*ANSWERED)).alias("_failed"), F.count("*").alias("_asked"))
    strife = F.array_contains("reasons", "ambiguous_candidates") | (F.col("identity_status") == "conflict")
    per = found.groupBy("blocked_id").agg(F.count("*").alias("_n"), F.array_sort(F.collect_set(F.when(strife, F.col("group_key")))).alias("_between"))
    whole = hints.select("blocked_id").distinct().join(apart(health), "blocked_id", "left").join(apart(per), "blocked_id", "left").fillna(0, ["_failed", "_asked", "_n"])
    row = lambda kind, evidence: F.struct(kind.alias("kind"), evidence.alias("evidence"))
    kinds = [F.when(F.col("_failed") > 0, row(F.when(F.col("_failed") == F.col("_asked"), "provider_failure").otherwise("partial_provider_failure"), none)),
             F.when((F.col("_failed") == 0) & (F.col("_n") == 0), row(F.lit("no_candidates"), none)), F.when(F.size("_between") > 0, row(F.lit("ambiguous_candidates"), F.col("_between")))]
    whole = whole.select("blocked_id", F.lit(None).cast("string").alias("group_key"), F.inline(F.array_compact(F.array(*kinds))))
    kind = (F.when(F.array_contains("reasons", "version_conflict"), "version_conflict").when(F.col("identity_status") == "conflict", "identifier_conflict")
            .when(F.col("source_status") == "metadata_only", "no_importable_source").when(F.col("confidence") != "strong", "insufficient_metadata"))
    each = found.select("blocked_id", "group_key", kind.alias("kind"), "evidence").where("kind is not null")
    actions = F.create_map(*[x for name, what in ACTIONS.items() for x in (F.lit(name), F.array(*map(F.lit, what)))])
    return whole.select("blocked_id", "kind", "group_key", "evidence").unionByName(each.select("blocked_id", "kind", "group_key", "evidence")).withColumn("next_actions", actions[F.col("kind")])
