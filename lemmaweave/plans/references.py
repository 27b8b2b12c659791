"""Queries of hints and assessments of references, each with its SQL.

Parts stand for blocked references: the size of a part decides how its entry is written, which providers know the
work and what they say of it, so what must be found is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import assessment, references
from . import reading
from .catalog import ORACLE_SQL, QUERIES, Tables, query

__all__ = ["ORACLE_SQL", "QUERIES", "reading"]


def _name() -> Column:
    return F.trim(F.regexp_replace("p_name", "[^a-z ]", ""))


def entries(t: Tables) -> DataFrame:
    """A bibliography entry per part: a title in quotes, in a command, between stops, with two years, or never closed."""
    form, people, name = F.col("p_size") % 5, F.lit("A. Lee and B. Chen. "), F.concat(F.lit("Studies in "), _name())
    text = (F.when(form == 0, F.concat(people, F.lit('"'), name, F.lit('". Press, 1999.'))).when(form == 1, F.concat(people, F.lit("\\emph{Studies in {"), _name(), F.lit("}}. Press, 1999.")))
            .when(form == 2, F.concat(F.lit("[k] "), people, name, F.lit(". Press 1999."))).when(form == 3, F.concat(people, F.lit('"'), name, F.lit('". Press, 1999; again 2001.'))).otherwise(F.concat(F.lit("\\emph{"), name, F.lit(", 1999."))))
    text = F.concat(text, F.when(F.col("p_size") % 7 == 0, F.concat(F.lit(" doi:10.1000/"), "p_partkey")).otherwise(""))
    key = F.col("p_partkey").cast("string")
    return t.part.select(key.alias("blocked_id"), F.lit(0).alias("ord"), F.lit("bibliography_entry").alias("kind"), F.concat(F.lit("e"), key).alias("evidence_id"), F.lit("k").alias("citation_key"), text.alias("raw_text"))


def records(t: Tables) -> DataFrame:
    """What providers know of each part: x all, y every second one with full names, z every third one under another DOI."""
    key = F.col("p_partkey").cast("string")
    short, full = F.array(F.lit("A. Lee"), F.lit("B. Chen")), F.array(F.lit("Lee, Ann"), F.lit("Chen, Bo"))
    arxiv, none = F.concat(F.lit("2001."), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0")), F.lit(None).cast("string")

    def of(provider: str, known: Column, people: Column, doi: Column, arxiv_id: Column) -> DataFrame:
        return t.part.where(known).select(key.alias("blocked_id"), F.lit(provider).alias("provider"), F.concat(F.lit("Studies in "), _name()).alias("title"), people.alias("authors"), F.lit("1999").alias("year"), doi.alias("doi"), arxiv_id.alias("arxiv_id"),
                                          none.alias("arxiv_version"), none.alias("url"), F.lit(False).alias("is_retracted"))

    doi = F.concat(F.lit("10.1000/"), key)
    return of("x", F.lit(True), short, doi, arxiv).unionByName(of("y", F.col("p_size") % 2 == 0, full, none, arxiv)).unionByName(of("z", F.col("p_size") % 3 == 0, short, F.concat(doi, F.lit("z")), none))


def answers(t: Tables) -> DataFrame:
    late = F.when(F.col("p_size") % 4 == 0, "timeout").otherwise("ok")
    return t.part.select(F.col("p_partkey").cast("string").alias("blocked_id"), F.inline(F.array(F.struct(F.lit("x").alias("provider"), F.lit("ok").alias("outcome")), F.struct(F.lit("w").alias("provider"), late.alias("outcome")))))


_RAW = r"""n AS (SELECT p_partkey AS k, p_size AS s, p_size % 5 AS form, trim(regexp_replace(p_name, '[^a-z ]', '', 'g')) AS name FROM part),
r AS (SELECT *, CASE form WHEN 0 THEN 'A. Lee and B. Chen. "Studies in ' || name || '". Press, 1999.' WHEN 1 THEN 'A. Lee and B. Chen. \emph{Studies in {' || name || '}}. Press, 1999.' WHEN 2 THEN '[k] A. Lee and B. Chen. Studies in ' || name || '. Press 1999.'
WHEN 3 THEN 'A. Lee and B. Chen. "Studies in ' || name || '". Press, 1999; again 2001.' ELSE '\emph{Studies in ' || name || ', 1999.' END || CASE WHEN s % 7 = 0 THEN ' doi:10.1000/' || k ELSE '' END AS raw,
CASE form WHEN 1 THEN 'Studies in {' || name || '}' WHEN 4 THEN NULL ELSE 'Studies in ' || name END AS title FROM n)"""


@query(f"""WITH {_RAW} SELECT CAST(k AS VARCHAR) AS blocked_id, raw AS bibliography_text, title AS title_hint, CASE WHEN form = 4 THEN '' ELSE 'A. Lee;B. Chen' END AS authors, CASE WHEN form <> 3 THEN '1999' END AS year_hint,
CASE WHEN s % 7 = 0 THEN 'doi:10.1000/' || k ELSE '' END AS identifiers, CASE form WHEN 3 THEN 'conflicting_years' WHEN 4 THEN 'uncertain_title' ELSE '' END AS warnings FROM r""")
def reference_hints(t: Tables) -> DataFrame:
    rows = entries(t)
    out = references.hints(references.parsed(rows), rows)
    return out.select("blocked_id", "bibliography_text", "title_hint", F.array_join("author_hints", ";").alias("authors"), "year_hint", F.array_join(F.transform("identifier_hints", lambda i: i["identity"]), ";").alias("identifiers"), F.array_join("warnings", ";").alias("warnings"))


@query(rf"""WITH {_RAW}, f AS (SELECT k, raw, 'title' AS field, title AS value, CASE form WHEN 1 THEN '\emph{{' || title || '}}' WHEN 2 THEN title ELSE '"' || title || '"' END AS piece FROM r WHERE form <> 4
UNION ALL SELECT k, raw, 'authors', v, v FROM (SELECT k, raw, form, unnest(['A. Lee', 'B. Chen']) AS v FROM r) WHERE form <> 4 UNION ALL SELECT k, raw, 'year', v, v FROM (SELECT k, raw, form, unnest(['1999', '2001']) AS v FROM r) WHERE v = '1999' OR form = 3
UNION ALL SELECT k, raw, 'doi', 'doi:10.1000/' || k, 'doi:10.1000/' || k FROM r WHERE s % 7 = 0)
SELECT CAST(k AS VARCHAR) AS blocked_id, field, value, CAST(strpos(raw, piece) - 1 AS INTEGER) AS span_start, CAST(strpos(raw, piece) - 1 + length(piece) AS INTEGER) AS span_end FROM f""")
def reference_spans(t: Tables) -> DataFrame:
    return references.spans(references.parsed(entries(t))).select("blocked_id", "field", "value", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


#: g: the groups of each part (1: x and y, 2: z), with what speaks against them
_GROUPS = f"""{_RAW}, g AS (SELECT k, s, form, grp, grp = 1 AND s % 7 = 0 AS exact, form = 3 OR (grp = 2 AND s % 7 = 0) AS against, form = 3 OR (s % 21 = 0) AS any_against FROM r, (VALUES (1), (2)) AS v(grp) WHERE grp = 1 OR s % 3 = 0),
c AS (SELECT *, CASE WHEN against THEN 'conflict' WHEN exact THEN 'exact_identifier' WHEN form IN (0, 2) AND grp = 1 AND s % 2 = 0 THEN 'corroborated_metadata' WHEN form = 4 THEN 'insufficient_evidence' ELSE 'partial_match' END AS status FROM g)"""


def _assessed(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = entries(t)
    hints = references.hints(references.parsed(rows), rows)
    return hints, assessment.facts_of(hints, records(t))


@query(f"""WITH {_GROUPS} SELECT CAST(k AS VARCHAR) AS blocked_id, CASE WHEN grp = 1 AND s % 2 = 0 THEN 'x,y' WHEN grp = 1 THEN 'x' ELSE 'z' END AS providers, status AS identity_status,
CASE WHEN against THEN 'ambiguous' WHEN status IN ('exact_identifier', 'corroborated_metadata') THEN 'strong' WHEN status = 'partial_match' THEN 'plausible' ELSE 'weak' END AS confidence,
CAST(CASE WHEN exact THEN 8 ELSE 0 END + CASE form WHEN 1 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 1 ELSE 6 END AS DOUBLE) AS score,
CASE WHEN any_against THEN 'ambiguous_candidates' WHEN status NOT IN ('exact_identifier', 'corroborated_metadata') THEN 'insufficient_identity_evidence' WHEN NOT exact AND s % 4 = 0 THEN 'partial_provider_failure' END AS denied FROM c""")
def reference_candidates(t: Tables) -> DataFrame:
    _, facts = _assessed(t)
    return assessment.candidates(facts, answers(t)).select("blocked_id", F.array_join("providers", ",").alias("providers"), "identity_status", "confidence", "score", "denied")


@query(f"""WITH {_GROUPS} SELECT CAST(k AS VARCHAR) AS blocked_id, 'partial_provider_failure' AS kind, count(*) AS n FROM r WHERE s % 4 = 0 GROUP BY k
UNION ALL SELECT CAST(k AS VARCHAR), 'ambiguous_candidates', 1 FROM (SELECT DISTINCT k FROM c WHERE against)
UNION ALL SELECT CAST(k AS VARCHAR), kind, count(*) FROM (SELECT k, CASE WHEN against THEN 'identifier_conflict' WHEN grp = 2 THEN 'no_importable_source' WHEN status NOT IN ('exact_identifier', 'corroborated_metadata') THEN 'insufficient_metadata' END AS kind FROM c) WHERE kind IS NOT NULL GROUP BY k, kind""")
def reference_boundaries(t: Tables) -> DataFrame:
    hints, facts = _assessed(t)
    said = answers(t)
    return assessment.boundaries(hints, assessment.candidates(facts, said), said).groupBy("blocked_id", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH {_RAW}, f AS (SELECT k, s, form, grp, unnest(['title', 'authors', 'year']) AS field FROM r, (VALUES (1), (2)) AS v(grp) WHERE grp = 1 OR s % 3 = 0),
x AS (SELECT field, CASE WHEN form = 4 AND field <> 'year' OR form = 3 AND field = 'year' THEN 'missing_query' WHEN field = 'title' AND form = 1 THEN 'fuzzy' WHEN field = 'authors' AND grp = 1 AND s % 2 = 0 THEN 'normalized_equivalent' ELSE 'exact' END AS relation FROM f
UNION ALL SELECT 'identifiers', 'exact' FROM r WHERE s % 7 = 0) SELECT field, relation, count(*) AS n FROM x GROUP BY field, relation""")
def reference_fields(t: Tables) -> DataFrame:
    _, facts = _assessed(t)
    return assessment.fields(facts).groupBy("field", "relation").agg(F.count("*").alias("n"))
