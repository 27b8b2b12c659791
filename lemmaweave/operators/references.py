"""Hints of blocked references: where titles, people, years and identifiers stand in their texts, and what is doubtful.

Every text is cut by column expressions whose positions are kept, so each hint is a span of characters in the raw text
(code points from 0, end exclusive).  What cannot be told stays open and is named by a warning.

Defined results: null, empty and blank texts give no span; repeated rows say the same once more and change nothing;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from . import search

#: How entries are written (fixed values): the label before an entry, DOI and arXiv identifiers, a year, a title in
#: quotes, the start of a title as a command, the end of a sentence (not behind a lone initial), the joints of authors.
LABEL = r"^\s*\[[^\]]+\]\s*"
IDENTIFIERS = (
    r'https?://(?:dx\.)?doi\.org/[^\s<>"{}]+', r'(?:doi:\s*)?10\.\d{4,9}/[^\s<>"{}]+',
    r'https?://(?:www\.|export\.)?arxiv\.org/(?:abs|pdf)/[^\s<>"{}]+', r"arxiv:\s*(?:\d{4}\.\d{4,5}|[a-z.-]+/\d{7})(?:v\d+)?",
)
YEAR, YEAR_IN_BRACKETS = r"(?U)\b(?:18|19|20)[0-9]{2}\b", r"(?U)\(?\b(?:18|19|20)[0-9]{2}\b\)?"
QUOTED, COMMAND, SENTENCE = r'["“][^"”]+["”]', r"\\(?:emph|textit|textbf)\s*\{", r"(?U)(?<!\b\w)\.\s+"
JOINTS = r"\s+and\s+|;\s*|,\s*(?=\p{L}\.)"
#: Warnings (fixed values) that take a hint away.
TITLES, YEARS, PEOPLE, UNCERTAIN = "conflicting_titles", "conflicting_years", "conflicting_authors", "uncertain_title"

SPAN = "struct<start:int,end:int,value:string>"
IDENTIFIER = "struct<kind:string,raw:string,canonical:string,identity:string,version:string,valid:boolean,exact_eligible:boolean,warnings:array<string>>"


def identified(value: Column, kind: Column, version: Column) -> Column:
    """The identifier as a struct of its parts; null for null."""
    names = [part.split(":")[0] for part in IDENTIFIER[7:-1].split(",")]

    @F.pandas_udf(IDENTIFIER)
    def parsed(v: pd.Series, k: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [identity.identifier(a, b, c) if a is not None else dict.fromkeys(names) for a, b, c in zip(v, k, n, strict=True)]
        return pd.DataFrame(rows, columns=names, dtype=object)

    return F.when(value.isNotNull(), parsed(value, kind, version))


def _span(start: Column, end: Column, value: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"))


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches: what lies between them gives their places."""
    pairs = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        return F.struct(F.coalesce(end, start).alias("at"), F.when(pair["hit"].isNotNull(), F.concat(done["out"], F.array(_span(start, end, pair["hit"])))).otherwise(done["out"]).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), step, lambda done: done["out"])


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed and planned once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def pieces(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of what lies between the matches."""
    def between(marks: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(marks, lambda m: m["end"]))
        ends = F.concat(F.transform(marks, lambda m: m["start"]), F.array(F.length(text)))
        return F.zip_with(starts, ends, lambda a, b: _span(a, b, _cut(text, a, b)))

    return _with(occurrences(text, pattern), between)


def stripped(piece: Column, characters: str) -> Column:
    """The span without some characters at its ends."""
    left = piece["start"] + F.length(piece["value"]) - F.length(F.regexp_replace(piece["value"], f"^[{characters}]+", ""))
    value = F.regexp_replace(piece["value"], f"^[{characters}]+|[{characters}]+$", "")
    return _with(F.struct(left.alias("left"), value.alias("value")), lambda x: _span(x["left"], x["left"] + F.length(x["value"]), x["value"]))


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of spans, so that all other places stay."""
    return F.aggregate(spans, text, lambda t, s: F.concat(_cut(t, F.lit(0), s["start"]), F.repeat(F.lit(" "), s["end"] - s["start"]), F.substring(t, s["end"] + 1, F.length(t))))


def people(text: Column) -> Column:
    """Spans of authors in what stands before a title: names of two words or more; none where it is no plain list."""
    def listed(whole: Column) -> Column:
        names = F.transform(pieces(whole["value"], JOINTS), lambda p: stripped(p, r"\s,;"))
        names = F.filter(names, lambda n: n["value"].rlike(r"\S\s+\S"))
        names = F.transform(names, lambda n: _span(n["start"] + whole["start"], n["end"] + whole["start"], n["value"]))
        return F.when(whole["value"].rlike(r'[\\{}:"]'), F.array().cast(f"array<{SPAN}>")).otherwise(names)

    bare = blanked(text, occurrences(text, YEAR_IN_BRACKETS))
    return _with(_with(bare, lambda t: stripped(_span(F.lit(0), F.length(t), t), r"\s.,;:")), listed)


def _commands(text: Column) -> Column:
    """Titles in commands, each with its end where its brace closes; end is null where it never does."""
    def closed(mark: Column, braces: Column) -> Column:
        opened = F.filter(braces, lambda b: b["start"] >= mark["end"] - 1)
        start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"))
        depth = lambda d, b: d["depth"] + F.when(b["value"] == "{", 1).otherwise(-1)
        end = F.aggregate(opened, start, lambda d, b: F.when(d["end"].isNotNull(), d).otherwise(F.struct(depth(d, b).alias("depth"), F.when(depth(d, b) == 0, b["end"]).alias("end"))), lambda d: d["end"])
        return _with(end, lambda e: _span(mark["start"], e, _cut(text, mark["end"], e - 1)))

    return _with(occurrences(text, r"[{}]"), lambda braces: F.transform(occurrences(text, COMMAND), lambda mark: closed(mark, braces)))


def _ruled(spans: Column, rule: str, confidence: str = "explicit") -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence")))


def parsed(blocked: DataFrame) -> DataFrame:
    """blocked_id, ord, evidence_id, entry (is it a bibliography entry), raw_text and the spans: ids, titles, malformed, title (if certain), authors, years.

    blocked: blocked_id, ord, kind, evidence_id, raw_text.
    """
    rows = blocked.where(F.trim("raw_text") != "").select("blocked_id", "ord", "evidence_id", "raw_text", F.coalesce(F.col("kind") == "bibliography_entry", F.lit(False)).alias("entry"))
    rows = rows.repartition("blocked_id", "ord", "evidence_id")  # a small file may hold very many texts
    text = F.col("_text")
    rows = rows.withColumn("_text", blanked(F.col("raw_text"), occurrences(F.col("raw_text"), LABEL)))
    rows = rows.withColumn("ids", occurrences(text, "(?i)" + "|".join(IDENTIFIERS)))
    rows = rows.withColumn("_text", blanked(text, F.col("ids"))).withColumn("_commands", _commands(text))
    quoted = F.transform(occurrences(text, QUOTED), lambda s: _span(s["start"], s["end"], F.substring(s["value"], F.lit(2), F.length(s["value"]) - 2)))
    said = F.concat(_ruled(quoted, "quoted_title"), _ruled(F.filter("_commands", lambda s: s["end"].isNotNull()), "tex_title"))
    rows = rows.withColumns({"_said": said, "malformed": F.exists("_commands", lambda s: s["end"].isNull()), "_parts": F.transform(pieces(text, SENTENCE), lambda p: stripped(p, r"\s"))})
    # three sentences, of which the first names people and the third or a later one has a year: the second is the title
    first, second = F.get("_parts", F.lit(0)), F.get("_parts", F.lit(1))
    dated = F.exists(F.slice("_parts", 3, F.greatest(F.size("_parts") - 2, F.lit(1))), lambda p: p["value"].rlike(YEAR))
    guessed = (F.size("_said") == 0) & ~F.col("malformed") & (F.size("_parts") >= 3) & (F.size(people(F.coalesce(first["value"], F.lit("")))) > 0) & dated & ~second["value"].rlike(YEAR) & (second["end"] > second["start"])
    titles = F.when(~F.col("entry"), F.array().cast("array<struct<start:int,end:int,value:string,rule:string,confidence:string>>")).when(F.coalesce(guessed, F.lit(False)), _ruled(F.array(second), "delimited_title", "heuristic")).otherwise(F.col("_said"))
    rows = rows.withColumn("titles", titles)
    certain = ~F.col("malformed") & (F.size(F.array_distinct(F.transform("titles", lambda s: s["value"]))) == 1)
    rows = rows.withColumn("title", F.when(certain, F.get("titles", F.lit(0))))
    before = F.when(F.col("title").isNotNull(), people(_cut(text, F.lit(0), F.col("title.start"))))
    rest = F.when(F.col("title").isNotNull(), blanked(text, F.array("title"))).otherwise(text)
    rows = rows.withColumns({"authors": F.coalesce(before, F.array().cast(f"array<{SPAN}>")), "years": F.when(F.col("entry"), occurrences(rest, YEAR)).otherwise(F.array().cast(f"array<{SPAN}>"))})
    return rows.select("blocked_id", "ord", "evidence_id", "entry", "raw_text", "ids", "titles", "malformed", "title", "authors", "years")


def _kind(value: Column) -> Column:
    return F.when(F.lower(value).contains("arxiv"), "arxiv").otherwise("doi")


def _identifier_text(value: Column) -> Column:
    """As the parser of identifiers takes it: no blank behind the prefix."""
    return F.regexp_replace(F.trim(value), r"(?i)^arxiv:\s*", "arxiv:")


def spans(rows: DataFrame) -> DataFrame:
    """blocked_id, evidence_id, field, start, end, value, rule, confidence of everything that parsed rows hold."""
    def found(name: str, field: Callable[[Column], Column], rule: str, confidence: str) -> Column:
        return F.transform(name, lambda s: F.struct(field(s["value"]).alias("field"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence")))

    titles = F.transform("titles", lambda s: F.struct(F.lit("title").alias("field"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["rule"].alias("rule"), s["confidence"].alias("confidence")))
    every = F.concat(found("ids", _kind, "explicit_identifier", "explicit"), titles, found("authors", lambda _: F.lit("authors"), "author_prefix", "heuristic"), found("years", lambda _: F.lit("year"), "year_token", "heuristic"))
    return rows.select("blocked_id", "evidence_id", F.inline(every))


def hints(rows: DataFrame, blocked: DataFrame) -> DataFrame:
    """blocked_id, citation_keys, citation_texts, bibliography_text, title_hint, author_hints, year_hint, identifier_hints, warnings.

    rows: what parsed(blocked) gives.  Where several entries disagree the hint is null (or empty) and a warning says so.
    """
    names = F.transform("authors", lambda s: s["value"])
    people_of = F.when(F.size(names) > 0, names)
    value, years = F.when(F.col("title").isNotNull(), F.col("title.value")), F.transform("years", lambda s: s["value"])
    differ = lambda c: F.min(c) != F.max(c)
    per = rows.groupBy("blocked_id").agg(
        F.min_by(value, F.when(value.isNotNull(), F.struct("ord", "evidence_id"))).alias("_title"), differ(value).alias("_other_title"),
        F.max(F.col("entry") & (F.col("malformed") | F.col("title").isNull())).alias("_unsure"), F.max(F.size(F.array_distinct(F.transform("titles", lambda s: s["value"]))) > 1).alias("_several"),
        F.min_by(people_of, F.when(people_of.isNotNull(), F.struct("ord", "evidence_id"))).alias("_people"), differ(people_of).alias("_other_people"),
        F.min(F.array_min(years)).alias("_year"), F.max(F.array_max(years)).alias("_last_year"))
    per = per.fillna(False, ["_other_title", "_unsure", "_several", "_other_people"])
    flags = {TITLES: F.col("_several") | F.col("_other_title"), UNCERTAIN: F.col("_unsure") | F.col("_other_title"), YEARS: F.col("_year") != F.col("_last_year"), PEOPLE: F.col("_other_people")}
    per = per.withColumn("warnings", F.array_sort(F.array_compact(F.array(*[F.when(holds, name) for name, holds in flags.items()]))))
    off = lambda name: F.array_contains("warnings", name)
    none = F.array().cast("array<string>")
    per = per.select("blocked_id", F.when(~off(UNCERTAIN), F.col("_title")).alias("title_hint"), F.when(off(PEOPLE), none).otherwise(F.coalesce("_people", none)).alias("author_hints"), F.when(~off(YEARS), F.col("_year")).alias("year_hint"), "warnings")
    # outer: else the engine cuts all texts once more, before they are dealt, to see which have identifiers
    ids = rows.select("blocked_id", F.explode_outer("ids").alias("s")).where("s is not null").select("blocked_id", _identifier_text(F.col("s.value")).alias("v")).distinct()
    ids = ids.withColumn("i", identified(F.col("v"), _kind(F.col("v")), F.lit(None).cast("string"))).groupBy("blocked_id").agg(F.array_sort(F.collect_set("i")).alias("identifier_hints"))
    texts = search.hints(blocked).select("blocked_id", "citation_keys", "citation_texts", "bibliography_text")
    out = texts.join(per.hint("merge"), "blocked_id", "left").join(ids.hint("merge"), "blocked_id", "left")  # the engine guesses their size too low
    return out.withColumns({"author_hints": F.coalesce("author_hints", none), "warnings": F.coalesce("warnings", none), "identifier_hints": F.coalesce("identifier_hints", F.array().cast(f"array<{IDENTIFIER}>"))})
