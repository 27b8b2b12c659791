"""Scholarly records from provider answers, as column expressions over raw JSON rows.

answers: blocked_id, provider, status (HTTP code or null), body.  How to fetch is a
matter of the caller: fetched() calls the given function for each request, in the
partition of the request; nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF = ("struct<message:struct<items:array<struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string,name:string>>,"
            f"`published-print`:{_DATE},`published-online`:{_DATE},published:{_DATE},issued:{_DATE},`container-title`:array<string>,URL:string>>>>")
OPENALEX = "struct<results:array<struct<doi:string,title:string,authorships:array<struct<author:struct<display_name:string>>>,publication_year:int,is_retracted:boolean,ids:struct<arxiv:string>,locations:array<struct<landing_page_url:string>>>>>"
ATOM = "struct<entry:array<struct<id:string,title:string,published:string,author:array<struct<name:string>>>>,_bad:string>"
RECORD = ["blocked_id", "provider", "outcome", "title", "authors", "year", "doi", "arxiv_id", "is_retracted"]


def outcome(status: Column, parsed: Column, n: Column) -> Column:
    return (
        F.when(status.isNull(), "timeout").when(status == 429, "rate_limited").when(status >= 500, "unavailable")
        .when((status != 200) | parsed.isNull() | n.isNull(), "invalid_response").when(n == 0, "empty").otherwise("ok")
    )


def _records(answers: DataFrame, schema: str, items: str) -> DataFrame:
    rows = answers.withColumn("_p", F.from_json("body", schema, {"mode": "PERMISSIVE"}))
    n = F.when(F.col(items).isNotNull(), F.size(items))
    return rows.select("blocked_id", "provider", outcome(F.col("status"), F.col("_p"), n).alias("outcome"), F.explode_outer(items).alias("r"))


def _bare_doi(doi: Column) -> Column:
    return F.lower(F.regexp_replace(doi, r"(?i)^https?://(dx\.)?doi\.org/", ""))


def crossref(answers: DataFrame) -> DataFrame:
    year = lambda c: F.get(F.get(F.col(f"r.{c}.date-parts" if "-" not in c else f"r.`{c}`.`date-parts`"), F.lit(0)), F.lit(0))
    first = F.coalesce(year("published-print"), year("published-online"), F.get(F.get(F.col("r.published.`date-parts`"), F.lit(0)), F.lit(0)), F.get(F.get(F.col("r.issued.`date-parts`"), F.lit(0)), F.lit(0)))
    people = F.transform("r.author", lambda a: F.coalesce(a["name"], F.concat_ws(" ", a["given"], a["family"])))
    return _records(answers, CROSSREF, "_p.message.items").select("blocked_id", "provider", "outcome", F.get("r.title", F.lit(0)).alias("title"), people.alias("authors"), first.cast("string").alias("year"), _bare_doi(F.col("r.DOI")).alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.lit(None).cast("boolean").alias("is_retracted"))


def openalex(answers: DataFrame) -> DataFrame:
    page = F.element_at(F.filter(F.transform("r.locations", lambda x: F.regexp_extract(x["landing_page_url"], r"arxiv\.org/abs/([^?#]+)", 1)), lambda x: x != ""), 1)
    page = F.when(F.size(F.filter("r.locations", lambda x: x["landing_page_url"].rlike(r"arxiv\.org/abs/."))) > 0, page)
    people = F.transform("r.authorships", lambda a: a["author"]["display_name"])
    return _records(answers, OPENALEX, "_p.results").select("blocked_id", "provider", "outcome", "r.title", people.alias("authors"), F.col("r.publication_year").cast("string").alias("year"), _bare_doi(F.col("r.doi")).alias("doi"), F.coalesce("r.ids.arxiv", page).alias("arxiv_id"), "r.is_retracted")


#: Where a feed begins, and the address of a work with its version (fixed values).
FEED, WORK = r"^\s*(<\?[^>]*\?>\s*|<!--(?s:.*?)-->\s*)*<feed\b[^>]*http://www\.w3\.org/2005/Atom", r"(?i)^https?://(?:www\.|export\.)?arxiv\.org/abs/((?:\d{4}\.\d{4,5}|[a-z][a-z0-9.-]*/\d{7})(?:v[1-9]\d*)?)$"


def arxiv(answers: DataFrame) -> DataFrame:
    """Records of Atom feeds; the id keeps its version.  A feed with some unreadable entries is partial and gives the others."""
    rows = answers.withColumn("_p", F.from_xml("body", ATOM, {"columnNameOfCorruptRecord": "_bad"}))
    entries = F.coalesce("_p.entry", F.array().cast("array<struct<id:string,title:string,published:string,author:array<struct<name:string>>>>"))
    named = F.transform(entries, lambda e: F.struct(F.lower(F.regexp_extract(F.trim(e["id"]), WORK, 1)).alias("arxiv_id"), e["title"].alias("title"), e["published"].alias("published"), e["author"]["name"].alias("authors")))
    good = F.filter(named, lambda e: F.coalesce(e["arxiv_id"] != "", F.lit(False)))
    parsed = F.when(F.col("body").rlike(FEED) & F.col("_p").isNotNull() & F.col("_p._bad").isNull(), F.col("_p"))
    state = outcome(F.col("status"), parsed, F.size(entries))
    missing = F.size(good) < F.size(entries)
    state = F.when((state == "ok") & missing, F.when(F.size(good) > 0, "partial").otherwise("invalid_response")).otherwise(state)
    rows = rows.select("blocked_id", "provider", state.alias("outcome"), F.explode_outer(F.when(state.isin("ok", "partial"), good)).alias("r"))
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    year = F.when(F.col("r.published").rlike(r"^\d{4}"), F.substring("r.published", 1, 4))
    none = lambda kind: F.lit(None).cast(kind)
    people = F.filter(F.transform("r.authors", flat), lambda a: a != "")
    return rows.select("blocked_id", "provider", "outcome", flat(F.col("r.title")).alias("title"), people.alias("authors"), year.alias("year"), none("string").alias("doi"), "r.arxiv_id", none("boolean").alias("is_retracted"))


#: Addresses of searches; the sought text goes behind them (fixed values).
SEARCH = {"crossref": "https://api.crossref.org/works?rows=5&query.bibliographic=", "openalex": "https://api.openalex.org/works?per_page=5&search=",
          "arxiv": "https://export.arxiv.org/api/query?start=0&max_results=5&sortBy=relevance&search_query="}
READERS = {"crossref": crossref, "openalex": openalex, "arxiv": arxiv}


def requests(hint: DataFrame, providers: tuple[str, ...] = tuple(SEARCH)) -> DataFrame:
    """blocked_id, provider, url: a row for each hint (blocked_id, title_hint, bibliography_text) and provider."""
    text = F.coalesce(F.when(F.col("title_hint") != "", F.col("title_hint")), F.col("bibliography_text"), F.lit(""))
    quoted = F.when(text == "", "all:*").otherwise(F.concat(F.lit('all:"'), text, F.lit('"')))
    urls = [F.struct(F.lit(p).alias("provider"), F.concat(F.lit(SEARCH[p]), F.url_encode(quoted if p == "arxiv" else text)).alias("url")) for p in providers]
    return hint.select("blocked_id", F.inline(F.array(*urls)))


def fetched(wanted: DataFrame, fetch: Callable[[str], tuple[int, str]]) -> DataFrame:
    """Answers of all requests; a fetch that times out has no status, one that fails otherwise has 503.  Texts of errors are not kept."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for url in batch["url"]:
                try:
                    got.append(fetch(url))
                except TimeoutError:
                    got.append((None, None))
                except Exception:  # noqa: BLE001 - whatever a client raises is a failure row, not the end of the scan
                    got.append((503, None))
            yield batch[["blocked_id", "provider"]].assign(status=pd.array([g[0] for g in got], "Int32"), body=[g[1] for g in got])

    return wanted.mapInPandas(rows, "blocked_id string, provider string, status int, body string")


def records(answers: DataFrame) -> DataFrame:
    """Records of all known providers in one shape; each answer without a record stays as a row with its outcome."""
    out = None
    for name, read in READERS.items():
        rows = read(answers.where(F.col("provider") == name)).select(RECORD)
        out = rows if out is None else out.unionByName(rows)
    return out
