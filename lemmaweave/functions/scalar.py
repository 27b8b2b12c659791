"""Scalar functions of the evidence model, as column expressions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(text: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def excerpt(text: Column, limit: int = 240) -> Column:
    """Collapsed text of at most limit characters; a cut one ends in three dots within the limit."""
    flat = collapsed(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def slug(text: Column) -> Column:
    """Lower-case letters, digits, dots, underscores and dashes; other runs become one dash."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "item").otherwise(s)


def locator(*parts: Column) -> Column:
    """Content-addressed name of a source block."""
    return F.concat(F.lit("source-block:"), F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256))


def global_id(paper_id: Column, local_id: Column) -> Column:
    return F.concat(paper_id, F.lit("::"), local_id)


def paper_of(global_id_: Column) -> Column:
    """The part before the first separator."""
    return F.split(global_id_, "::", 2).getItem(0)


def focus_match(haystack: Column, focus: Column) -> Column:
    """Every word of focus of three letters or more occurs in the haystack."""
    tokens = F.filter(F.split(F.lower(focus), r"\s+"), lambda t: F.length(t) >= 3)
    return F.forall(tokens, lambda t: F.instr(F.lower(haystack), t) > 0)


#: Words that titles are compared without (fixed values).
TITLE_STOPS = ("a", "an", "and", "by", "in", "of", "on", "the")


def title_words(title: Column) -> Column:
    """Lower-case letters and digits in words, without stop words; order and repeats stay."""
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(F.filter(words, lambda w: ~w.isin(*TITLE_STOPS)), " ")


def preview(text: Column, limit: int = 160) -> Column:
    """As excerpt, but without a blank before the dots."""
    flat = collapsed(text)
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))).otherwise(flat)


def time_slug(at: Column) -> Column:
    """A UTC time in letters and digits only."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def display_label(label: Column, kind: Column, number: Column, identifier: Column) -> Column:
    """What a reader sees: the label, else kind and number, else the id."""
    return F.coalesce(label, F.concat(kind, F.lit(" "), number), identifier)


def similarity(a: Column, b: Column) -> Column:
    """Share of matching blocks of two strings (twice the matches over both lengths)."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else 1.0 if u == v else SequenceMatcher(None, u, v).ratio() for u, v in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)
