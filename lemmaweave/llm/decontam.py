"""Benchmark decontamination by template canonicalisation.

Words of documents and items become templates: numbers, names (capitalised
words) and units after a number turn into typed placeholders, the rest is
lower-cased.  Windows of eight template words are hash-joined; the slots behind
the placeholders must map each value of the item to one value of the document and
back, which catches re-parameterised questions and drops accidental templates.  Each
alignment of item and document, each chain of neighbouring windows and the
document as a whole are judged by themselves, and one that agrees is enough: a
second variant elsewhere in the text hides nothing.  As many windows that are equal
word for word as a leak needs are a leak, whatever other windows say: slots are asked
only of windows whose values differ.

Beside the templates the same join finds windows by their words, with case
folded: copies in another case, and items so rich in values that few of their
templates are searched.  Around a window that was found, all windows of the
alignment count whose words are equal or stand for values of one type.

Defined results: null and blank texts have no windows; an item shorter than a
window is one window of its own length; an item without a window of enough
literal words is found by its words, not with other values in all its windows; repeated
doc_ids are judged by row content and reported once per (doc_id, item_id), and a leak takes
all rows of its doc_id; documents without an id are judged, and taken, by their text, and
are reported together under null; empty tables give an empty result.  Extra columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, spread_join

#: Units replaced after a number (fixed values).
UNITS = ("cent", "cents", "cm", "day", "days", "degrees", "dollar", "dollars", "euro", "euros", "feet", "foot", "g", "gram", "grams", "hour", "hours", "inch", "inches", "kg", "km", "litre", "litres", "m", "meter", "meters", "mile", "miles", "minute", "minutes", "ml", "mm", "month", "months", "percent", "pound", "pounds", "second", "seconds", "ton", "tons", "week", "weeks", "yard", "yards", "year", "years")
#: Placeholders: three private-use characters that texts lose beforehand.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
_PRIVATE = "[\ue000-\ue002]"
#: stands for a null doc_id inside this module
NO_ID = (1 << 63) - 1
_TOKENS = r"[^\p{L}\p{N}\x{E000}-\x{E002}]+"


@dataclass(frozen=True)
class Templates:
    window: int = 8
    #: windows of an item that must be found (all of it if it has fewer): 13 words in a row
    hits: int = 6
    #: words of a window that must not be placeholders, for its template to be searched
    literal: int = 5
    #: share of (slot value -> value) observations that must agree
    agreement: float = 1.0
    broadcast_rows: int = 200_000


def joined_numbers(text: Column) -> Column:
    """Digit groups lose their separators, so that a number is one word."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _PRIVATE, " "), r"(?<=\p{Nd})[.,](?=\p{Nd})", "")


def folded_words(base: Column) -> Column:
    return F.split(F.btrim(F.lower(F.regexp_replace(base, _TOKENS, " "))), " ")


def template_words(base: Column) -> Column:
    """As many words as folded_words gives, placeholders in place of values."""
    t = F.regexp_replace(base, r"(?<![\p{L}\p{N}])\p{Lu}[\p{Ll}]+(?![\p{L}\p{N}])", NAME)
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])\p{Nd}+(?![\p{L}\p{N}])", NUMBER)
    t = F.regexp_replace(t, f"(?<={NUMBER})([^\\p{{L}}\\p{{N}}{NUMBER}{NAME}]{{1,3}})(?:{'|'.join(UNITS)})(?![\\p{{L}}\\p{{N}}])", f"$1{UNIT}")
    return F.split(F.btrim(F.lower(F.regexp_replace(t, _TOKENS, " "))), " ")


def _fields(k: int) -> list[str]:
    return [f"w{i}" for i in range(k)] + [f"r{i}" for i in range(k)]


def _windows(words: Column, raw: Column, k: int, width: int) -> Column:
    """array<struct<k,at,w0..,r0..>>: shifted slices of the words' hashes zipped, the incomplete end cut off; null behind k words."""
    n = F.size(words)
    none = F.array_repeat(F.lit(None).cast("long"), n)
    zipped = [F.slice(x, F.lit(i + 1), F.greatest(n - i, F.lit(0))) if i < k else none for x in (words, raw) for i in range(width)]
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    zipped = F.arrays_zip(F.array_repeat(F.lit(k), n), numbers, *zipped)
    named = f"array<struct<k:int,at:int,{','.join(f'{f}:bigint' for f in _fields(width))}>>"
    return F.slice(zipped, F.lit(1), F.greatest(n - k + 1, F.lit(0))).cast(named)


def _hashed(df: DataFrame, width: int, name: str, literal: int = 0) -> DataFrame:
    """One row per window with k, its position and 64-bit hash: of its template, and of its words if they differ.

    Templates of fewer literal words are left out.  A word never equals a placeholder, so one column serves both.
    """
    words, raw = ([F.col(f"_x.{f}") for f in part] for part in (_fields(width)[:width], _fields(width)[width:]))
    values = [F.xxhash64(F.lit(x)) for x in (NUMBER, NAME, UNIT)]
    literals = sum((F.when(w.isNull() | w.isin(*values), 0).otherwise(1) for w in words), F.lit(0))
    # the outer form, since for the inner one the optimizer repeats the whole expression in a filter on its size
    rows = df.select("*", F.explode_outer(F.col("_win")).alias("_x")).drop("_win").where("_x is not null")
    rows = rows.withColumns({"_t": F.xxhash64("_x.k", *words), "_r": F.xxhash64("_x.k", *raw), "_some": literals >= F.least(F.lit(literal), F.col("_x.k")), "k": F.col("_x.k"), name: F.col("_x.at")}).drop("_x")
    both = F.when((F.col("_t") == F.col("_r")) | ~F.col("_some"), F.array("_r")).otherwise(F.array("_t", "_r"))
    return rows.withColumn("_h", F.explode_outer(both)).drop("_t", "_r", "_some")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, never null, _k, text of the rows that have a text."""
    return docs.where("text is not null").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("_k"), "text")


def window_hits(docs: DataFrame, items: DataFrame, settings: Templates) -> DataFrame:
    """doc_id, _k, item_id, item_at, doc_at, k: windows with equal templates or words.  items: item_id, words, raw, k.

    The texts are read once, whatever the lengths of the items.
    """
    s = settings
    lengths = [r[0] for r in items.select("k").distinct().orderBy("k").collect()]  # at most `window` values
    if not lengths:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, _k bigint, item_id bigint, item_at int, doc_at int, k int")
    width = max(lengths)
    windows = F.flatten(F.array(*[_windows(F.col("_words"), F.col("_raw"), k, width) for k in lengths]))
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    own = F.filter(windows, lambda x: x["k"] == F.col("k"))
    item_rows = items.select("item_id", "k", hashed("words").alias("_words"), hashed("raw").alias("_raw"))
    item_side, small = bounded_broadcast(cut(_hashed(item_rows.select("item_id", own.alias("_win")), width, "item_at", s.literal)), s.broadcast_rows)
    doc_rows = docs.select("doc_id", "_k", joined_numbers(F.col("text")).alias("_base"))
    doc_rows = doc_rows.withColumns({"_words": hashed(template_words(F.col("_base"))), "_raw": hashed(folded_words(F.col("_base")))})
    doc_rows = doc_rows.select("doc_id", "_k", windows.alias("_win"))
    rows = _hashed(doc_rows, width, "doc_at")
    if small:
        return rows.join(item_side, ["_h", "k"]).select("doc_id", "_k", "item_id", "item_at", "doc_at", "k")
    places = item_side.groupBy("_h", "k").agg(F.collect_list(F.struct("item_id", "item_at")).alias("_places"))
    found = spread_join(rows, places, ["_h", "k"], ["doc_id", "_k", "doc_at"], "inner")  # a window that all texts share is dealt
    return found.select("doc_id", "_k", "doc_at", "k", F.inline("_places")).select("doc_id", "_k", "item_id", "item_at", "doc_at", "k")


def aligned(hits: DataFrame, docs: DataFrame, items: DataFrame, settings: Templates) -> DataFrame:
    """doc_id, _k, item_id, item_at, doc_at, k, pairs, verbatim, searched: all equal windows of the alignments (doc_at - item_at) that
    have a hit.  pairs: of each word of the window whether the item has a slot there, the words of item and document, and whether
    their templates are equal.  searched: equal templates of enough literal words."""
    s = settings
    shifts = hits.select("doc_id", "_k", "item_id", "k", (F.col("doc_at") - F.col("item_at")).alias("_shift")).distinct()
    # only now the words behind the placeholders, of the documents found, once per document
    wanted, _ = bounded_broadcast(hits.select("doc_id", "_k").distinct(), s.broadcast_rows)
    texts = docs.join(wanted, ["doc_id", "_k"], "left_semi").dropDuplicates(["doc_id", "_k"])
    base = joined_numbers(F.col("text"))
    texts = texts.select("doc_id", "_k", template_words(base).alias("_words"), folded_words(base).alias("_raw"))
    rows = shifts.join(texts, ["doc_id", "_k"]).join(items.select("item_id", "words", "raw"), "item_id")
    there = lambda i: i + F.col("_shift")
    pair = lambda i: F.struct(F.get("words", i).isin(NUMBER, NAME, UNIT).alias("slot"), F.get("raw", i).alias("a"), F.get("_raw", there(i)).alias("b"), (F.get("words", i) == F.get("_words", there(i))).alias("t"))
    same = lambda i: F.when((F.get("words", i) == F.get("_words", there(i))) | (F.get("raw", i) == F.get("_raw", there(i))), "1").otherwise("0")
    positions = F.sequence(F.lit(0), F.size("words") - 1)
    rows = rows.select("doc_id", "_k", "item_id", "k", "_shift", F.transform(positions, pair).alias("_pairs"), F.array_join(F.transform(positions, same), "").alias("_same"))
    starts = F.filter(F.sequence(F.lit(0), F.length("_same") - F.col("k")), lambda i: F.substring("_same", i + 1, F.col("k")) == F.repeat(F.lit("1"), F.col("k")))
    rows = rows.select("*", F.explode_outer(starts).alias("item_at")).where("item_at is not null")
    rows = rows.select("doc_id", "_k", "item_id", "k", "item_at", (F.col("item_at") + F.col("_shift")).alias("doc_at"), F.slice("_pairs", F.col("item_at") + 1, F.col("k")).alias("pairs"))
    searched = F.forall("pairs", lambda p: p["t"]) & (F.size(F.filter("pairs", lambda p: ~p["slot"])) >= F.least(F.lit(s.literal), F.col("k")))
    return rows.withColumns({"verbatim": F.forall("pairs", lambda p: p["a"] == p["b"]), "searched": searched})


def grouped(rows: DataFrame) -> DataFrame:
    """rows once for each group in which they are judged: their alignment, their chain of neighbouring windows (which may
    drift by a window's length, as a longer name moves what follows), and all of the document; and once more with the searched
    templates alone, so that a window of few literal words takes nothing away."""
    key = ["doc_id", "_k", "item_id"]
    whole, ordered = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("doc_at", "item_at")
    shift = F.col("doc_at") - F.col("item_at")
    rows = rows.withColumns({"_shift": shift, "_one": F.min(shift).over(whole) == F.max(shift).over(whole), "_all": F.every("searched").over(whole)})
    follows = (F.col("item_at") > F.lag("item_at").over(ordered)) & (F.abs(F.col("_shift") - F.lag("_shift").over(ordered)) <= F.col("k"))
    rows = rows.withColumn("_chain", F.sum(F.when(follows, 0).otherwise(1)).over(ordered).cast("int"))
    group = lambda kind, number: F.struct(F.lit(kind).alias("kind"), number.cast("int").alias("number"))
    alone, zero = group("alignment", F.col("_shift")), F.lit(0)
    groups = F.when(F.col("_one"), F.array(alone)).otherwise(F.array(alone, group("chain", F.col("_chain")), group("document", zero)))
    strict = F.transform(groups, lambda g: F.struct(F.concat(g["kind"], F.lit(" templates")).alias("kind"), g["number"].alias("number")))
    groups = F.when(F.col("searched") & ~F.col("_all"), F.concat(groups, strict)).otherwise(groups)
    return rows.withColumn("_group", F.explode_outer(groups)).drop("_shift", "_one", "_chain", "_all")


def judged(docs: DataFrame, items: DataFrame, settings: Templates = Templates()) -> DataFrame:
    """doc_id, _k, item_id, x (n_hits, n_windows, n_slots, n_agree, leaked) of the group of hits that says most.  docs: of numbered()."""
    s = settings
    base = items.where("item_id is not null and text rlike '[\\\\p{L}\\\\p{N}]'").select("item_id", joined_numbers(F.col("text")).alias("base"))
    base = base.select("item_id", template_words(F.col("base")).alias("words"), folded_words(F.col("base")).alias("raw"))
    base = base.withColumn("k", F.least(F.size("words"), F.lit(s.window)))
    hits = cut(window_hits(docs, base, s))
    windows = F.size("words") - F.col("k") + 1
    literals = lambda i: F.size(F.filter(F.slice("words", i + 1, F.col("k")), lambda w: ~w.isin(NUMBER, NAME, UNIT)))
    few = F.size(F.filter(F.sequence(F.lit(0), windows - 1), lambda i: literals(i) < F.least(F.lit(s.literal), F.col("k"))))
    sizes = base.groupBy("item_id").agg(F.max(windows).cast("long").alias("n_windows"), F.max(few).alias("_few"))
    need = F.least(F.lit(s.hits).cast("long"), F.col("n_windows"))
    enough = hits.groupBy("doc_id", "_k", "item_id").agg(F.countDistinct("item_at").alias("n_hits")).join(sizes, "item_id")
    # templates with few literal words are not searched, but compared where another window of the item was found
    enough = cut(enough.where(F.col("n_hits") + F.col("_few") >= need).select("doc_id", "_k", "item_id"))
    rows = grouped(aligned(hits.join(enough, ["doc_id", "_k", "item_id"], "left_semi"), docs, base, s))
    key = ["doc_id", "_k", "item_id", "_group"]
    counts = rows.groupBy(*key).agg(F.countDistinct("item_at").alias("n_hits"), F.countDistinct(F.when(F.col("verbatim"), F.col("item_at"))).alias("_verbatim"))
    votes = rows.where("not verbatim").select(*key, F.explode_outer("pairs").alias("_p")).groupBy(*key, "_p.slot", "_p.a", "_p.b").agg(F.count("*").alias("_n"))
    # one value of the item is one value of the document, and the other way round
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("v")), F.struct(F.lit(1).alias("side"), F.col("b").alias("v")))
    votes = votes.select(*key, "slot", "_n", F.explode(sides).alias("_v")).groupBy(*key, "slot", "_v.side", "_v.v").agg(F.max("_n").alias("_top"), F.sum("_n").alias("_n"))
    votes = votes.groupBy(*key, "side").agg(F.sum("_n").alias("_n"), F.sum("_top").alias("_top"))
    votes = votes.groupBy(*key).agg(F.max("_n").alias("n_slots"), F.min("_top").alias("n_agree"))
    # a group of windows that are all equal word for word has no votes
    out = counts.join(sizes, "item_id").where(F.col("n_hits") >= need).join(votes, key, "left").fillna(0, ["n_slots", "n_agree"])
    out = out.withColumn("leaked", (F.col("_verbatim") >= need) | (F.col("n_agree") >= s.agreement * F.col("n_slots")))
    best = F.max_by(F.struct("n_hits", "n_windows", "n_slots", "n_agree", "leaked"), F.struct("leaked", "n_hits", "n_agree", -F.col("n_slots"), "_group")).alias("x")
    return out.groupBy("doc_id", "_k", "item_id").agg(best)


def matches(docs: DataFrame, items: DataFrame, settings: Templates = Templates()) -> DataFrame:
    """doc_id, item_id, n_hits (item windows found), n_windows, n_slots, n_agree, leaked: of the text and group of hits that says most."""
    best = F.max_by("x", F.struct("x.leaked", "x.n_hits", "x.n_agree", -F.col("x.n_slots"), "_k")).alias("x")
    out = judged(numbered(docs), items, settings).groupBy("doc_id", "item_id").agg(best)
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "item_id", "x.*")


def clean(docs: DataFrame, items: DataFrame, settings: Templates = Templates()) -> DataFrame:
    """Documents that leak no item."""
    by_text = F.when(F.col("_d") == NO_ID, F.col("_k")).otherwise(0)
    leaks = judged(numbered(docs), items, settings).where("x.leaked").select(F.col("doc_id").alias("_d"), "_k")
    leaks = leaks.select("_d", by_text.alias("_t")).distinct()
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_d"), F.xxhash64("text").alias("_k"), F.struct(*docs.columns).alias("_row"))
    return rows.select("*", by_text.alias("_t")).join(leaks, ["_d", "_t"], "left_anti").select("_row.*")
