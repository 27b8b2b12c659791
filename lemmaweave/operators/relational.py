"""Relational operators of the evidence model: DataFrame in, DataFrame out, nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def page(df: DataFrame, order: Sequence, limit: int, offset: int = 0) -> DataFrame:
    """Offset pagination on a total order; limits are 1 to 100."""
    if isinstance(limit, bool) or not 1 <= limit <= 100 or isinstance(offset, bool) or offset < 0:
        raise ValueError("limit must be 1..100 and offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def substring_search(df: DataFrame, title: Column, content: Column, needle: str) -> DataFrame:
    """Rows whose title or content holds the needle, letters of either case alike, with an excerpt."""
    hay = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))))
    return df.where(F.instr(hay, needle.lower()) > 0).withColumn("excerpt", F.substring(content, 1, 240))


def tristate(mentions: DataFrame, key: str, targets: DataFrame, target_id: str) -> DataFrame:
    """Mentions with target and status: one target resolves, several are ambiguous, none stays visible as unresolved."""
    found = targets.groupBy(key).agg(F.count("*").alias("_n"), F.min(target_id).alias("_t"))
    out = mentions.join(found, key, "left")
    status = F.when(F.col("_n") == 1, "resolved_unique").when(F.col("_n") > 1, "ambiguous").otherwise("unresolved")
    return out.withColumn("resolution_status", status).withColumn("target", F.when(F.col("_n") == 1, F.col("_t"))).drop("_n", "_t")


def zero_filled_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, Column | None]]) -> DataFrame:
    """Counts of each child table by parent key, 0 where there is none; a condition counts only matching rows."""
    out = parents
    for name, (child, child_key, condition) in children.items():
        n = F.count("*") if condition is None else F.count_if(condition)
        out = out.join(child.groupBy(F.col(child_key).alias(key)).agg(n.alias(name)), key, "left")
    return out.fillna(0, list(children))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def around(df: DataFrame, keys: Sequence[str], order: Sequence, anchor: Column, context: int) -> DataFrame:
    """Rows within `context` places of the anchors of their group, with the role before, anchor or after."""
    if isinstance(context, bool) or not 0 <= context <= 5:
        raise ValueError("context must be 0..5")
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_a", anchor)
    lo, hi = (f(F.when(F.col("_a"), F.col("_n"))).over(w) for f in (F.min, F.max))
    rows = rows.withColumns({"_lo": lo, "_hi": hi}).where(F.col("_n").between(F.col("_lo") - context, F.col("_hi") + context))
    role = F.when(F.col("_n") < F.col("_lo"), "before").when(F.col("_n") > F.col("_hi"), "after").otherwise("anchor")
    return rows.withColumn("role_in_slice", role).drop("_n", "_a", "_lo", "_hi")


def unresolved(refs: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    return refs.join(targets, on, "left_anti")


def listed(links: DataFrame, key: str, position: str, sep: str = ",") -> DataFrame:
    """Positions of the links of each key, in order, as one text."""
    return links.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(position)).cast("array<string>"), sep).alias(f"{position}s"))


def first_child(parents: DataFrame, children: DataFrame, key: str, order: Sequence, columns: dict[str, str]) -> DataFrame:
    """Parents with the named columns of their first child, null where there is none."""
    first = first_wins(children, [key], order).select(key, *[F.col(c).alias(n) for c, n in columns.items()])
    return parents.join(first, key, "left")


def groups(rows: DataFrame, key: str, member: str) -> DataFrame:
    """key, group_id (a hash of the key), n, members: what shares a key, as one item to decide on."""
    members = F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ",")
    return rows.groupBy(key).agg(F.count("*").alias("n"), members.alias("members")).withColumn("group_id", F.sha2(F.col(key).cast("string"), 256))


def chosen_version(rows: DataFrame, work: str, version: str) -> DataFrame:
    """work, chosen (the last version as text), conflicting (there are several), n."""
    return rows.groupBy(work).agg(F.max(version).alias("chosen"), (F.countDistinct(version) > 1).alias("conflicting"), F.count("*").alias("n"))


def distinct_count(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.agg(F.countDistinct(*keys).alias("n"))


def first_texts(rows: DataFrame, key: str, text: str, order: str, k: int = 5, width: int = 160, sep: str = "|") -> DataFrame:
    """key, texts: the first k different texts of each key, cut to a width."""
    once = rows.groupBy(key, text).agg(F.min(order).alias("_f"))
    best = top_k(once, [key], ["_f"], k).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_f", text))).alias("_s"))
    return best.select(key, F.array_join(F.transform("_s", lambda x: F.substring(x[text], 1, width)), sep).alias("texts"))


def following(rows: DataFrame, key: str, order: str, steps: int, name: str) -> DataFrame:
    """Each row with the order value that lies some steps ahead, null at the end."""
    return rows.withColumn(name, F.lead(order, steps).over(Window.partitionBy(key).orderBy(order)))


def owner_before(rows: DataFrame, key: str, order: str, is_owner: Column, name: str) -> DataFrame:
    """Each row with the order value of the last owner before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(is_owner, F.col(order)), ignorenulls=True).over(w))


def chain(rows: DataFrame, steps: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """rows joined to a chain of parents: (table, child key, parent key) from the nearest to the farthest."""
    for table, child, parent in steps:
        rows = rows.join(table, rows[child] == table[parent])
    return rows


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """Adds rank, from 1, in the order of a unique key: ranges are sorted each by itself and begin behind those before."""
    dealt = checkpointed(rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return dealt.join(F.broadcast(before), "_part").withColumn("rank", own + F.col("_before")).drop("_part", "_before")


def running_max(rows: DataFrame, keys: list[str], time: str, value: str, span: str = "hour") -> DataFrame:
    """Adds running: the greatest non-null value of all rows of the keys up to this one's time, equal times included.

    Spans of time are taken each by itself and begin with the greatest value before them, so a key with very many
    rows is not sorted in one task.
    """
    rows = rows.withColumn("_bucket", F.coalesce(F.date_trunc(span, time).cast("string"), F.lit("")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(time).rangeBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*keys, "_bucket").agg(F.max(value).alias("_max"))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_bucket", F.max("_max").over(ahead).alias("_before"))
    found = rows.withColumn("_inside", F.max(value).over(inside)).join(before, [*keys, "_bucket"], "left")
    return found.withColumn("running", F.greatest("_before", "_inside")).drop("_bucket", "_before", "_inside")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """Pairs of left(start, end) and right(seg_start, seg_end) with equal keys and a common stretch; ends are exclusive.

    Both are cut into bins of a width and meet by keys and bin; a pair counts in the first bin they share.  So a long
    source is dealt by its bins, and spans meet only what is near them.
    """
    bins = lambda lo, hi: F.sequence(F.floor(F.col(lo) / width), F.floor((F.greatest(F.col(hi) - 1, F.col(lo))) / width))
    a = left.withColumn("_bin", F.explode(bins("start", "end")))
    b = right.withColumn("_bin", F.explode(bins("seg_start", "seg_end")))
    first = F.floor(F.greatest("start", "seg_start") / width)
    return a.join(b, [*keys, "_bin"]).where((F.col("_bin") == first) & (F.greatest("start", "seg_start") < F.least("end", "seg_end"))).drop("_bin")


#: Most pieces, and most characters, by which a needle is looked up before the exact test.
PIECES, FRONT = 3, 24


def containment(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """All pairs of rows of texts(text, ...) and needles(needle, ...) where the text contains the needle, repeated rows kept; nulls contain nothing.

    What stands between blanks inside a needle stands between blanks in the text, too: a needle is looked up by the
    hash of the longest run of three (or fewer) such pieces.  A needle without one is looked up by its first 24
    characters at every position.  Only hashes of 8 bytes are exploded; texts join once, as whole rows, to their hits.
    """
    pieces = F.split("needle", " ")
    inner = F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))
    n = F.least(F.size(inner), F.lit(PIECES))
    # arrays are bound by lambdas: as columns they could be split anew for every run
    every = lambda some: F.transform(F.sequence(F.lit(1), F.size(some) - n + 1), lambda i: F.array_join(F.slice(some, i, n), " "))
    runs = F.get(F.transform(F.array(inner), every), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda run: F.struct(F.length(run).alias("n"), run.alias("run"))))["run"]
    asked = needles.where("needle is not null").withColumn("_n", n)
    front = F.least(F.length("needle"), F.lit(FRONT))
    asked = asked.withColumns({"_front": F.when(F.col("_n") == 0, front), "_key": F.xxhash64(F.when(F.col("_n") > 0, longest).otherwise(F.substring("needle", F.lit(1), front)))})
    kinds = asked.select("_n", "_front").distinct().collect()  # at most 3 + 25 values
    runs_of = lambda words, k: F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(k)), " ")))).otherwise(F.array().cast("array<bigint>"))
    grams = lambda k: F.get(F.transform(F.array(F.split("text", " ")), lambda words: runs_of(words, k)), F.lit(0))
    fronts = lambda k: F.transform(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)), lambda x: F.xxhash64(x))
    keys = [F.array_distinct(grams(r["_n"]) if r["_n"] else fronts(r["_front"])) for r in kinds]
    rows = texts.where("text is not null").withColumn("_text", F.xxhash64("text"))
    hits = rows.select("_text", F.explode(F.flatten(F.array(*keys)) if keys else F.array().cast("array<bigint>")).alias("_key"))
    hits = hits.join(asked.select("_key", "needle").distinct(), "_key").select("_text", "needle").distinct()
    found = rows.join(hits, "_text").where(F.instr("text", F.col("needle")) > 0).drop("_text", "text")
    return found.join(asked.drop("_n", "_front", "_key"), "needle")
