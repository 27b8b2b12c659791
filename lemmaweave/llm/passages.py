"""Recurring passages over whole texts: what the two substring operators share.

A window is a fixed number of neighbouring symbols (words or bytes).  Each
window picks an anchor by content (hashing.anchors), so equal windows pick equal
grams and only windows of an equal gram can be equal.  The steps:

0. equal texts are one: the text with the smallest doc_id stands for all, and the
   others are removed whole, so a group of copies costs no more than one of them;
1. gram hashes meet in buckets; each task sends a gram once, and learns locally
   what several of its texts hold, so a gram in every document costs one entry per task;
2. texts with recurring grams are stored once; around each recurring anchor lies
   a segment: all windows that picked it.  Occurrences refer to segments by a
   128-bit hash, and equal segments of a task collapse to the first;
3. segments that stand alone in their gram hold windows that occur only together:
   the first occurrence settles all.  The segments of other grams meet in one
   task, which finds the first occurrence of each window; no task holds a hot gram:
   op7 leaves its windows to an aggregation on 128-bit window hashes, which combines
   before the shuffle; op4 deals its segments over tasks, which find the first
   occurrences among theirs, and an aggregation compares only what these leave open;
4. each occurrence compares itself with the first of its windows.

Nothing here gathers a gram's or a passage's occurrences in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import cut, shared_folder, spread_join, stored

#: stands for a null doc_id: the latest of all
LAST = 2**63 - 1
ITEM = "ih1 bigint, ih2 bigint, off int, n int, fd bigint, fp bigint, wh1 bigint, wh2 bigint"


class Unit:
    """How texts become symbols: byte starts and ends of each, and their hashes."""

    window: int
    gram: int
    #: whether repeats inside one text count
    within: bool

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray]:
        """symbols, byte starts, byte ends (None: bytes themselves), offsets in symbols."""
        raise NotImplementedError


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame) -> DataFrame:
    """did (doc_id, null as the latest), tk and tk2 (128 bits of text hash), text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("did"), F.xxhash64(text).alias("tk"), F.xxhash64(F.lit("2"), text).alias("tk2"), text.alias("text"))


def first_texts(docs: DataFrame) -> DataFrame:
    """tk, tk2, first (smallest did), _n (rows) of each different text."""
    return cut(keyed(docs).groupBy("tk", "tk2").agg(F.min("did").alias("first"), F.count("*").alias("_n")))


def _blocks(symbols: np.ndarray, offsets: np.ndarray, unit: Unit, most: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors; a text longer than a block goes by blocks of windows, so memory stays bounded."""
    most = most or hashing.BLOCK
    if len(symbols) <= most or len(offsets) != 2:
        yield hashing.anchors(symbols, offsets, unit.window, unit.gram)
        return
    for lo in range(0, len(symbols) - unit.window + 1, most):
        part = symbols[lo : lo + most + unit.window - 1]
        text, q, first, last, h = hashing.anchors(part, np.array([0, len(part)]), unit.window, unit.gram)
        yield text, q + lo, first + lo, last + lo, h


def anchored(batch: pa.RecordBatch, unit: Unit) -> Iterator[tuple]:
    """Per chunk of rows: lo, hi, data, symbols' bytes, offsets in symbols, anchors."""
    data, offsets = hashing.texts(batch.column("text"))
    for lo, hi in hashing.pieces(offsets):
        chunk, base = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        symbols, starts, ends, at = unit.symbols(chunk, base)
        for found in _blocks(symbols, at, unit):
            yield lo, hi, chunk, starts, ends, at, found


def recurring_grams(docs: DataFrame, unit: Unit) -> DataFrame:
    """tk, h: grams of a text that other texts hold (or the same again, if that counts).  One shuffle of 16 bytes a gram."""
    buckets = parts_of(docs) * 4

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, keys = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for batch in batches:
            tk = batch.column("tk").to_numpy()
            for lo, _, _, _, _, _, (text, q, _, _, h) in anchored(batch, unit):
                # a run of windows may meet its gram twice where blocks join: one place is one occurrence
                once = np.unique(np.column_stack((text, q)), axis=0, return_index=True)[1] if len(q) else np.empty(0, np.int64)
                grams.append(h[once])
                keys.append(tk[lo + text[once]])
        h, tk = np.concatenate(grams), np.concatenate(keys)
        order = np.lexsort((tk, h))
        h, tk = h[order], tk[order]
        pair = np.ones(len(h), bool)
        pair[1:] = (h[1:] != h[:-1]) | (tk[1:] != tk[:-1])
        at = np.flatnonzero(pair)
        again = np.diff(np.append(at, len(h))) > 1
        h, tk = h[at], tk[at]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        group = np.cumsum(first) - 1
        several = np.bincount(group)[group] > 1 if len(h) else first
        if unit.within and len(h):
            several = several | (np.bincount(group, weights=again)[group] > 0)
        rows: list[tuple[int, np.ndarray, np.ndarray, int]] = [(int(xxhash.xxh32_intdigest(h[:8].tobytes()) % buckets), h[several], tk[several], 0)]
        for known, mask in ((0, ~several), (1, first & several)):
            x, k = h[mask], tk[mask]
            to = (x >> np.uint64(16)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(buckets + 1))
            rows += [(b, x[order[i:j]], k[order[i:j]], 1 + known) for b, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if j > i]
        for i in range(0, len(rows), 64):
            part = rows[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1].tobytes() for r in part], pa.binary()), pa.array([r[2].tobytes() for r in part], pa.binary()), pa.array([r[3] for r in part], pa.int32())], ["bucket", "h", "tk", "kind"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        out = lambda h, tk: pa.RecordBatch.from_arrays([pa.array(tk), pa.array(hashing.signed(h))], ["tk", "h"])
        for batch in batches:
            for h, tk, kind in zip(batch.column("h"), batch.column("tk"), batch.column("kind"), strict=True):
                h, tk, kind = np.frombuffer(h.as_py(), np.uint64), np.frombuffer(tk.as_py(), np.int64), kind.as_py()
                if kind == 0:
                    yield out(h, tk)
                else:
                    asked.append((h, tk, np.full(len(h), kind == 2)))
        if asked:
            h, tk, known = (np.concatenate(x) for x in zip(*asked, strict=True))
            order = np.lexsort((tk, h))
            h, tk, known = h[order], tk[order], known[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            group = np.cumsum(first) - 1
            ends = np.append(np.flatnonzero(first)[1:], len(h)) - 1
            recurs = (tk[np.flatnonzero(first)] != tk[ends]) | (np.bincount(group, weights=known) > 0)
            hit = recurs[group] & ~known
            yield out(h[hit], tk[hit])

    rows = docs.select("tk", "text").mapInArrow(ask, "bucket int, h binary, tk binary, kind int")
    return rows.repartition(parts_of(docs), "bucket").mapInArrow(answer, "tk bigint, h bigint")


def involved(docs: DataFrame, firsts: DataFrame, unit: Unit) -> DataFrame:
    """did, tk, text, grams of the different texts with recurring grams, stored once in the shared folder."""
    shared_folder(docs.sparkSession)
    rows = keyed(docs)
    grams = recurring_grams(rows, unit).groupBy("tk").agg(F.collect_set("h").alias("grams"))
    wanted = grams.join(firsts.select("tk", "tk2", F.col("first").alias("did")), "tk")
    key = ["did", "tk", "tk2"]
    return stored(rows.join(wanted, key).dropDuplicates(key).select("did", "tk", "text", "grams"), "passages-texts")


def item_hash(segment: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(segment)
    return (x >> 64) - 2**63, (x & (2**64 - 1)) - 2**63


def item_rows(keys: np.ndarray, off: np.ndarray, n: np.ndarray, did: np.ndarray, place: np.ndarray, hashes: list[np.ndarray] | None = None) -> pa.RecordBatch:
    cols = [pa.array(x) for x in (keys[:, 0], keys[:, 1], off.astype(np.int32), n.astype(np.int32), did, place)]
    cols += [pa.array(x) for x in hashes] if hashes else [pa.nulls(len(off), pa.int64())] * 2
    return pa.RecordBatch.from_arrays(cols, ["ih1", "ih2", "off", "n", "fd", "fp", "wh1", "wh2"])


def _windows(did: np.ndarray, lo: np.ndarray, symbols: tuple[np.ndarray, np.ndarray], at: np.ndarray, window: int) -> tuple:
    """Segment, offset in it, place (did, lo + offset) and the two hashes of every window of the segments at symbols[..][at[i]:at[i+1]]."""
    n = np.maximum(np.diff(at) - window + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = at[:-1][row] + off
    return row, off, did[row], lo[row] + off, [hashing.signed(hashing.Runs(symbols[which], which).at(start, start + window)) for which in (0, 1)]


def window_rows(keys: np.ndarray, did: np.ndarray, lo: np.ndarray, symbols: tuple[np.ndarray, np.ndarray], at: np.ndarray, window: int, settle: bool) -> pa.RecordBatch:
    """ITEM rows of segments at symbols[..][at[i]:at[i+1]]; the symbols come as two independent hashes of each.

    settle: the batch holds all segments of its grams, so first occurrences are found here.
    """
    if settle:
        return settled_rows(keys, did, lo, symbols, at, window)[0]
    row, off, fd, fp, hashes = _windows(did, lo, symbols, at, window)
    return item_rows(keys[row], off, np.ones(len(row), np.int64), fd, fp, hashes)


def settled_rows(keys: np.ndarray, did: np.ndarray, lo: np.ndarray, symbols: tuple[np.ndarray, np.ndarray], at: np.ndarray, window: int, more: np.ndarray | None = None) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """ITEM rows by the first occurrences in this batch: neighbouring windows with neighbouring first occurrences are one row.

    more: segments whose gram has segments in other batches, too.  Their windows that no smaller did of this batch
    holds come as single windows besides; the others are removed whatever other batches hold, if smaller dids remove.
    """
    row, off, own, fp, hashes = _windows(did, lo, symbols, at, window)
    fd = own.copy()
    order = np.lexsort((fp, fd, hashes[1], hashes[0]))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(hashes[0][order]) != 0) | (np.diff(hashes[1][order]) != 0)
    least = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    fd[order], fp[order] = fd[least], fp[least]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(fd) != 0) | (np.diff(fp - off) != 0)
    first = np.flatnonzero(new)
    left = np.flatnonzero(more[row] & (fd == own)) if more is not None else np.empty(0, np.int64)
    runs = item_rows(keys[row[first]], off[first], np.diff(np.append(first, len(row))), fd[first], fp[first])
    return runs, item_rows(keys[row[left]], off[left], np.ones(len(left), np.int64), fd[left], fp[left], [x[left] for x in hashes])


def resolved(items: DataFrame, occurrences: DataFrame, earlier: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """did, tk, ranges: runs of removed windows (first, last) of each text.

    items: ITEM rows; without window hashes a run of n windows from off whose first occurrences are
    fp, fp + 1, ... in fd; with them a single window and the first occurrence of its segment.
    """
    windows = items.where("wh1 is not null")
    least = cut(windows.groupBy("wh1", "wh2").agg(F.min(F.struct("fd", "fp")).alias("m"), F.count("*").alias("_n")))
    found = spread_join(windows, least.select("wh1", "wh2", "m"), ["wh1", "wh2"], ["ih1", "ih2", "off"], "inner", least.select("wh1", "wh2", "_n"))
    singles = found.select("ih1", "ih2", "off", F.lit(1).alias("n"), F.col("m.fd").alias("fd"), F.col("m.fp").alias("fp"))
    return removed(singles.unionByName(items.where("wh1 is null").select(*singles.columns)), occurrences, earlier)


def removed(runs: DataFrame, occurrences: DataFrame, earlier: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """did, tk, ranges: runs of removed windows of each text.  runs: ITEM rows without window hashes, any number of verdicts a window."""
    # a segment has as many verdicts as windows, or twice as many, at most: a fixed number
    verdicts = cut(runs.select("ih1", "ih2", F.struct("off", "n", "fd", "fp").alias("v")).groupBy("ih1", "ih2").agg(F.collect_list("v").alias("v")))
    rows = spread_join(occurrences, verdicts, ["ih1", "ih2"], ["did", "tk"], "inner")
    span = lambda lo, v: F.struct((lo + v["off"]).alias("a"), (lo + v["off"] + v["n"] - 1).alias("b"))
    gone = F.transform("v", lambda v: F.transform(F.filter("los", lambda lo: earlier(v["fd"], v["fp"], F.col("did"), lo + v["off"])), lambda lo: span(lo, v)))
    return rows.select("did", "tk", F.flatten(gone).alias("g")).where(F.size("g") > 0).groupBy("did", "tk").agg(F.flatten(F.collect_list("g")).alias("ranges"))


def by_text(docs: DataFrame, firsts: DataFrame, changed: DataFrame, columns: list[Column]) -> DataFrame:
    """did, tk, the given columns of every row, first (the smallest did with its text) and the columns of changed(did, tk, ...)."""
    texts = firsts.select("tk", "tk2", F.col("first").alias("did")).join(changed, ["did", "tk"], "left").withColumnRenamed("did", "first")
    rows = keyed(docs).select("did", "tk", "tk2", *columns)
    return spread_join(rows, texts, ["tk", "tk2"], ["did"], "left", firsts.select("tk", "tk2", "_n")).drop("tk2")


def by_item(rows: list[tuple]) -> dict[tuple, list[int]]:
    """Occurrences (did, tk, lo, ...rest) with equal text and item as one row with all its places: a text of one
    repeated word is a few rows, not one per window."""
    out: dict[tuple, list[int]] = {}
    for did, tk, lo, *rest in rows:
        out.setdefault((did, tk, *rest), []).append(lo)
    return out


def covered(ranges: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal runs of symbols [start, end) under windows first..last."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + window)
        else:
            out.append([a, b + window])
    return [(a, b) for a, b in out]
