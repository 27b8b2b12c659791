"""Removing repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte is removed where a string of 100 bytes over it also starts earlier.
Suffixes that no other can match are left out beforehand: of a suffix only those
at content-defined anchors with a recurring 40-gram are kept (passages.py), each
with the bytes to its left that its windows need.  Every task sorts its suffixes,
front-codes them (length of the prefix shared with the one before, and the rest)
and exchanges slices of these runs by splitters.  A reducer merges its runs with
a loser tree whose players remember the prefix they share with the last winner:
a longer shared prefix wins without looking at a byte, and comparisons start
behind the shared part, so known prefixes are never compared again.  The shared
prefix of neighbours in the merged order tells equal suffixes and suffixes of an
equal gram.

Defined results: a null text is empty; matches stay inside one document; a null
doc_id (or one of 2**63 - 1, which returns as null) is later than all others; among rows of one doc_id the start decides;
an empty table gives an empty table.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, passages
from .common import cut, discard, forget, stored

#: suffixes that a task sorts at once
RUN = 100_000
#: bytes of suffixes in a shard, which one task merges at a time
SHARD = 8 << 20


class Bytes(passages.Unit):
    def __init__(self, window: int = 100, gram: int = 40):
        self.window, self.gram, self.within = window, gram, True

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, None, None, np.ndarray]:
        return data, None, None, offsets


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    step = 16
    while known < n:
        end = min(known + step, n)
        if a[known:end] == b[known:end]:
            known, step = end, step * 2
        elif end - known == 1:
            return known
        else:
            step = (end - known) // 2
    return n


@dataclass
class Run:
    """A front-coded sorted run: prefix lengths, tails, and what belongs to each suffix."""

    shared: list[int]
    tails: list[bytes]
    left: list[int]  # how many bytes at the end of the item stand left of the suffix
    did: list[int]
    lo: list[int]

    def packed(self) -> tuple[bytes, bytes, bytes, bytes, bytes, bytes]:
        ints = [np.asarray(x, np.int64).tobytes() for x in (self.shared, [len(t) for t in self.tails], self.left, self.did, self.lo)]
        return (*ints, b"".join(self.tails))

    @staticmethod
    def unpacked(cells: list[bytes]) -> Run:
        shared, size, left, did, lo = (np.frombuffer(x, np.int64).tolist() for x in cells[:5])
        ends = np.cumsum(size).tolist() if size else []
        return Run(shared, [cells[5][e - s : e] for s, e in zip(size, ends, strict=True)], left, did, lo)

    def suffixes(self) -> Iterator[bytes]:
        last = b""
        for n, tail in zip(self.shared, self.tails, strict=True):
            last = last[:n] + tail
            yield last


def front_coded(rows: list[tuple[bytes, int, int, int]]) -> Run:
    """A run of sorted rows (suffix with its left part, left length, did, lo)."""
    run, last = Run([], [], [], [], []), b""
    for item, left, did, lo in rows:
        n = shared_prefix(last, item, 0)
        run.shared.append(n)
        run.tails.append(item[n:])
        run.left.append(left)
        run.did.append(did)
        run.lo.append(lo)
        last = item
    return run


def sliced(run: Run, shard: np.ndarray) -> Iterator[tuple[int, Run]]:
    """Sub-runs by shard; shared prefixes come from running minima, no byte is compared."""
    items = list(run.suffixes())
    shared = np.asarray(run.shared)
    for number in np.unique(shard):
        at = np.flatnonzero(shard == number)
        # the prefix two kept neighbours share is the least on the way between them
        least = np.minimum.reduceat(shared[: at[-1] + 1], np.concatenate(([0], at[:-1] + 1)))
        least = np.minimum(least, [len(items[i]) for i in at])
        least[0] = 0
        yield int(number), Run(least.tolist(), [items[i][n:] for i, n in zip(at, least, strict=True)], [run.left[i] for i in at], [run.did[i] for i in at], [run.lo[i] for i in at])


def merged(runs: list[Run]) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(prefix shared with the item before, item, left, did, lo) of all runs in order, by an LCP loser tree."""
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    streams = [iter(zip(r.shared, r.suffixes(), r.left, r.did, r.lo, strict=True)) for r in runs]
    streams += [iter(())] * (k - len(runs))
    heads = [next(s, None) for s in streams]
    # a player: its head's item and the length it shares with the last winner
    prefix = [h[0] if h else 0 for h in heads]
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if prefix[a] != prefix[b]:  # the longer shares more with the last winner and so is smaller
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        n = shared_prefix(x[1], y[1], prefix[a])
        first = (x[1][n : n + 1], *x[2:]) <= (y[1][n : n + 1], *y[2:])
        won, lost = (a, b) if first else (b, a)
        prefix[lost] = n
        return won, lost

    def seed(node: int) -> int:
        if node >= k:
            return node - k
        won, losers[node] = play(seed(2 * node), seed(2 * node + 1))
        return won

    top = seed(1)
    while heads[top] is not None:
        _, item, left, did, lo = heads[top]
        yield prefix[top], item, left, did, lo
        heads[top] = head = next(streams[top], None)
        prefix[top] = head[0] if head else 0
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def sorted_runs(texts: DataFrame, unit: Bytes) -> DataFrame:
    """kind o: texts and items with all places and the front of the suffix; kind r: pieces of each task's sorted run."""
    schema = "kind string, did bigint, tk bigint, los array<bigint>, ih1 bigint, ih2 bigint, front bigint, run array<binary>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of: dict[tuple[bytes, int], tuple[int, int]] = {}
        for batch in batches:
            did, tk, grams = batch.column("did").to_numpy(), batch.column("tk").to_numpy(), batch.column("grams")
            for lo, hi, data, _, _, at, (text, q, first, last, h) in passages.anchored(batch, unit):
                keep = np.zeros(len(h), bool)
                cut = np.searchsorted(text, np.arange(hi - lo + 1))
                for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    keep[a:b] = np.isin(h[a:b], np.asarray(grams[lo + i].values).view(np.uint64))
                raw, out = data.tobytes(), []
                for t, p, a, b in zip(text[keep].tolist(), q[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
                    item, left = raw[p : b + unit.window] + raw[a:p], p - a
                    place = (int(did[lo + t]), a - int(at[t]))
                    old = first_of.get((item, left))
                    if old is None or place < old:
                        first_of[item, left] = place
                    out.append((place[0], int(tk[lo + t]), place[1], *passages.item_hash(raw[a : b + unit.window]), int.from_bytes(item[:8], "big") - 2**63))
                found = passages.by_item(out)
                d, k, x, y, front = ([key[i] for key in found] for i in range(5))
                yield _batch(["o"] * len(found), d, k, list(found.values()), x, y, front, [None] * len(found))
                if len(first_of) > RUN:  # a run is bounded, so a task's memory is
                    yield from run_rows(first_of)
                    first_of = {}
        yield from run_rows(first_of)

    def run_rows(first_of: dict) -> Iterator[pa.RecordBatch]:
        order = sorted((item, left, *place) for (item, left), place in first_of.items())
        for i in range(0, len(order), 4096):
            run = front_coded(order[i : i + 4096])
            yield _batch(["r"], [None], [None], [None], [None], [None], [None], [list(run.packed())])

    return texts.mapInArrow(rows, schema)


def _batch(kind: list, did: list, tk: list, los: list, ih1: list, ih2: list, front: list, run: list) -> pa.RecordBatch:
    big = lambda x: pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), big(did), big(tk), pa.array(los, pa.list_(pa.int64())), big(ih1), big(ih2), big(front), pa.array(run, pa.list_(pa.binary()))], ["kind", "did", "tk", "los", "ih1", "ih2", "front", "run"])


def shards_of(found: DataFrame, unit: Bytes) -> int:
    """As many shards as keep each to about SHARD bytes, but no fewer than partitions."""
    rows = found.where("kind = 'o'").count()
    return max(passages.parts_of(found), -(-rows * (unit.window + unit.gram) // SHARD))


def splitters(found: DataFrame, shards: int) -> np.ndarray:
    """Quantiles of the first eight bytes of the suffixes: at most shards - 1 numbers."""
    if shards < 2:
        return np.empty(0, np.int64)
    cuts = found.where("kind = 'o'").agg(F.percentile_approx("front", [i / shards for i in range(1, shards)], max(1000, 4 * shards))).first()[0]
    return np.array(sorted(cuts or []), np.int64)


def exchanged(found: DataFrame, cuts: np.ndarray) -> DataFrame:
    """shard, several, run: each run cut by the splitters.

    A front that fills several shards is dealt over them by a hash of the suffix;
    such shards (several) leave every window to the aggregation.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in batch.column("run"):
                run = Run.unpacked(cells.as_py())
                fronts = np.array([int.from_bytes(x[:8], "big") - 2**63 for x in run.suffixes()], np.int64)
                a, b = np.searchsorted(cuts, fronts, "left"), np.searchsorted(cuts, fronts, "right")
                shard = b.copy()
                for i in np.flatnonzero(b - a > 1):
                    shard[i] = a[i] + 1 + passages.item_hash(b"%d" % run.left[i] + run.tails[i])[1] % (b[i] - a[i])
                many = (b - a > 1).astype(np.int64)
                out = [(s // 2, bool(s % 2), list(part.packed())) for s, part in sliced(run, shard * 2 + many)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.list_(pa.binary()))], ["shard", "several", "run"])

    return found.where("kind = 'r'").select("run").mapInArrow(rows, "shard int, several boolean, run array<binary>")


def _item_rows(group: list[tuple[bytes, int, int, int]], unit: Bytes, kind: str) -> pa.RecordBatch:
    """ITEM rows of items that stand alone, of whole groups to settle here, or of single windows."""
    texts = [item[len(item) - left :] + item[: len(item) - left] for item, left, _, _ in group]
    keys = np.array([passages.item_hash(t) for t in texts], np.int64).reshape(-1, 2)
    size = np.array([len(t) for t in texts])
    did, lo = (np.array([g[i] for g in group], np.int64) for i in (2, 3))
    if kind == "alone":
        return passages.item_rows(keys, np.zeros(len(group), np.int64), size - unit.window + 1, did, lo)
    at = np.concatenate(([0], np.cumsum(size)))
    return passages.window_rows(keys, did, lo, (np.frombuffer(b"".join(texts), np.uint8),) * 2, at, unit.window, kind == "settle")


def merged_items(runs: DataFrame, unit: Bytes, shards: int) -> DataFrame:
    """passages.ITEM rows from merging the runs of each shard; a task holds one shard at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list] = {"alone": [], "settle": [], "windows": []}

        def put(kind: str, rows: list) -> Iterator[pa.RecordBatch]:
            waiting[kind] += rows
            if len(waiting[kind]) > 2048:
                yield _item_rows(waiting[kind], unit, kind)
                waiting[kind] = []

        def merge(runs: list[Run], several: bool) -> Iterator[pa.RecordBatch]:
            group: list = []
            for shared, item, left, did, lo in merged(runs):
                if shared < unit.gram:  # another gram begins
                    yield from put("windows" if several else "settle" if len(group) > 1 else "alone", group)
                    group = []
                last = group[-1] if group else None
                if last and shared == len(item) == len(last[0]) and left == last[1]:
                    continue  # equal, and later: the tree puts the earlier first
                group.append((item, left, did, lo))
                if several and len(group) > 1:  # a hot gram is not gathered
                    yield from put("windows", [group.pop(0)])
            yield from put("windows" if several else "settle" if len(group) > 1 else "alone", group)

        held: list[Run] = []
        key = None
        for batch in batches:  # ordered by shard
            for shard, several, cells in zip(batch.column("shard").to_pylist(), batch.column("several").to_pylist(), batch.column("run"), strict=True):
                if (shard, several) != key:
                    if held:
                        yield from merge(held, key[1])
                    held, key = [], (shard, several)
                held.append(Run.unpacked(cells.as_py()))
        if held:
            yield from merge(held, key[1])
        for kind, rows in waiting.items():
            if rows:
                yield _item_rows(rows, unit, kind)

    # the number of a shard is that of its task: hashed, several would meet in one
    return runs.repartitionById(shards, "shard").sortWithinPartitions("shard", "several").mapInArrow(rows, passages.ITEM)


def removed_bytes(docs: DataFrame, firsts: DataFrame, window: int = 100, gram: int = 40) -> tuple[DataFrame, DataFrame]:
    """(texts that take part, ranges did, tk, ranges of window starts)."""
    unit = Bytes(window, gram)
    texts = passages.involved(docs, firsts, unit)
    found = stored(sorted_runs(texts, unit), "passages-runs", by="kind")
    shards = shards_of(found, unit)
    items = stored(merged_items(exchanged(found, splitters(found, shards)), unit, shards), "passages-items")
    discard(found, "kind", "r")
    places = found.where("kind = 'o'").select("did", "tk", "los", "ih1", "ih2")
    ranges = cut(passages.resolved(items, places, lambda fd, fp, did, lo: (fd < did) | ((fd == did) & (fp < lo))))
    for table in (items, found):
        forget(table)
    return texts, ranges


def changed_texts(docs: DataFrame, firsts: DataFrame, window: int = 100, gram: int = 40, keep: bool = True) -> DataFrame:
    """did, tk, n_removed, spans, kept, kept_sha256 of the different texts that lose bytes, the first row of each."""
    texts, ranges = removed_bytes(docs, firsts, window, gram)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for text, found in zip(batch.column("text"), batch.column("ranges"), strict=True):
                raw = text.as_py().encode()
                runs = passages.covered([(r["a"], r["b"]) for r in found.as_py()], window)
                edges = [0, *(x for r in runs for x in r), len(raw)]
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            gone = [sum(r["end"] - r["start"] for r in s) for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("tk"), pa.array(gone, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], ["did", "tk", "n_removed", "spans", "kept", "kept_sha256"])

    changed = ranges.join(texts.select("did", "tk", "text"), ["did", "tk"]).select("did", "tk", "text", "ranges")
    out = changed.mapInArrow(rows, "did bigint, tk bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string")
    out = cut(out if keep else out.drop("kept"))
    forget(texts)
    return out


def digests(docs: DataFrame, firsts: DataFrame, changed: DataFrame, window: int = 100) -> DataFrame:
    """did, tk, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    raw = F.col("text").cast("binary")
    own = changed.select("did", "tk", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
    rows = passages.by_text(docs, firsts, own, [F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("_sha")])
    copy = (F.col("did") > F.col("first")) & (F.col("n_bytes") >= window)  # an earlier row has the same text
    zero = F.lit(0).cast("long")
    return rows.select(
        "did", "tk", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, zero + 1).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
    )


def cleaned(docs: DataFrame, window: int = 100, gram: int = 40, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, spans (start, end) and kept (bytes), null where nothing was removed."""
    firsts = passages.first_texts(docs)
    changed = changed_texts(docs, firsts, window, gram, keep=texts)
    out = digests(docs, firsts, changed, window)
    if texts:
        out = out.join(changed.select("did", "tk", "spans", "kept"), ["did", "tk"], "left")
        whole = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_bytes"))
        span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
        out = out.withColumns({"spans": F.when(whole, span).otherwise(F.col("spans")), "kept": F.when(whole, F.lit(b"")).otherwise(F.col("kept"))})
    return out.withColumn("doc_id", F.nullif(F.col("did"), F.lit(passages.LAST))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["spans", "kept"] * texts)
