"""Resharding by minimum-cost flow.

The old layout gives bytes per old shard, the new one a capacity per shard.  A
minimum-cost flow over (old shard, new shard) - both counts are parameters, so
the network is small - finds the block transfers that move the fewest bytes.
Documents of an old shard lie in one order by a hash of their text, so equal
texts are neighbours; the flow cuts that order into runs, one per transfer.  Groups
of equal texts larger than a fixed fraction of a shard are placed before the
flow: their number is at most 1/fraction per shard.  Only a group that exceeds a
shard by itself is divided.

The plan is carried out by rewrite(): only shards that gain or lose rows are
written, into a folder of a new version, and a manifest names the folder of every
shard; a shard that lost all its rows is in no manifest.  Nothing is overwritten,
so a run that fails leaves the old version as it was.

Defined results: a null text has 0 bytes and checksum 0, and size 16 like an empty
one; repeated rows are separate documents; an empty table gives an empty table;
slots run from 0 without gaps in the order (block, text hash, doc_id); a column
old_shard of the input counts only if it is named, another is not read.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

OVERHEAD = 16


@dataclass(frozen=True)
class Layout:
    shards: int = 40
    old_shards: int = 32
    #: groups above this fraction of a shard are placed one by one
    big: float = 0.005
    #: bytes of documents that one block of the order holds on average
    block_bytes: int = 1 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, of least total cost(i, j) * bytes.

    Successive shortest paths with potentials.  Sum of supply must not exceed
    the sum of capacity.
    """
    n, m = len(supply), len(capacity)
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]
    source, sink = n + m, n + m + 1

    def edge(a: int, b: int, room: int, price: int) -> list[int]:
        there, back = [b, room, price, len(graph[b])], [a, 0, -price, len(graph[a])]
        graph[a].append(there)
        graph[b].append(back)
        return there

    for i, x in enumerate(supply):
        edge(source, i, x, 0)
    arcs = {(i, j): edge(i, n + j, supply[i], cost(i, j)) for i in range(n) for j in range(m)}
    for j, x in enumerate(capacity):
        edge(n + j, sink, x, 0)
    left, height = sum(supply), [0] * len(graph)
    while left:
        best: list[float] = [float("inf")] * len(graph)
        best[source], via, heap = 0, {}, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                new = d + price + height[a] - height[b]
                if room > 0 and new < best[b]:
                    best[b], via[b] = new, (a, k)
                    heapq.heappush(heap, (new, b))
        if sink not in via:
            raise ValueError("capacities are below the supplies")
        height = [h + (int(d) if d < float("inf") else 0) for h, d in zip(height, best, strict=True)]
        push, b = left, sink
        while b != source:
            a, k = via[b]
            push, b = min(push, graph[a][k][1]), a
        b = sink
        while b != source:
            a, k = via[b]
            graph[a][k][1] -= push
            graph[b][graph[a][k][3]][1] += push
            b = a
        left -= push
    return {ij: supply[ij[0]] - arc[1] for ij, arc in arcs.items() if supply[ij[0]] - arc[1] > 0}


def sized(docs: DataFrame, old: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, _t (a hash that equal texts share, 128 bits), old_shard from the column named old, and keep."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    given = [F.col(old).cast("int").alias("old_shard")] if old else []
    return docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("_t"), *given, *keep)


def _place_big(groups: list[tuple[str, int, int, int]], capacity: int, shards: int) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Longest first, each to its own shard where it fits, else the emptiest: hash -> [(first byte, shard)]."""
    room, where = [capacity] * shards, {}
    for text, old, size, widest in sorted(groups, key=lambda g: (-g[2], g[0])):
        parts, at = [], 0
        while at < size:
            own = old if old < shards and at == 0 and room[old] >= size else max(range(shards), key=lambda j: (room[j], -j))
            take = size - at if size - at <= max(room[own], widest) else max(room[own], widest)
            parts.append((at, own))
            room[own] -= take
            at += take
        where[text] = parts
    return where, room


def plan(rows: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Adds old_shard, shard, moved, block to rows of sized()."""
    spark, n = rows.sparkSession, layout.shards
    kept = [c for c in rows.columns if c not in ("doc_id", "size", "text_crc32", "_t", "old_shard")]
    if "old_shard" not in rows.columns:
        rows = rows.withColumn("old_shard", F.pmod(F.conv(F.substring("_t", 25, 8), 16, 10).cast("long"), F.lit(layout.old_shards)).cast("int"))
    rows = cut(rows)  # hashes and sizes only: texts are read once
    groups = cut(rows.groupBy("old_shard", "_t").agg(F.sum("size").alias("bytes"), F.max("size").alias("widest"), F.count("*").alias("n")))
    total, = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()
    capacity = -(-total // n)
    # at most shards / big groups can pass this filter
    big = [(r._t, r.old_shard, r.bytes, r.widest) for r in groups.where((F.col("n") > 1) & (F.col("bytes") > layout.big * capacity)).collect()]
    placed, room = _place_big([(f"{old}/{t}", old, b, w) for t, old, b, w in big], capacity, n)
    big_rows = [(int(k.split("/")[0]), k.split("/")[1], [p for p, _ in v], [s for _, s in v]) for k, v in placed.items()]
    marks = F.broadcast(spark.createDataFrame(big_rows, "old_shard int, _t string, _from array<bigint>, _to array<int>"))
    small = groups.join(marks.select("old_shard", "_t"), ["old_shard", "_t"], "left_anti")
    supply = {r.old_shard: r.b for r in small.groupBy("old_shard").agg(F.sum("bytes").alias("b")).collect()}  # one row per old shard
    olds, room = sorted(supply), [max(0, r) for r in room]
    short = max(0, sum(supply.values()) - sum(room))
    room = [r + -(-short // n) for r in room]
    flow = min_cost_flow([supply[o] for o in olds], room, lambda i, j: 0 if olds[i] == j else 1)
    # each old shard's order of bytes, cut by destination: its own shard first, then by number
    cuts = []
    for i, old in enumerate(olds):
        at = 0
        for _, j in sorted((k for k in flow if k[0] == i), key=lambda k: (k[1] != old, k[1])):
            cuts.append((old, at, j))
            at += flow[i, j]
    by_old: dict[int, tuple[list[int], list[int]]] = {}
    for old, at, j in cuts:
        by_old.setdefault(old, ([], []))
        by_old[old][0].append(at)
        by_old[old][1].append(j)
    runs = F.broadcast(spark.createDataFrame([(o, *v) for o, v in by_old.items()], "old_shard int, _from array<bigint>, _to array<int>"))
    # prefix sums in two levels: blocks by the front of the text hash, then inside a block
    digits = 0
    while 16**digits * layout.block_bytes * max(1, len(olds)) < total:
        digits += 1
    block = F.substring("_t", 1, digits)
    small = small.withColumn("block", block)
    starts = small.groupBy("old_shard", "block").agg(F.sum("bytes").alias("_b"))
    starts = starts.withColumn("_block_at", F.sum("_b").over(Window.partitionBy("old_shard").orderBy("block")) - F.col("_b")).drop("_b")
    inside = Window.partitionBy("old_shard", "block").orderBy("_t")
    small = small.join(starts, ["old_shard", "block"]).withColumn("_at", F.col("_block_at") + F.sum("bytes").over(inside) - F.col("bytes"))
    run = lambda at: F.element_at("_to", F.size(F.filter("_from", lambda x: x <= at)))
    small = small.join(runs, "old_shard").select("old_shard", "_t", run(F.col("_at") + F.expr("bytes div 2")).alias("_shard"))
    # rows: divided groups by their own prefix sum, all others by their group
    rows = rows.withColumn("block", F.substring("_t", 1, digits))
    large = rows.join(marks, ["old_shard", "_t"])
    whole = large.where(F.size("_to") == 1).withColumn("shard", F.element_at("_to", 1)).drop("_from", "_to")
    split = _divided(large.where(F.size("_to") > 1))
    rest = rows.join(marks.select("old_shard", "_t"), ["old_shard", "_t"], "left_anti").join(small, ["old_shard", "_t"]).withColumnRenamed("_shard", "shard")
    cols = ["doc_id", "size", "text_crc32", "_t", "old_shard", "block", "shard", *kept]
    out = rest.select(cols).unionByName(whole.select(cols)).unionByName(split.select(cols))
    return out.withColumn("moved", F.col("shard") != F.col("old_shard"))


def _divided(rows: DataFrame) -> DataFrame:
    """Rows of a group that exceeds a shard: dealt over its parts by their byte shares.

    All sizes in a group are equal, so a hash of doc_id gives salts, salts give prefix sums,
    and no task sees more than a salt.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(256)).cast("int"))
    salts = rows.groupBy("old_shard", "_t", "_salt").agg(F.sum("size").alias("_b"))
    salts = salts.withColumn("_salt_at", F.sum("_b").over(Window.partitionBy("old_shard", "_t").orderBy("_salt")) - F.col("_b")).drop("_b")
    inside = Window.partitionBy("old_shard", "_t", "_salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(salts, ["old_shard", "_t", "_salt"]).withColumn("_at", F.col("_salt_at") + F.sum("size").over(inside) - F.col("size"))
    at = F.col("_at")
    return rows.withColumn("shard", F.element_at("_to", F.size(F.filter("_from", lambda x: x <= at)))).drop("_from", "_to", "_salt", "_salt_at", "_at")


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 per shard, by counts of (shard, block, salt) and ranks inside one."""
    rows = rows.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
    key = ["shard", "block", "_s"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy("shard").orderBy("block", "_s")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_t", "doc_id"))
    return rows.withColumn("_rank", rank).join(counts, key).withColumn("slot", F.col("_first") + F.col("_rank") - 1).drop("_first", "_rank", "_s")


def resharded(docs: DataFrame, layout: Layout = Layout(), old: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, moved, slot.  old: the column with the old shards, else a hash of the text."""
    return with_slots(plan(sized(docs, old), layout)).drop("block", "_t")


#: rows of a shard that stay together when shards are written
FILE_ROWS = 4096


def rewrite(docs: DataFrame, folder: str, layout: Layout = Layout(), old: str | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """Reshard docs, a table read from files, and write the shards that change under folder; gives the new manifest(shard, path).

    manifest, old: the current version and the column with its shards; without them all shards are new.
    """
    spark = docs.sparkSession
    place = ("_file", "_line")  # where a row lies; row numbers of a file never change
    rows = docs.withColumns({"_file": F.col("_metadata.file_path"), "_line": F.col("_metadata.row_index")})
    placed = cut(with_slots(plan(sized(rows, old, place), layout)).select(*place, "size", "text_crc32", "old_shard", "shard", "moved", "slot"))
    shards = placed.select("shard").distinct()
    touched = shards if manifest is None else placed.where("moved").select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    touched = F.broadcast(touched)  # at most one row per shard
    new = rows.drop(*[c for c in ("size", "text_crc32", "shard", "slot", old) if c]).join(placed.join(touched, "shard", "left_semi"), list(place)).drop("old_shard", "moved", *place)
    version = f"{folder.rstrip('/')}/version-{uuid.uuid4().hex}"
    new.repartition("shard", F.expr(f"slot div {FILE_ROWS}")).write.partitionBy("shard").option("compression", "zstd").parquet(version)
    here = F.concat(F.lit(version + "/shard="), F.col("shard").cast("string"))
    out = shards.join(touched, "shard", "left_semi").select("shard", here.alias("path"))
    if manifest is not None:
        stay = manifest.join(shards, "shard", "left_semi").join(touched, "shard", "left_anti")
        out = out.unionByName(stay.select("shard", "path"))
    out.coalesce(1).write.parquet(f"{version}/_manifest")
    return spark.read.schema("shard int, path string").parquet(f"{version}/_manifest")


def read_shards(manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """All documents of a version with size, text_crc32, slot and shard; one path per shard, whose number is a parameter.

    docs: what was resharded, whose columns a version without any shard has.
    """
    spark: SparkSession = manifest.sparkSession
    by_version: dict[str, list[str]] = {}
    for r in manifest.orderBy("shard").collect():
        by_version.setdefault(r.path.rsplit("/", 1)[0], []).append(r.path)
    out = None
    for version, paths in by_version.items():
        rows = spark.read.option("basePath", version).parquet(*paths)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        kinds = {"size": "long", "text_crc32": "long", "slot": "long", "shard": "int"}
        return docs.drop(*kinds).select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).limit(0)
    return out
