"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Rows are dealt into shards of bounded size by a hash of vec_id, so copies of one vector,
however many, spread evenly; within a shard equal vectors are one node.  Nodes get random
levels and are numbered by falling level, so the members of a layer are its first nodes,
every layer is a matrix of neighbour numbers, and node 0 is where all searches begin.  A
shard is stored as one row of flat arrays.

Nodes are inserted in batches that double until a batch has its full size: each batch
searches the graph of all before it and its own members, keeps the links that point into
different directions, and links back; lists that overflow are cut in the same way.
Searches move a beam over the graph for a whole batch of queries at once.

Every shard answers every query.  Queries meet shards in blocks by key, so neither side is
broadcast, and a task holds one shard and one block.  Distances of results are computed in
double precision on the original vectors.

Defined results: rows without vec_id, and vectors that are null, zero, empty or hold null,
NaN or infinite components take no part; of rows that share a vec_id the smallest vector
stands for them, so no vec_id answers twice; vectors are compared with those of their
length only; equal distances go to the smaller vec_id; a query never finds its own vec_id;
an empty table gives an empty table; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, finite_vector, stored

#: the random levels of a shard depend on nothing else, so a task that runs again builds the same graph
SEED = 20_240


@dataclass(frozen=True)
class Shape:
    #: rows of a shard on average
    shard_rows: int = 8192
    #: links a new node makes in a layer; layer 0 keeps twice as many
    links: int = 16
    #: candidates of an insertion and of a search
    build_width: int = 80
    search_width: int = 200
    #: nodes or queries that move at once, and beam members that each of them expands at once
    batch: int = 512
    expand: int = 4
    #: queries of a block on average
    query_block: int = 4096


class Graph:
    """Nodes in order of falling level; layers[l][i]: neighbours of node i in layer l, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], shape: Shape) -> None:
        # moved to their mean, so that products lose no digits to a common offset
        self.centre = vectors.mean(0)
        self.x = vectors - self.centre
        self.scale = max(float(np.abs(self.x).max(initial=0)), 1e-300)
        self.x = self.x / self.scale
        self.squares = np.einsum("ij,ij->i", self.x, self.x)
        self.layers, self.shape = layers, shape

    def moved(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.centre) / self.scale

    def _far(self, points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each node of its row."""
        return np.maximum(self.squares[nodes] - 2 * np.einsum("bd,bmd->bm", points, self.x[nodes]) + np.einsum("bd,bd->b", points, points)[:, None], 0)

    def beam(self, points: np.ndarray, entry: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances), nearest first, -1 and inf where fewer were found.  entry: nodes to begin with, -1 for none."""
        rows, links = len(points), self.layers[layer]
        own = np.einsum("bd,bd->b", points, points)
        nodes, far, done = np.full((rows, width), -1), np.full((rows, width), np.inf), np.ones((rows, width), bool)
        entry = entry[:, :width]
        n = entry.shape[1]
        nodes[:, :n], done[:, :n] = entry, entry < 0
        far[:, :n] = np.where(entry < 0, np.inf, self._far(points, entry))
        seen = np.zeros((rows, len(links) + 1), bool)  # the last column takes the -1
        seen[np.arange(rows)[:, None], entry] = True
        seen[:, -1] = True
        at, expand = np.arange(rows), min(self.shape.expand, width)
        while True:
            waiting = np.where(done[at], np.inf, far[at])
            alive = waiting.min(1) < np.inf
            at, waiting = at[alive], waiting[alive]
            if not len(at):
                break
            pick = np.argpartition(waiting, expand - 1, 1)[:, :expand] if expand < width else np.argsort(waiting, 1)[:, :expand]
            good = np.take_along_axis(waiting, pick, 1) < np.inf
            done[at[:, None], pick] = True
            found, fresh = [], []
            for j in range(expand):
                near = np.where(good[:, j, None], links[nodes[at, pick[:, j]]], -1)
                fresh.append(~seen[at[:, None], near])
                seen[at[:, None], near] = True
                found.append(near)
            near, new = np.concatenate(found, 1), np.concatenate(fresh, 1)
            row, column = np.nonzero(new)
            to = near[row, column]
            reach = np.full(near.shape, np.inf)
            reach[row, column] = np.maximum(self.squares[to] - 2 * np.einsum("ij,ij->i", self.x[to], points[at[row]]) + own[at[row]], 0)
            every = np.concatenate((far[at], reach), 1)
            keep = np.argpartition(every, width - 1, 1)[:, :width]
            far[at] = np.take_along_axis(every, keep, 1)
            nodes[at] = np.take_along_axis(np.concatenate((nodes[at], near), 1), keep, 1)
            done[at] = np.take_along_axis(np.concatenate((done[at], ~new), 1), keep, 1)
        order = np.argsort(far, 1, kind="stable")
        far, nodes = np.take_along_axis(far, order, 1), np.take_along_axis(nodes, order, 1)
        return np.where(np.isinf(far), -1, nodes), far

    def spread(self, nodes: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` links of each row: nodes that are nearer to the point than to any link before.

        nodes: nearest first, -1 for none."""
        x, squares = self.x[nodes], self.squares[nodes]
        between = squares[:, :, None] + squares[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
        nearest, chosen, count = np.full(nodes.shape, np.inf), np.zeros(nodes.shape, bool), np.zeros(len(nodes), np.int64)
        for c in range(nodes.shape[1]):
            good = (nodes[:, c] >= 0) & (count < most) & (far[:, c] < nearest[:, c])
            chosen[:, c], count = good, count + good
            nearest = np.where(good[:, None], np.minimum(nearest, between[:, c]), nearest)
        order = np.argsort(~chosen, 1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(chosen, order, 1), np.take_along_axis(nodes, order, 1), -1)

    def link_back(self, layer: int, source: np.ndarray, target: np.ndarray) -> None:
        """Links from each target to its source; full lists are cut to what spread() keeps."""
        links = self.layers[layer]
        room, most = links.shape[1], self.shape.links * (1 if layer else 2)
        far = self._far(self.x[target], source[:, None])[:, 0]
        order = np.lexsort((source, far, target))
        source, target = source[order], target[order]
        nodes, start, n = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(start, n)
        had = (links[nodes] >= 0).sum(1)
        fits = np.repeat(had + n <= room, n)
        links[target[fits], (np.repeat(had, n) + place)[fits]] = source[fits]
        for part in np.array_split(np.flatnonzero(had + n > room), max(1, int((had + n > room).sum()) // 256)):
            if not len(part):
                continue
            slot = np.full(len(nodes), -1)
            slot[part] = np.arange(len(part))
            mine = (np.repeat(slot, n) >= 0) & (place < room)
            more = np.full((len(part), room), -1)
            more[np.repeat(slot, n)[mine], place[mine]] = source[mine]
            links[nodes[part]] = self._cut(nodes[part], np.concatenate((links[nodes[part]], more), 1), most, room)

    def _cut(self, nodes: np.ndarray, near: np.ndarray, most: int, room: int) -> np.ndarray:
        far = np.where(near < 0, np.inf, self._far(self.x[nodes], near))
        order = np.argsort(far, 1, kind="stable")
        kept = self.spread(np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1), most)
        return np.concatenate((kept, np.full((len(nodes), room - kept.shape[1]), -1)), 1) if kept.shape[1] < room else kept

    def insert(self, start: int, stop: int, members: np.ndarray) -> None:
        """Nodes start to stop, which no list names yet.  members: nodes of each layer in the end."""
        entry, points, width = np.zeros((stop - start, 1), np.int64), self.x[start:stop], self.shape.build_width
        for layer in range(len(self.layers) - 1, -1, -1):
            joins = int(np.clip(members[layer] - start, 0, stop - start))  # the first nodes of the batch reach higher
            nodes, far = self.beam(points[:joins], entry[:joins], layer, width)
            passing, _ = self.beam(points[joins:], entry[joins:], layer, self.shape.expand)
            if joins:
                batch = np.arange(start, start + joins)
                among = self._far(points[:joins], np.broadcast_to(batch, (joins, joins)))
                np.fill_diagonal(among, np.inf)
                closest = np.argpartition(among, min(width, joins) - 1, 1)[:, :width]
                nodes2, far2 = np.concatenate((nodes, batch[closest]), 1), np.concatenate((far, np.take_along_axis(among, closest, 1)), 1)
                nodes2 = np.where(np.isinf(far2), -1, nodes2)
                order = np.argsort(far2, 1, kind="stable")[:, :width]
                links = self.spread(np.take_along_axis(nodes2, order, 1), np.take_along_axis(far2, order, 1), self.shape.links)
                self.layers[layer][start : start + joins, : links.shape[1]] = links
                row, column = np.nonzero(links >= 0)
                self.link_back(layer, batch[row], links[row, column])
            entry = np.full((stop - start, self.shape.expand), -1)
            entry[:joins] = nodes[:, : self.shape.expand]
            entry[joins:] = passing[:, : self.shape.expand]

    def connect(self) -> None:
        """Give every node of layer 0 a way from node 0: cut lists can leave some that nothing leads to."""
        links = self.layers[0]
        while True:
            reached, front = np.zeros(len(links), bool), np.zeros(1, np.int64)
            reached[0] = True
            while len(front):
                near = np.unique(links[front])
                front = near[(near >= 0) & ~reached[near]]
                reached[front] = True
            lost = np.flatnonzero(~reached)[: self.shape.batch]
            if not len(lost):
                return
            near, _ = self.beam(self.x[lost], np.zeros((len(lost), 1), np.int64), 0, self.shape.build_width)  # of those that are reached
            for node, row in zip(lost.tolist(), near, strict=True):
                row = row[row >= 0]
                free = (links[row] < 0).any(1)
                if free.any():
                    host = row[free.argmax()]
                    links[host, (links[host] < 0).argmax()] = node
                else:  # one more column for all
                    links = self.layers[0] = np.concatenate((links, np.full((len(links), 1), -1)), 1)
                    links[row[0], -1] = node

    def nearest(self, vectors: np.ndarray, width: int) -> np.ndarray:
        """Nodes near each vector, -1 where fewer than width were found."""
        found = []
        for at in range(0, len(vectors), self.shape.batch):
            points = self.moved(vectors[at : at + self.shape.batch])
            entry = np.zeros((len(points), 1), np.int64)
            for layer in range(len(self.layers) - 1, 0, -1):
                entry, _ = self.beam(points, entry, layer, self.shape.expand)
            found.append(self.beam(points, entry, 0, width)[0])
        return np.concatenate(found) if found else np.empty((0, width), np.int64)


def grown(vectors: np.ndarray, shape: Shape) -> tuple[np.ndarray, Graph]:
    """(order of the nodes, the graph of vectors in that order)."""
    rng = np.random.default_rng(SEED)
    level = (-np.log(1 - rng.random(len(vectors))) / np.log(shape.links)).astype(np.int64)
    order = np.lexsort((rng.random(len(vectors)), -level))
    members = np.bincount(level)[::-1].cumsum()[::-1]
    most = [shape.links * (1 if layer else 2) for layer in range(len(members))]
    layers = [np.full((int(n), m + m // 2), -1) for n, m in zip(members, most, strict=True)]
    graph = Graph(vectors[order], layers, shape)
    start = 1
    while start < len(vectors):
        stop = min(len(vectors), start + min(shape.batch, start))
        graph.insert(start, stop, members)
        start = stop
    for layer, (links, m) in enumerate(zip(layers, most, strict=True)):  # lists had room to grow by a half
        long = np.flatnonzero(links[:, m] >= 0)
        for part in np.array_split(long, len(long) // 256 + 1):
            links[part] = graph._cut(part, links[part], m, links.shape[1])
        graph.layers[layer] = links[:, :m].copy()
    graph.connect()
    return order, graph


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of the rows that take part."""
    good = F.col("vec_id").isNotNull() & finite_vector(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(good).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


INDEX = "length int, shard int, members array<int>, widths array<int>, links array<int>, vectors array<double>, ids array<bigint>, ends array<int>"


@dataclass(frozen=True)
class Index:
    """shards: a row of flat arrays for each.  A node keeps the `copies` smallest vec_ids of its vector."""

    shards: DataFrame
    shape: Shape
    copies: int


def _shard_row(length: int, shard: int, ids: np.ndarray, vectors: np.ndarray, shape: Shape, copies: int) -> pa.RecordBatch:
    vectors = vectors + 0.0  # no -0.0
    _, first, node = np.unique(vectors.view([("", vectors.dtype)] * length).ravel(), return_index=True, return_inverse=True)
    nodes, graph = grown(vectors[first], shape)
    place = np.empty(len(nodes), np.int64)
    place[nodes] = np.arange(len(nodes))
    node = place[node.ravel()]
    by = np.lexsort((ids, node))
    node, ids = node[by], ids[by]
    kept = np.arange(len(node)) - np.searchsorted(node, node) < copies
    ends = np.cumsum(np.bincount(node[kept], minlength=len(nodes)))
    flat = np.concatenate([layer.ravel() for layer in graph.layers]).astype(np.int32)
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    columns = [pa.array([length], pa.int32()), pa.array([shard], pa.int32()), one([len(x) for x in graph.layers], pa.int32()), one([x.shape[1] for x in graph.layers], pa.int32()), one(flat, pa.int32()), one(vectors[first][nodes].ravel(), pa.float64()), one(ids[kept], pa.int64()), one(ends.astype(np.int32), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["length", "shard", "members", "widths", "links", "vectors", "ids", "ends"])


def build(vectors: DataFrame, k: int = 10, shape: Shape = Shape()) -> Index:
    """An index of all rows of usable(), for searches of up to k neighbours, in the shared folder."""
    vectors = cut(vectors)
    # a row for each length of vectors, which are as good as always one
    lengths = [(r.length, -(-r.n // shape.shard_rows)) for r in vectors.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n")).orderBy("length").collect()]
    number, total = [], 0
    for length, shards in lengths:
        number.append((length, shards, total))
        total += shards
    dealt = F.broadcast(vectors.sparkSession.createDataFrame(number, "length int, shards int, before int"))
    shard = F.col("before") + F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")
    rows = vectors.withColumn("length", F.size("embedding")).join(dealt, "length").select("length", shard.alias("shard"), "vec_id", "embedding")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, values = None, [], []
        for batch in batches:  # ordered by shard
            length, shard, new = (batch.column(c).to_numpy() for c in ("length", "shard", "vec_id"))
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if ids and key[1] != shard[a]:
                    yield _shard_row(*key, np.concatenate(ids), np.concatenate(values), shape, k + 1)
                    ids, values = [], []
                key = int(length[a]), int(shard[a])
                ids.append(new[a:b])
                values.append(batch.column("embedding").slice(a, b - a).flatten().to_numpy().reshape(b - a, key[0]))
        if ids:
            yield _shard_row(*key, np.concatenate(ids), np.concatenate(values), shape, k + 1)

    # the number of a shard is that of its task; vec_id makes the order of the nodes the same in every run
    dealt = rows.repartitionById(max(total, 1), "shard").sortWithinPartitions("shard", "vec_id")
    return Index(stored(dealt.mapInArrow(shards, INDEX), "neighbour-graphs"), shape, k + 1)


def _answers(shard: pa.Table, queries: pa.Table, shape: Shape, k: int) -> pa.Table:
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if shard.num_rows and queries.num_rows:
        flat = {c: shard.column(c).combine_chunks().flatten().to_numpy() for c in ("members", "widths", "links", "vectors", "ids", "ends")}
        length = shard.column("length")[0].as_py()
        vectors, starts = flat["vectors"].reshape(-1, length), np.concatenate(([0], flat["ends"][:-1])).astype(np.int64)
        cells = np.cumsum(flat["members"].astype(np.int64) * flat["widths"])
        layers = [x.reshape(int(n), -1) for x, n in zip(np.split(flat["links"], cells[:-1]), flat["members"], strict=True)]
        graph = Graph(vectors, layers, shape)
        asked, points = queries.column("query_id").to_numpy(), queries.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, length)
        for query, point, nodes in zip(asked, points, graph.nearest(points, max(shape.search_width, k + 1)), strict=True):
            nodes = nodes[nodes >= 0]
            score = np.sqrt(((vectors[nodes] - point) ** 2).sum(1))
            nodes, score = (x[np.lexsort((flat["ids"][starts[nodes]], score))[: k + 1]] for x in (nodes, score))
            n = flat["ends"][nodes] - starts[nodes]
            ids = flat["ids"][np.repeat(starts[nodes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            keep = ids != query
            ids, score = ids[keep], np.repeat(score, n)[keep]
            first = np.lexsort((ids, score))[:k]
            out.append((np.full(len(first), query), ids[first], score[first]))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k nearest that were found, all if there are fewer.

    queries: vec_id, embedding like those of usable(); k: at most that of the index."""
    if k + 1 > index.copies:
        raise ValueError(f"the index keeps {index.copies} copies of a vector, {k + 1} are needed")
    shape = index.shape
    asked = cut(queries.select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("length")))
    blocks = -(-asked.count() // shape.query_block)
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1))).cast("int").alias("block")
    numbers = index.shards.select("length", F.col("shard").alias("to"))
    asked = asked.select("*", block).join(numbers, "length").select("to", F.col("block").alias("part"), "query_id", "embedding")
    shards = index.shards.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))).alias("block"))
    found = shards.groupBy("shard", "block").cogroup(asked.groupBy("to", "part")).applyInArrow(lambda left, right: _answers(left, right, shape, k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
