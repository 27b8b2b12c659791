"""Ranked lexical search over an inverted index with variable blocks of postings.

A shard is a run of documents of one task, bounded by documents and by postings.  Its
lists hold local document numbers in the order of doc_id and the impact of each posting:
the part of a score that does not depend on how rare the term is.  Dynamic programming
cuts every list into blocks so that the bound error - block size times highest impact,
less the impacts - plus a price per block is least, over all cuts into blocks of at most
`widest` postings; all lists of a shard are solved at once, position by position.

A search adds up, for every document number, the highest impacts of the blocks that
span it, times the terms' weights - of a block with wide gaps only at its own documents,
where a cursor would stand: the WAND test with block bounds, made for all numbers of a
shard in one pass instead of one pivot at a time.  Documents are then scored in the
order of their bounds, in steps that grow, reading only blocks that span one of them, and
it ends when the next bound lies below the k-th best score.  So every document that is
skipped is proven not to be among the best, and results are exact, ties included.

Queries are taken in blocks of bounded size; the lists of a block's terms meet by shard,
and the best of all shards by query.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond
ASCII, with only A-Z lower-cased.  Scores are whole numbers, see weight() and impacts().

Defined results: null texts and texts without a term are no documents and ask for nothing;
repeated rows are documents, or queries, each by itself, and equal scores stand in the
order of doc_id, a null doc_id last; an empty table gives an empty table; columns other
than doc_id and text, or the query's id and text, are not read.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import stored

#: bytes to bytes: letters and digits, A-Z as a-z, bytes of characters beyond ASCII; all others to a blank
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
LAST = (1 << 63) - 1
#: documents scored in the first step; each step has four times as many
STEP = 256
#: a block that spans more than so many document numbers for each posting has wide gaps
GAPS = 4
#: terms of a shard that are written in one batch
TERMS = 4096


@dataclass(frozen=True)
class Layout:
    #: a shard is closed at this number of documents or postings, whichever comes first
    documents: int = 16_384
    postings: int = 4_000_000
    #: most postings in a block, and the bound error a further block must save
    widest: int = 64
    price: int = 1_000_000
    #: a block of queries is closed at this number of queries or bytes of text
    queries: int = 1000
    query_bytes: int = 8 << 20


@dataclass(frozen=True)
class Index:
    """postings: shard, term, n, docs, impacts, ends, tops.  shards: number, doc_ids.  Both are stored tables."""

    postings: DataFrame
    shards: DataFrame
    documents: int
    terms: int
    layout: Layout


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, size: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What an occurrence count adds to a score for each unit of weight; size: terms of the document."""
    m = 100 - 75 + (75 * size * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def block_ends(values: np.ndarray, starts: np.ndarray, widest: int, price: int) -> np.ndarray:
    """True at the last posting of every block.  values: all lists one after another; starts: where each begins, and the end.

    best[j] = min over i of best[i] + price + (j - i) * max(values[i:j]); the sum of the values is the
    same for all cuts.  Numbers stay below 2^53, so float64 holds them exactly.
    """
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    first, size = starts[:-1][order], size[order]
    came = np.zeros(len(values), np.int32)
    best = np.zeros(len(first))
    highest = np.zeros((widest, len(first)))
    before = np.zeros((widest, len(first)))
    begins = np.zeros(widest, np.int64)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # lists longer than j stand first
    for j in range(longest):
        a = int(active[j])
        if a < highest.shape[1] // 2:
            highest, before, best, first = (np.ascontiguousarray(x[..., :a]) for x in (highest, before, best, first))
        at, slot, used = first[:a] + j, j % widest, min(j + 1, widest)
        value = values[at].astype(np.float64)
        highest[slot, :a] = 0
        before[slot, :a] = best[:a] * widest + slot  # the slot rides along in the low digits
        begins[slot] = j
        top = highest[:used, :a]
        np.maximum(top, value, out=top)
        found = (top * ((j + 1 - begins[:used]) * float(widest))[:, None] + before[:used, :a]).min(0)
        chosen = (found % widest).astype(np.int64)
        best[:a] = (found - chosen) / widest + price
        came[at] = begins[chosen]
    last = np.zeros(len(values), bool)
    first, left = starts[:-1][order], size.copy()
    while len(left):
        alive = left > 0
        first, left = first[alive], left[alive]
        at = first + left - 1
        last[at] = True
        left = came[at].astype(np.int64)
    return last


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


class _Run:
    """Documents of a shard under construction."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids, self.sizes, self.distinct = [], [], []
        self.term, self.tf = array("i"), array("q")

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        counts = Counter(terms)
        number = self.numbers
        self.term.extend([number.setdefault(t, len(number)) for t in counts])
        self.tf.extend(counts.values())
        self.ids.append(doc_id)
        self.sizes.append(len(terms))
        self.distinct.append(len(counts))

    def rows(self, shard: int, documents: int, terms: int, layout: Layout) -> Iterator[pa.RecordBatch]:
        order = np.argsort(np.array([LAST if i is None else i for i in self.ids], np.int64), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, self.distinct)
        impact = impacts(np.array(self.tf, np.int64), np.repeat(np.array(self.sizes, np.int64), self.distinct), documents, terms)
        term = np.array(self.term, np.int64)
        by = np.argsort(term * len(order) + doc)
        doc, impact = doc[by], impact[by]
        starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(self.numbers)))))
        last = block_ends(impact, starts, layout.widest, layout.price)
        ends = np.flatnonzero(last) + 1
        tops = np.maximum.reduceat(impact, np.concatenate(([0], ends[:-1])))
        blocks = np.concatenate(([0], np.cumsum(np.add.reduceat(last.astype(np.int64), starts[:-1]))))
        ends -= np.repeat(starts[:-1], np.diff(blocks))
        names = list(self.numbers)
        for a in range(0, len(names), TERMS):
            b = min(a + TERMS, len(names))
            p, q = slice(starts[a], starts[b]), slice(blocks[a], blocks[b])
            lists = [_lists(starts[a : b + 1] - starts[a], x[p]) for x in (doc, impact)] + [_lists(blocks[a : b + 1] - blocks[a], x[q]) for x in (ends, tops)]
            yield _index_batch(shard, pa.array(names[a:b], pa.binary()), np.diff(starts[a : b + 1]), lists, pa.nulls(b - a, pa.list_(pa.int64())))
        ids = pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64()))
        yield _index_batch(shard, pa.nulls(1, pa.binary()), np.zeros(1), [pa.nulls(1, pa.list_(pa.int32()))] * 4, ids)


def _index_batch(shard: int, term: pa.Array, n: np.ndarray, lists: list[pa.Array], ids: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard] * len(term), pa.int64()), term, pa.array(n.astype(np.int32)), *lists, ids], ["shard", "term", "n", "docs", "impacts", "ends", "tops", "doc_ids"])


def statistics(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, their terms with repeats)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in batches:
            for text in batch.column(0):
                n = len(terms_of(text.as_py() or b""))
                documents, terms = documents + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], ["documents", "terms"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(sums, "documents bigint, terms bigint")
    total = found.agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).first()
    return total.documents or 0, total.terms or 0


def build(docs: DataFrame, layout: Layout = Layout()) -> Index:
    """An index of all terms of all documents, in the shared folder."""
    documents, terms = statistics(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, run = TaskContext.get().partitionId() << 24, _Run()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if found := terms_of(text.as_py() or b""):
                    run.add(doc_id, found)
                if len(run.ids) >= layout.documents or len(run.term) >= layout.postings:
                    yield from run.rows(shard, documents, terms, layout)
                    shard, run = shard + 1, _Run()
        if run.ids:
            yield from run.rows(shard, documents, terms, layout)

    schema = "shard bigint, term binary, n int, docs array<int>, impacts array<int>, ends array<int>, tops array<int>, doc_ids array<bigint>"
    table = stored(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(rows, schema), "lexical-index")
    return Index(table.where("term IS NOT NULL").drop("doc_ids"), table.where("term IS NULL").select(F.col("shard").alias("number"), "doc_ids"), documents, terms, layout)


class _Shard:
    """The lists of some terms of a shard."""

    def __init__(self, table: pa.Table, size: int) -> None:
        self.size, self.at = size, {t: i for i, t in enumerate(table.column("t").to_pylist())}
        lists = {c: table.column(c).combine_chunks() for c in ("docs", "impacts", "ends", "tops")}
        self.docs, self.impacts, self.ends, self.tops = (lists[c].flatten().to_numpy().astype(np.int64) for c in lists)
        self.posting, self.block = (np.concatenate(([0], np.cumsum(lists[c].value_lengths().to_numpy()))).astype(np.int64) for c in ("docs", "ends"))
        stop = self.ends + np.repeat(self.posting[:-1], np.diff(self.block))
        self.length = np.diff(np.concatenate(([0], stop)))  # of every block; lists and their blocks leave no gaps
        self.first, self.last = self.docs[stop - self.length], self.docs[stop - 1]

    def best(self, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(local numbers, scores) of the k best documents above 0, best first."""
        nobody = np.empty(0, np.int64), np.empty(0, np.int64)
        present = [(self.at[t], w) for t, w in query if t in self.at]
        if not present:
            return nobody
        slices = lambda edge: np.concatenate([np.arange(edge[i], edge[i + 1]) for i, _ in present])
        blocks, postings = slices(self.block), slices(self.posting)
        factor = np.array([w for _, w in present], np.int64)
        tops = self.tops[blocks] * np.repeat(factor, [self.block[i + 1] - self.block[i] for i, _ in present])
        first, last, length = self.first[blocks], self.last[blocks], self.length[blocks]
        docs = self.docs[postings]
        gains = self.impacts[postings] * np.repeat(factor, [self.posting[i + 1] - self.posting[i] for i, _ in present])
        # whole numbers far below 2^53, which float64 holds exactly
        wide = last - first >= GAPS * length
        rise = np.bincount(first[~wide], tops[~wide], self.size + 1) - np.bincount(last[~wide] + 1, tops[~wide], self.size + 1)
        bound = np.cumsum(rise)[: self.size] + np.bincount(docs[np.repeat(wide, length)], np.repeat(tops[wide], length[wide]), self.size)
        order = np.argsort(-bound, kind="stable")
        order = order[: np.searchsorted(-bound[order], 0)]  # bounds above 0
        found, scores, least, at, step = *nobody, 1, 0, STEP
        while at < len(order) and bound[order[at]] >= least:
            next_docs = order[at : at + step]
            next_docs = next_docs[bound[next_docs] >= least]
            wanted = np.zeros(self.size + 1, bool)
            wanted[next_docs + 1] = True
            upto = np.cumsum(wanted)
            read = np.repeat(upto[last + 1] > upto[first], length)  # postings of blocks that span a wanted document
            total = np.bincount(docs[read], gains[read], self.size)[next_docs].astype(np.int64)
            found, scores = np.concatenate((found, next_docs[total > 0])), np.concatenate((scores, total[total > 0]))
            keep = np.lexsort((found, -scores))[:k]
            found, scores = found[keep], scores[keep]
            least = int(scores[-1]) if len(scores) == k else 1
            at, step = at + step, step * 4
        return found, scores


def _query_blocks(queries: DataFrame, key: str, layout: Layout) -> Iterator[list[tuple[object, Counter]]]:
    block, size = [], 0
    for row in queries.select(key, F.col("text").cast("binary").alias("text")).toLocalIterator():
        if terms := terms_of(bytes(row[1] or b"")):
            block.append((row[0], Counter(terms)))
            size += len(row[1])
        if len(block) >= layout.queries or size >= layout.query_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search_block(index: Index, block: list[tuple[object, Counter]], key: str, kind: str, k: int) -> DataFrame:
    spark = index.postings.sparkSession
    terms = sorted({t for _, counts in block for t in counts})
    # bounded by the bytes of a block of queries
    names = F.broadcast(spark.createDataFrame([Row(t=i, term=bytearray(t)) for i, t in enumerate(terms)], "t int, term binary"))
    lists = index.postings.join(names, "term").drop("term")
    holding = {r.t: r.n for r in lists.groupBy("t").agg(F.sum("n").alias("n")).collect()}
    weights = {i: weight(index.documents, n) for i, n in holding.items()}
    number = {t: i for i, t in enumerate(terms)}
    asked = [[(number[t], weights[number[t]] * times) for t, times in counts.items() if weights.get(number[t], 0) > 0] for _, counts in block]

    def search(_: tuple, found: pa.Table, shard: pa.Table) -> pa.Table:
        ids = shard.column("doc_ids").combine_chunks().flatten()
        lists, out = _Shard(found, len(ids)), []
        for i, query in enumerate(asked):
            docs, scores = lists.best(query, k)
            out.append((np.full(len(docs), i), docs, scores))
        query, docs, scores = (np.concatenate(x) if out else np.empty(0, np.int64) for x in zip(*out, strict=True))
        return pa.table([pa.array(query, pa.int32()), ids.take(pa.array(docs)), pa.array(scores)], ["_query", "doc_id", "score"])

    lists = lists.select("shard", "t", "docs", "impacts", "ends", "tops")
    found = lists.groupBy("shard").cogroup(index.shards.groupBy("number")).applyInArrow(search, "_query int, doc_id bigint, score bigint")
    best = Window.partitionBy("_query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    asking = F.broadcast(spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], f"_query int, {key} {kind}"))
    return ranked.join(asking, "_query").select(key, "rank", "doc_id", "score")


def search(index: Index, queries: DataFrame, k: int = 10, key: str = "item_id") -> DataFrame:
    """key, rank from 1, doc_id, score: the k best documents of each query, all with a score above 0 if fewer."""
    kind = dict(queries.dtypes)[key]
    blocks = _query_blocks(queries, key, index.layout)
    found = [_search_block(index, block, key, kind, k) for block in blocks] if index.documents else []
    if len(found) > 1:
        found = [stored(x, "lexical-found") for x in found]
    out = found[0] if found else queries.sparkSession.createDataFrame([], f"{key} {kind}, rank int, doc_id bigint, score bigint")
    for more in found[1:]:
        out = out.unionByName(more)
    return out
