"""Near-duplicate classes by ProbMinHash.

Every shingle of five words (all words of a shorter text) is an element, its
count the weight.  An element's arrivals form a Poisson process of that rate;
each arrival hits a random register, which keeps the earliest arrival and the
element behind it.  An element stops as soon as its next arrival is later than
the latest register, so long texts cost little more than one arrival per
element.  The share of equal registers estimates the probability Jaccard
similarity.  A text with a repeated shingle has a second sketch with weight 1 for
each, whose registers estimate the Jaccard similarity of the sets.  Registers are
banded; texts that share a band of either sketch are candidates, and every link
is confirmed on the shingle sets themselves: the estimate of 256 registers has a
standard error of 0.025 at 0.8, so it finds candidates and decides nothing.

A text, not a row, is the unit: each different text is one node, whose number is
fixed by a checkpoint, and doc_ids come back at the end.  So rows that repeat a
doc_id with other texts, in any order, lose no link.

Links are looked for in two steps, neither of which emits the pairs of a group.
First every text is compared with the smallest one of each of its bands.  Then,
in each band that still holds several classes, the texts outside its largest
class are compared with all of the band, block by block: a block of queries
against a block of members is one row, and a sparse product counts the common
shingles of all its pairs.  Bands with the same members count once.  So no link
among candidates is lost, texts that share no band are never compared, and a band
that collapses onto its centre costs one comparison per text.

Defined results: texts without a word are similar only if equal; a null text
equals an empty one and null ids are not classed (class_id is null); equal texts
always share a class; the class id is the smallest doc_id of the class; repeated
doc_ids share the class of all their texts; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import cut, spread_join


@dataclass(frozen=True)
class NearDup:
    shingle: int = 5
    registers: int = 256
    rows: int = 8  # registers in a band: 32 bands of the even sketch find a pair of set Jaccard 0.8 with probability 0.997, 0.85 with 0.9999
    block: int = 128  # texts of one block of a group
    block_bytes: int = 1 << 21  # bytes of sets in one block, but for a longer one
    similarity: float = 0.8


def shingles(symbols: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each shingle; a text of fewer than k words is one shingle."""
    n = np.diff(at)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), counts)
    first = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(len(text))
    return text, hashing.span_hashes(symbols, first, np.minimum(first + k, at[1:][text]))


def weighted(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with counts, ordered by text and hash."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def sketch(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """(n_texts, m) elements behind the earliest arrivals; 0 where a text has no element."""
    time = np.full(n_texts * m, np.inf)
    who = np.zeros(n_texts * m, np.uint64)
    latest = np.full(n_texts, np.inf)
    step, arrival = 0, np.zeros(len(h))
    rate = weight.astype(np.float64)
    while len(h):
        step += 1
        r = hashing.mix(h + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        arrival = arrival - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        go = arrival < latest[text]  # early termination
        text, h, rate, arrival, r = text[go], h[go], rate[go], arrival[go], r[go]
        slot = text * m + (hashing.mix(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(time, slot, arrival)
        won = time[slot] == arrival
        who[slot[won]] = h[won]
        latest = time.reshape(n_texts, m).max(axis=1)
    return who.reshape(n_texts, m)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated probability Jaccard similarity of two sketches."""
    return float((a == b).mean())


def _per_chunk(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = hashing.texts(batch.column("text"))
    for lo, hi in hashing.pieces(offsets):
        part = offsets[lo : hi + 1]
        h, _, _, at = hashing.word_hashes(data[part[0] : part[-1]], part - part[0])
        yield lo, hi, *weighted(*shingles(h, at, k))


def banded(regs: np.ndarray, r: int) -> np.ndarray:
    """(n_texts, bands) hashes of r neighbouring registers and their place."""
    n, each = regs.size // r, regs.shape[1] // r
    bands = hashing.Runs(regs.reshape(-1)).at(np.arange(n) * r, np.arange(1, n + 1) * r).reshape(-1, each)
    return hashing.signed(hashing.mix(bands + np.arange(each, dtype=np.uint64)))


def sketched(docs: DataFrame, settings: NearDup) -> DataFrame:
    """doc_id, _k (hash of the text), bands: one pass over the texts, which are not shuffled."""
    m, r, k = settings.registers, settings.rows, settings.shingle

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text, h, weight in _per_chunk(batch, k):
                regs = sketch(text, h, weight, hi - lo, m)
                listed = [b if ok else None for b, ok in zip(banded(regs, r), regs.any(axis=1), strict=True)]
                # with weight 1 the registers of the others agree with the share of the set Jaccard
                counted = np.unique(text[weight > 1])
                pick = np.isin(text, counted)
                even = sketch(np.searchsorted(counted, text[pick]), h[pick], np.ones(int(pick.sum())), len(counted), m)
                for i, b in zip(counted, banded(even, r), strict=True):
                    listed[i] = np.union1d(listed[i], b)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("_k").slice(lo, hi - lo), pa.array(listed, pa.list_(pa.int64()))], ["doc_id", "_k", "bands"])

    return docs.select("doc_id", text_key().alias("_k"), "text").mapInArrow(rows, "doc_id bigint, _k string, bands array<bigint>")


def shingle_sets(texts: DataFrame, settings: NearDup) -> DataFrame:
    """id, set: the distinct shingle hashes of a text, sorted, as bytes."""
    k = settings.shingle

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text, h, _ in _per_chunk(batch, k):
                at = np.searchsorted(text, np.arange(hi - lo + 1))
                sets = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(sets, pa.binary())], ["id", "set"])

    return texts.select("id", "text").mapInArrow(rows, "id bigint, set binary")


def _jaccard(a: bytes, b: bytes, similarity: float = 0.0) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return 0.0  # even a subset would not reach it
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(x) + len(y) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets reach the similarity.  A hot a, the centre of many, is dealt by b."""
    both = spread_join(pairs, sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), ["a"], ["b"], "inner")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column("sa"), batch.column("sb")
            good = [_jaccard(x.as_py(), y.as_py(), similarity) >= similarity for x, y in zip(sa, sb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(rows, "a bigint, b bigint")


def _block_links(left: tuple, right: tuple, similarity: float) -> list[tuple[int, int]]:
    """Links between members (ids, labels, sets) of two blocks; one for each pair of classes is enough."""
    (ia, la, sa), (ib, lb, sb) = left, right
    sets = [np.frombuffer(x, np.uint64) for x in (*sa, *sb)]
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    codes, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[inverse] > 1  # a shingle of one document adds nothing to an intersection
    column = (np.cumsum(count > 1) - 1)[inverse[shared]]
    owner, n, width = owner[shared], len(ia), 1 << 14
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((n, len(ib)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        cells = np.zeros((len(sets), width), np.float32)
        cells[owner[a:b], column[a:b] - lo] = 1
        common += cells[:n] @ cells[n:].T
    union = size[:n, None] + size[None, n:] - common
    near = (common >= similarity * union - 1e-4) & (np.array(la)[:, None] != np.array(lb)[None, :])
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for x, y in zip(*np.nonzero(near), strict=True):
        found.setdefault((la[x], lb[y]), (ia[x], ib[y]))
    return [(min(p), max(p)) for p in found.values()]


def block_links(members: DataFrame, settings: NearDup) -> DataFrame:
    """Links across classes of members(id, comp, label, set) in the groups comp that hold several."""
    sized = members.groupBy("comp", "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("set")).alias("z"))
    whole = sized.groupBy("comp").agg(F.max_by("label", F.struct("n", "label")).alias("big"), F.sum("n").alias("_all"), F.sum("z").alias("_bytes"), F.max("n").alias("_most"), F.max_by("z", F.struct("n", "label")).alias("_rest")).where("_all > _most")
    whole = whole.select("comp", "big", "_all", "_bytes", (F.col("_all") - F.col("_most")).alias("_few"), (F.col("_bytes") - F.col("_rest")).alias("_few_bytes"))
    rows = cut(spread_join(members, whole, ["comp"], ["id"], "inner"))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda n, z: F.greatest(F.ceil(F.col(n) / settings.block), F.ceil(F.col(z) / settings.block_bytes)).cast("long")

    def gathered(df: DataFrame, seed: int, n: str, z: str, name: str) -> DataFrame:
        # dealt by group and block: the blocks of a large group lie in different tasks
        df = df.withColumn("_b", F.pmod(F.xxhash64("id", F.lit(seed)), count(n, z))).repartition(parts, "comp", "_b")
        return df.groupBy("comp", "_b").agg(F.collect_list(F.struct("id", "label", "set")).alias(name), F.first(count("_all", "_bytes")).alias("_blocks"))

    queries = gathered(rows.where("label <> big"), 1, "_few", "_few_bytes", "q")
    against = gathered(rows, 2, "_all", "_bytes", "m")
    # each query block names the member blocks it meets, so that the join is dealt by both
    meets = queries.select("comp", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_b"))
    tasks = meets.join(against.select("comp", "_b", "m"), ["comp", "_b"]).select("q", "m")
    similarity = settings.similarity

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(x: list) -> tuple:
            return [r["id"] for r in x], [r["label"] for r in x], [r["set"] for r in x]

        for batch in batches:
            for i in range(batch.num_rows):
                found = _block_links(block(batch.column("q")[i].as_py()), block(batch.column("m")[i].as_py()), similarity)
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    return tasks.repartition(parts).mapInArrow(links, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """id, root (smallest id of its component) of all ids in links(a, b), by large and small stars.

    Each half-step is an aggregation and a join by key, with constant work per link; a hot centre's
    links are on the streamed side of the join.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


#: stands for a null doc_id where rows without one take part
NO_ID = (1 << 63) - 1


def text_key() -> F.Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def links_between(bands: DataFrame, docs: DataFrame, named: DataFrame, settings: NearDup) -> DataFrame:
    """Confirmed links (a, b) that span each class.  bands(id, band); named(id, doc_id, _k): the rows of docs that stand for the ids."""
    # groups of one are dropped; a count by band combines before the shuffle
    shared = cut(bands.groupBy("band").agg(F.count("*").alias("_n"), F.min("id").alias("a")).where("_n > 1"))
    sizes = shared.select("band", "_n")
    bands = cut(spread_join(bands, shared.select("band", "a"), ["band"], ["id"], "inner", sizes))
    # texts are shuffled once, and only against the ids that have a candidate
    wanted = cut(named.join(bands.select("id").distinct(), "id", "left_semi"))
    texts = docs.select("doc_id", text_key().alias("_k"), "text").join(wanted, ["doc_id", "_k"]).dropDuplicates(["doc_id", "_k"])
    sets = cut(shingle_sets(texts, settings))
    stars = cut(bands.where("a <> id").select("a", F.col("id").alias("b")).distinct())
    links = cut(confirmed(stars, sets, settings.similarity))
    # what is left: bands of several classes, once for all bands of the same members
    labels = cut(components(links))
    marked = cut(bands.select("id", "band").join(labels, "id", "left").select("id", "band", F.coalesce("root", "id").alias("label")))
    open_bands = marked.groupBy("band").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count("*").alias("_n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("_sum")).where("_lo <> _hi")
    open_bands = cut(open_bands.groupBy("_n", "_sum").agg(F.min("band").alias("band")))
    members = spread_join(marked, open_bands.select("band", F.lit(True).alias("_open")), ["band"], ["id"], "inner", open_bands.select("band", "_n"))
    members = members.select("id", F.col("band").alias("comp"), "label").join(sets, "id")
    return links.unionByName(cut(block_links(cut(members), settings)))


def linked(docs: DataFrame, settings: NearDup) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows(doc_id, _k), nodes(_k, text_id, _n, id) of the different texts with an id, links(a, b) between nodes."""
    rows = cut(sketched(docs, settings))
    # one node for each different text; the checkpoint fixes its number
    firsts = rows.where("doc_id is not null").groupBy("_k").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("_n"))
    nodes = cut(firsts.withColumn("id", F.monotonically_increasing_id()))
    named = nodes.select(F.col("text_id").alias("doc_id"), "_k", "id")
    bands = rows.join(named, ["doc_id", "_k"]).select("id", F.explode("bands").alias("band")).distinct()
    return rows.select("doc_id", "_k"), nodes, links_between(bands, docs, named, settings)


def classes(docs: DataFrame, settings: NearDup = NearDup()) -> DataFrame:
    """doc_id, class_id, text_id (smallest doc_id with the equal text)."""
    rows, nodes, found = linked(docs, settings)
    ids = cut(spread_join(rows, nodes.select("_k", "id", "text_id"), ["_k"], ["doc_id"], "left", nodes.select("_k", "_n")))
    # texts under one repeated doc_id belong together
    repeated = ids.where("doc_id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("_hi")).where("a <> _hi")
    ties = ids.join(repeated, "doc_id").select("a", F.col("id").alias("b")).where("a <> b")
    roots = components(found.unionByName(ties)).join(nodes.select("id", "text_id"), "id")
    least = cut(roots.groupBy("root").agg(F.min("text_id").alias("class_id"), F.count("*").alias("_n")))
    roots = cut(spread_join(roots.select("root", "id"), least.select("root", "class_id"), ["root"], ["id"], "left", least.select("root", "_n")).select("id", "class_id"))
    out = spread_join(ids, roots, ["id"], ["doc_id"], "left", nodes.select("id", "_n"))
    owned = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(owned, F.coalesce("class_id", "text_id")).alias("class_id"), F.when(owned, F.col("text_id")).alias("text_id"))


def deduplicated(docs: DataFrame, settings: NearDup = NearDup()) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id, then text hash.

    A row without an id comes after all others, and stays if it is a copy of none.  Texts that only share a
    doc_id are no copies of each other, so each stays unless it is a copy of another text; of rows equal in
    doc_id and text one stays.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.struct(*docs.columns).alias("_row"))
    _, nodes, found = linked(docs, settings)
    held = nodes.join(components(found), "id", "left").withColumn("_class", F.coalesce("root", "id"))
    best = held.groupBy("_class").agg(F.min(F.struct("text_id", "_k")).alias("_x")).select(F.col("_x.text_id").alias("doc_id"), "_x._k")
    rows = docs.select("doc_id", text_key().alias("_k"), "_row")  # the text travels once, in its row
    return rows.join(best, ["doc_id", "_k"], "left_semi").dropDuplicates(["doc_id", "_k"]).select("_row.*")
