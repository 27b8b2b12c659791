"""Lexical search, neighbour graphs and vector codes against brute force, with nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lemmaweave.llm import lexical_search, neighbour_graph, vector_codes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, item_id int, score string, rank string"


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(A_TO_Z))


@pytest.fixture(scope="module")
def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Äpfel", "ÄPFEL", "naïve", "x²", "日本", "a b"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    out: list = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 90)))) for i in range(400)]
    out += [(500 + i, out[7][1]) for i in range(30)]  # equal scores
    out += [(7, out[7][1]), (7, "W1 w2-w3"), (None, out[7][1]), (600, ""), (601, None), (602, " .,; \x7f"), (603, "w1 " * 5000), (604, "Zebra zebra_ZEBRA"), (605, "É é")]
    return out


def ranked(corpus, queries, k: int = 10) -> Counter:
    docs = [(i, Counter(terms(t))) for i, t in corpus if terms(t)]
    n, total, holding = len(docs), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    want = Counter()
    for item, text in queries:
        scores = []
        for i, c in docs:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in Counter(terms(text)).items() if c[t])
            if score > 0:
                scores.append((-score, 1 << 63 if i is None else i, i))
        want.update((item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1))
    return want


QUERIES = [(1, "w1 w2 w2 W3"), (2, "zebra"), (3, "äpfel ÄPFEL É"), (4, None), (5, "unknown"), (6, ""), (None, "w5"), (1, "w9 日本"), (7, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("layout", [lexical_search.Layout(), lexical_search.Layout(documents=37, postings=900, widest=5, price=20_000, queries=2)])
def test_search_is_exact(spark, corpus, layout, monkeypatch):
    monkeypatch.setattr(lexical_search, "STEP", 8)
    docs = spark.createDataFrame([(i, t, 0, "s", "r") for i, t in corpus], DOCS).repartition(3)
    queries = spark.createDataFrame([(q, t, -1, "s") for q, t in QUERIES], "item_id int, text string, doc_id int, rank string")
    got = Counter(tuple(r) for r in lexical_search.search(lexical_search.build(docs, layout), queries).select("item_id", "rank", "doc_id", "score").collect())
    assert got == ranked(corpus, QUERIES) and len(got) > 40


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    queries = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert lexical_search.search(lexical_search.build(docs), queries).count() == 0
    some = spark.createDataFrame([(1, "a", 0, "", "")], DOCS)
    assert lexical_search.search(lexical_search.build(some), queries.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.search(lexical_search.build(some), queries).count() == 1


def test_blocks_have_the_least_bound_error():
    rng = np.random.default_rng(5)
    for widest, price in ((4, 10), (16, 700), (64, 5000)):
        size = rng.integers(1, 150, 9)
        starts = np.concatenate(([0], np.cumsum(size)))
        values = rng.integers(1, 1000, starts[-1])
        last = lexical_search.block_ends(values, starts, widest, price)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            x = values[a:b]
            best = [0] + [math.inf] * len(x)
            for j in range(1, len(x) + 1):
                best[j] = min(best[i] + price + (j - i) * x[i:j].max() for i in range(max(0, j - widest), j))
            ends = [0, *(np.flatnonzero(last[a:b]) + 1)]
            assert ends[-1] == len(x)
            assert sum(price + (q - p) * x[p:q].max() for p, q in zip(ends[:-1], ends[1:], strict=True)) == best[-1]


def test_search_skips_blocks():
    """A rare term decides: of the common one only few postings are read."""
    run = lexical_search._Run()
    for i in range(4000):
        run.add(i, [b"common"] * (1 + i % 3) + ([b"rare"] if i % 400 == 0 else []) + [b"x%d" % i])
    batches = list(run.rows(0, 4000, 12_000, lexical_search.Layout()))
    table = lexical_search.pa.Table.from_batches([b for b in batches if b.column("term")[0].is_valid])
    keep = [table.column("term").to_pylist().index(t) for t in (b"common", b"rare")]
    shard = lexical_search._Shard(table.take(keep).append_column("t", lexical_search.pa.array([0, 1])), 4000)
    steps = []
    bincount = np.bincount

    def watched(x, weights=None, minlength=0):
        steps.append(len(x))
        return bincount(x, weights, minlength)

    np.bincount = watched
    try:
        docs, _ = shard.best([(0, 1), (1, 6000)], 5)
    finally:
        np.bincount = bincount
    assert all(d % 400 == 0 for d in docs.tolist()) and sum(steps[3:]) < 1500  # of 4010 postings


VECTORS = "vec_id bigint, embedding array<float>, label int, query_id string, score int, rank string"


@pytest.fixture(scope="module")
def vectors() -> list[tuple[int | None, list | None, int | None]]:
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(8, 32))
    x = np.concatenate([rng.normal(size=(900, 32)), centres[rng.integers(0, 8, 600)] + 0.1 * rng.normal(size=(600, 32))]).astype(np.float32)
    out: list = [(i, v.tolist(), i % 5 if i % 7 else None) for i, v in enumerate(x)]
    out += [(2000 + i, x[100].tolist(), 1) for i in range(300)]  # copies
    out += [(50, x[50].tolist(), 0), (60, x[61].tolist(), 0), (None, x[3].tolist(), 2)]  # repeated rows
    bad = x[5].tolist()
    out += [(3000, None, 1), (3100, [0.0] * 32, 1), (3200, [float("nan"), *bad[1:]], 1), (3300, [float("inf"), *bad[1:]], 1), (3400, [None, *bad[1:]], 1), (3500, [], 1)]
    out += [(3600, [1.0, 2.0], 1), (3601, [1.0, 2.5], 1), (3700, [-0.0, *bad[1:]], 1), (3701, [0.0, *bad[1:]], 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "q", 9, "r") for i, v, label in rows], VECTORS).repartition(3)


def test_neighbours_recall_and_form(spark, vectors):
    good = defaultdict(list)
    for i, v, _ in vectors:
        if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v):
            good[i].append(v)
    good = {i: np.array(min(v), np.float64) for i, v in good.items()}
    want = {}
    for q in (i for i in good if i % 50 == 0):
        far = sorted((float(np.sqrt(((good[i] - good[q]) ** 2).sum())), i) for i in good if i != q and len(good[i]) == len(good[q]))
        want[q] = far[:10]
    shape = neighbour_graph.Shape(shard_rows=500, batch=64, query_block=16)
    rows = neighbour_graph.usable(frame(spark, vectors))
    index = neighbour_graph.build(rows, 10, shape)
    assert index.shards.count() == 5  # 4 of the long vectors, 1 of the short ones
    got = defaultdict(list)
    for r in neighbour_graph.search(index, rows.where("vec_id % 50 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id]) and r.score == pytest.approx(np.linalg.norm(good[r.vec_id] - good[r.query_id]), rel=1e-12)
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    assert all(x == sorted(x) and q not in [i for _, i in x] for q, x in got.items())
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / len(want[q]) for q in want]) >= 0.9
    assert [i for _, i in got[100]] == list(range(2000, 2010))  # copies: the smallest ids
    assert got[3600] == [(0.5, 3601)]


def test_neighbours_of_few_rows(spark):
    few = frame(spark, [(0, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (7, [0.0, 1.0], None)])
    rows = neighbour_graph.usable(few)
    got = [tuple(r) for r in neighbour_graph.search(neighbour_graph.build(rows), rows.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, math.sqrt(2)), (0, 2, 100, math.sqrt(2)), (100, 1, 7, 0.0), (100, 2, 0, math.sqrt(2))]
    none = neighbour_graph.usable(frame(spark, [(0, None, 1)]))
    assert neighbour_graph.search(neighbour_graph.build(none), none).count() == 0


def test_graph_reaches_every_node():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(700, 16)), 1e-6 * rng.normal(size=(700, 16)) + 5])
    order, graph = neighbour_graph.grown(x, neighbour_graph.Shape(batch=64))
    assert sorted(order.tolist()) == list(range(1400))
    reached, front = {0}, [0]
    while front:
        front = [n for i in front for n in graph.layers[0][i].tolist() if n >= 0 and not (n in reached or reached.add(n))]
    assert len(reached) == 1400
    found = graph.nearest(x[order], 100)
    assert np.mean(found[:, 0] == np.arange(1400)) > 0.95


def brute_codes(rows: list, parts: int, entries: int, rounds: int):
    length = len(rows[0][1])
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * float(x)))) for x in v], label) for i, v, label in rows if len(v) == length]
    width = length // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for i, v, label in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    errors = Counter()
    for _, _, d, label in out:
        errors[label] += d
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return Counter((i, code, d, errors[label]) for i, code, d, label in out), digest


@pytest.mark.parametrize(("parts", "entries", "rows"), [(16, 64, 3000), (8, 16, 3000), (16, 64, 20)])
def test_vector_codes(spark, vectors, parts, entries, rows, monkeypatch):
    some = vectors[:rows] if rows > 20 else vectors[:rows] + vectors[-10:]
    if entries == 16:  # far apart, equal parts, beyond the bound
        some = some[:300] + [(9000 + i, [1e30, -1e30, 16777217.0, 16777216.0] * 8, 1) for i in range(3)] + [(9100, [3e5 + i / 256 for i in range(32)], 2), (9101, [3e5] * 32, 2)]
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 2)
    good = [(i, np.float32(v).tolist(), label) for i, v, label in some if v and None not in v and all(map(math.isfinite, np.float32(v))) and len(v) % parts == 0]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is not None, r[2] or 0))
    want, digest = brute_codes(good, parts, entries, 2)
    got, books = vector_codes.coded(frame(spark, some), vector_codes.Coding(parts, entries, 2))
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()) == want
    assert vector_codes.codebook_digest(books) == digest


def test_screening_is_exact_where_float32_is_not():
    rng = np.random.default_rng(4)
    for spread, offset in ((3, 0), (3, 1 << 26), (1 << 13, 1 << 20), (1, 0)):
        book = rng.integers(-spread, spread + 1, (64, 4)) + offset
        points = rng.integers(-spread, spread + 1, (500, 4)) + offset
        entry, far = vector_codes.screened(points, book)
        every = ((points[:, None] - book[None]) ** 2).sum(2)
        assert (entry == every.argmin(1)).all() and (far == every.min(1)).all()


def test_codes_of_an_empty_table(spark):
    got, books = vector_codes.coded(frame(spark, [(1, None, 1), (2, [float("nan")] * 32, 1)]))
    assert got.count() == 0 and books.size == 0
