"""Snapshots, leases by time, components of graphs with cycles, interval joins, statements over blocks."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lemmaweave.functions import identity
from lemmaweave.operators import blocks, expansion, graph, relational
from lemmaweave.sources.snapshots import Conflict, Snapshots


def test_a_commit_holds_for_all_tables_or_none(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "paper_id string, x int")
    read = lambda name, version=None: sorted((r.paper_id, r.x) for r in tables.read(name, "paper_id string, x int", version).collect())
    assert read("results") == [] and tables.version() == 0
    tables.commit({"results": rows(("a", 1), ("b", 2)), "proofs": rows(("a", 10))}, rows(("a", 0), ("b", 0)))
    broken = rows(("a", 7)).withColumn("x", F.expr("cast(raise_error('lost') as int)"))
    with pytest.raises(Exception, match="lost"):  # between two tables
        tables.commit({"proofs": rows(("a", 77)), "results": broken}, rows(("a", 0)))
    assert (read("results"), read("proofs"), tables.version()) == ([("a", 1), ("b", 2)], [("a", 10)], 1)
    tables.commit({"results": rows(("a", 3), ("c", 4))}, rows(("a", 0), ("c", 0)), label="batch 1")
    assert (read("results"), read("proofs")) == ([("a", 3), ("b", 2), ("c", 4)], [])  # a has no proofs any more
    assert read("proofs", 1) == [("a", 10)]
    with pytest.raises(Conflict):
        tables.commit({"results": rows(("b", 9))}, rows(("b", 0)), base=1)
    with pytest.raises(Conflict):
        tables._publish({"version": 2, "commits": []})
    assert tables.commit({"results": rows(("a", 99))}, rows(("a", 0)), label="batch 1") == 2
    tables.compact({"results": "paper_id string, x int", "proofs": "paper_id string, x int"})
    assert len(tables.vacuum()) >= 3 and read("results") == [("a", 3), ("b", 2), ("c", 4)]
    assert tables.commit({"results": rows(("a", 99))}, rows(("a", 0)), label="batch 1") == 3


def test_writes_meet_the_lease_of_their_time(spark):
    day = datetime(2024, 1, 1)
    at = lambda minutes, seconds=0: day + timedelta(minutes=minutes, seconds=seconds)
    log = [("r", "a", 1, at(0)), ("r", "a", 1, at(1, 30)), ("r", "b", 2, at(60)), ("r", "a", 1, at(60, 30)), ("s", "c", 1, at(0))]
    cases = [("r", "a", 1, at(0, 59), True), ("r", "a", 1, at(3), True), ("r", "a", 1, at(3, 30), False), ("r", "b", 2, at(30), False), ("r", "b", 2, at(60), True), ("r", "b", 1, at(1), False),
             ("r", "a", 1, at(60, 40), False), ("r", "b", 2, at(61, 59), True), ("r", "b", 2, at(62), False), ("s", "c", 1, at(-1), False), ("s", "c", 1, at(1), True), ("none", "c", 1, at(1), False), (None, "c", 1, at(1), False), ("s", "c", 1, None, False)]
    writes = spark.createDataFrame([(*c[:4], i) for i, c in enumerate(cases)], "run_id string, holder string, token int, at timestamp, n int")
    got = {r.n: r.accepted for r in expansion.fenced(writes, spark.createDataFrame(log, "run_id string, holder string, token int, at timestamp")).collect()}
    assert got == {i: c[4] for i, c in enumerate(cases)}


def test_components_and_reach_of_a_graph_with_a_giant_cycle(spark):
    rng = random.Random(6)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(75)} | {(i, (i + 1) % 20) for i in range(20)} | {(70, 71), (71, 72), (72, 70), (72, 73), (80, 80), (81, 82)}
    nodes = {n for e in edges for n in e}
    reached = {}
    for n in nodes:
        seen, front = set(), [n]
        while front:
            front = [b for a, b in edges for x in front if a == x and not (b in seen or seen.add(b))]
        reached[n] = seen
    want = {n: min([n, *(m for m in reached[n] if n in reached[m])]) for n in nodes}
    table = spark.createDataFrame([*edges, (None, 3), (5, None)], "src long, dst long")
    assert {r.node: r.comp for r in graph.strong_components(table).collect()} == want
    starts = spark.createDataFrame([(n,) for n in (0, 70, 73, 80, 81)], "node long")
    assert {(r.src, r.dst) for r in graph.reach(table, starts).collect()} == {(n, m) for n in (0, 70, 73, 80, 81) for m in reached[n]}
    assert {r.node: r.n_reached for r in graph.reach_counts(table).collect()} == {n: len(reached[n]) for n in nodes}


def test_a_tree_with_a_cycle_is_an_error(spark):
    loop = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    with pytest.raises(ValueError, match="cycle"):
        graph.reach_in_tree(loop, loop.select("src"))


def test_intervals_meet_over_the_edges_of_bins(spark):
    rng = random.Random(9)
    spans = [(rng.choice("pq"), (a := rng.randrange(3000)), a + rng.choice([0, 1, 8, 64, 900])) for _ in range(150)] + [("p", 64, 128), ("p", 63, 65)]
    parts = [(p, a, min(a + w, 3000)) for p, w in (("p", 64), ("q", 700)) for a in range(0, 3000, w)]
    left, right = spark.createDataFrame(spans, "paper_id string, start int, end int"), spark.createDataFrame(parts, "paper_id string, seg_start int, seg_end int")
    found = relational.overlapping(left, right, ["paper_id"], 64)
    assert sorted(tuple(r) for r in found.select("paper_id", "start", "end", "seg_start", "seg_end").collect()) == sorted((p, a, b, c, d) for p, a, b in spans for q, c, d in parts if p == q and max(a, c) < min(b, d))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in plan and "Cartesian" not in plan


def test_statements_end_where_they_should(spark):
    page = lambda *texts: [(t, 10.0, 10.0 + 40 * i, 100.0, 40.0 + 40 * i) for i, t in enumerate(texts)]
    cases = {
        "stop": (page("Lemma 1. A is.", "Then b", "Proof. c"), ["Lemma 1. A is.\nThen b"]),
        "closed": (page("Lemma 1. A is.", "Another b"), ["Lemma 1. A is."]),
        "bare": (page("Theorem 2 (Name).", "All is well.", "Not more"), ["Theorem 2 (Name).\nAll is well."]),
        "section": (page("Claim 3: a", "3.1 Next part"), ["Claim 3: a"]),
        "number": (page("Claim 3: a.", "(12) b", "(x) c"), ["Claim 3: a.\n(12) b\n(x) c"]),
        "word": (page("Claim 3: a.", "Thenceforth"), ["Claim 3: a."]),
        "many": (page("Remark 1. a", *"bcdefghij"), ["\n".join(["Remark 1. a", *"bcdefgh"])]),
        "twice": (page("Lemma 1. a.", "Lemma 1. b"), ["Lemma 1. a.", "Lemma 1. b"]),
    }
    rows = [(p, "s", 1, i + 1, *box, text) for p, (texts, _) in cases.items() for i, (text, *box) in enumerate(texts)]
    rows += [("head", "s", 1, 3, 10.0, 700.0, 100.0, 720.0, "Lemma 4. a"), ("head", "s", 2, 0, 10.0, 5.0, 100.0, 9.0, "RUNNING HEAD"), ("head", "s", 2, 1, 10.0, 20.0, 100.0, 30.0, "goes on"), ("far", "s", 1, 1, 10.0, 10.0, 90.0, 20.0, "Lemma 5. a"), ("far", "s", 1, 2, 10.0, 60.0, 90.0, 70.0, "b")]
    table = spark.createDataFrame(rows, "paper_id string, source_ref string, page int, block_index int, x0 double, y0 double, x1 double, y1 double, text string")
    got: dict = {}
    for r in blocks.statements(table).orderBy("paper_id", F.array_min("positions")).collect():
        got.setdefault(r.paper_id, []).append((r.local_id, r.statement))
    assert {p: [s for _, s in x] for p, x in got.items()} == {p: want for p, (_, want) in cases.items()} | {"head": ["Lemma 4. a\ngoes on"], "far": ["Lemma 5. a"]}
    assert [i for i, _ in got["twice"]] == ["pdf:lemma:1", "pdf:lemma:1:2"]


def test_wrapped_identifiers():
    assert identity.identifier(' <("10.1000/A")> ', "doi")["canonical"] == "10.1000/a"
    assert identity.identifier("()", "doi")["valid"] is False and identity.folded(" Ａ\n b ") == "a b"
