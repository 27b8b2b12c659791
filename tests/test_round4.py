"""Findings of round 4: whole results beyond a budget, at sizes that estimates get wrong."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lemmaweave.operators import assessment, crawl, references, scholarly
from lemmaweave.streaming import expansion


def test_targets_beyond_the_edge_budget_stay_as_boundary_rows(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("a", "y"), ("b", "c"), ("b", "x"), ("c", "z")], "paper_id string, target string")
    papers = spark.createDataFrame([(p,) for p in "rabc"], "paper_id string")
    states = lambda run: {r.paper_id: (r.depth, r.state) for r in run.nodes.collect()}
    run = crawl.advance(crawl.start(papers.where("paper_id = 'r'"), crawl.Policy(depth=4, edges=3)), edges, papers)
    assert (run.state, run.reason, run.edges.count()) == ("paused", "edge_budget", 3)
    below = {"r": (0, "visited"), "a": (1, "visited"), "b": (1, "visited"), "x": (2, "boundary"), "y": (2, "boundary"), "c": (2, "boundary")}
    assert states(run) == below
    assert states(crawl.advance(crawl.updated(run, crawl.Policy(depth=4, edges=4)), edges, papers)) == below
    # with a larger budget it goes on where it stopped, as a run that had it from the start
    done = crawl.advance(crawl.updated(run, crawl.Policy(depth=4)), edges, papers)
    whole = crawl.advance(crawl.start(papers.where("paper_id = 'r'"), crawl.Policy(depth=4)), edges, papers)
    assert done.state == whole.state == "completed" and done.edges.count() == whole.edges.count() == 7
    assert states(done) == states(whole) == below | {"c": (2, "visited"), "z": (3, "boundary")}


def test_runs_of_a_table_need_no_state_store(spark):
    fields = [c.split()[0] for c in expansion.EVENT.split(", ")]
    sent = [{"kind": "create", "papers": ["p"], "limits": {"edges": 2}}, {"kind": "advance", "steps": 9}, *[{"kind": "found", "paper_id": "p", "key": k} for k in "abc"], {"kind": "page_end", "paper_id": "p", "outcome": "done"}]
    rows = [{"run_id": r, "event_id": str(i), "at": datetime(2024, 1, 1) + timedelta(seconds=i)} | e for r in (None, "r", "s") for i, e in enumerate(sent)]
    rows += [{"run_id": "late", "event_id": "0", "at": datetime(2024, 1, 1), "kind": "pause"}]
    events = spark.createDataFrame([tuple(e.get(f) for f in fields) for e in reversed(rows)], expansion.EVENT)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # runs go over the ends of batches
    try:
        out = expansion.actions(events)
        assert "TransformWithState" not in out._jdf.queryExecution().toString()
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    one = [("state", None, None), ("state", None, None), ("discover", "p", None), ("search", "p|a", None), ("search", "p|b", None), ("state", None, "edge_limit"), ("refused", "5", "not_discovering")]
    for run in (None, "r", "s"):
        own = sorted((r for r in got if r.run_id == run), key=lambda r: r.n)
        assert [(r.action, r.item, r.reason) for r in own] == one and [r.n for r in own] == list(range(1, 8)) and own[-1].state == "paused"
    assert [(r.n, r.action, r.reason) for r in got if r.run_id == "late"] == [(None, "refused", "unknown_run")] and len(got) == 22


def test_references_are_ranked_in_one_pass(spark):
    fields = "title string, authors array<string>, year string, doi string, arxiv_id string"
    lee = ("Maps", ["Ann Lee"], "2001", None)
    asked = spark.createDataFrame([(n, *lee, None) for n in ("a", "b", "none", None)], f"blocked_id string, {fields}")
    rows = [(n, p, "ok", *lee, "2001.00001") for n in ("a", "b", None, "never asked") for p in ("x", "y", "z")] + [("b", "w", "timeout", None, None, None, None, None)]
    records = spark.createDataFrame(rows, f"blocked_id string, provider string, outcome string, {fields}")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # references go over the ends of batches
    try:
        found = scholarly.candidates(asked, records)
        assert "CoGroup" not in found._jdf.queryExecution().toString()
        got = {r.blocked_id: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {n: (r.position, r.confidence, r.score, r.n_records, r.eligible) for n, r in got.items()} == {"a": (1, "strong", 6.0, 3, True), "b": (1, "strong", 6.0, 3, False), None: (1, "strong", 6.0, 3, True)}
    one = [{"provider": p} | dict(zip(("title", "authors", "year", "doi", "arxiv_id"), (*lee, "2001.00001"), strict=True)) for p in "xyz"]
    assert got["a"].group_key == scholarly.key_of(sorted(map(scholarly.key_of, one)))


RECORDS = "blocked_id string, provider string, title string, authors array<string>, year string, doi string, arxiv_id string, arxiv_version string, url string, is_retracted boolean"


def test_groups_of_large_and_small_references_are_alike(spark, monkeypatch):
    one = lambda name, provider, doi=None, arxiv=None, title="Maps", year="1999": (name, provider, title, ["A. Lee"], year, doi, arxiv, None, None, None)
    # a chain over doi and arXiv, two alike by title and year, one by itself, for references of different size
    of = lambda name: [one(name, "x", "10.1000/a"), one(name, "y", "10.1000/A", "2001.00001"), one(name, "z", None, "2001.00001"), one(name, "x"), one(name, "y", title="MAPS"), one(name, "w", year=None)]
    rows = [*of("b"), *of("a"), one("c", "x"), *of("d"), one(None, "x"), *[one("d", f"p{i}", "10.1000/a") for i in range(5)]]
    keyed = assessment.keyed(spark.createDataFrame(rows, RECORDS)).cache()

    def groups():
        size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # references go over the ends of batches
        try:
            found = assessment.grouped(keyed)
            return sorted((r.blocked_id, r.group_key, r.provider, r.title) for r in found.collect())
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)

    calls = []
    components = assessment.graph.components
    monkeypatch.setattr(assessment.graph, "components", lambda links: calls.append(1) or components(links))
    small = groups()
    assert not calls and len(small) == 24
    sizes = {}
    for name, key, *_ in small:
        sizes.setdefault(name, []).append(key)
    assert {n: sorted(Counter(keys).values()) for n, keys in sizes.items()} == {"a": [1, 2, 3], "b": [1, 2, 3], "c": [1], "d": [1, 2, 8]}
    for most in (6, 0):  # one reference, and all, as components
        monkeypatch.setattr(assessment, "MANY", most)
        assert groups() == small
    assert len(calls) == 2


def test_joins_of_references_are_not_planned_by_guessed_sizes(spark, tmp_path):
    from lemmaweave.plans import references as plans
    from lemmaweave.plans.catalog import Tables

    spark.range(40).selectExpr("id as p_partkey", "'lace spring' as p_name", "cast(id % 50 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    assert int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()) >= 10 << 20
    t = Tables(spark, str(tmp_path))
    hints, facts = plans._assessed(t)
    found = assessment.candidates(facts, plans.answers(t))
    for name, frame in (("hints", hints), ("candidates", found), ("boundaries", assessment.boundaries(hints, found, plans.answers(t)))):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString(), name
        assert frame.count()


def test_fields_compare_without_guessed_sizes(spark, tmp_path):
    from lemmaweave.plans import references as plans
    from lemmaweave.plans.catalog import Tables

    spark.range(40).selectExpr("id as p_partkey", "'lace spring' as p_name", "cast(id % 50 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    t = Tables(spark, str(tmp_path))
    rows = plans.entries(t)
    facts = assessment._facts(assessment.grouped(assessment.keyed(plans.records(t))), references.hints(references.parsed(rows), rows))
    assert "Broadcast" not in facts._jdf.queryExecution().executedPlan().toString()
    assert {r.field: r.n for r in assessment.fields(facts).groupBy("field").agg(F.count("*").alias("n")).collect()} == {"title": 54, "authors": 54, "year": 54, "identifiers": 6}
