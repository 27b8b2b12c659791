"""Expansion runs as a stream: order, budgets, control, decisions, timers, and going on after a stop."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from lemmaweave.streaming import expansion

FIELDS = [c.split()[0] for c in expansion.EVENT.split(", ")]


class Feed:
    """Events in files, one batch each; the actions that came back after every batch."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, str(folder), 0

    def send(self, *events):
        rows = []
        for e in events:
            self.n += 1
            full = {"run_id": "r", "event_id": f"{self.n:05d}", "at": datetime(2024, 1, 1) + timedelta(seconds=self.n)} | e
            rows.append(tuple(full.get(f) for f in FIELDS))
        before = self.n - len(rows)
        if rows:
            self.spark.createDataFrame(rows, expansion.EVENT).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        return self.run(before)

    def run(self, before=0):
        known = self.seen()
        stream = expansion.actions(self.spark.readStream.schema(expansion.EVENT).parquet(f"{self.folder}/in"))
        query = stream.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        return sorted((r for r in self.rows() if tuple(r) not in known), key=lambda r: (r.run_id or "", r.n or 0))

    def rows(self):
        try:
            return self.spark.read.schema(expansion.ACTION).parquet(f"{self.folder}/out").collect()
        except Exception:  # noqa: BLE001 - nothing was written so far
            return []

    def seen(self):
        return {tuple(r) for r in self.rows()}


def short(rows):
    return [(r.action, r.item, r.target) if r.action != "state" else ("state", r.state, r.reason) for r in rows]


@pytest.fixture
def feed(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield Feed(spark, tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_run_goes_on_where_it_stopped(feed):
    limits = {"depth": 2, "papers": 1, "searches": 1, "edges": 3}
    found = lambda key, target=None: {"kind": "found", "paper_id": "p", "key": key, "target": target}
    got = feed.send({"kind": "create", "papers": ["p"], "limits": limits}, {"kind": "advance", "steps": 50})
    assert short(got) == [("state", "ready", None), ("state", "running", None), ("discover", "p", None)]
    # three of four references fit; each call is a new query over the same checkpoint
    got = feed.send(found("a"), found("b"), found("c", "x"), found("d"), {"kind": "page_end", "paper_id": "p", "outcome": "done"})
    assert ("state", "paused", "edge_limit") in short(got) and [a for a, *_ in short(got)].count("search") == 1
    assert short(got)[-1][0] == "refused"  # the page is open no more: it is asked for again from its cursor
    # a budget below what is used, then one that fits
    assert [r.reason for r in feed.send({"kind": "policy", "limits": {"edges": 2}})] == ["below_usage"]
    got = feed.send({"kind": "policy", "limits": {"edges": 9}}, {"kind": "advance"})
    assert [(r.item, r.cursor) for r in got if r.action == "discover"] == [("p", 3)]
    assert ("state", "paused", "search_limit") in short(got)
    got = feed.send(found("d"), {"kind": "page_end", "paper_id": "p", "outcome": "done"}, {"kind": "answered", "edge_id": "p|a", "outcome": "needs_review", "reason": "ambiguous"},
                    {"kind": "policy", "limits": {"searches": 9}}, {"kind": "advance"})
    assert [r.item for r in got if r.action in ("search", "import")] == ["p|b", "p|c"] or [r.item for r in got if r.action == "search"] == ["p|b"]
    # the one paper is reserved by its import
    assert ("state", "paused", "paper_limit") in short(got)
    # an event that is sent again changes nothing
    got = feed.send({"kind": "imported", "edge_id": "p|c", "outcome": "imported"}, {"kind": "imported", "edge_id": "p|c", "outcome": "imported"}, {"kind": "lost", "edge_id": "p|b"},
                    {"kind": "policy", "limits": {"papers": 9}}, {"kind": "advance"})
    assert [r.reason for r in got if r.action == "refused"] == ["not_importing"]
    assert ("discover", "x", None) not in short(got) and [r.item for r in got if r.action == "search"] == ["p|d"]  # depth 0 first
    got = feed.send({"kind": "answered", "edge_id": "p|d", "outcome": "selected", "target": "p"})
    assert ("linked", "p|d", "p") in short(got) and ("discover", "x", None) in short(got)
    got = feed.send({"kind": "page_end", "paper_id": "x", "outcome": "done"}, {"kind": "decide", "edge_id": "p|a", "outcome": "skip"}, {"kind": "decide", "edge_id": "p|b", "outcome": "retry"}, {"kind": "decide", "edge_id": "p|c", "outcome": "skip"}, {"kind": "decide", "edge_id": "no", "outcome": "skip"}, {"kind": "advance"})
    assert short(got)[0] == ("state", "waiting", None)
    assert [r.reason for r in got if r.action == "refused"] == ["completed_edge", "unknown_edge"] and ("search", "p|b", None) in short(got)
    got = feed.send({"kind": "answered", "edge_id": "p|b", "outcome": "boundary"})
    assert short(got) == [("state", "completed", None)]


def test_control_and_refusals(feed):
    got = feed.send({"kind": "advance"}, {"kind": "create", "papers": [], "limits": None}, {"kind": "create", "papers": ["p"], "limits": {"edges": 10_001}}, {"kind": "create", "papers": ["q", "p"]},
                    {"kind": "create", "papers": ["z"]}, {"kind": "advance", "steps": 101}, {"kind": "nonsense"}, {"kind": None}, {"run_id": None, "kind": "create", "papers": ["n"]})
    assert sorted(r.reason for r in got if r.action == "refused") == sorted(["unknown_run", "no_roots", "invalid_limits", "run_exists", "invalid_bounds", "unknown_kind", "unknown_kind"])
    assert [(r.run_id, r.state) for r in got if r.action == "state"] == [(None, "ready"), ("r", "ready")]
    got = feed.send({"kind": "advance", "steps": 1}, {"kind": "pause"})
    assert short(got) == [("state", "running", None), ("discover", "p", None), ("state", "ready", None), ("state", "paused", "user_pause")]
    got = feed.send({"kind": "cancel"}, {"kind": "cancel"}, {"kind": "advance"})
    assert short(got)[0] == ("state", "cancelled", "user_cancel") and [r.reason for r in got[1:]] == ["run_cancelled"] * 2


def test_time_ends_an_advance(feed):
    feed.send({"kind": "create", "papers": ["p"]}, {"kind": "advance", "seconds": 1})
    got = feed.send({"run_id": "other", "kind": "create", "papers": ["q"], "at": datetime(2024, 1, 1, 1)})
    assert ("state", "ready", None) in short(r for r in got if r.run_id == "r")
