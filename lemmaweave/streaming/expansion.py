"""Expansion runs as a stateful stream: events of workers and clients come in, actions and states of runs go out.

events: run_id, event_id, at, kind and what the kind needs, else null.

- create: papers (the roots), limits (depth, papers, searches, edges); advance: steps, seconds
- found: paper_id, key, target (an identifier that the reference itself names, or null): one reference of a page;
  page_end: paper_id, outcome more or done
- answered: edge_id, outcome selected, needs_review, boundary or retryable_failure, target, reason
- imported: edge_id, outcome imported, linked_existing, needs_review, boundary or retryable_failure, target, reason
- lost: edge_id or paper_id, of a worker whose lease ended; failed: reason
- pause, cancel; policy: limits; decide: edge_id, outcome skip, retry, target or existing, target

Workers take the actions: discover (item: a paper; cursor: how many of its references are taken already), search and
import (item: an edge).  All items of one depth go out before any of the next, as many as the advance has steps for, so a
paper has its least depth.  Budgets are kept where an action goes out or a reference comes in; what they stop stays in the
state and goes on after a policy event.  A repeated event meets a state that it no longer fits and changes nothing, so
workers may send again after a failure.  A run has at most its budget of edges and pages of bounded size under way: its
state and its events of one batch are small, whatever the number of runs.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

EVENT = "run_id string, event_id string, at timestamp, kind string, papers array<string>, limits map<string,int>, steps int, seconds int, paper_id string, key string, edge_id string, target string, outcome string, reason string"
ACTION = "run_id string, n bigint, action string, item string, target string, cursor int, state string, reason string"
#: Default and largest budgets, and bounds of an advance (fixed values).
LIMITS = {"depth": (2, 10), "papers": (10, 100), "searches": (100, 1000), "edges": (500, 10_000)}
STEPS, SECONDS = 100, 60
#: States of edges that wait for an action, are under way, or wait for a person (fixed values).
READY, BUSY, REVIEW = ("queued", "selected"), ("searching", "importing"), ("needs_review", "retryable_failure")
_HEAD = ["depth", "papers", "searches", "edges", "new_papers", "used_searches", "used_edges", "steps", "n", "state", "reason"]


class _Run:
    """One run while its events are taken."""

    def __init__(self, run_id: str, head: dict | None, nodes: dict[str, dict], edges: dict[str, dict]):
        self.run_id, self.head, self.nodes, self.edges, self.out = run_id, head, nodes, edges, []
        self.touched: set[tuple[str, str]] = set()

    def emit(self, action: str, item: str | None = None, target: str | None = None, cursor: int | None = None, reason: str | None = None) -> None:
        n = None
        if self.head:
            self.head["n"] += 1
            n = self.head["n"]
        self.out.append((self.run_id, n, action, item, target, cursor, self.head and self.head["state"], reason))

    def move(self, state: str, reason: str | None = None) -> None:
        if (self.head["state"], self.head["reason"]) != (state, reason):
            self.head.update(state=state, reason=reason)
            self.emit("state", reason=reason)

    def node(self, paper: str, **change: Any) -> None:
        self.nodes[paper] = self.nodes.get(paper, {"depth": 0, "discovery": "queued", "cursor": 0}) | change
        self.touched.add(("nodes", paper))

    def edge(self, edge_id: str, **change: Any) -> None:
        self.edges[edge_id] = self.edges[edge_id] | change
        self.touched.add(("edges", edge_id))

    def depth_of(self, edge: dict) -> int:
        return self.nodes[edge["source"]]["depth"]

    def reach(self, paper: str, depth: int) -> None:
        if paper not in self.nodes:
            self.node(paper, depth=depth, discovery="queued" if depth < self.head["depth"] else "depth_limit")

    def reserved(self) -> int:
        return sum(e["state"] == "importing" for e in self.edges.values())

    # events

    def take(self, e: Any) -> None:
        if e.kind == "create":
            self.create(e)
        elif self.head is None:
            self.emit("refused", e.event_id, reason="unknown_run")
        elif self.head["state"] in ("cancelled", "failed"):
            self.emit("refused", e.event_id, reason=f"run_{self.head['state']}")
        elif (act := getattr(self, f"on_{e.kind}", None)) is None:
            self.emit("refused", e.event_id, reason="unknown_kind")
        elif (problem := act(e)) is not None:
            self.emit("refused", e.event_id, reason=problem)

    def create(self, e: Any) -> None:
        given, roots = _limits(e.limits), sorted(p for p in (e.papers if e.papers is not None else ()) if p)
        wrong = [k for k, v in given.items() if k not in LIMITS or not 1 <= v <= LIMITS[k][1]]
        if self.head is not None or wrong or not roots:
            self.emit("refused", e.event_id, reason="run_exists" if self.head else "invalid_limits" if wrong else "no_roots")
            return
        self.head = dict.fromkeys(_HEAD, 0) | {k: v for k, (v, _) in LIMITS.items()} | given | {"state": None, "reason": None}
        for paper in roots:
            self.node(paper)
        self.move("ready")

    def on_advance(self, e: Any) -> str | None:
        steps, seconds = (10 if pd.isna(e.steps) else int(e.steps)), (20 if pd.isna(e.seconds) else int(e.seconds))
        if not (1 <= steps <= STEPS and 1 <= seconds <= SECONDS):
            return "invalid_bounds"
        self.head["steps"], self.deadline = steps, int(e.ms) + 1000 * seconds
        self.move("running")
        return None

    def on_found(self, e: Any) -> str | None:
        source = self.nodes.get(e.paper_id)
        edge_id = f"{e.paper_id}|{e.key}"
        if source is None or source["discovery"] != "discovering":
            return "not_discovering"
        if edge_id in self.edges:
            return None
        if self.head["used_edges"] >= self.head["edges"]:
            self.node(e.paper_id, discovery="queued")  # the next page begins at its cursor
            self.move("paused", "edge_limit")
            return None
        self.head["used_edges"] += 1
        self.node(e.paper_id, cursor=source["cursor"] + 1)
        self.edges[edge_id] = {"source": e.paper_id, "target": e.target, "state": "selected" if e.target else "queued", "reason": None}
        self.touched.add(("edges", edge_id))
        return None

    def on_page_end(self, e: Any) -> str | None:
        if self.nodes.get(e.paper_id, {}).get("discovery") != "discovering":
            return "not_discovering"
        self.node(e.paper_id, discovery="done" if e.outcome == "done" else "queued")
        return None

    def on_answered(self, e: Any) -> str | None:
        if self.edges.get(e.edge_id, {}).get("state") != "searching":
            return "not_searching"
        if e.outcome not in ("selected", "boundary", *REVIEW) or (e.outcome == "selected") != bool(e.target):
            return "invalid_outcome"
        self.edge(e.edge_id, state=e.outcome, target=e.target, reason=e.reason)
        return None

    def on_imported(self, e: Any) -> str | None:
        edge = self.edges.get(e.edge_id)
        if edge is None or edge["state"] != "importing":
            return "not_importing"
        if e.outcome not in ("imported", "linked_existing", "boundary", *REVIEW):
            return "invalid_outcome"
        target = e.target or edge["target"]
        if e.outcome == "imported" and target not in self.nodes:
            self.head["new_papers"] += 1
        self.edge(e.edge_id, state=e.outcome, reason=e.reason, target=target)
        if e.outcome in ("imported", "linked_existing"):
            self.reach(target, self.depth_of(edge) + 1)
        return None

    def on_lost(self, e: Any) -> str | None:
        edge, node = self.edges.get(e.edge_id), self.nodes.get(e.paper_id)
        if edge and edge["state"] == "searching":
            self.edge(e.edge_id, state="retryable_failure", reason="interrupted_search")
        elif edge and edge["state"] == "importing":
            self.edge(e.edge_id, state="selected")  # what it left behind is overwritten
        elif node and node["discovery"] == "discovering":
            self.node(e.paper_id, discovery="queued")
        else:
            return "not_under_way"
        return None

    def on_failed(self, e: Any) -> None:
        self.move("failed", e.reason)

    def on_pause(self, e: Any) -> None:
        self.move("paused", "user_pause")

    def on_cancel(self, e: Any) -> None:
        self.move("cancelled", "user_cancel")

    def on_policy(self, e: Any) -> str | None:
        given = _limits(e.limits)
        if not given or any(k not in LIMITS or not 1 <= v <= LIMITS[k][1] for k, v in given.items()):
            return "invalid_limits"
        new = {k: self.head[k] for k in LIMITS} | given
        deepest = max([n["depth"] for n in self.nodes.values()] + [self.depth_of(x) + 1 for x in self.edges.values() if x["state"] == "importing"])
        used = {"papers": self.head["new_papers"] + self.reserved(), "searches": self.head["used_searches"], "edges": self.head["used_edges"], "depth": deepest}
        if any(new[k] < v for k, v in used.items()):
            return "below_usage"
        self.head.update(new)
        for paper, n in list(self.nodes.items()):
            if n["discovery"] == "depth_limit" and n["depth"] < new["depth"]:
                self.node(paper, discovery="queued")
        self.move("ready")
        return None

    def on_decide(self, e: Any) -> str | None:
        edge = self.edges.get(e.edge_id)
        if edge is None:
            return "unknown_edge"
        if edge["state"] in ("imported", "linked_existing"):
            return "completed_edge"
        if edge["state"] == "importing":
            return "import_under_way"
        if e.outcome == "skip":
            self.edge(e.edge_id, state="skipped", reason="user_skipped")
        elif e.outcome == "retry":
            if edge["state"] != "retryable_failure":
                return "nothing_to_retry"
            self.edge(e.edge_id, state="selected" if edge["target"] else "queued", reason=None)
        elif e.outcome in ("target", "existing") and e.target:
            self.edge(e.edge_id, state="selected", target=e.target, reason=None)
        else:
            return "invalid_decision"
        self.move("ready")
        return None

    # actions

    def pending(self) -> list[tuple[int, str, int, str]]:
        """(depth, source, 0 to discover or 1 for an edge, id) in the order of the work."""
        nodes = [(n["depth"], p, 0, p) for p, n in self.nodes.items() if n["discovery"] == "queued" and n["depth"] < self.head["depth"]]
        edges = [(self.depth_of(x), x["source"], 1, i) for i, x in self.edges.items() if x["state"] in READY and self.depth_of(x) < self.head["depth"]]
        return sorted(nodes + edges)

    def busy(self) -> list[int]:
        return [n["depth"] for n in self.nodes.values() if n["discovery"] == "discovering"] + [self.depth_of(x) for x in self.edges.values() if x["state"] in BUSY]

    def issue(self) -> None:
        """Send out what the budgets allow; then say where the run stands."""
        if self.head is None or self.head["state"] != "running":
            return
        while self.head["steps"] and (todo := self.pending()):
            level = min(self.busy(), default=todo[0][0])
            now = [t for t in todo if t[0] <= level]
            for depth, _, is_edge, item in now[: self.head["steps"]]:
                if not (self.edge_out(item, depth) if is_edge else self.page_out(item)):
                    return
                self.head["steps"] -= 1
            if self.busy():
                break
        if not self.busy() or (not self.head["steps"] and self.pending()):
            self.settle()

    def page_out(self, paper: str) -> bool:
        self.node(paper, discovery="discovering")
        self.emit("discover", paper, cursor=self.nodes[paper]["cursor"])
        return True

    def edge_out(self, item: str, depth: int) -> bool:
        edge = self.edges[item]
        if edge["target"] in self.nodes and edge["state"] == "selected":
            self.edge(item, state="linked_existing")
            self.emit("linked", item, edge["target"])
            return True
        if self.head["new_papers"] + self.reserved() >= self.head["papers"]:
            self.move("paused", "paper_limit")
            return False
        if edge["state"] == "selected":
            self.edge(item, state="importing")
            self.emit("import", item, edge["target"])
            return True
        if self.head["used_searches"] >= self.head["searches"]:
            self.move("paused", "search_limit")
            return False
        self.head["used_searches"] += 1
        self.edge(item, state="searching")
        self.emit("search", item)
        return True

    def settle(self) -> None:
        if self.busy() or self.pending():
            self.move("ready")
        else:
            self.move("waiting" if any(x["state"] in REVIEW for x in self.edges.values()) else "completed")

    deadline: int | None = None


def _limits(given: Any) -> dict[str, int]:
    return {} if given is None else dict(given)


class ExpansionRuns(StatefulProcessor):
    """Header, papers and edges of each run as state; a timer ends the time of an advance in the time of the events."""

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "depth int, papers int, searches int, edges int, new_papers int, used_searches int, used_edges int, steps int, n bigint, state string, reason string")
        self.nodes = handle.getMapState("nodes", "paper_id string", "depth int, discovery string, cursor int")
        self.edges = handle.getMapState("edges", "edge_id string", "source string, target string, state string, reason string")

    def _load(self, run_id: str) -> _Run:
        head = self.head.get()
        named = lambda state, names: {k[0]: dict(zip(names, v, strict=True)) for k, v in state.iterator()}
        return _Run(run_id, dict(zip(_HEAD, head, strict=True)) if head else None, named(self.nodes, ("depth", "discovery", "cursor")), named(self.edges, ("source", "target", "state", "reason")))

    def _save(self, run: _Run) -> pd.DataFrame:
        if run.head:
            self.head.update(tuple(run.head[k] for k in _HEAD))
        for name, item in run.touched:
            getattr(self, name).updateValue((item,), tuple(getattr(run, name)[item].values()))
        return pd.DataFrame(run.out, columns=[c.split()[0] for c in ACTION.split(", ")]).astype({"n": "Int64", "cursor": "Int32"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run, events = self._load(key[0]), pd.concat(list(rows))
        events = events.astype(object).where(events.notna(), None).sort_values(["ms", "event_id"], na_position="first")
        for event in events.itertuples(index=False):
            run.take(event)
            run.issue()
        if run.deadline is not None and run.head["state"] == "running":
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old if isinstance(old, int) else old[0])
            self.handle.registerTimer(run.deadline)
        yield self._save(run)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run = self._load(key[0])
        if run.head and run.head["state"] == "running":
            run.head["steps"] = 0
            run.settle()
        yield self._save(run)

    def close(self) -> None:
        pass


#: An event of a table, with its time in milliseconds; actions as Arrow has them, and how many go out at once.
_Event = namedtuple("_Event", [*[c.split()[0] for c in EVENT.split(", ") if not c.startswith("at ")], "ms"])
_ACTIONS = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in ACTION.split(", ")])
AT_ONCE = 10_000


def _sent(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _ACTIONS, strict=True)], schema=_ACTIONS)


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Actions of runs whose events come one behind the other, in their order; only the run under way is held."""
    run, out = None, []
    for batch in batches:
        columns = [[None] * len(batch) if c.null_count == len(c) else c.to_pylist() for c in map(batch.column, _Event._fields)]
        for event in map(_Event._make, zip(*columns, strict=True)):
            if run is None or run.run_id != event.run_id:
                run = _Run(event.run_id, None, {}, {})
                run.out = out
            run.take(event)
            run.issue()
            if len(out) >= AT_ONCE:
                yield _sent(out)
                out.clear()
    if out:
        yield _sent(out)


#: The state store that such a stream needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def actions(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Actions, refusals and states of all runs, of a stream of events or a table of them; n counts within a run.

    Time is that of the events: an advance ends when the watermark passes its last second, so a replay ends alike.  The
    engine drops an event that is later than `late` behind the newest; one without a time counts as of now.  A table has
    all events of its runs, so it needs no store: each run is followed once, in the order of its sorted events.
    """
    rows = events.select(*[c.split()[0] for c in EVENT.split(", ")]).withColumn("at", F.coalesce("at", F.current_timestamp()))
    rows = rows.withColumn("ms", F.unix_millis("at"))
    if not events.isStreaming:
        return rows.select(*_Event._fields).repartition("run_id").sortWithinPartitions("run_id", "ms", "event_id").mapInArrow(_whole_runs, ACTION)
    for name, value in STORE.items():
        events.sparkSession.conf.set(name, value)
    rows = rows.withWatermark("at", late)
    return rows.groupBy("run_id").transformWithStateInPandas(ExpansionRuns(), ACTION, "Append", "EventTime")
