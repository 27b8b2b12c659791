"""Control of an expansion: pages with a cursor, leases, fingerprints, attempts, events and the tree that shows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from . import relational

#: References discovered in one step, and seconds of a lease and between renewals (fixed values).
PAGE, LEASE, RENEW = 25, 120, 10


def paged(references: DataFrame, size: int = PAGE) -> DataFrame:
    """references(run_id, node, ord, ...) with page (from 0) and cursor, the place behind the page."""
    order = F.row_number().over(Window.partitionBy("run_id", "node").orderBy("ord"))
    rows = references.withColumn("_n", order - 1).withColumn("page", F.expr(f"cast(_n div {size} as int)"))
    total = F.count("*").over(Window.partitionBy("run_id", "node"))
    return rows.withColumn("cursor", F.least((F.col("page") + 1) * size, total).cast("long")).drop("_n")


def next_pages(references: DataFrame, cursors: DataFrame, size: int = PAGE) -> DataFrame:
    """The page of each node behind its cursor (0 where there is none); nodes that are done give no row."""
    rows = references.withColumn("_n", F.row_number().over(Window.partitionBy("run_id", "node").orderBy("ord")) - 1)
    at = F.coalesce("cursor", F.lit(0))
    return rows.join(cursors, ["run_id", "node"], "left").where((F.col("_n") >= at) & (F.col("_n") < at + size)).withColumn("cursor", at + size).drop("_n")


def work(pending: DataFrame) -> DataFrame:
    """Items of a run in their order: depth, source, discovery before edges, id."""
    order = Window.partitionBy("run_id").orderBy("depth", "source", F.when(F.col("kind") == "discover", 0).otherwise(1), "item_id")
    return pending.withColumn("position", F.row_number().over(order))


def fingerprints(rows: DataFrame, key: str, columns: list[Column | str]) -> DataFrame:
    """key, fingerprint: a hash of all rows of a key, whatever their order."""
    each = F.sha2(F.to_json(F.struct(*columns)), 256)
    return rows.select(key, each.alias("_h")).groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("fingerprint"))


def staleness(stored: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """key, state: current, stale (the source changed), gone or new."""
    both = stored.select(key, F.col("fingerprint").alias("_old")).join(now.select(key, F.col("fingerprint").alias("_new")), key, "full")
    state = F.when(F.col("_new").isNull(), "gone").when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("_new"), "current").otherwise("stale")
    return both.select(key, state.alias("state"))


def leases(log: DataFrame, seconds: int = LEASE) -> DataFrame:
    """run_id, holder, token, expires of the lease that stands at the end of the log: run_id, holder, token, at of grants and renewals."""
    last = log.groupBy("run_id").agg(F.max(F.struct("token", "at", "holder")).alias("x"))
    return last.select("run_id", "x.holder", "x.token", (F.col("x.at") + F.expr(f"interval {seconds} seconds")).alias("expires"))


def fenced(writes: DataFrame, log: DataFrame, seconds: int = LEASE) -> DataFrame:
    """writes(run_id, holder, token, at, ...) with accepted: made by the holder of the lease that stood at that time.

    A grant has a higher token than those before, so it ends them from its time on; a renewal moves the end of its own
    lease, and one with an older token moves nothing.  A lease ends `seconds` after its last grant or renewal, that
    moment excluded.  Each write meets the greatest (token, at) up to its time.
    """
    lease = F.struct("token", "at", "holder")
    given = log.select("run_id", "at", lease.alias("_lease"))
    asked = writes.select("run_id", "at", F.struct(*writes.columns).alias("_write"))
    rows = relational.running_max(given.unionByName(asked, allowMissingColumns=True), ["run_id"], "at", "_lease").where("_write is not null")
    held, own = (lambda c: F.col(f"running.{c}")), (lambda c: F.col(f"_write.{c}"))
    alive = own("at") < held("at") + F.expr(f"interval {seconds} seconds")
    accepted = (own("token") == held("token")) & (own("holder") == held("holder")) & alive
    return rows.select("_write.*", F.coalesce(accepted, F.lit(False)).alias("accepted"))


def reconciled(attempts: DataFrame, markers: DataFrame, papers: DataFrame) -> DataFrame:
    """run_id, attempt_id, paper_id, outcome: an import counts once, by its marker.

    committed: marker and paper are there; retry: no marker (what it left behind is overwritten);
    lost: marked, but the paper is gone.
    """
    marks = markers.select("run_id", "attempt_id").distinct().withColumn("_mark", F.lit(True))
    here = papers.select("paper_id").distinct().withColumn("_here", F.lit(True))
    rows = attempts.select("run_id", "attempt_id", "paper_id").distinct().join(marks, ["run_id", "attempt_id"], "left").join(here, "paper_id", "left")
    outcome = F.when(F.col("_mark").isNull(), "retry").when(F.col("_here").isNull(), "lost").otherwise("committed")
    return rows.select("run_id", "attempt_id", "paper_id", outcome.alias("outcome"))


def merged_events(stored: DataFrame, control: DataFrame) -> DataFrame:
    """Events of a run with those that came from outside (negative ids), each id once; stored ones win."""
    return stored.unionByName(control.join(stored.select("run_id", "event_id"), ["run_id", "event_id"], "left_anti").dropDuplicates(["run_id", "event_id"]))


def tree(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """run_id, depth, path, node, mark: the expansion as a tree.

    A node is unfolded where it is first met, by depth and then path; met again it is marked shared, and
    cycle if it lies on its own path.  One join per level, up to the depth of the run.
    """
    level = checkpointed(roots.select("run_id", F.lit(0).alias("depth"), F.array("node").alias("path"), "node", F.lit("").alias("mark")))
    rows = [level]
    seen = level.select("run_id", "node")
    for d in range(1, depth + 1):
        child = level.where("mark = ''").join(edges.select("run_id", F.col("source").alias("node"), F.col("target").alias("_t")), ["run_id", "node"])
        child = child.select("run_id", F.lit(d).alias("depth"), F.concat("path", F.array("_t")).alias("path"), F.col("_t").alias("node"), F.array_contains("path", F.col("_t")).alias("_cycle"))
        again = F.row_number().over(Window.partitionBy("run_id", "node").orderBy("_cycle", "path")) > 1
        child = child.withColumn("_again", again).join(seen.withColumn("_seen", F.lit(True)), ["run_id", "node"], "left")
        mark = F.when(F.col("_cycle"), "cycle").when(F.col("_again") | F.col("_seen").isNotNull(), "shared").otherwise("")
        level = checkpointed(child.select("run_id", "depth", "path", "node", mark.alias("mark")))
        if level.isEmpty():
            break
        rows.append(level)
        seen = checkpointed(seen.unionByName(level.where("mark = ''").select("run_id", "node")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def rendered(run: DataFrame) -> str:
    """Lines of one run's tree, indented by depth."""
    lines = []
    for r in run.orderBy("path").collect():  # one run has at most as many rows as its edge budget
        lines.append("  " * r.depth + "- " + r.node + (f" ({r.mark})" if r.mark else ""))
    return "\n".join(lines)
