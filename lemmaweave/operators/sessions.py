"""Reading sessions: ids, notes, summaries with what to do next, and queues applied to them.

sessions: session_id, paper_id, target_id, at.  notes: session_id, note_type, text, at, seq.  The log of
checkpoints is that of state.py.  All are append-only tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from . import state

#: Note types (fixed values).
NOTE_TYPES = ("note", "question", "review")
#: What to do next and when, in this order (fixed values).
NEXT_ACTIONS = (
    ("review_blocked_targets", "n_blocked > 0"),
    ("continue_queued_targets", "n_queued > 0"),
    ("review_target_result", "target_id is not null and not target_seen"),
    ("answer_or_retire_open_questions", "n_questions > 0"),
)


def named(requests: DataFrame, taken: DataFrame) -> DataFrame:
    """requests(paper_id, at, ...) with session_id: paper and time; ids that are taken or repeat get -2, -3, ..."""
    base = F.concat_ws("-", scalar.slug(F.col("paper_id")), scalar.time_slug(F.col("at")))
    rows = requests.withColumn("_base", base)
    used = taken.select(F.regexp_extract("session_id", r"^(.*Z)(?:-(\d+))?$", 1).alias("_base"), F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(session_id, '^(.*Z)(?:-(\\d+))?$', 2), '') as int)"), F.lit(1)).alias("_n"))
    used = used.groupBy("_base").agg(F.max("_n").alias("_used"))
    order = Window.partitionBy("_base").orderBy("at", "paper_id")
    rows = rows.join(used, "_base", "left").withColumn("_n", F.row_number().over(order) + F.coalesce("_used", F.lit(0)))
    return rows.withColumn("session_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string")))).drop("_base", "_used", "_n")


def latest_notes(notes: DataFrame, k: int = 5) -> DataFrame:
    """session_id, latest: the last k notes, the newest first."""
    order = Window.partitionBy("session_id").orderBy(F.desc("at"), F.desc("seq"))
    last = notes.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    listed = F.array_sort(F.collect_list(F.struct("_rank", "note_type", "text", "at")))
    return last.groupBy("session_id").agg(F.transform(listed, lambda x: x.dropFields("_rank")).alias("latest"))


def summaries(sessions: DataFrame, log: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per session: counts of every status, open questions, latest notes and next_actions in order."""
    points = state.checkpoints(log)
    seen = points.select("session_id", "target_id").distinct().withColumn("_seen", F.lit(True))
    asked = notes.groupBy("session_id").agg(F.count("*").alias("n_notes"), F.count_if(F.col("note_type") == "question").alias("n_questions"))
    out = sessions.join(state.progress(log), "session_id", "left").join(asked, "session_id", "left").join(seen, ["session_id", "target_id"], "left").join(latest_notes(notes), "session_id", "left")
    out = out.fillna(0, ["n_targets", "n_notes", "n_questions", *[f"n_{s}" for s in state.STATUSES]]).withColumn("target_seen", F.coalesce("_seen", F.lit(False))).drop("_seen")
    actions = F.array_compact(F.array(*[F.when(F.expr(when), F.lit(name)) for name, when in NEXT_ACTIONS]))
    return out.withColumn("next_actions", actions).drop("target_seen")


def listed(sessions: DataFrame, log: DataFrame, notes: DataFrame, paper_id: str | None = None) -> DataFrame:
    """Sessions with their numbers of checkpoints and notes, the newest first."""
    rows = sessions if paper_id is None else sessions.where(F.col("paper_id") == paper_id)
    n = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    rows = rows.join(n(state.checkpoints(log), "n_checkpoints"), "session_id", "left").join(n(notes, "n_notes"), "session_id", "left")
    return rows.fillna(0, ["n_checkpoints", "n_notes"]).orderBy(F.desc("at"), "session_id")


def applied(items: DataFrame, queues: DataFrame, sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Log rows that put the items of a queue into a session as queued; wanted: queue_id, session_id, at, seq.

    Queue and session must be of one paper: a pair that is not gives a row with refused set, and no items.
    """
    pairs = wanted.join(queues.select("queue_id", F.col("paper_id").alias("_q")), "queue_id", "left").join(sessions.select("session_id", F.col("paper_id").alias("_s")), "session_id", "left")
    pairs = pairs.withColumn("refused", F.when(F.col("_q").isNull(), "unknown_queue").when(F.col("_s").isNull(), "unknown_session").when(F.col("_q") != F.col("_s"), "other_paper"))
    good = pairs.where("refused is null").join(state.queue(items), "queue_id")
    cols = ["session_id", "queue_id", "target_kind", "target_id", "status", "at", "seq", "refused"]
    rows = good.withColumns({"status": F.lit("queued"), "seq": F.col("seq") + F.col("position")}).select(cols)
    none = pairs.where("refused is not null").withColumns({c: F.lit(None).cast("string") for c in ("target_kind", "target_id", "status")}).select(cols)
    return rows.unionByName(none)


def invalid_targets(log: DataFrame, known: DataFrame) -> DataFrame:
    """Log rows whose target does not exist; stops of a queue need no target."""
    free = F.col("target_kind").isin("external_stop", "unresolved_stop")
    return log.where(~free).join(known.select("target_kind", "target_id"), ["target_kind", "target_id"], "left_anti")


def review_notes(log: DataFrame, paper_sessions: DataFrame, at, text: str = "the paper was imported again") -> DataFrame:  # noqa: ANN001
    """A note for each session of a paper that came anew, so that a reader sees why its checkpoints are blocked."""
    touched = state.checkpoints(log).where("status <> 'skipped'").join(paper_sessions.select("session_id").distinct(), "session_id", "left_semi")
    return touched.groupBy("session_id").agg(F.count("*").alias("seq")).select("session_id", F.lit("review").alias("note_type"), F.lit(text).alias("text"), F.lit(at).alias("at"), "seq")
