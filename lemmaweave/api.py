"""A workspace of papers: named questions over evidence tables in one folder.

Every question gives a DataFrame; single lookups raise KeyError for an unknown
id.  Papers are replaced whole, in one commit over all tables; reading state is an append-only log.
"""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import extract, graph, relational, report, state
from .session import reach_workers
from .sources import archive, store
from .sources.snapshots import Snapshots

LOG = "session_id string, target_kind string, target_id string, status string, note string, at timestamp, seq bigint"
QUEUE = "queue_id string, section int, ord int, target_kind string, target_id string"


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        reach_workers(spark)
        self.spark, self.folder = spark, folder.rstrip("/")
        self.snapshots = Snapshots(spark, f"{self.folder}/papers")

    # papers

    def add_projects(self, projects: DataFrame) -> None:
        """Extract projects(paper_id, main, files) and replace those papers; repeated local ids are refused."""
        docs = extract.documents(projects).persist()
        store.check_unique(docs, ["paper_id"], "papers")
        store.check_unique(extract.results(docs), ["paper_id", "local_id"], "results")
        self.snapshots.commit({"documents": docs}, docs)
        docs.unpersist()

    def add_evidence(self, docs: DataFrame) -> None:
        """Replace papers by evidence documents that were extracted elsewhere; bad ones change nothing."""
        docs = docs.select(*extract.documents(self.spark.createDataFrame([], "paper_id string, main string, files map<string,string>")).columns).persist()
        store.check_evidence(docs)
        self.snapshots.commit({"documents": docs}, docs)
        docs.unpersist()

    def add_files(self, paper_id: str, files: dict[str, str], main: str | None = None) -> None:
        row = (paper_id, archive.main_file(files, main), files)
        self.add_projects(self.spark.createDataFrame([row], "paper_id string, main string, files map<string,string>"))

    def add_folder(self, paper_id: str, folder: str, main: str | None = None) -> None:
        root = Path(folder)
        self.add_files(paper_id, {p.relative_to(root).as_posix(): p.read_text("utf-8", "replace") for p in sorted(root.rglob("*")) if p.suffix in (".tex", ".bib")}, main)

    def add_package(self, paper_id: str, package: bytes, main: str | None = None) -> None:
        self.add_files(paper_id, archive.unpack(package), main)

    @property
    def documents(self) -> DataFrame:
        return self.snapshots.read("documents", extract.DOCUMENT)

    def _paper(self, paper_id: str) -> DataFrame:
        one = self.documents.where(F.col("paper_id") == paper_id)
        if one.isEmpty():
            raise KeyError(paper_id)
        return one

    def list_papers(self) -> DataFrame:
        d = self.documents
        n = lambda df, name: (df, "paper_id", None)
        return relational.zero_filled_counts(d.select("paper_id", "title", "error"), "paper_id", {
            "n_results": n(extract.results(d), "r"), "n_proofs": n(d.select("paper_id", F.inline("proofs")), "p"), "n_citations": n(d.select("paper_id", F.inline("citations")), "c")})

    def paper_summary(self, paper_id: str) -> DataFrame:
        return extract.results(self._paper(paper_id)).groupBy("normalized_kind").agg(F.count("*").alias("n"))

    # results

    def list_results(self, paper_id: str | None = None, kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        rows = extract.results(self.documents if paper_id is None else self._paper(paper_id))
        if kind is not None:
            rows = rows.where((F.col("kind") == kind) | (F.col("normalized_kind") == kind))
        return relational.page(rows, ["paper_id", "global_id"], limit, offset)

    def search(self, needle: str, paper_id: str | None = None, kind: str | None = None, limit: int = 20) -> DataFrame:
        if not needle.strip():
            raise ValueError("an empty search")
        rows = relational.substring_search(extract.results(self.documents), F.col("title"), F.col("content"), needle)
        for column, value in (("paper_id", paper_id), ("kind", kind)):
            rows = rows if value is None else rows.where(F.col(column) == value)
        return relational.page(rows.drop("content"), ["paper_id", "global_id"], limit)

    def get_result(self, global_id: str) -> dict:
        paper_id = global_id.split("::", 1)[0]
        row = extract.results(self._paper(paper_id)).where(F.col("global_id") == global_id).first()
        if row is None:
            raise KeyError(global_id)
        return row.asDict(recursive=True)

    def get_proof(self, global_id: str) -> DataFrame:
        """The proof of a result: of several, the one whose number is first as text."""
        row = self.get_result(global_id)
        mine = self._paper(row["paper_id"]).select("paper_id", F.inline("proofs")).where(F.col("owner") == row["local_id"])
        return mine.orderBy(F.col("number").cast("string")).limit(1)

    def dependencies(self, global_id: str, recursive: bool = False) -> DataFrame:
        row = self.get_result(global_id)
        refs = extract.statement_refs(self._paper(row["paper_id"]))
        if not recursive:
            return refs.where(F.col("source") == row["local_id"]).orderBy("ref_label")
        edges = refs.where("target is not null").select("paper_id", F.col("source").alias("src"), F.col("target").alias("dst"), "ord")
        return graph.dependencies(edges).where(F.col("root") == row["local_id"]).orderBy("position")

    def where_used(self, global_id: str) -> DataFrame:
        row = self.get_result(global_id)
        return extract.statement_refs(self._paper(row["paper_id"])).where(F.col("target") == row["local_id"]).select("source").distinct().orderBy("source")

    def diagnostics(self, global_id: str) -> dict:
        """Labels referred to, resolved and not; no reference does not mean independence."""
        rows = self.dependencies(global_id).collect()
        return {"referenced": [r.ref_label for r in rows], "resolved": [r.ref_label for r in rows if r.target], "unresolved": [r.ref_label for r in rows if not r.target], "warning": None if rows else "no explicit reference; independence is not established"}

    def reading_path(self, global_id: str) -> DataFrame:
        row = self.get_result(global_id)
        return graph.reading_paths(extract.dependency_edges(self._paper(row["paper_id"]))).where(F.col("root") == row["local_id"])

    # citations

    def citations(self, paper_id: str, direction: str = "outgoing", include_unresolved: bool = True) -> DataFrame:
        rows = extract.citation_records(self.documents)
        if direction not in ("outgoing", "incoming"):
            raise ValueError(direction)
        rows = rows.where(F.col("paper_id" if direction == "outgoing" else "target_paper_id") == paper_id)
        return rows if include_unresolved else rows.where("target_paper_id is not null")

    def import_plan(self, paper_id: str | None = None) -> DataFrame:
        plan = extract.import_plan(self.documents)
        return plan if paper_id is None else plan.where(F.array_contains("needed_by", paper_id))

    def cross_paper_edges(self, paper_ids: list[str]) -> DataFrame:
        if not 2 <= len(set(paper_ids)) <= 8:
            raise ValueError("2 to 8 different papers")
        rows = extract.citation_records(self.documents)
        return rows.where(F.col("paper_id").isin(paper_ids) & F.col("target_paper_id").isin(paper_ids)).groupBy("paper_id", "target_paper_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("key")).alias("keys"))

    # overviews

    def paper_map(self, paper_id: str, max_candidates: int = 5) -> DataFrame:
        if isinstance(max_candidates, bool) or not 1 <= max_candidates <= 20:
            raise ValueError("max_candidates must be 1..20")
        return report.main_results(self._paper(paper_id), max_candidates)

    def triage(self) -> DataFrame:
        return report.triage(self.documents)

    def reading_report(self, paper_id: str) -> str:
        return report.reading_report(self.documents, paper_id)

    # reading state

    def record(self, session_id: str, target_kind: str, target_id: str, status: str, note: str | None = None, at: datetime | None = None) -> None:
        if status not in state.STATUSES:
            raise ValueError(status)
        at = at or datetime.now(UTC).replace(tzinfo=None)
        row = (session_id, target_kind, target_id, status, note, at, int(at.timestamp() * 1e6))
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    @property
    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")

    def checkpoints(self, session_id: str) -> DataFrame:
        return state.checkpoints(self.log.where(F.col("session_id") == session_id))

    def progress(self) -> DataFrame:
        return state.progress(self.log)

    def create_queue(self, queue_id: str, global_id: str) -> None:
        """A result, its proof, its dependencies in reading order, and what stops the reading."""
        row = self.get_result(global_id)
        key = lambda c: scalar.global_id(F.lit(row["paper_id"]), c)
        one = self.spark.createDataFrame([(queue_id, 0, 0, "result", global_id)], QUEUE)
        deps = self.reading_path(global_id).select(F.posexplode("top_down").alias("ord", "node")).where("ord > 0").select(F.lit(queue_id).alias("queue_id"), F.lit(1).alias("section"), "ord", F.lit("result").alias("target_kind"), key(F.col("node")).alias("target_id"))
        stops = extract.proof_mentions(self._paper(row["paper_id"])).where((F.col("owner") == row["local_id"]) & F.col("target").isNull()).select(F.lit(queue_id).alias("queue_id"), F.lit(2).alias("section"), "ord", F.lit("unresolved_stop").alias("target_kind"), F.col("ref_label").alias("target_id"))
        one.unionByName(deps).unionByName(stops).coalesce(1).write.mode("append").parquet(f"{self.folder}/queues")

    def queue(self, queue_id: str) -> DataFrame:
        items = self.spark.read.schema(QUEUE).parquet(f"{self.folder}/queues").where(F.col("queue_id") == queue_id)
        return state.queue(items).orderBy("position")
