"""Several tables of papers that change together, or not at all.

A commit writes the rows of its papers into a folder of its own and then puts one manifest
beside those before; a version is the manifest of that number.  Writers race for the next
number: the rename of a manifest to a name that is taken fails, and the loser finds that
someone else was first (Conflict).  A job that dies before leaves a folder that no manifest
names.  Readers take one manifest for all tables, so they never see half a commit, and an
older version stays readable until vacuum() removes it.

A paper's rows are those of the last commit that named it, in every table: a paper that
comes anew without rows in a table has none there.  compact() writes a version's rows into
one commit, which ends the join by paper that finds them.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 12


class Conflict(RuntimeError):
    """Another commit was first."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    @property
    def _fs(self):
        return self._path("_versions").getFileSystem(self._conf)

    def version(self) -> int:
        """The last version, 0 before the first commit."""
        folder = self._path("_versions")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n[:WIDTH]) for n in names if n.endswith(".json") and n[:WIDTH].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """version, commits (folder, tables, label), the oldest first."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "commits": []}
        return json.loads(self.spark.read.text(f"{self.root}/_versions/{version:0{WIDTH}d}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> int:
        folder, context = self._path("_versions"), self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("_versions").toUri(), self._conf)
        self._fs.mkdirs(folder)
        draft, final = self._path(f"_versions/.{uuid.uuid4().hex}"), self._path(f"_versions/{manifest['version']:0{WIDTH}d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:  # without the option to overwrite
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(error):
                raise Conflict(f"version {manifest['version']} is taken") from error
            raise
        return manifest["version"]

    def commit(self, tables: dict[str, DataFrame], papers: DataFrame, base: int | None = None, label: str | None = None) -> int:
        """Replace the papers in all tables by the given rows; the new version.

        tables: rows with paper_id, of the papers named only.  base: the version the rows were made from, the last one
        if not given; a later commit is a Conflict.  label: a commit with a label that is there already changes nothing,
        so a replayed batch counts once.
        """
        base = self.version() if base is None else base
        before = self.manifest(base)
        if label is not None and any(c["label"] == label for c in before["commits"]):
            return base
        if self.version() != base:
            raise Conflict(f"version {base} is no longer the last")
        folder = f"commit-{uuid.uuid4().hex}"
        papers.select("paper_id").distinct().write.parquet(f"{self.root}/{folder}/_papers")
        for name, rows in tables.items():
            rows.write.parquet(f"{self.root}/{folder}/{name}")
        commits = [*before["commits"], {"folder": folder, "tables": sorted(tables), "label": label}]
        return self._publish({"version": base + 1, "commits": commits})

    def read(self, name: str, schema, version: int | None = None) -> DataFrame:
        """The rows of a table in one version."""
        commits = self.manifest(version)["commits"]
        found, owners = None, None
        for number, commit in enumerate(commits):
            named = self.spark.read.parquet(f"{self.root}/{commit['folder']}/_papers").withColumn("_commit", F.lit(number))
            owners = named if owners is None else owners.unionByName(named)
            if name in commit["tables"]:
                rows = self.spark.read.schema(schema).parquet(f"{self.root}/{commit['folder']}/{name}").withColumn("_commit", F.lit(number))
                found = rows if found is None else found.unionByName(rows)
        if found is None:
            return self.spark.createDataFrame([], schema)
        if len(commits) > 1:
            found = found.join(owners.groupBy("paper_id").agg(F.max("_commit").alias("_commit")), ["paper_id", "_commit"])
        return found.select(*self.spark.createDataFrame([], schema).columns)

    def compact(self, schemas: dict) -> int:
        """The last version with all its rows in one commit; labels stay known."""
        base = self.version()
        before = self.manifest(base)
        folder = f"commit-{uuid.uuid4().hex}"
        papers = None
        for commit in before["commits"]:
            one = self.spark.read.parquet(f"{self.root}/{commit['folder']}/_papers")
            papers = one if papers is None else papers.unionByName(one)
        if papers is None:
            return base
        papers.distinct().write.parquet(f"{self.root}/{folder}/_papers")
        for name, schema in schemas.items():
            self.read(name, schema, base).write.parquet(f"{self.root}/{folder}/{name}")
        known = [{"folder": folder, "tables": [], "label": c["label"]} for c in before["commits"] if c["label"] is not None]
        return self._publish({"version": base + 1, "commits": [*known[:-1], {"folder": folder, "tables": sorted(schemas), "label": known[-1]["label"] if known else None}]})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete versions before the last `keep` and the folders that only they name; the folders deleted.  Not beside a running commit."""
        last = self.version()
        kept = [v for v in range(max(1, last - keep + 1), last + 1)]
        used = {c["folder"] for v in kept for c in self.manifest(v)["commits"]}
        gone = [f.getPath().getName() for f in self._fs.listStatus(self._path("")) if f.getPath().getName().startswith("commit-") and f.getPath().getName() not in used]
        for name in gone:
            self._fs.delete(self._path(name), True)
        for f in self._fs.listStatus(self._path("_versions")):
            name = os.path.splitext(f.getPath().getName())[0]
            if name.isdigit() and int(name) not in kept:
                self._fs.delete(f.getPath(), False)
        return gone
