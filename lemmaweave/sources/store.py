"""Evidence tables as Parquet by paper, replaced whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class InvalidEvidence(ValueError):
    """Rows that refer to nothing, or ids that repeat."""


def check_unique(df: DataFrame, keys: list[str], what: str) -> None:
    bad = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if bad:
        raise InvalidEvidence(f"{what}: repeated {bad[0].asDict()}")


def check_traceable(refs: DataFrame, column: str, targets: DataFrame, target: str, what: str) -> None:
    """Every non-null reference has its target, else nothing is written."""
    bad = refs.where(F.col(column).isNotNull()).join(targets, refs[column] == targets[target], "left_anti").limit(1).collect()
    if bad:
        raise InvalidEvidence(f"{what}: no target for {bad[0][column]}")


def replace_papers(df: DataFrame, path: str, papers: DataFrame | None = None) -> None:
    """Overwrite the partitions of the papers in df; other papers stay, and a failing job changes nothing.

    papers: all that came anew.  Those of them without a row in df lose the rows they had.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("paper_id").parquet(path)
    if papers is not None:
        emptied = papers.select("paper_id").distinct().join(df.select("paper_id").distinct(), "paper_id", "left_anti")
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for row in emptied.toLocalIterator():  # no more than the papers of one batch, one at a time
            name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(row.paper_id)
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/paper_id={name}")
            folder.getFileSystem(conf).delete(folder, True)


def latest(projects: DataFrame) -> DataFrame:
    """One row per paper: the greatest seq, if there is such a column, then the greatest hash of the files."""
    content = F.sha2(F.to_json(F.struct("main", F.array_sort(F.map_entries("files")))), 256)
    order = F.struct(*[F.col(c) for c in ("seq",) if c in projects.columns], content)
    whole = F.struct(*projects.columns)
    return projects.groupBy("paper_id").agg(F.max_by(whole, order).alias("_p")).select("_p.*")


def read_evidence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evidence documents from JSON lines; a line that is no document is an error, not a row of nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def check_evidence(docs: DataFrame) -> None:
    """Names of papers and results are well formed and unique, and every owner of a proof is a result of its paper."""
    bad = docs.where(F.col("paper_id").isNull() | ~F.col("paper_id").rlike("^(local|arxiv):[^:]+$")).limit(1).collect()
    if bad:
        raise InvalidEvidence(f"papers: no name is {bad[0].paper_id}")
    results = docs.select("paper_id", F.inline("statements")).select("paper_id", "local_id")
    check_unique(docs, ["paper_id"], "papers")
    check_unique(results, ["paper_id", "local_id"], "results")
    if not results.where(F.col("local_id").isNull() | F.col("local_id").contains("::")).isEmpty():
        raise InvalidEvidence("results: an id is missing or holds '::'")
    owners = docs.select("paper_id", F.inline("proofs")).where("owner is not null").select(F.concat_ws("::", "paper_id", "owner").alias("owner"))
    check_traceable(owners, "owner", results.select(F.concat_ws("::", "paper_id", "local_id").alias("id")), "id", "proofs")


def read_projects(spark: SparkSession, path: str, main: str = "main.tex") -> DataFrame:
    """projects(paper_id, main, files) from folders of text files: the folder below path names the paper."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"\.(tex|bib)$"))
    rest = F.substring_index("path", path.rstrip("/") + "/", -1)
    rows = files.select(F.concat(F.lit("local:"), F.substring_index(rest, "/", 1)).alias("paper_id"), F.expr("1").alias("_one"), rest.alias("_p"), F.decode("content", "UTF-8").alias("text"))
    rows = rows.withColumn("file", F.regexp_replace("_p", "^[^/]*/", ""))
    return rows.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("file", "text"))).alias("files")).withColumn("main", F.lit(main))
