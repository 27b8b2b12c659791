"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reach_workers

#: ASCII white space that separates words, for trimming and as a regex class.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def finite_vector(vector: Column) -> Column:
    """True for vectors that have components, and only finite ones."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.  Only a session on one machine may go without: it takes one under /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        folder = "file:///tmp/checkpoints/lemmaweave"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, which survives lost executors.

    Shuffle files and checkpoints that nothing refers to any more are deleted now, not when the
    driver next collects its garbage.
    """
    shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    df.sparkSession.sparkContext._jvm.System.gc()
    return done


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder, in folders by a column if named, and read it back."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files behind the table now
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(table: DataFrame, column: str, value: str) -> None:
    """Delete the folders of one value of a table stored by that column, when nothing reads them any more."""
    for folder in {os.path.dirname(f) for f in table.where(F.col(column) == value).inputFiles()}:
        if folder.endswith(f"/{column}={value}"):
            _delete(table.sparkSession, folder)


def forget(table: DataFrame) -> None:
    """Delete a table of stored() when nothing reads it any more."""
    shared = shared_folder(table.sparkSession)
    for folder in {os.path.dirname(f) for f in table.inputFiles()}:
        if shared.split(":")[-1].strip("/") in folder:
            _delete(table.sparkSession, folder)


def bounded_broadcast(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Hint a broadcast only if a count proves the side small; callers join by key either way."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], by: list[str], how: str = "left", counts: DataFrame | None = None, share: int = 1000) -> DataFrame:
    """Join rows to a side with one row per key, so that no task gets all the rows of a hot key.

    The rows of a key that holds more than 1/share of them are dealt by a hash of `by` over as many salts
    as it holds such shares, and the side has a row for each salt.  There are fewer than share hot keys,
    with fewer than 2 * share salts together, so only their names are broadcast, never the side, and the
    side grows by fewer than 2 * share rows.  Rows with a null in a key match nothing and are dealt too.
    counts: keys and _n, if known.
    """
    counts = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n"))) if counts is None else counts
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    each = max(total // share, 1)
    ways = F.ceil(F.col("_n") / each).cast("long").alias("_ways")
    hot = F.broadcast(counts.where((F.col("_n") > each) & (F.col("_n") > total / share)).select(*keys, ways))
    columns = [c for c in side.columns if c not in keys]
    whole = F.struct(*[F.col(c) for c in columns]) if columns else F.lit(True)
    spread = F.xxhash64(*by)
    empty = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    salt = F.when(empty, -1 - F.pmod(spread, F.lit(share))).when(F.col("_ways").isNotNull(), F.pmod(spread, F.col("_ways"))).otherwise(0)
    marked = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_ways")
    # salts come from explode: a literal 0 would become a filter, and the rows would be dealt by the keys alone
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_ways", F.lit(1)) - 1)).alias("_salt")
    many = side.select(*keys, whole.alias("_side")).join(hot, keys, "left").select(*keys, "_side", salts)
    out = marked.join(many, [*keys, "_salt"], how)
    return out.select(*[c for c in rows.columns], *[F.col("_side").getField(c).alias(c) for c in columns])
