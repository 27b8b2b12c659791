"""Product codes of vectors in whole numbers, alike on every machine.

A component x becomes floor(256 * x).  A vector is cut into equal parts, and a part is
coded by the nearest entry of its position's codebook.  Distances are screened by a
float32 matrix product, whose rounding error has a proven bound: every entry whose
interval overlaps the best one is measured again in 64-bit integers, and ties go to the
lower index.  So codes do not depend on the order of additions, the BLAS or the batches.

The codebooks hold parts x entries x width numbers, a size fixed by parameters and the
vectors' length; they travel with the tasks.  A round sums the members of every entry
within a task, then over tasks by (part, entry, component).

Defined results: rows whose vector is null or holds null, NaN or infinite components take
no part, nor do vectors whose length is not that of the kept row with the smallest vec_id
or no multiple of the number of parts; repeated rows are coded each; rows that share a
vec_id stand in the order of vector and label, a null vec_id last; with fewer rows than
entries the codebooks are as short; 256 * x beyond +-2^27 is held there, so that distances
fit into 64 bits; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, finite_vector, spread_join, stored

SCALE, LIMIT = 256.0, float(1 << 27)
#: unit roundoff of float32
ROUNDOFF = 2.0**-24
#: rows that are compared with a codebook at once
CHUNK = 4096
#: labels up to this number are broadcast with their sums
BROADCAST_LABELS = 100_000


@dataclass(frozen=True)
class Coding:
    parts: int = 16
    entries: int = 64
    rounds: int = 2


def integers(flat: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * flat.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def screened(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each point, ties to the lower index; both int64."""
    rows, width = points.shape
    squares = (book * book).sum(1)
    # |x - c|^2 less |x|^2, which is the same for all entries
    product = points.astype(np.float32) @ book.astype(np.float32).T
    score = (squares.astype(np.float32) - 2 * product).astype(np.float64)
    # Rounded inputs err by 2u, sums of `width` products in any order by about width * u, the rest by 2u;
    # sums of |x_i c_i| are at most |x| |c|.  A few u are added for the bound's own rounding.
    spans = np.sqrt((points.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt(squares.astype(np.float64))
    error = 1.01 * ROUNDOFF * (2 * (width + 6) * spans + 4 * squares)
    best = (score + error).min(1, keepdims=True)
    row, entry = np.nonzero(score - error <= best)
    exact = ((points[row] - book[entry]) ** 2).sum(1)
    least = np.minimum.reduceat(exact, np.searchsorted(row, np.arange(rows)))
    hits = np.flatnonzero(exact == least[row])
    first = hits[np.concatenate(([True], row[hits][1:] != row[hits][:-1]))]
    return entry[first], least


def assigned(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, distances) with a column per part.  values: rows x length; books: parts x entries x width."""
    parts, _, width = books.shape
    codes, far = np.empty((len(values), parts), np.int64), np.empty((len(values), parts), np.int64)
    for at in range(0, len(values), CHUNK):
        for p in range(parts):
            codes[at : at + CHUNK, p], far[at : at + CHUNK, p] = screened(values[at : at + CHUNK, p * width : (p + 1) * width], books[p])
    return codes, far


def _values(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return integers(batch.column("embedding").flatten().to_numpy(zero_copy_only=False)).reshape(-1, length)


def _partial_sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, component, total, n: the members of every entry, one row for each task that has some."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            values = _values(batch, parts * width)
            codes, _ = assigned(values, books)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], values[:, p * width : (p + 1) * width])
                n[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        part, entry, component = np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x, pa.int32()) for x in (part, entry, component)), pa.array(total[part, entry, component]), pa.array(n[part, entry])],
            ["part", "entry", "component", "total", "n"],
        )

    found = rows.select("embedding").mapInArrow(sums, "part int, entry int, component int, total bigint, n bigint")
    return found.groupBy("part", "entry", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def usable(vectors: DataFrame, coding: Coding) -> tuple[DataFrame, list]:
    """(rows that take part, the first of them that start the codebooks)."""
    rows = vectors.select("vec_id", "embedding", "label").where(finite_vector(F.col("embedding")) & (F.size("embedding") % coding.parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), "embedding", "label"]
    first = rows.orderBy(*order).select(F.size("embedding").alias("n")).first()
    rows = rows.where(F.size("embedding") == (first.n if first else 0))
    return rows, rows.orderBy(*order).limit(coding.entries).select("embedding").collect()


def trained(rows: DataFrame, start: list, coding: Coding) -> np.ndarray:
    """Codebooks, parts x entries x width, after the rounds.  start: at most `entries` rows."""
    first = integers(np.array([r.embedding for r in start], np.float64))
    books = np.ascontiguousarray(first.reshape(len(first), coding.parts, -1).transpose(1, 0, 2))
    for _ in range(coding.rounds):
        found = _partial_sums(rows, books).collect()  # at most parts x entries x width rows
        books = books.copy()
        for r in found:
            books[r.part, r.entry, r.component] = r.total // r.n
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of rows that take part."""
    parts, _, width = books.shape

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, far = assigned(_values(batch, parts * width), books)
            text = [row.tobytes().hex() for row in found.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds label_error, the error of all rows with the same label; nulls count as one label."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = rows.withColumn("_label", key)
    sums = rows.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    side, small = bounded_broadcast(sums.select("_label", "label_error"), BROADCAST_LABELS)
    out = rows.join(side, "_label") if small else spread_join(rows, side, ["_label"], ["vec_id", "code"], counts=sums.select("_label", "_n"))
    return out.drop("_label")


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, coding: Coding = Coding()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error; codebooks), trained on all rows and used for all rows."""
    if coding.entries > 256:
        raise ValueError("an index has two hex digits: at most 256 entries")
    rows, start = usable(vectors, coding)
    if not start:
        kinds = dict(rows.dtypes)
        return vectors.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint, label_error bigint"), np.empty((coding.parts, 0, 0), np.int64)
    books = trained(rows, start, coding)
    return with_label_error(stored(encoded(rows, books), "vector-codes")), books
