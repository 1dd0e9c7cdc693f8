"""Validation: recorded files against what is there, and chunk rows against the files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..manifest import Manifest
from ..schema import INLINE, VIRTUAL
from .listing import all_chunks


def file_status(files: DataFrame, live: DataFrame) -> DataFrame:
    """Each file: missing (not there), unverifiable (no recorded size), mismatch or verified.

    `live` has uri and live_size of the files that are there. Sizes alone are compared. A file
    that is not there is missing, whether or not its size was recorded.
    """
    status = (
        F.when(F.col("live_size").isNull(), "missing").when(F.col("size").isNull(), "unverifiable").when(F.col("size") != F.col("live_size"), "mismatch").otherwise("verified")
    )
    return files.join(live, "uri", "left").select("file_id", "uri", "size", "live_size", status.alias("status"))


def issues(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunk rows that cannot be right: bad_index, offset_overflow, empty_inline."""
    rows = chunks.join(files.select("file_id", F.col("size").alias("file_size"), F.lit(True).alias("known")), "file_id", "left")
    kind = (
        F.when((F.col("state") == VIRTUAL) & F.col("known").isNull(), "bad_index")
        .when((F.col("state") == VIRTUAL) & (F.col("offset") + F.col("nbytes") > F.col("file_size")), "offset_overflow")
        .when((F.col("state") == INLINE) & (F.coalesce(F.octet_length("inline"), F.lit(0)) == 0), "empty_inline")
    )
    return rows.select("array_path", "chunk_lin", kind.alias("issue")).filter(F.col("issue").isNotNull())


def summary(status: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counts, and passed: no fault at all and one verified file at least."""
    s = status.agg(*[F.count_if(F.col("status") == k).alias(f"n_{k}") for k in ("verified", "unverifiable", "missing", "mismatch")])
    i = found.agg(F.count("*").alias("n_issues"))
    both = s.join(i)  # one row each
    return both.withColumn("passed", (F.col("n_missing") + F.col("n_mismatch") + F.col("n_issues") == 0) & (F.col("n_verified") > 0))


def probe(files: DataFrame, size_of: Callable[[str], int | None]) -> DataFrame:
    """uri and live_size of each distinct file, asked once on the executors; null if not there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uris = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array([size_of(u) for u in uris], pa.int64())], names=["uri", "live_size"])

    return files.select("uri").distinct().mapInArrow(run, "uri string, live_size long")


def validate(m: Manifest, size_of: Callable[[str], int | None] | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status, issues, summary). With `strict` the first fault raises, chunk rows before files."""
    if size_of is None:
        from ..plans.fetch import current

        size_of = current().size  # the driver's transports and checks go along
    status, found = file_status(m.files, probe(m.files, size_of)), issues(all_chunks(m), m.files)
    if strict:
        bad = found.orderBy("array_path", "chunk_lin").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0]['issue']} in {bad[0]['array_path']}, chunk {bad[0]['chunk_lin']}")
        bad = status.filter(F.col("status").isin("missing", "mismatch")).orderBy("file_id").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0]['status']}: {bad[0]['uri']}")
    return status, found, summary(status, found)
