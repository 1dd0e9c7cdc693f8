"""Edits of references. Each gives a new manifest; a check that fails changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..manifest import Manifest
from ..schema import CHUNKS, INLINE, MISSING, VIRTUAL
from .listing import affine_chunks


def _no_collision(files: DataFrame) -> None:
    twice = files.groupBy("uri").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two files would have the uri {twice[0]['uri']!r}")


def with_uri(files: DataFrame, file_id: int, uri: str) -> DataFrame:
    return files.withColumn("uri", F.when(F.col("file_id") == file_id, F.lit(uri)).otherwise(F.col("uri")))


def with_prefix(files: DataFrame, old: str, new: str) -> DataFrame:
    return files.withColumn("uri", F.when(F.col("uri").startswith(old), F.concat(F.lit(new), F.substring("uri", len(old) + 1, 1 << 30))).otherwise(F.col("uri")))


def set_uri(m: Manifest, file_id: int, uri: str) -> Manifest:
    files = with_uri(m.files, file_id, uri)
    _no_collision(files)
    return m.with_(files=files)


def replace_prefix(m: Manifest, old: str, new: str) -> Manifest:
    """Repoint all files whose uri begins with `old`; all or none."""
    files = with_prefix(m.files, old, new)
    _no_collision(files)
    return m.with_(files=files)


def push_uris(files: DataFrame, more: DataFrame) -> DataFrame:
    """Insert-if-absent of (uri, etag, size, mtime); new files are numbered on from the last.

    A uri that is there with another size, etag or mtime is an error; null is no value.
    """
    every = files.select("uri", "etag", "size", "mtime").unionByName(more.select("uri", "etag", "size", "mtime"))
    clash = every.groupBy("uri").agg(*[F.count_distinct(c).alias(c) for c in ("etag", "size", "mtime")]).filter("etag > 1 or size > 1 or mtime > 1").limit(1).collect()
    if clash:
        raise ValueError(f"conflicting metadata for {clash[0]['uri']!r}")
    from pyspark.sql import Window

    new = more.join(files.select("uri"), "uri", "left_anti").groupBy("uri").agg(F.max("etag").alias("etag"), F.max("size").alias("size"), F.max("mtime").alias("mtime"))
    last = files.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
    # The new files only are numbered in one order; that list is the path dictionary's growth, not the chunks.
    numbered = new.withColumn("file_id", F.row_number().over(Window.orderBy("uri")).cast("long") + last)
    return files.unionByName(numbered.select(*files.columns))


def upsert_chunks(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of `changed` in place of those with their array and number."""
    return chunks.join(changed.select("array_path", "chunk_lin"), ["array_path", "chunk_lin"], "left_anti").unionByName(changed.select(*chunks.columns))


def set_chunk(m: Manifest, path: str, chunk_lin: int, *, uri: str | None = None, offset: int = 0, nbytes: int = 0, data: bytes | None = None) -> Manifest:
    """One chunk virtual (uri), inline (data) or missing (neither)."""
    row = m.array(path)
    if row["map_kind"] == "affine":
        raise ValueError(f"{path}: the chunks of a formula cannot be set; materialize it first")
    total = 1
    for n, c in zip(row["shape"], row["chunks"]):
        total *= -(-n // c)
    if not 0 <= chunk_lin < total:
        raise IndexError(f"{path} has {total} chunks")
    if data is not None and not data:
        raise ValueError("an inline chunk needs bytes")
    files, file_id, state = m.files, None, MISSING
    if data is not None:
        state = INLINE
    elif uri is not None:
        state = VIRTUAL
        files = push_uris(files, m.spark.createDataFrame([(uri, None, None, None)], "uri string, etag string, size long, mtime double"))
        file_id = files.filter(F.col("uri") == uri).first()["file_id"]
    new = m.spark.createDataFrame([(path, chunk_lin, state, file_id, offset if uri else None, nbytes if uri else None, data)], CHUNKS)
    return m.with_(files=files, chunks=upsert_chunks(m.chunks, new))


def materialize_affine(m: Manifest) -> Manifest:
    """Formulas written out as chunk rows."""
    arrays = m.arrays.withColumn("map_kind", F.lit("explicit")).withColumn("affine", F.lit(None).cast(m.arrays.schema["affine"].dataType))
    return m.with_(arrays=arrays, chunks=m.chunks.unionByName(affine_chunks(m.arrays)))
