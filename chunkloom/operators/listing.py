"""What a manifest holds: states, places, sizes, keys and groups."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from ..manifest import Manifest
from ..schema import INLINE, MISSING, VIRTUAL


#: Chunk numbers of a formula that are listed together.
STRETCH = 1 << 16


def chunk_state(file_id):
    """The state that a saved file index stands for."""
    return F.when(file_id == 0, MISSING).when(file_id == 2**32 - 1, INLINE).otherwise(VIRTUAL)


def state_counts(chunks: DataFrame) -> DataFrame:
    """Chunks by state and distinct files, for each array and in total (array_path null)."""
    count = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    virtual = F.when(F.col("state") == VIRTUAL, F.col("file_id"))
    return chunks.rollup("array_path").agg(count(VIRTUAL), count(INLINE), count(MISSING), F.count_distinct(virtual).alias("n_files"))


def locations(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Place of every virtual chunk: array_path, chunk_lin, uri, offset, nbytes."""
    return chunks.filter(F.col("state") == VIRTUAL).join(files.select("file_id", "uri"), "file_id").select("array_path", "chunk_lin", "uri", "offset", "nbytes")


def storage_size(chunks: DataFrame) -> DataFrame:
    """Encoded bytes of each array: virtual and inline ones; missing chunks take none."""
    size = F.when(F.col("state") == VIRTUAL, F.col("nbytes")).when(F.col("state") == INLINE, F.octet_length("inline").cast("long")).otherwise(0)
    return chunks.groupBy("array_path").agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def affine_chunks(arrays: DataFrame) -> DataFrame:
    """Chunk rows of arrays whose places are a formula, generated from it."""
    keep = [c for c in ("member",) if c in arrays.columns]
    formula = [F.col(f"affine.{c}").alias(f"_{c}") for c in ("file_id", "base", "strides", "chunkbytes")]
    a = arrays.filter(F.col("map_kind") == "affine").select(*keep, "array_path", *formula, grid.grid_size(F.col("shape"), F.col("chunks")).alias("grid"))
    # Stretches of chunk numbers first, dealt out, then the numbers: no task lists those of a large array alone.
    last = grid.product(F.col("grid")) - 1
    a = a.filter(last >= 0).withColumn("last", last).select("*", F.explode(F.sequence(F.lit(0).cast("long"), grid.quotient(F.col("last"), F.lit(STRETCH)))).alias("stretch"))
    first = F.col("stretch") * STRETCH
    rows = a.repartition("array_path", "stretch").select(*keep, "array_path", "_file_id", "_base", "_strides", "_chunkbytes", "grid", F.explode(F.sequence(first, F.least(first + STRETCH - 1, F.col("last")))).alias("chunk_lin"))
    where = grid.affine_offset(grid.delinearize(F.col("chunk_lin"), F.col("grid")), F.col("_base"), F.col("_strides"))
    return rows.select(
        *keep, "array_path", "chunk_lin", F.lit(VIRTUAL).alias("state"), F.col("_file_id").alias("file_id"), where.alias("offset"), F.col("_chunkbytes").alias("nbytes"), F.lit(None).cast("binary").alias("inline")
    )


def all_chunks(m: Manifest) -> DataFrame:
    return m.chunks.unionByName(affine_chunks(m.arrays))


def chunk_keys(arrays: DataFrame, chunks: DataFrame) -> DataFrame:
    """The key `i.j.k` of every chunk row."""
    g = arrays.select("array_path", grid.grid_size(F.col("shape"), F.col("chunks")).alias("grid"))
    return chunks.join(g, "array_path").select("*", grid.chunk_key(grid.delinearize(F.col("chunk_lin"), F.col("grid"))).alias("chunk_key"))


def children(paths: DataFrame, group: str = "") -> DataFrame:
    """Names right below a group, and whether each is an array or a group."""
    head = group + "/" if group else ""
    rest = F.substring(F.col("array_path"), len(head) + 1, 1 << 30)
    inside = paths.filter(F.col("array_path").startswith(head)) if head else paths
    return (
        inside.select(F.substring_index(rest, "/", 1).alias("name"), rest.contains("/").alias("deeper"))
        .groupBy("name").agg(F.when(F.bool_or("deeper"), "group").otherwise("array").alias("kind"))
    )


def implicit_groups(paths: DataFrame) -> DataFrame:
    """Groups that exist by their arrays' paths only, the root among them."""
    groups = paths.select(F.explode(grid.prefixes(F.col("array_path"))).alias("group_path")).distinct()
    return groups.join(paths.select(F.col("array_path").alias("group_path")), "group_path", "left_anti")


def array_document(row) -> dict:
    """The Zarr v2 metadata of an array row."""
    fill = row["fill_value"]
    if fill is not None and row["dtype"][1:2] in "iu":
        fill = int(float(fill))
    elif fill is not None and row["dtype"][1:2] in "fc":
        fill = fill if fill in ("NaN", "Infinity", "-Infinity") else json.loads(fill)
    elif fill is not None and row["dtype"][1:2] == "b":
        fill = fill.lower() in ("true", "1")
    return {
        "zarr_format": 2, "shape": list(row["shape"]), "chunks": list(row["chunks"]), "dtype": row["dtype"], "compressor": json.loads(row["compressor"]) if row["compressor"] else None,
        "fill_value": fill, "order": "C", "filters": [json.loads(f) for f in row["filters"]] if row["filters"] else None,
    }


def attr_document(row) -> dict:
    """Attributes with _ARRAY_DIMENSIONS; values that JSON cannot spell are left out."""
    attrs = json.loads(row["attrs"] or "{}")
    keep = {k: v for k, v in attrs.items() if not (isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))))}
    return keep | ({"_ARRAY_DIMENSIONS": list(row["dims"])} if row["dims"] is not None else {})


def lookup(m: Manifest, key: str):
    """What a store key stands for: a document (dict), a chunk row, or None."""
    prefix, _, leaf = key.rpartition("/")
    if leaf in (".zarray", ".zattrs", ".zgroup"):
        rows = m.arrays.filter(F.col("array_path") == prefix).limit(1).collect()
        if rows:
            return {".zarray": array_document, ".zattrs": attr_document}.get(leaf, lambda r: None)(rows[0])
        if prefix and m.arrays.filter(F.col("array_path").startswith(prefix + "/")).isEmpty():
            return None
        return {".zgroup": {"zarr_format": 2}, ".zattrs": m.attrs if not prefix else {}}.get(leaf)
    rows = m.arrays.filter(F.col("array_path") == prefix).select("array_path", grid.parse_chunk_key(F.lit(leaf), grid.grid_size(F.col("shape"), F.col("chunks"))).alias("chunk_lin"))
    found = all_chunks(m).join(rows, ["array_path", "chunk_lin"]).filter(F.col("state") != MISSING).limit(1).collect()
    return found[0] if found else None


def keys(m: Manifest, path: str) -> list[str]:
    """Keys below an array or group: its documents and its chunks that are not missing."""
    row = m.arrays.filter(F.col("array_path") == path).limit(1).collect()
    if not row:
        return [".zattrs", ".zgroup"]
    own = all_chunks(m).filter((F.col("array_path") == path) & (F.col("state") != MISSING))
    return [".zarray", ".zattrs"] + [r[0] for r in chunk_keys(m.arrays, own).orderBy("chunk_lin").select("chunk_key").collect()]


def exists(m: Manifest, path: str) -> bool:
    return is_array(m, path) or is_group(m, path)


def is_array(m: Manifest, path: str) -> bool:
    return not m.arrays.filter(F.col("array_path") == path).isEmpty()


def is_group(m: Manifest, path: str) -> bool:
    """The root, or a path that an array lies below."""
    return not path or not m.arrays.filter(F.col("array_path").startswith(path + "/")).isEmpty()


def dimensions(m: Manifest, path: str) -> dict[str, int]:
    row = m.array(path)
    return dict(zip(row["dims"], row["shape"]))


def attribute(m: Manifest, path: str, name: str):
    """One attribute of an array, None if it has none of the name."""
    return json.loads(m.array(path)["attrs"] or "{}").get(name)


def is_initialized(m: Manifest, path: str, chunk_lin: int) -> bool:
    """Whether a chunk has bytes."""
    return not all_chunks(m).filter((F.col("array_path") == path) & (F.col("chunk_lin") == chunk_lin) & (F.col("state") != MISSING)).isEmpty()
