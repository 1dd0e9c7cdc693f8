"""Kerchunk references, JSON and Parquet, in and out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import grid
from ..manifest import Manifest
from ..operators.listing import all_chunks, array_document, attr_document, chunk_keys, implicit_groups
from ..plans.window import dealt, fetcher


def embedded(chunks: DataFrame, files: DataFrame, threshold: int) -> DataFrame:
    """The chunk rows with virtual ones of fewer bytes than the threshold read in and made inline."""
    small = (F.col("state") == schema.VIRTUAL) & (F.col("nbytes") < threshold)
    kept = chunks.filter(~F.coalesce(small, F.lit(False)))
    fetched, columns = fetcher(), chunks.columns

    def run(batches):
        for r, data in fetched(batches):
            row = {"array_path": r["array_path"], "chunk_lin": r["chunk_lin"], "inline": data}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("array_path", pa.string()), ("chunk_lin", pa.int64()), ("inline", pa.binary())]))

    placed = chunks.filter(small).join(files.select("file_id", "uri"), "file_id").select("array_path", "chunk_lin", "state", "uri", "offset", "nbytes", "inline")
    read = dealt(placed).mapInArrow(run, "array_path string, chunk_lin long, inline binary")
    nul = lambda c: F.lit(None).cast("long").alias(c)
    state = F.when(F.col("inline").isNull(), schema.MISSING).otherwise(schema.INLINE).alias("state")
    return kept.unionByName(read.select("array_path", "chunk_lin", state, nul("file_id"), nul("offset"), nul("nbytes"), "inline").select(*columns))


def json_refs(chunks: DataFrame, files: DataFrame, arrays: DataFrame, inline_threshold: int = 0) -> DataFrame:
    """key and ref (JSON text or base64 text) of every chunk that is not missing. Chunks of fewer
    bytes than the threshold are embedded."""
    if inline_threshold > 0:
        chunks = embedded(chunks, files, inline_threshold)
    rows = chunk_keys(arrays, chunks.filter(F.col("state") != schema.MISSING)).join(files.select("file_id", "uri"), "file_id", "left")
    place = F.to_json(F.array(F.col("uri"), F.col("offset").cast("string"), F.col("nbytes").cast("string")))
    whole = F.to_json(F.array("uri"))
    plain = F.regexp_replace(place, r'^(\[".*"),"(\d+)","(\d+)"\]$', "$1,$2,$3]")
    ref = F.when(F.col("state") == schema.INLINE, F.concat(F.lit("base64:"), F.regexp_replace(F.base64("inline"), r"\s", ""))).when(F.col("nbytes") == schema.WHOLE_OBJECT, whole).otherwise(plain)
    return rows.select(F.concat_ws("/", "array_path", "chunk_key").alias("key"), ref.alias("ref"), (F.col("state") == schema.INLINE).alias("is_text"))


def documents(m: Manifest) -> dict[str, dict]:
    """All metadata documents: of the arrays and of the groups their paths imply."""
    out: dict[str, dict] = {".zgroup": {"zarr_format": 2}, ".zattrs": m.attrs}
    for r in m.arrays.collect():
        out[f"{r['array_path']}/.zarray"], out[f"{r['array_path']}/.zattrs"] = array_document(r), attr_document(r)
    for (g,) in implicit_groups(m.arrays.select("array_path")).filter("group_path != ''").collect():
        out[f"{g}/.zgroup"] = {"zarr_format": 2}
    return out


def save_json(m: Manifest, path: str, inline_threshold: int = 0) -> None:
    """One JSON document. Its refs are written by Spark as lines and joined to a file of parts:
    the format is a single object, so the driver streams the lines into it."""
    refs = json_refs(all_chunks(m), m.files, m.arrays, inline_threshold)
    with open(path, "w") as f:
        f.write('{"version":1,"refs":{')
        first = True
        for key, doc in sorted(documents(m).items()):
            f.write(("" if first else ",") + json.dumps(key) + ":" + json.dumps(json.dumps(doc)))
            first = False
        for r in refs.toLocalIterator():
            f.write("," + json.dumps(r["key"]) + ":" + (json.dumps(r["ref"]) if r["is_text"] else r["ref"]))
        f.write("}}")


def _array_row(path: str, doc: dict, attrs: dict) -> tuple:
    fill = doc.get("fill_value")
    dims = attrs.pop("_ARRAY_DIMENSIONS", None) or [f"dim_{i}" for i in range(len(doc["shape"]))]
    text = None if fill is None else fill if isinstance(fill, str) else json.dumps(fill)
    filters = [json.dumps(x) for x in doc["filters"]] if doc.get("filters") else None
    return (
        path, schema.check_dtype(doc["dtype"], path), doc["shape"], doc["chunks"], dims, text, json.dumps(doc["compressor"]) if doc.get("compressor") else None,
        filters, json.dumps(attrs), "explicit", None,
    )


def load_json(spark: SparkSession, path: str) -> Manifest:
    """A version 1 document: templates are put in, the four shapes of references told apart."""
    text = spark.read.text(path, wholetext=True)
    doc = F.from_json("value", "version int, gen string, templates map<string,string>")
    top = text.select(doc.alias("d"), F.get_json_object("value", "$.refs").isNotNull().alias("has_refs")).select("d.*", "has_refs").first()
    if top is None or not top["has_refs"] or top["version"] is None:
        raise ValueError(f"{path}: version and refs are needed")
    if top["version"] != 1 or top["gen"] is not None:
        raise ValueError(f"{path}: version {top['version']} or generated references are not supported")
    # One task parses the document, which is one JSON object; its rows are dealt out and kept.
    entries = F.from_json("value", "refs map<string,string>")["refs"]
    refs = text.select(F.explode(entries).alias("key", "ref")).repartition(spark.sparkContext.defaultParallelism).persist()
    docs = {r["key"]: r["ref"] for r in refs.filter(F.col("key").rlike(r"(^|/)\.z(array|attrs|group)$")).collect()}
    arrays = []
    for key, ref in sorted(docs.items()):
        if key.endswith(".zarray"):
            name = key[: -len("/.zarray")] if "/" in key else ""
            attrs = json.loads(docs.get(f"{name}/.zattrs" if name else ".zattrs", "{}"))
            arrays.append(_array_row(name, json.loads(ref), attrs))
    table = spark.createDataFrame(arrays, schema.ARRAYS)
    url = F.get_json_object("ref", "$[0]")
    for k, v in (top["templates"] or {}).items():
        url = F.replace(url, F.lit("{{" + k + "}}"), F.lit(v))
    rows = refs.filter(~F.col("key").rlike(r"(^|/)\.z(array|attrs|group)$"))
    is_list = F.col("ref").startswith("[")
    rows = rows.select(
        F.regexp_replace("key", "/?[^/]*$", "").alias("array_path"), F.substring_index("key", "/", -1).alias("chunk_key"),
        F.when(is_list, url).alias("uri"), F.when(is_list, F.coalesce(F.get_json_object("ref", "$[1]").cast("long"), F.lit(0))).alias("offset"),
        F.when(is_list, F.coalesce(F.get_json_object("ref", "$[2]").cast("long"), F.lit(schema.WHOLE_OBJECT))).alias("nbytes"),
        F.when(~is_list, F.when(F.col("ref").startswith("base64:"), F.unbase64(F.substring("ref", 8, 1 << 30))).otherwise(F.encode("ref", "utf-8"))).alias("inline"),
    )
    root = json.loads(docs.get(".zattrs", "{}")) if ".zarray" not in docs else {}
    return _numbered(spark, table, rows, root, {"path": path})


def _numbered(spark, arrays: DataFrame, rows: DataFrame, attrs: dict, provenance: dict) -> Manifest:
    from pyspark.sql import Window

    files = rows.select("uri").filter(F.col("uri").isNotNull()).distinct().select(F.row_number().over(Window.orderBy("uri")).cast("long").alias("file_id"), "uri", F.lit(None).cast("string").alias("etag"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("double").alias("mtime"))
    g = arrays.select("array_path", grid.grid_size(F.col("shape"), F.col("chunks")).alias("grid"))
    if "chunk_key" in rows.columns:
        rows = rows.join(g, "array_path").withColumn("chunk_lin", grid.parse_chunk_key(F.col("chunk_key"), F.col("grid"))).filter(F.col("chunk_lin").isNotNull())
    state = F.when(F.col("inline").isNotNull(), schema.INLINE).when(F.col("uri").isNotNull(), schema.VIRTUAL).otherwise(schema.MISSING)
    chunks = rows.join(files.select("file_id", "uri"), "uri", "left").select("array_path", "chunk_lin", state.alias("state"), "file_id", "offset", "nbytes", "inline")
    return Manifest(files, arrays, chunks, attrs, provenance)


def parquet_rows(chunks: DataFrame, files: DataFrame, totals: DataFrame, record_size: int) -> DataFrame:
    """The rows of the refs.N.parq files: every file has record_size rows, missing ones null."""
    n = F.floor((F.col("total") + record_size - 1) / record_size) * record_size
    every = totals.select("array_path", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_lin"))
    own = chunks.join(files.select("file_id", "uri"), "file_id", "left").withColumn("is_virtual", F.col("state") == schema.VIRTUAL)
    both = every.join(own, ["array_path", "chunk_lin"], "left")
    value = lambda c: F.when(F.col("is_virtual"), F.col(c)).otherwise(0)
    return both.select(
        "array_path", F.floor(F.col("chunk_lin") / record_size).alias("file_no"), (F.col("chunk_lin") % record_size).alias("row_no"), F.when(F.col("is_virtual"), F.col("uri")).alias("path"),
        value("offset").alias("offset"), value("nbytes").alias("size"), F.when(F.col("state") == schema.INLINE, F.col("inline")).alias("raw"),
    )


def save_parquet(m: Manifest, path: str, record_size: int = 10_000) -> None:
    """A directory that all executors reach: .zmetadata and <array>/refs.N.parq."""
    import os

    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.zmetadata", "w") as f:
        json.dump({"metadata": documents(m), "record_size": record_size, "zarr_consolidated_format": 1}, f)
    totals = m.arrays.select("array_path", grid.product(grid.grid_size(F.col("shape"), F.col("chunks"))).alias("total"))
    if m.arrays.filter(F.size("shape") == 0).limit(1).count():
        raise ValueError("an array without dimensions cannot be saved in this format")
    rows = parquet_rows(all_chunks(m), m.files, totals, record_size).repartition("array_path", "file_no").sortWithinPartitions("array_path", "file_no", "row_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        kind = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("raw", pa.binary())])
        now, held = None, []

        def put():
            if now is not None:
                os.makedirs(f"{path}/{now[0]}", exist_ok=True)
                pq.write_table(pa.Table.from_batches(held, schema=kind), f"{path}/{now[0]}/refs.{now[1]}.parq", compression="zstd", use_dictionary=["path"], write_statistics=False)

        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != now:
                    put()
                    now, held = keys[at], []
                held.append(pa.RecordBatch.from_arrays([b.column(i).slice(at, end - at).cast(t.type) for i, t in zip((3, 4, 5, 6), kind)], schema=kind))
                at = end
        put()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["done"])

    rows.mapInArrow(run, "done long").count()


def load_parquet(spark: SparkSession, path: str) -> Manifest:
    with open(f"{path}/.zmetadata") as f:
        top = json.load(f)
    record, docs = top["record_size"], top["metadata"]
    arrays = [_array_row(k[: -len("/.zarray")], v, dict(docs.get(k[: -len(".zarray")] + ".zattrs", {}))) for k, v in sorted(docs.items()) if k.endswith("/.zarray")]
    table = spark.createDataFrame(arrays, schema.ARRAYS)
    sizes = table.select("array_path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((grid.product(grid.grid_size(F.col("shape"), F.col("chunks"))) - 1) / record))).alias("file_no"), grid.product(grid.grid_size(F.col("shape"), F.col("chunks"))).alias("total"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            for name, k, total in zip(*(b.column(i).to_pylist() for i in range(3))):
                t = pq.read_table(f"{path}/{name}/refs.{k}.parq", columns=["path", "offset", "size", "raw"])
                n = min(record, total - k * record)
                if t.num_rows < n:
                    raise ValueError(f"{path}/{name}/refs.{k}.parq has {t.num_rows} of {n} references")
                t = t.slice(0, n)
                lin = pa.array(range(k * record, k * record + n), pa.int64())
                uri = t.column("path").cast(pa.string()).combine_chunks()
                yield from pa.table({"array_path": pa.array([name] * n, pa.string()), "chunk_lin": lin, "uri": uri, "offset": t.column("offset").cast(pa.int64()), "nbytes": t.column("size").cast(pa.int64()), "inline": t.column("raw").cast(pa.binary())}).to_batches()

    rows = sizes.repartition("array_path", "file_no").mapInArrow(run, "array_path string, chunk_lin long, uri string, offset long, nbytes long, inline binary")
    whole = rows.filter("uri is not null and offset = 0 and nbytes = 0 and inline is null").limit(1).collect()
    if whole:
        raise ValueError(f"{whole[0]['uri']}: whole-object references are not supported in this format")
    return _numbered(spark, table, rows, docs.get(".zattrs", {}), {"path": path})
