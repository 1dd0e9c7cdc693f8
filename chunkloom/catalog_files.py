"""Queries over real files: each writes small files of a format from the driver's tables, scans or
loads them, and returns what the tables' SQL says must come out."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import api, catalog, samples, schema, typed
from .catalog import CELLS_SQL, REFS_SQL, TREE_SQL, query
from .functions import crs
from .manifest import Manifest
from .operators import edit, integrity, listing, raster
from .plans import fetch, window
from .shared import shared_dir
from .sources import kerchunk, zips

#: Vectors to a file, and the chunk shape in it.
PART, CHUNK = 100, (50, 16)


def _where(spark: SparkSession, d: str, name: str) -> str:
    at = shared_dir(spark)
    return f"{at[len('file://'):] if at.startswith('file://') else at}/files/{zlib.crc32(d.encode()):08x}/{name}"


def _parts(spark: SparkSession, d: str, name: str, ending: str, make: Callable[[int, np.ndarray], bytes]) -> list[str]:
    """A file for every hundred vectors, of their float32 matrix."""
    e = catalog._t(spark, d, "embeddings").select(F.expr(f"vec_id div {PART}").alias("part"), "vec_id", "embedding")
    build = lambda k, rows: (f"part{k:05d}.{ending}", make(k, np.array([r["embedding"] for r in rows], "<f4")))
    return samples.write_parts(e, "part", build, _where(spark, d, name))


def _cells(df: DataFrame, column: str = "value") -> DataFrame:
    return df.select("i0", "i1", F.col(column).cast("double").alias("value"))


ALL_SQL = f"with {CELLS_SQL} select i0, i1, v::double as value from cells"
N_SQL = "parts as (select vec_id // 100 as part, count(*) as n, max(len(embedding)) as k from embeddings group by 1)"


# --- HDF5


def _h5(index: str | None, deflate: bool = False, absent: tuple[int, ...] = ()) -> Callable[[int, np.ndarray], bytes]:
    def make(k: int, a: np.ndarray) -> bytes:
        n, width = a.shape
        scale = {"CLASS": "DIMENSION_SCALE"}
        tree = {
            "v": samples.Dataset(a, None if index is None else CHUNK, index or "btree1", deflate, deflate, {"units": "1"}, -9999.0, absent, ("vec", "dim")),
            "vec": samples.Dataset(np.arange(k * PART, k * PART + n, dtype="<i8"), (PART,), attrs=scale),
            "dim": samples.Dataset(np.arange(width, dtype="<i8"), attrs=scale),
        }
        return samples.H5Writer().file(tree, {"title": "embeddings", "part_size": PART})

    return make


def _series(spark, d, name, ending, make, dim="vec") -> Manifest:
    return api.concat(api.scan_series(spark, _parts(spark, d, name, ending, make)), dim)


@query(ALL_SQL)
def h5_btree1(spark, d):
    """Chunks by version 1 B-tree, shuffled and deflated, files stacked along a named dimension."""
    return _cells(api.read_window(_series(spark, d, "h5_btree1", "h5", _h5("btree1", True)), "v"))


@query(ALL_SQL)
def h5_fixed_array(spark, d):
    return _cells(api.read_window(_series(spark, d, "h5_fixed", "h5", _h5("fixed", True)), "v"))


@query(ALL_SQL)
def h5_extensible_array(spark, d):
    return _cells(api.read_window(_series(spark, d, "h5_extensible", "nc", _h5("extensible")), "v"))


@query(ALL_SQL)
def h5_btree2(spark, d):
    return _cells(api.read_window(_series(spark, d, "h5_btree2", "he5", _h5("btree2", True)), "v"))


@query(f"with {CELLS_SQL} select i0, i1, v::double as value from cells where i0 between 30 and 349 and i1 between 5 and 40")
def h5_implicit_window(spark, d):
    """A formula's chunks, read through a window that cuts chunks and files."""
    return _cells(api.read_window(_series(spark, d, "h5_implicit", "h5", _h5("implicit")), "v", [(30, 350), (5, 41)]))


@query(f"with {CELLS_SQL} select i0, i1, v::double as value, i0 as vec, i1 as dim from cells where i0 < 100")
def h5_contiguous_raster(spark, d):
    """Contiguous data is a formula; coordinates come by the dimension scales' names."""
    m = api.scan(spark, _parts(spark, d, "h5_contiguous", "h5", _h5(None))[0])
    kinds = {r["array_path"]: r["map_kind"] for r in m.arrays.collect()}
    assert kinds["v"] == "affine" and kinds["vec"] == "explicit", kinds
    return api.raster(m, "v").select("i0", "i1", F.col("value").cast("double").alias("value"), "vec", "dim")


@query(f"with {CELLS_SQL} select i0, i1, case when i1 // 16 = 1 and (i0 % 100) < 50 then -9999 else v::double end as value from cells")
def h5_missing_chunks(spark, d):
    """Chunks that were never written have the fill value."""
    return _cells(api.read_window(_series(spark, d, "h5_missing", "h5", _h5("fixed", True, (1,))), "v"))


@query(f"with {N_SQL}, g as (select sum(cast(ceil(n / 50.0) as bigint))::bigint as rows, max(k) as k from parts) select i * 4 + j as chunk_lin, (i // 2) as part, 3200 as nbytes, 'virtual' as state from g, range(rows) a(i), range(4) b(j)")
def h5_chunk_rows(spark, d):
    """The chunk table of the stacked files: which file, how many bytes."""
    m = _series(spark, d, "h5_chunks", "h5", _h5("extensible"))
    rows = m.chunks.filter("array_path = 'v'").join(m.files, "file_id")
    return rows.select("chunk_lin", F.regexp_extract("uri", r"part(\d+)", 1).cast("long").alias("part"), "nbytes", "state")


@query(f"with {N_SQL} select part, n, 'vec,dim' as dims, 'embeddings' as title, 100 as part_size, '1' as units from parts")
def h5_metadata(spark, d):
    """Order of a scan of many, shapes, dimension names, group and dataset attributes."""
    ms = api.scan_many(spark, _parts(spark, d, "h5_metadata", "h5", _h5("btree2")))
    rows = []
    for i, m in enumerate(ms):
        a = m.array("v")
        rows.append((i, a["shape"][0], ",".join(a["dims"]), m.attrs["title"], m.attrs["part_size"], json.loads(a["attrs"])["units"]))
    ms[0].release()
    return spark.createDataFrame(rows, "part long, n long, dims string, title string, part_size long, units string")


def _dense(k: int, rows: list[dict]) -> tuple[str, bytes]:
    by: dict[str, list[int]] = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r["doc_id"])
    tree = {s: samples.Dataset(np.array(sorted(ids), "<i8"), (8,), "extensible") for s, ids in by.items()}
    names = samples.Dataset(sorted(by), (3,), "btree2", True, True)
    return "dense.h5", samples.H5Writer().file({"docs": (tree, {f"attr{i}": i for i in range(12)}), "names": names}, {"n": len(by)}, dense=True)


def _dense_file(spark, d):
    docs = catalog._t(spark, d, "documents").select(F.lit(0).alias("k"), "doc_id", "source")
    return samples.write_parts(docs, "k", _dense, _where(spark, d, "h5_dense"))[0]


@query("select 'docs/' || source as array_path, count(*) as n, cast(ceil(count(*) / 8.0) as bigint) as n_chunks from documents group by source union all select 'names', count(distinct source), 1 from documents")
def h5_dense_groups(spark, d):
    """Links and attributes in fractal heaps, chunks by extensible arrays of every depth."""
    m = api.scan(spark, _dense_file(spark, d))
    n = m.chunks.groupBy("array_path").agg(F.count("*").alias("n_chunks"))
    return m.arrays.join(n, "array_path").select("array_path", F.element_at("shape", 1).alias("n"), "n_chunks")


@query("select row_number() over (order by source) - 1 as i0, source as value from (select distinct source from documents)")
def h5_strings(spark, d):
    """Variable-length strings come inline with the scan."""
    return api.read_window(api.scan(spark, _dense_file(spark, d)), "names")


@query("select source as array_path, count(*) as n from documents group by source")
def h5_group_option(spark, d):
    """A scan of one group, and a view of a group: the same arrays."""
    path = _dense_file(spark, d)
    one, view = api.scan(spark, path, group="docs"), api.scan(spark, path).group("docs")
    shape = F.element_at("shape", 1).alias("n")
    own = one.arrays.select(F.substring("array_path", 6, 99).alias("array_path"), shape)
    return own.intersect(view.arrays.select("array_path", shape))


@query(f"with {CELLS_SQL} select i0, i1, v::double as value from cells where i1 = i0 % 64")
def h5_typed_elements(spark, d):
    """Typed opens: existence, extents, and elements at points, file by file."""
    rows = []
    for k, path in enumerate(_parts(spark, d, "h5_typed", "h5", _h5("btree1", True))):
        with typed.h5open(path) as f:
            n, width = f.dims("v")
            assert f.exists("/v") and f.is_group("/") and not f.exists("w") and f.attr_string("v", "units") == "1"
            at = [(i, (k * PART + i) % 64) for i in range(n)]
            rows += [(k * PART + i, j, float(v)) for (i, j), v in zip(at, f.read_elements("v", at, "<f8"))]
    return spark.createDataFrame(rows, "i0 long, i1 long, value double")


# --- TIFF

QUANT_SQL = f"with {CELLS_SQL}, q as (select i0, i1, (round(v::double * 100) + 20000)::bigint as value from cells)"


def _quantized(a: np.ndarray) -> np.ndarray:
    x = a.astype("<f8") * 100
    return (np.copysign(np.floor(np.abs(x) + 0.5), x) + 20000).astype("<u2")


def _tiff(**how) -> Callable[[int, np.ndarray], bytes]:
    big = how.pop("big", False)
    return lambda k, a: samples.tiff([samples.TiffPage(_quantized(a), **how)], big)


def _tiff_cells(spark, d, name, make):
    return api.read_window(_series(spark, d, name, "tif", make, "y"), "0/data").select("i0", "i1", F.col("value").cast("long").alias("value"))


@query(f"{QUANT_SQL} select * from q")
def tiff_strips(spark, d):
    """Plain strips are a formula, cut anew by chunkbytes."""
    paths = _parts(spark, d, "tiff_strips", "tif", _tiff(rows=10))
    m = api.concat(api.scan_series(spark, paths, chunkbytes=25 * 64 * 2), "y")
    return api.read_window(m, "0/data").select("i0", "i1", F.col("value").cast("long").alias("value"))


@query(f"{QUANT_SQL} select * from q")
def tiff_deflate_predictor(spark, d):
    return _tiff_cells(spark, d, "tiff_deflate", _tiff(tile=(25, 16), codec="deflate", predictor=True))


@query(f"{QUANT_SQL} select * from q")
def tiff_lzw_bigtiff(spark, d):
    return _tiff_cells(spark, d, "tiff_lzw", _tiff(rows=20, codec="lzw", predictor=True, big=True))


@query(f"{QUANT_SQL} select * from q")
def tiff_zstd(spark, d):
    return _tiff_cells(spark, d, "tiff_zstd", _tiff(tile=(25, 32), codec="zstd"))


BANDS_SQL = f"{QUANT_SQL} select i0, i1, b as band, value + b as value from q, range(2) t(b)"


@query(BANDS_SQL)
def tiff_planar(spark, d):
    """Bands one after another: (band, y, x)."""
    make = lambda k, a: samples.tiff([samples.TiffPage(np.stack([_quantized(a), _quantized(a) + 1]), tile=(25, 16), codec="deflate", planar=True)])
    cells = api.read_window(_series(spark, d, "tiff_planar", "tif", make, "y"), "0/data")
    return cells.select(F.col("i1").alias("i0"), F.col("i2").alias("i1"), F.col("i0").alias("band"), F.col("value").cast("long").alias("value"))


@query(BANDS_SQL)
def tiff_chunky(spark, d):
    """Bands side by side in each pixel: (y, x, band), with a predictor across them."""
    make = lambda k, a: samples.tiff([samples.TiffPage(np.stack([_quantized(a), _quantized(a) + 1], -1), rows=25, codec="deflate")])
    cells = api.read_window(_series(spark, d, "tiff_chunky", "tif", make, "y"), "0/data")
    return cells.select("i0", "i1", F.col("i2").alias("band"), F.col("value").cast("long").alias("value"))


def _pyramid(k: int, a: np.ndarray) -> bytes:
    q = _quantized(a)
    geo = samples.geo_tags(100000.0 + 1000 * k, 500000.0, 10.0, 32601 + k % 60, "7")
    pages = [samples.TiffPage(q, rows=25, codec="deflate", tags=geo), samples.TiffPage(q[::2, ::2], rows=25, codec="deflate", tags={254: (4, [1])}), samples.TiffPage(q[::4, ::4], rows=25, codec="deflate", tags={254: (4, [1])})]
    mask = samples.TiffPage(np.full(q[::2, ::2].shape, 255, "|u1"), rows=25, codec="deflate", tags={254: (4, [5])})
    return samples.tiff([*pages, mask])


@query(f"""with {N_SQL}, l as (select part, n, k, unnest([0, 1, 2]) as level from parts)
 select part, level || '/data' as array_path, cast(ceil(n / power(2, level)) as bigint) as height, cast(ceil(k / power(2, level)) as bigint) as width, '7' as fill_value from l
 union all select part, '1/mask', cast(ceil(n / 2.0) as bigint), cast(ceil(k / 2.0) as bigint), null from l where level = 1""")
def tiff_pyramid(spark, d):
    """Pages as levels of an image, masks beside them, nodata inherited."""
    s = api.scan_series(spark, _parts(spark, d, "tiff_pyramid", "tif", _pyramid))
    rows = s.arrays.filter(F.col("array_path").rlike("/(data|mask)$"))
    return rows.select(F.col("member").cast("long").alias("part"), "array_path", F.element_at("shape", 1).alias("height"), F.element_at("shape", 2).alias("width"), "fill_value")


@query(f"""with {N_SQL}, l as (select part, n, k, unnest([0, 1, 2]) as level from parts), s as (select *, ceil(n / power(2, level)) as h, ceil(k / power(2, level)) as w from l)
 select part, level::int as level, round(100000 + 1000 * part + 0.5 * 10 * k / w, 6) as x0, round(500000 - 0.5 * 10 * n / h, 6) as y0, (32601 + part % 60)::int as epsg, 'transverse_mercator' as mapping,
 (part % 60 + 1) * 6 - 183.0::double as meridian from s""")
def tiff_geo(spark, d):
    """Coordinates of each level's first pixel (overviews by extent), code, CF grid mapping."""
    s = api.scan_series(spark, _parts(spark, d, "tiff_geo", "tif", _pyramid))
    level = F.substring_index("array_path", "/", 1).cast("int").alias("level")
    first = F.udf(lambda b: float(np.frombuffer(b, "<f8")[0]) if b else None, "double")
    axis = lambda c: s.chunks.filter(F.col("array_path").endswith("/" + c)).select("member", level, F.round(first("inline"), 6).alias(c + "0"))
    ref = s.arrays.filter(F.col("array_path").endswith("/spatial_ref")).select("member", level, raster.epsg_of(F.col("attrs")).alias("epsg"), F.get_json_object("attrs", "$.grid_mapping_name").alias("mapping"), F.get_json_object("attrs", "$.longitude_of_central_meridian").cast("double").alias("meridian"))
    return axis("x").join(axis("y"), ["member", "level"]).join(ref, ["member", "level"]).select(F.col("member").cast("long").alias("part"), "level", "x0", "y0", "epsg", "mapping", "meridian")


@query("select 32600 + z as epsg, 'transverse_mercator' as name, z * 6 - 183.0::double as meridian, 'WGS 84 / UTM zone ' || z || 'N' as title from range(1, 61) t(z) union all select 32700 + z, 'transverse_mercator', z * 6 - 183.0::double, 'WGS 84 / UTM zone ' || z || 'S' from range(1, 61) t(z)")
def crs_grid_mappings(spark, d):
    rows = [(c, g["grid_mapping_name"], g["longitude_of_central_meridian"], g["crs_wkt"].split('"')[1]) for c in [*range(32601, 32661), *range(32701, 32761)] for g in [crs.grid_mapping(c)]]
    return spark.createDataFrame(rows, "epsg long, name string, meridian double, title string")


@query(f"{QUANT_SQL} select * from q where i0 % 100 between 20 and 60 and i1 between 10 and 30")
def tiff_typed_window(spark, d):
    """Windows of typed arrays, through readahead and a cache on disk."""
    rows = []
    for k, path in enumerate(_parts(spark, d, "tiff_typed", "tif", _tiff(tile=(25, 16), codec="lzw"))):
        assert typed.tiff_eltype(path) == "<u2"
        a = typed.cached(typed.open_tiff(path, "<u2"), _where(spark, d, f"tiff_typed_cache/{k}"))
        got = a[20:61, 10:31]
        rows += [(k * PART + 20 + i, 10 + j, int(got[i, j])) for i in range(got.shape[0]) for j in range(got.shape[1])]
    return spark.createDataFrame(rows, "i0 long, i1 long, value long")


# --- JPEG 2000, zip


def _of_sources(spark, d, name: str, make: Callable[[str, list[tuple[int, bytes]]], tuple[str, bytes]]) -> list[str]:
    """A file for each source, of its documents in order of their ids."""
    docs = catalog._t(spark, d, "documents").select(F.col("doc_id"), "source", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    ids = docs.select("source").distinct().select(F.row_number().over(Window.orderBy("source")).cast("long").alias("k"), "source")
    rows = docs.join(ids, "source").select("k", "doc_id", "source", "data")
    return samples.write_parts(rows, "k", lambda k, own: make(own[0]["source"], [(r["doc_id"], bytes(r["data"])) for r in own]), _where(spark, d, name))


COLUMNS = 8


def _jp2(source: str, docs: list[tuple[int, bytes]]) -> tuple[str, bytes]:
    tiles = [[b[: len(b) // 2], b[len(b) // 2 :]] if i % 3 == 0 else [b] for i, b in docs]
    tiles += [[b""]] * (-len(tiles) % COLUMNS)
    return f"{source}.jp2", samples.jp2(tiles, COLUMNS)


@query("""with t as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as tile, case when doc_id % 3 = 0 then 28 else 14 end + strlen(text) as nbytes from documents),
 e as (select source, n + i as tile, 14 as nbytes from (select source, count(*) as n, (8 - count(*) % 8) % 8 as more from documents group by source), range(8) t(i) where i < more), a as (select source, tile, nbytes from t union all select * from e)
 select source, tile, nbytes::bigint as nbytes, (85 + sum(nbytes) over (partition by source order by tile) - nbytes)::bigint as "offset" from a""")
def jp2_tiles(spark, d):
    """A chunk for each tile, tile-parts put together, found by walking the codestream."""
    s = api.scan_series(spark, _of_sources(spark, d, "jp2", _jp2))
    rows = s.chunks.join(s.files.select("member", "uri"), "member")
    return rows.select(F.regexp_extract("uri", r"([^/]+)\.jp2$", 1).alias("source"), F.col("chunk_lin").alias("tile"), "nbytes", "offset")


def _zip(source: str, docs: list[tuple[int, bytes]]) -> tuple[str, bytes]:
    return f"{source}.zip", samples.archive([(f"docs/{i}.txt", b) for i, b in docs], lambda k: k % 5 == 0)


def _zips(spark, d, name="zip") -> DataFrame:
    return zips.members(spark, _of_sources(spark, d, name, _zip))


def _source_of():
    return F.regexp_extract(F.col("uri"), r"([^/]+)\.zip$", 1).alias("source")


@query("select source, 'docs/' || doc_id || '.txt' as name, case when (row_number() over (partition by source order by doc_id) - 1) % 5 = 0 then 0 else 8 end::bigint as method, strlen(text)::bigint as uncompressed from documents")
def zip_members(spark, d):
    return _zips(spark, d).select(_source_of(), "name", "method", "uncompressed")


@query("select source, 'docs/' || doc_id || '.txt' as name, md5(text) as digest from documents")
def zip_read(spark, d):
    return zips.read_members(_zips(spark, d)).select(_source_of(), "name", F.md5("data").alias("digest"))


@query("""with t as (select source, doc_id, hex(encode(text)) as h, strlen(text) as len from documents where strlen(text) >= 8), r as (select *, unnest([0, 1, 2]) as k from t)
 select source, 'docs/' || doc_id || '.txt' as name, (len // 4 * k)::bigint as "offset", substr(h, (len // 4 * k * 2 + 1)::bigint, (len // 4 * 2)::bigint) as hex from r""")
def zip_ranges(spark, d):
    """Many ranges of each member, inflated in one pass."""
    rows = _zips(spark, d)
    wanted = rows.filter("uncompressed >= 8").select("uri", "name", F.expr("uncompressed div 4").alias("n"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    got = zips.inflate_ranges(rows, wanted.select("uri", "name", (F.col("n") * F.col("k")).alias("offset"), "n"))
    return got.select(_source_of(), "name", "offset", F.hex("data").alias("hex"))


@query("select 'docs/' || doc_id || '.txt' as name, strlen(text)::bigint as size, md5(text) as digest from documents")
def zip_extract(spark, d):
    """Members written to a folder, read back by Spark."""
    to = _where(spark, d, "zip_out")
    zips.extract(_zips(spark, d), to).count()
    back = spark.read.format("binaryFile").load(f"file://{to}/docs")
    return back.select(F.concat(F.lit("docs/"), F.substring_index("path", "/", -1)).alias("name"), F.col("length").alias("size"), F.md5("content").alias("digest"))


# --- references into files that are there: saved formats, edits, reads


def _texts(spark, d, name: str) -> dict[str, str]:
    """A file of all texts of each source, one after another; path by source."""
    paths = _of_sources(spark, d, name, lambda source, docs: (f"{source}.bin", b"".join(b for _, b in docs)))
    return {p.rsplit("/", 1)[-1][: -len(".bin")]: p for p in paths}


def document_refs(spark: SparkSession, d: str, name: str = "texts") -> Manifest:
    """One array of bytes for each source, a chunk for each document, some missing, some inline."""
    at = _texts(spark, d, name)
    folder = next(iter(at.values())).rsplit("/", 1)[0] if at else ""
    r = catalog.refs(spark, d)
    files = catalog.files(spark, d).withColumn("uri", F.concat(F.lit(folder + "/"), F.substring("uri", 7, 999), F.lit(".bin")))
    # An element is a byte, a chunk as long as the longest text; documents are shorter, which chunks may be.
    most = catalog._t(spark, d, "documents").agg(F.max(F.octet_length("text"))).first()[0] or 1
    per = r.groupBy("array_path").agg((F.max("chunk_lin") + 1).alias("n"))
    nul = lambda t, n: F.lit(None).cast(t).alias(n)
    side = F.lit(int(most)).cast("long")
    arrays = per.select("array_path", F.lit("|u1").alias("dtype"), F.array("n", side).alias("shape"), F.array(F.lit(1).cast("long"), side).alias("chunks"), F.array(F.lit("doc"), F.lit("byte")).alias("dims"), F.lit("0").alias("fill_value"), nul("string", "compressor"), nul("array<string>", "filters"), F.lit('{"kind":"text"}').alias("attrs"), F.lit("explicit").alias("map_kind"), nul("struct<file_id:long,base:long,strides:array<long>,chunkbytes:long>", "affine"))
    chunks = catalog._chunks(r.withColumn("file_id", F.when(F.col("state") == schema.VIRTUAL, F.col("file_id"))))
    return Manifest(files, arrays, chunks, {"title": "documents"}, {"path": name})


SAVED_SQL = f"with {REFS_SQL} select array_path, chunk_lin, state, case when state = 'virtual' then substr(uri, 7) end as source, case when state = 'virtual' then \"offset\" end as \"offset\", nbytes from refs where state <> 'missing'"


def _saved(m: Manifest) -> DataFrame:
    rows = m.chunks.filter("state <> 'missing'").join(m.files.select("file_id", "uri"), "file_id", "left")
    size = F.when(F.col("state") == schema.INLINE, F.octet_length("inline").cast("long")).otherwise(F.col("nbytes"))
    return rows.select("array_path", "chunk_lin", "state", F.regexp_extract("uri", r"([^/]+)\.bin$", 1).alias("source"), F.when(F.col("state") == schema.VIRTUAL, F.col("offset")).alias("offset"), size.alias("nbytes"))


def _again(spark, d, format: str, path: str, **options) -> Manifest:
    import shutil

    to = _where(spark, d, path)
    shutil.rmtree(to, ignore_errors=True)
    import os

    os.makedirs(os.path.dirname(to), exist_ok=True)
    api.save(document_refs(spark, d), to, format, **options)
    m = api.load(spark, to)
    assert api.format_of(to) == format and m.attrs == {"title": "documents"}, (api.format_of(to), m.attrs)
    return m


@query(SAVED_SQL)
def save_load_native(spark, d):
    return _saved(_again(spark, d, "native", "saved/native"))


@query(SAVED_SQL)
def save_load_zarr_manifest(spark, d):
    return _saved(_again(spark, d, "zarr_manifest", "saved/columns"))


@query(SAVED_SQL)
def save_load_kerchunk_json(spark, d):
    return _saved(_again(spark, d, "kerchunk_json", "saved/refs.json"))


@query(SAVED_SQL)
def save_load_kerchunk_parquet(spark, d):
    return _saved(_again(spark, d, "kerchunk_parquet", "saved/refs.parquet", record_size=16))


@query(f"with {REFS_SQL} select array_path, chunk_lin, md5(d.text) as digest from refs join documents d using (doc_id) where state = 'inline' or (state = 'virtual' and nbytes < 400)")
def kerchunk_embedded(spark, d):
    """Chunks below the threshold are read and put into the document."""
    import os

    to = _where(spark, d, "saved/embedded.json")
    os.makedirs(os.path.dirname(to), exist_ok=True)
    api.save(document_refs(spark, d), to, "kerchunk_json", inline_threshold=400)
    return api.load(spark, to).chunks.filter("state = 'inline'").select("array_path", "chunk_lin", F.md5("inline").alias("digest"))


@query(f"with {REFS_SQL} select array_path, chunk_lin, uri || '.bin' as uri, case when doc_id % 2 = 0 then null else \"offset\" end as \"offset\" from refs where state = 'virtual'")
def kerchunk_templates(spark, d):
    """Templates put in; references of a whole object beside those of a range."""
    import os

    r = catalog.refs(spark, d).filter("state = 'virtual'")
    n = {x["array_path"]: x["n"] for x in catalog.refs(spark, d).groupBy("array_path").agg((F.max("chunk_lin") + 1).alias("n")).collect()}
    refs = {f"{p}/.zarray": json.dumps({"zarr_format": 2, "shape": [k], "chunks": [1], "dtype": "|u1", "compressor": None, "fill_value": None, "order": "C", "filters": None}) for p, k in n.items()}
    for x in r.select("doc_id", "uri", "array_path", "chunk_lin", "offset", "nbytes").toLocalIterator():
        uri = "{{u}}" + x["uri"][len("mem://") :] + ".bin"
        refs[f"{x['array_path']}/{x['chunk_lin']}"] = [uri] if x["doc_id"] % 2 == 0 else [uri, x["offset"], x["nbytes"]]
    to = _where(spark, d, "saved/templates.json")
    os.makedirs(os.path.dirname(to), exist_ok=True)
    with open(to, "w") as f:
        json.dump({"version": 1, "templates": {"u": "mem://"}, "refs": refs}, f)
    m = api.load(spark, to)
    whole = F.col("nbytes") == schema.WHOLE_OBJECT
    return m.chunks.join(m.files, "file_id").select("array_path", "chunk_lin", "uri", F.when(~whole, F.col("offset")).alias("offset"))


@query(f"with {REFS_SQL} select array_path, chunk_lin, case when state <> 'missing' then md5(d.text) end as digest from refs join documents d using (doc_id)")
def chunk_read(spark, d):
    """The bytes of chunks of every state, read from the files."""
    return window.chunk_bytes(document_refs(spark, d)).select("array_path", "chunk_lin", F.md5("data").alias("digest"))


@query(f"with {REFS_SQL} select substr(uri, 7) as source, size::bigint as size, case when file_id % 4 = 1 then 'missing' when file_id % 4 = 2 then 'mismatch' else 'verified' end as status from files")
def validate_real_files(spark, d):
    """Files probed on executors: some moved away, some of another size than recorded."""
    m = document_refs(spark, d)
    files = m.files.withColumn("uri", F.when(F.col("file_id") % 4 == 1, F.concat("uri", F.lit(".gone"))).otherwise(F.col("uri")))
    files = files.withColumn("size", F.when(F.col("file_id") % 4 == 2, F.col("size") + 1).otherwise(F.col("size")))
    status, _, _ = integrity.validate(m.with_(files=files))
    plain = F.when(F.col("file_id") % 4 == 2, F.col("size") - 1).otherwise(F.col("size"))
    return status.select(F.regexp_extract("uri", r"([^/]+)\.bin", 1).alias("source"), plain.alias("size"), "status")


@query("""with t as (select source, string_agg(hex(encode(text)), '' order by doc_id) as h from documents group by source)
 select source, substr(h, 1, 2 * least(16, length(h) // 2)) as head, substr(h, length(h) - 2 * least(16, length(h) // 2) + 1) as tail, (length(h) // 2)::bigint as size from t""")
def fetch_ends(spark, d):
    """Head, tail and size of each file, asked together."""
    rows = []
    for source, path in _texts(spark, d, "ends").items():
        head, tail, size = fetch.fetch_ends(path, 16)
        rows.append((source, head.hex().upper(), tail.hex().upper(), size))
    return spark.createDataFrame(rows, "source string, head string, tail string, size long")


@query(f"with {REFS_SQL} select d.source, d.doc_id, md5(d.text) as digest from documents d")
def fetch_ranges(spark, d):
    """All ranges of each file, in another order than the file's, read in a few blocks."""
    at = _texts(spark, d, "ranges")
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    docs = catalog._t(spark, d, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("n"))
    docs = docs.withColumn("o", F.sum("n").over(w) - F.col("n"))
    rows = []
    import hashlib

    for source, path in at.items():
        own = docs.filter(F.col("source") == source).orderBy(F.xxhash64("doc_id")).collect()
        got = fetch.fetch_ranges(path, [(r["o"], r["n"]) for r in own])
        rows += [(source, r["doc_id"], hashlib.md5(b).hexdigest()) for r, b in zip(own, got)]
    return spark.createDataFrame(rows, "source string, doc_id long, digest string")


@query(f"""with {REFS_SQL}, one as (select min(array_path) as p from refs) select chunk_lin, case chunk_lin when 0 then 'inline' when 1 then 'missing' when 2 then 'virtual' else state end as state,
 case chunk_lin when 0 then md5('new bytes') when 1 then null when 2 then md5((select substr(text, 1, 3) from documents where source = (select replace(p, 'docs/', '') from one) order by doc_id limit 1)) else case when state <> 'missing' then md5(d.text) end end as digest
 from refs join documents d using (doc_id), one where array_path = p""")
def edit_chunks(spark, d):
    """One chunk made inline, one missing, one virtual; the bytes read afterwards."""
    m = document_refs(spark, d, "edit")
    path = m.arrays.agg(F.min("array_path")).first()[0]
    uri = m.files.filter(F.col("uri").endswith(path.split("/")[1] + ".bin")).first()["uri"]
    first = catalog._t(spark, d, "documents").filter(F.col("source") == path.split("/")[1]).orderBy("doc_id").first()["text"]
    m = api.set_chunk(api.set_chunk(api.set_chunk(m, path, 0, data=b"new bytes"), path, 1), path, 2, uri=uri, offset=0, nbytes=len(first[:3].encode()))
    rows = m.chunks.filter(F.col("array_path") == path)
    got = window.chunk_bytes(m, rows).select("chunk_lin", F.md5("data").alias("digest"))
    return rows.select("chunk_lin", "state").join(got, "chunk_lin")


@query("select (1 + row_number() over (order by source) - 1)::bigint as file_id, 'mem://' || source as uri from (select distinct source from documents) union all select (select count(distinct source) from documents) + row_number() over (order by c_custkey), 's3://new/' || c_custkey from customer")
def push_uris(spark, d):
    """Insert-if-absent: known uris stay, new ones are numbered on."""
    files = catalog.files(spark, d)
    new = catalog._t(spark, d, "customer").select(F.format_string("s3://new/%012d", "c_custkey").alias("uri"))
    nul = lambda t, n: F.lit(None).cast(t).alias(n)
    both = new.unionByName(files.select("uri")).select("uri", nul("string", "etag"), nul("long", "size"), nul("double", "mtime"))
    out = edit.push_uris(files, both).select("file_id", "uri")
    return out.withColumn("uri", F.when(F.col("uri").startswith("s3:"), F.concat(F.lit("s3://new/"), F.regexp_extract("uri", "0*([0-9]+)$", 1))).otherwise(F.col("uri")))


@query(f"with {REFS_SQL}, one as (select min(array_path) as p from refs) select chunk_lin || '.0' as key from refs, one where array_path = p and state <> 'missing' union all select unnest(['.zarray', '.zattrs'])")
def array_keys(spark, d):
    """Store keys below an array: documents, and chunks that have bytes."""
    m = document_refs(spark, d)
    path = m.arrays.agg(F.min("array_path")).first()[0]
    keys = listing.keys(m, path)
    assert listing.lookup(m, f"{path}/.zarray")["dtype"] == "|u1" and listing.lookup(m, "docs/.zgroup") and listing.lookup(m, f"{path}/999999.0") is None
    return spark.createDataFrame([(k,) for k in keys], "key string")


@query(f"with {REFS_SQL}, n as (select array_path, max(chunk_lin) + 1 as n from refs group by array_path) select array_path || '/.zarray' as key, n as rows, 2 as zarr_format from n union all select array_path || '/.zattrs', null, null from n union all select unnest(['.zgroup', 'docs/.zgroup']), null, 2 union all select '.zattrs', null, null")
def store_documents(spark, d):
    """Metadata documents of arrays and of the groups that their paths imply."""
    rows = [(k, v["shape"][0] if "shape" in v else None, v.get("zarr_format")) for k, v in kerchunk.documents(document_refs(spark, d)).items()]
    return spark.createDataFrame(rows, "key string, rows long, zarr_format int")


@query("select 'json' as form, count(distinct source) as n_arrays from documents union all select 'native', count(distinct source) from documents union all select 'tif', 1")
def load_many_forms(spark, d):
    """Saved manifests of two formats and a source file, loaded together in order."""
    tif = _parts(spark, d, "load_many", "tif", _tiff(rows=25))[0]
    a, b = _where(spark, d, "saved/many.json"), _where(spark, d, "saved/many")
    import os
    import shutil

    os.makedirs(os.path.dirname(a), exist_ok=True)
    shutil.rmtree(b, ignore_errors=True)
    m = document_refs(spark, d)
    api.save(m, a)
    api.save(m, b, "native")
    return spark.createDataFrame([(k, x.arrays.count()) for k, x in zip(("json", "native", "tif"), api.load_many(spark, [a, b, tif]))], "form string, n_arrays long")


@query(f"with {N_SQL} select 'part' || lpad(part::varchar, 5, '0') || '/' || unnest(['v', 'vec', 'dim']) as array_path from parts")
def merge_files(spark, d):
    """Files as layers, named after themselves."""
    return api.merge(api.scan_series(spark, _parts(spark, d, "merge", "h5", _h5("fixed")))).arrays.select("array_path")


@query(f"with {CELLS_SQL} select i0, i1, v::double as emb, v::double * 2 as twice from cells")
def raster_layers(spark, d):
    """Layers of one chunk grid, decoded together chunk by chunk."""
    make = lambda k, a: samples.H5Writer().file({"emb": samples.Dataset(a, CHUNK, "fixed", True, True), "twice": samples.Dataset(a * 2, CHUNK, "btree2", True)})
    out = api.raster_stack(_series(spark, d, "layers", "h5", make, "dim_0"))
    return out.select("i0", "i1", F.col("emb").cast("double").alias("emb"), F.col("twice").cast("double").alias("twice"))


@query(ALL_SQL)
def codec_chain(spark, d):
    """Shuffle, checksum and zstd, applied and undone."""
    m = catalog.embeddings(spark, d)
    n, k = m.array("emb")["shape"]
    how = ['{"id":"shuffle","elementsize":4}', '{"id":"fletcher32","verify":true}']
    rows = window.encode_cells(catalog.embedding_cells(spark, d), "emb", "<f4", [n, k], [33, 20], compressor='{"id":"zstd","level":3}', filters=how)
    arrays = spark.createDataFrame([("emb", "<f4", [n, k], [33, 20], ["vec", "dim"], None, '{"id":"zstd","level":3}', how, "{}", "explicit", None)], schema.ARRAYS)
    return _cells(window.read_window(m.with_(arrays=arrays, chunks=rows), "emb"))


@query(f"with {N_SQL} select part, true as asked, true as within from parts")
def scan_costs(spark, d):
    """What each file's scan took: requests, and no more bytes than the file has."""
    paths = _parts(spark, d, "costs", "h5", _h5("btree1"))
    cost = api.scan_cost(spark, paths)
    sizes = spark.createDataFrame([(p, fetch.object_size(p)) for p in paths], "uri string, size long")
    return cost.join(sizes, "uri").select(F.col("ord").alias("part"), (F.col("requests") > 0).alias("asked"), (F.col("bytes_read") <= F.col("size")).alias("within"))


@query("""with m as (select date_diff('day', date '2024-01-01', ts::date) as member, hour(ts) // 6 as lin, count(*) as n from events group by all)
 select member::int as member, lin + member * 4 as chunk_lin, n from m""")
def stream_append_chunks(spark, d):
    """Days arrive as a stream of chunk rows and land at their places behind the days before."""
    import uuid

    from .streaming.append import append_chunks

    at = _where(spark, d, f"append/{uuid.uuid4().hex}")
    _, blocks = catalog._series(spark, d)
    blocks.write.parquet(f"file://{at}/in")
    stream = spark.readStream.schema(blocks.schema).parquet(f"file://{at}/in")
    append_chunks(stream, 4, 1, f"file://{at}/out", f"file://{at}/state").awaitTermination()
    return spark.read.parquet(f"file://{at}/out").select("member", "chunk_lin", "n")


@query(f"with {TREE_SQL} select n_name || '/pop' as array_path from tree where r_name = 'ASIA'")
def group_view(spark, d):
    """What lies below a group, as a manifest that cannot be saved by itself."""
    t = catalog._tree(spark, d)
    cols = spark.createDataFrame([], schema.ARRAYS).schema
    arrays = t.select(*[F.col("array_path") if f.name == "array_path" else F.lit("explicit").alias(f.name) if f.name == "map_kind" else F.lit(None).cast(f.dataType).alias(f.name) for f in cols])
    view = Manifest(spark.createDataFrame([], schema.FILES), arrays, spark.createDataFrame([], schema.CHUNKS)).group("ASIA")
    try:
        api.save(view, _where(spark, d, "saved/none"))
    except ValueError:
        return view.arrays.select("array_path")
    raise AssertionError("a view of a group was saved")


