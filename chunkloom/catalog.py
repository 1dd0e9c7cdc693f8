"""The operators as queries over the driver's tables, with the SQL that says what each returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .functions import geo, grid
from .manifest import Manifest
from .operators import combine, edit, integrity, listing, pages, ranges, raster
from .plans import window

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return put


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items() if s}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- fixtures: references into the texts of each source, and the embeddings as an array

FILES_SQL = """files as (select row_number() over (order by source) as file_id, 'mem://' || source as uri, sum(strlen(text))::bigint as size
 from documents group by source)"""
REFS_SQL = FILES_SQL + """, refs as (select d.doc_id, f.file_id, f.uri, 'docs/' || d.source as array_path,
 row_number() over (partition by d.source order by d.doc_id) - 1 as chunk_lin,
 case when d.doc_id % 13 = 0 then 'missing' when d.doc_id % 17 = 0 then 'inline' else 'virtual' end as state,
 (sum(strlen(d.text)) over (partition by d.source order by d.doc_id) - strlen(d.text))::bigint as "offset", strlen(d.text)::bigint as nbytes
 from documents d join files f on f.uri = 'mem://' || d.source)"""
CELLS_SQL = "cells as (select vec_id as i0, j as i1, v from (select vec_id, unnest(embedding) v, unnest(range(len(embedding))) j from embeddings))"


def files(spark: SparkSession, d: str) -> DataFrame:
    per = _t(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("size"))
    return per.select(F.row_number().over(Window.orderBy("source")).cast("long").alias("file_id"), F.concat(F.lit("mem://"), "source").alias("uri"), F.lit(None).cast("string").alias("etag"), F.col("size").cast("long"), F.lit(None).cast("double").alias("mtime"))


def refs(spark: SparkSession, d: str) -> DataFrame:
    """Chunk rows of one array per source, each document a chunk."""
    docs = _t(spark, d, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("nbytes"), F.encode("text", "utf-8").alias("data"))
    w = Window.partitionBy("source").orderBy("doc_id")
    rows = docs.withColumn("uri", F.concat(F.lit("mem://"), "source")).withColumn("chunk_lin", (F.row_number().over(w) - 1).cast("long"))
    rows = rows.withColumn("offset", F.sum("nbytes").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("nbytes"))
    state = F.when(F.col("doc_id") % 13 == 0, schema.MISSING).when(F.col("doc_id") % 17 == 0, schema.INLINE).otherwise(schema.VIRTUAL)
    rows = rows.join(files(spark, d).select("file_id", "uri"), "uri").withColumn("state", state)
    return rows.select("doc_id", "uri", F.concat(F.lit("docs/"), "source").alias("array_path"), "chunk_lin", "state", "file_id", "offset", "nbytes", F.when(F.col("state") == schema.INLINE, F.col("data")).alias("inline"))


def _chunks(r: DataFrame) -> DataFrame:
    return r.select("array_path", "chunk_lin", "state", "file_id", "offset", "nbytes", "inline")


EMB = (50, 16)


def embedding_cells(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "value")).select("i0", F.col("i1").cast("long").alias("i1"), "value")


def embeddings(spark: SparkSession, d: str, chunks=EMB, fill: str | None = None, codec: str | None = '{"id":"zlib","level":1}') -> Manifest:
    """The embeddings as a chunked, compressed float32 array with its bytes inline."""
    e = _t(spark, d, "embeddings")
    n, k = e.agg(F.max("vec_id") + 1, F.max(F.size("embedding"))).first()
    shape = [n, k]
    rows = window.encode_cells(embedding_cells(spark, d), "emb", "<f4", shape, list(chunks), compressor=codec, filters=['{"id":"shuffle","elementsize":4}'])
    arrays = [("emb", "<f4", shape, list(chunks), ["vec", "dim"], fill, codec, ['{"id":"shuffle","elementsize":4}'], "{}", "explicit", None)]
    return Manifest(spark.createDataFrame([], schema.FILES), spark.createDataFrame(arrays, schema.ARRAYS), rows)


def entry(spark: SparkSession, d: str) -> DataFrame:
    """A window of the embeddings array: pruned, decoded, clipped, aggregated by row."""
    cells = window.read_window(embeddings(spark, d), "emb", [(100, 180), (8, 40)])
    return cells.groupBy("i0").agg(F.round(F.sum(F.col("value").cast("double")), 3).alias("total"), F.count("*").alias("n"))


# --- states, places, sizes, keys


@query(f"with {REFS_SQL} select array_path, count(*) filter (state='virtual') as n_virtual, count(*) filter (state='inline') as n_inline, count(*) filter (state='missing') as n_missing, count(distinct case when state='virtual' then file_id end) as n_files from refs group by rollup(array_path)")
def chunk_state_counts(spark, d):
    return listing.state_counts(refs(spark, d))


@query(f"with {REFS_SQL} select array_path, chunk_lin, uri, \"offset\", nbytes from refs where state = 'virtual'")
def chunk_location(spark, d):
    return listing.locations(_chunks(refs(spark, d)), files(spark, d))


@query(f"with {REFS_SQL} select array_path, sum(case when state = 'missing' then 0 else nbytes end)::bigint as bytes from refs group by array_path")
def storage_size(spark, d):
    return listing.storage_size(_chunks(refs(spark, d)))


def _tree(spark, d):
    r, n = _t(spark, d, "region"), _t(spark, d, "nation")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat_ws("/", "r_name", "n_name", F.lit("pop")).alias("array_path"), "n_nationkey", "n_regionkey", "r_name", "n_name")


TREE_SQL = "tree as (select r_name || '/' || n_name || '/pop' as array_path, n_nationkey, n_regionkey, r_name, n_name from nation join region on n_regionkey = r_regionkey)"


@query(f"with {TREE_SQL} select distinct 'root' as parent, r_name as name, 'group' as kind from tree union all select 'ASIA', n_name, 'group' from tree where r_name = 'ASIA'")
def subdirs(spark, d):
    t = _tree(spark, d)
    return listing.children(t).withColumn("parent", F.lit("root")).unionByName(listing.children(t, "ASIA").withColumn("parent", F.lit("ASIA")))


@query(f"with {TREE_SQL} select '' as group_path union select r_name from tree union select r_name || '/' || n_name from tree")
def implicit_groups(spark, d):
    return listing.implicit_groups(_tree(spark, d))


@query("with g as (select cast(ceil(count(*) / 50.0) as bigint) as n from embeddings) select i * 4 + j as chunk_lin, i || '.' || j as chunk_key from g, range(n) a(i), range(4) b(j)")
def chunk_keys(spark, d):
    n, k = _t(spark, d, "embeddings").agg(F.count("*"), F.max(F.size("embedding"))).first()
    arrays = spark.createDataFrame([("emb", [n, k], list(EMB))], "array_path string, shape array<long>, chunks array<long>")
    rows = arrays.select("array_path", F.explode(F.sequence(F.lit(0).cast("long"), grid.product(grid.grid_size(F.col("shape"), F.col("chunks"))) - 1)).alias("chunk_lin"))
    return listing.chunk_keys(arrays, rows).select("chunk_lin", "chunk_key")


@query("select p_partkey, case when p_partkey % 12 < 10 and p_partkey % 5 < 4 then (p_partkey % 12) * 4 + p_partkey % 5 end::bigint as chunk_lin from part")
def parse_chunk_keys(spark, d):
    key = F.concat_ws(".", (F.col("p_partkey") % 12).cast("string"), (F.col("p_partkey") % 5).cast("string"))
    return _t(spark, d, "part").select("p_partkey", grid.parse_chunk_key(key, F.array(F.lit(10).cast("long"), F.lit(4).cast("long"))).alias("chunk_lin"))


AFFINE = [
    ("a", "<i4", [1536], [128], ["x"], None, None, None, "{}", "affine", (1, 8, [512], 512)),
    ("b", "<f8", [3, 4, 25], [1, 1, 5], ["z", "y", "x"], None, None, None, "{}", "affine", (1, 5759, [4000, 800, 40], 40)),
    ("c", "<i4", [], [], [], None, None, None, "{}", "affine", (1, 16, [], 4)),
]


@query("""select 'a' as array_path, i as chunk_lin, 8 + 512 * i as "offset", 512 as nbytes from range(12) t(i)
 union all select 'b', i * 20 + j * 5 + k, 5759 + 4000 * i + 800 * j + 40 * k, 40 from range(3) a(i), range(4) b(j), range(5) c(k) union all select 'c', 0, 16, 4""")
def affine_expand(spark, d):
    return listing.affine_chunks(spark.createDataFrame(AFFINE, schema.ARRAYS)).select("array_path", "chunk_lin", "offset", "nbytes")


# --- reads


@query("select i * 4 + j as chunk_lin from range(2, 4) a(i), range(0, 3) b(j)")
def window_prune(spark, d):
    n, k = _t(spark, d, "embeddings").agg(F.count("*"), F.max(F.size("embedding"))).first()
    rows = spark.range(-(-n // EMB[0]) * -(-k // EMB[1])).withColumnRenamed("id", "chunk_lin")
    return window.prune(rows, [n, k], EMB, [(100, 180), (8, 40)])


@query(f"with {CELLS_SQL} select i0, round(sum(v::double), 3) as total, count(*) as n from cells where i0 >= 100 and i0 < 180 and i1 >= 8 and i1 < 40 group by i0")
def window_read_sum(spark, d):
    return entry(spark, d)


@query(f"with {CELLS_SQL} select i0, i1, round(v::double, 4) + 0.0::double as value from cells where i1 = i0 % 64")
def point_select(spark, d):
    points = _t(spark, d, "embeddings").select(F.col("vec_id").alias("i0"), (F.col("vec_id") % 64).alias("i1"))
    return window.read_points(embeddings(spark, d), "emb", points).select("i0", "i1", (F.round(F.col("value").cast("double"), 4) + 0.0).alias("value"))


@query(f"with {CELLS_SQL} select i0, count(*) filter (w) as n_filled, round(sum(case when w then -9999 else v::double end), 3) as total from (select *, ((i0 // 50) * 4 + i1 // 16) % 7 = 3 as w from cells) group by i0")
def fill_missing(spark, d):
    m = embeddings(spark, d, fill="-9999")
    m = m.with_(chunks=m.chunks.filter(F.col("chunk_lin") % 7 != 3))
    cells = window.read_window(m, "emb")
    return cells.groupBy("i0").agg(F.count_if(F.col("value") == -9999).alias("n_filled"), F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))


@query(f"with {CELLS_SQL} select count(*) as n, round(sum(v::double), 2) as total, round(min(v)::double, 4) as least, round(max(v)::double, 4) as most from cells")
def full_reduction(spark, d):
    v = F.col("value").cast("double")
    return window.read_window(embeddings(spark, d, chunks=(48, 20)), "emb").agg(F.count("*").alias("n"), F.round(F.sum(v), 2).alias("total"), F.round(F.min(v), 4).alias("least"), F.round(F.max(v), 4).alias("most"))


# --- integrity

PERTURBED_SQL = REFS_SQL + """, recorded as (select file_id, uri, case when file_id % 11 = 0 then null else size end as size from files),
 live as (select uri, case when file_id % 7 = 0 then size - 1 else size end as live_size from files where file_id % 5 <> 0),
 status as (select r.file_id, r.uri, r.size, l.live_size, case when l.live_size is null then 'missing' when r.size is null then 'unverifiable' when r.size <> l.live_size then 'mismatch' else 'verified' end as status from recorded r left join live l using (uri)),
 bad as (select array_path, chunk_lin, state, case when doc_id % 29 = 0 then file_id + 1000 else file_id end as file_id, case when doc_id % 31 = 0 then "offset" + (select max(size) from files) else "offset" end as "offset", nbytes, case when doc_id % 34 = 0 then 0 else nbytes end as n_inline from refs),
 issues as (select array_path, chunk_lin, case when state = 'virtual' and f.file_id is null then 'bad_index' when state = 'virtual' and "offset" + nbytes > f.size then 'offset_overflow' when state = 'inline' and n_inline = 0 then 'empty_inline' end as issue from bad left join files f using (file_id))"""


def _recorded(spark, d):
    return files(spark, d).withColumn("size", F.when(F.col("file_id") % 11 != 0, F.col("size")))


def _live(spark, d):
    f = files(spark, d).filter(F.col("file_id") % 5 != 0)
    return f.select("uri", F.when(F.col("file_id") % 7 == 0, F.col("size") - 1).otherwise(F.col("size")).alias("live_size"))


def _perturbed(spark, d):
    most = files(spark, d).agg(F.max("size")).first()[0]
    r = refs(spark, d)
    r = r.withColumn("file_id", F.when(F.col("doc_id") % 29 == 0, F.col("file_id") + 1000).otherwise(F.col("file_id")))
    r = r.withColumn("offset", F.when(F.col("doc_id") % 31 == 0, F.col("offset") + most).otherwise(F.col("offset")))
    return _chunks(r.withColumn("inline", F.when(F.col("doc_id") % 34 == 0, F.lit(b"")).otherwise(F.col("inline"))))


@query(f"with {PERTURBED_SQL} select * from status")
def validate_files(spark, d):
    return integrity.file_status(_recorded(spark, d), _live(spark, d))


@query(f"with {PERTURBED_SQL} select * from issues where issue is not null")
def validate_consistency(spark, d):
    return integrity.issues(_perturbed(spark, d), files(spark, d))


@query(f"with {PERTURBED_SQL} select *, (n_missing + n_mismatch + n_issues = 0 and n_verified > 0)::int as passed from (select count(*) filter (status = 'verified') as n_verified, count(*) filter (status = 'unverifiable') as n_unverifiable, count(*) filter (status = 'missing') as n_missing, count(*) filter (status = 'mismatch') as n_mismatch, (select count(*) from issues where issue is not null) as n_issues from status)")
def validate_passed(spark, d):
    s = integrity.summary(integrity.file_status(_recorded(spark, d), _live(spark, d)), integrity.issues(_perturbed(spark, d), files(spark, d)))
    return s.withColumn("passed", F.col("passed").cast("int"))


# --- path tables, edits


def _members(spark, d):
    """Three path tables that share uris: thirds of the documents, each numbering its own files."""
    docs = _t(spark, d, "documents").select((F.col("doc_id") % 3).cast("int").alias("member"), F.concat(F.lit("mem://"), "source").alias("uri")).distinct()
    w = Window.partitionBy("member").orderBy(F.desc("uri"))
    return docs.select("member", F.row_number().over(w).cast("long").alias("file_id"), "uri", F.lit(None).cast("string").alias("etag"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("double").alias("mtime"))


MEMBERS_SQL = """members as (select member, uri, row_number() over (partition by member order by uri desc) as file_id from (select distinct (doc_id % 3)::int as member, 'mem://' || source as uri from documents)),
 merged as (select row_number() over (order by m, f) as new_id, uri from (select uri, min(member) as m, arg_min(file_id, member) as f from members group by uri))"""


@query(f"with {MEMBERS_SQL} select new_id, uri from merged")
def path_table_dedup(spark, d):
    return combine.merge_tables(_members(spark, d)).select("new_id", "uri")


@query(f"with {MEMBERS_SQL}, c as (select member, file_id, case when file_id % 4 = 0 then 'missing' else 'virtual' end as state from members) select c.member, c.file_id as old_id, case when state = 'virtual' then g.new_id end as file_id, state from c join members m using (member, file_id) join merged g using (uri)")
def table_remap(spark, d):
    m = _members(spark, d)
    state = F.when(F.col("file_id") % 4 == 0, schema.MISSING).otherwise(schema.VIRTUAL)
    chunks = m.select("member", "file_id", F.col("file_id").alias("old_id"), state.alias("state"))
    return combine.remap(chunks, m, combine.merge_tables(m)).select("member", "old_id", "file_id", "state")


@query(f"with {FILES_SQL} select file_id, case when uri like 'mem://src1%' then 's3://bucket/one' || substr(uri, 11) else uri end as uri from files")
def replace_prefix(spark, d):
    return edit.with_prefix(files(spark, d), "mem://src1", "s3://bucket/one").select("file_id", "uri")


@query(f"with {FILES_SQL} select file_id, case when file_id = 3 then 'file:///moved' else uri end as uri from files")
def set_uri(spark, d):
    return edit.with_uri(files(spark, d), 3, "file:///moved").select("file_id", "uri")


@query(f"with {REFS_SQL} select array_path, chunk_lin, case when chunk_lin % 5 = 0 then 'missing' else state end as state, case when chunk_lin % 5 = 0 then null else \"offset\" end as \"offset\" from refs")
def set_chunk(spark, d):
    c = _chunks(refs(spark, d))
    nul = lambda n: F.lit(None).cast(c.schema[n].dataType).alias(n)
    gone = c.filter(F.col("chunk_lin") % 5 == 0).select("array_path", "chunk_lin", F.lit(schema.MISSING).alias("state"), nul("file_id"), nul("offset"), nul("nbytes"), nul("inline"))
    return edit.upsert_chunks(c, gone).select("array_path", "chunk_lin", "state", "offset")


# --- combination

DAYS_SQL = "days as (select date_diff('day', date '2024-01-01', ts::date) as member, hour(ts) // 6 as lin, count(*) as n, count(distinct event_type) as n_types from events group by all)"


def _series(spark, d):
    """One member per day: value(event_type, time) of 5 x 24 in chunks of 5 x 6."""
    ev = _t(spark, d, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    blocks = ev.groupBy(day.cast("int").alias("member"), F.floor(F.hour("ts") / 6).cast("long").alias("chunk_lin")).agg(F.count("*").alias("n"))
    arr = blocks.select("member").distinct()
    lit = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    arrays = arr.select("member", F.lit("value").alias("array_path"), F.lit("<f8").alias("dtype"), lit([5, 24]).alias("shape"), lit([5, 6]).alias("chunks"), F.array(F.lit("event_type"), F.lit("time")).alias("dims"), F.lit("0.0").alias("fill_value"), F.lit(None).cast("string").alias("compressor"), F.lit(None).cast("array<string>").alias("filters"), F.lit("{}").alias("attrs"))
    return arrays, blocks.withColumn("array_path", F.lit("value"))


@query(f"with {DAYS_SQL}, m as (select member, row_number() over (order by member) - 1 as k from (select distinct member from days)) select days.member::int as member, k * 4 + lin as chunk_lin, n from days join m using (member)")
def concat_time(spark, d):
    arrays, blocks = _series(spark, d)
    _, moved = combine.shift_along(arrays, blocks, "time")
    return moved.select("member", "chunk_lin", "n")


@query(f"with {DAYS_SQL} select 'value' as array_path, 'event_type,time' as dims, '5,' || 24 * count(distinct member) as shape from days")
def concat_shape(spark, d):
    arrays, blocks = _series(spark, d)
    shaped, _ = combine.shift_along(arrays, blocks, "time")
    return shaped.select("array_path", F.array_join("dims", ",").alias("dims"), F.array_join(F.transform("shape", lambda x: x.cast("string")), ",").alias("shape"))


FAULTY = [
    ("good", [4, 6], [2, 3], [4, 9], [2, 3], "<i4", "<i4", None), ("chunked", [4, 6], [2, 3], [4, 9], [2, 9], "<i4", "<i4", "chunk shapes differ"),
    ("edge", [4, 7], [2, 3], [4, 9], [2, 3], "<i4", "<i4", "a member ends inside a chunk"), ("typed", [4, 6], [2, 3], [4, 9], [2, 3], "<i4", "<f4", "types differ"),
    ("other", [4, 6], [2, 3], [5, 9], [2, 3], "<i4", "<i4", "other dimensions differ"), ("alone", [4, 6], [2, 3], None, None, "<i4", None, "not in every member"),
]


@query("select * from (values " + ", ".join(f"('{r[0]}', '{r[7]}')" for r in FAULTY if r[7]) + ") t(array_path, fault)")
def concat_checks(spark, d):
    rows = [(0, r[0], r[5], r[1], r[2], ["y", "time"], None, None, None, "{}") for r in FAULTY] + [(1, r[0], r[6], r[3], r[4], ["y", "time"], None, None, None, "{}") for r in FAULTY if r[3]]
    arrays = spark.createDataFrame(rows, "member int, array_path string, dtype string, shape array<long>, chunks array<long>, dims array<string>, fill_value string, compressor string, filters array<string>, attrs string")
    return combine.concat_faults(arrays, "time")


@query(f"with {TREE_SQL} select array_path, case when n_nationkey % 3 = 0 then 'left' else 'right' end as side from tree where n_nationkey % 3 <> 1")
def key_differences(spark, d):
    t = _tree(spark, d)
    return combine.key_differences(t.filter("n_nationkey % 3 < 2"), t.filter("n_nationkey % 3 > 0"))


@query(f"with {TREE_SQL} select 'l' || n_regionkey || '/' || n_name || '/pop' as array_path from tree")
def merge_layers(spark, d):
    t = _tree(spark, d)
    keep = [(r["n_regionkey"],) for r in t.select("n_regionkey").distinct().orderBy("n_regionkey").collect()]  # a layer a region
    none = spark.createDataFrame([], schema.FILES)
    ms = []
    for (k,) in keep:
        rows = t.filter(F.col("n_regionkey") == k).select(F.concat_ws("/", "n_name", F.lit("pop")).alias("array_path"))
        nul = lambda t_, n: F.lit(None).cast(t_).alias(n)
        cols = spark.createDataFrame([], schema.ARRAYS).schema
        arrays = rows.select(*[F.col("array_path") if f.name == "array_path" else F.lit("explicit").alias(f.name) if f.name == "map_kind" else nul(f.dataType, f.name) for f in cols])
        ms.append(Manifest(none, arrays, spark.createDataFrame([], schema.CHUNKS)))
    return combine.merge(ms, [f"l{k}" for (k,) in keep]).arrays.select("array_path")


@query("select c_mktsegment as key, count(distinct v) as n_values from (select c_mktsegment, c_nationkey, round(max(c_acctbal), 0) as v from customer group by all) group by c_mktsegment having count(distinct v) > 1")
def attr_merge_conflicts(spark, d):
    a = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("member"), F.col("c_mktsegment").alias("key")).agg(F.round(F.max("c_acctbal"), 0).alias("value"))
    return combine.attr_conflicts(a)


# --- ranges

GAP, MOST = 1024, 20000
VIRT_SQL = REFS_SQL + ", v as (select * from refs where state = 'virtual')"


def _virtual(spark, d):
    return refs(spark, d).filter(F.col("state") == schema.VIRTUAL)


@query(f"""with {VIRT_SQL}, p as (select *, max("offset" + nbytes) over (partition by uri order by "offset", nbytes rows between unbounded preceding and 1 preceding) as e from v),
 q as (select *, sum(case when "offset" > e + {GAP} then 1 else 0 end) over (partition by uri order by "offset", nbytes rows between unbounded preceding and current row) as island from p)
 select uri, min("offset") as block_offset, max("offset" + nbytes) - min("offset") as block_nbytes, count(*) as n_ranges from q group by uri, island""")
def coalesce_gap(spark, d):
    return ranges.coalesce_ranges(_virtual(spark, d), GAP)


@query(f"""with recursive {VIRT_SQL}, s as (select uri, "offset" as o, nbytes as n, row_number() over (partition by uri order by "offset", nbytes) as k from v),
 f as (select uri, k, o as st, o + n as en, o as b from s where k = 1
 union all select s.uri, s.k, case when s.o - f.en <= {GAP} and greatest(s.o + s.n, f.en) - f.st <= {MOST} then f.st else s.o end,
 case when s.o - f.en <= {GAP} and greatest(s.o + s.n, f.en) - f.st <= {MOST} then greatest(f.en, s.o + s.n) else s.o + s.n end,
 case when s.o - f.en <= {GAP} and greatest(s.o + s.n, f.en) - f.st <= {MOST} then f.b else s.o end from f join s on s.uri = f.uri and s.k = f.k + 1)
 select uri, b as block_offset, max(en) - b as block_nbytes, count(*) as n_ranges from f group by uri, b""")
def coalesce_maxblock(spark, d):
    return ranges.coalesce_ranges(_virtual(spark, d), GAP, MOST)


@query(_QUERIES["coalesce_maxblock"][1])
def coalesce_udtf(spark, d):
    """The same as a table function of SQL."""
    ranges.register_udtf(spark)
    _virtual(spark, d).select("uri", "offset", "nbytes").createOrReplaceTempView("_virtual_ranges")
    return spark.sql(f"select * from coalesce_ranges(table(_virtual_ranges) partition by (uri) order by (offset, nbytes), {GAP}, {MOST})")


@query(f"""with {VIRT_SQL}, r as (select *, chunk_lin - row_number() over (partition by array_path, file_id order by chunk_lin) as run from v),
 p as (select *, (row_number() over (partition by array_path, file_id, run order by chunk_lin) - 1) // 8 as part from r)
 select array_path, file_id, min(chunk_lin) as first_chunk, count(*) as n_chunks, sum(nbytes)::bigint as nbytes from p group by array_path, file_id, run, part""")
def readahead_runs(spark, d):
    return ranges.readahead_runs(_chunks(refs(spark, d)), 8)


BINDINGS = [("http://", "plain"), ("https://", "tls"), ("https://blog.", "blog"), ("https://www.", "www"), ("http://blog.th", "th")]
BINDINGS_SQL = "b(prefix, target) as (values " + ", ".join(f"('{p}', '{t}')" for p, t in BINDINGS) + ")"


@query(f"with {BINDINGS_SQL} select page_id, url as uri, prefix, target from (select page_id, url, prefix, target, row_number() over (partition by page_id order by length(prefix) desc) as k from pages left join b on starts_with(url, prefix)) where k = 1")
def route_longest_prefix(spark, d):
    return ranges.route(_t(spark, d, "pages").select("page_id", F.col("url").alias("uri")), spark.createDataFrame(BINDINGS, "prefix string, target string"))


@query(f"with {VIRT_SQL}, pts as (select uri, \"offset\" as point from v where chunk_lin % 4 = 1) select v.uri, v.\"offset\" as at, max(point) as point from v left join pts on pts.uri = v.uri and point <= v.\"offset\" group by v.uri, v.\"offset\"")
def asof_access_point(spark, d):
    v = _virtual(spark, d)
    points = v.filter(F.col("chunk_lin") % 4 == 1).select("uri", F.col("offset").alias("point"))
    return ranges.as_of(v.select("uri", F.col("offset").alias("at")), points, "uri", "at", "point")


@query(f"with {VIRT_SQL}, w as (select uri, k * 30000 + 5000 as lo, k * 30000 + 12000 as hi from (select uri, unnest(range(size // 30000 + 1)) as k from files)) select v.uri, v.\"offset\", v.nbytes, lo, hi from v join w on v.uri = w.uri and v.\"offset\" < hi and lo < v.\"offset\" + v.nbytes and v.nbytes > 0")
def range_overlap(spark, d):
    w = files(spark, d).select("uri", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("size div 30000"))).alias("k")).select("uri", (F.col("k") * 30000 + 5000).cast("long").alias("lo"), (F.col("k") * 30000 + 12000).cast("long").alias("hi"))
    return ranges.overlaps(_virtual(spark, d).select("uri", "offset", "nbytes"), w, "uri", 16384)


@query(f"with {REFS_SQL} select array_path, chunk_lin, \"offset\" - coalesce(lag(\"offset\") over (partition by array_path order by chunk_lin), 0) as delta, \"offset\" as decoded from refs")
def delta_roundtrip(spark, d):
    enc = ranges.delta_encode(refs(spark, d).select("array_path", "chunk_lin", "offset"), "array_path", "chunk_lin", "offset")
    return ranges.delta_decode(enc.drop("offset"), "array_path", "chunk_lin")


@query(f"with {REFS_SQL} select array_path, n_cells, coalesce(sum(n_cells) over (order by array_path rows between unbounded preceding and 1 preceding), 0)::bigint as start from (select array_path, count(*) as n_cells from refs group by array_path)")
def native_start(spark, d):
    per = refs(spark, d).groupBy("array_path").agg(F.count("*").alias("n_cells")).withColumn("_all", F.lit(1))
    return per.withColumn("start", ranges.exclusive_sum(F.col("n_cells"), "_all", "array_path").cast("long")).drop("_all")


@query(f"with {CELLS_SQL}, q as (select i0, i1, (cast(round(v * 100) as bigint) % 256 + 256) % 256 as x from cells) select i0, i1, x as decoded from q")
def predictor2_decode(spark, d):
    q = embedding_cells(spark, d).select("i0", "i1", F.pmod(F.round(F.col("value") * F.lit(100).cast("float")).cast("long"), F.lit(256)).alias("x"))
    enc = ranges.delta_encode(q, "i0", "i1", "x").select("i0", "i1", F.pmod("delta", F.lit(256)).alias("x"))
    return ranges.undo_predictor(enc, ["i0"], "i1", "x", 8).select("i0", "i1", "decoded")


# --- saved formats, pages, rasters


@query(f"""with {REFS_SQL}, n as (select array_path, max(chunk_lin) + 1 as total from refs group by array_path),
 g as (select array_path, unnest(range(((total + 15) // 16) * 16)) as i from n)
 select g.array_path, i // 16 as file_no, i % 16 as row_no, case when state = 'virtual' then uri end as path, case when state = 'virtual' then "offset" else 0 end as "offset", case when state = 'virtual' then nbytes else 0 end as size
 from g left join refs on refs.array_path = g.array_path and refs.chunk_lin = i""")
def kerchunk_rows(spark, d):
    from .sources import kerchunk

    r = refs(spark, d)
    totals = r.groupBy("array_path").agg((F.max("chunk_lin") + 1).alias("total"))
    return kerchunk.parquet_rows(_chunks(r), files(spark, d), totals, 16).select("array_path", "file_no", "row_no", "path", "offset", "size")


@query(f"with {REFS_SQL} select array_path || '/' || chunk_lin as key, case when state = 'virtual' then '[\"' || uri || '\",' || \"offset\" || ',' || nbytes || ']' else 'base64:' || to_base64(encode(d.text)) end as ref from refs join documents d using (doc_id) where state <> 'missing'")
def kerchunk_json_refs(spark, d):
    from .sources import kerchunk

    r = refs(spark, d)
    arrays = r.groupBy("array_path").agg(F.array(F.max("chunk_lin") + 1).alias("shape")).withColumn("chunks", F.array(F.lit(1).cast("long")))
    return kerchunk.json_refs(_chunks(r), files(spark, d), arrays).select("key", "ref")


@query("select s_suppkey, i, round(500000.0 + s_nationkey * 10 + (i + 0.5) * (s_nationkey + 1), 3) as x, round(4000000.0 - (i + 0.5) * (s_nationkey + 2), 3) as y from supplier, range(4) t(i)")
def pixel_coordinates(spark, d):
    s = _t(spark, d, "supplier")
    k = F.col("s_nationkey").cast("double")
    affine = geo.affine_of(F.lit(None).cast("array<double>"), F.array(k + 1, k + 2, F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), k * 10 + 500000.0, F.lit(4000000.0), F.lit(0.0)))
    a = s.select("s_suppkey", affine.alias("a"))
    xs, ys = geo.pixel_centers(F.col("a"), F.lit(4), "x", F.lit(True)), geo.pixel_centers(F.col("a"), F.lit(4), "y", F.lit(True))
    return a.select("s_suppkey", F.posexplode(F.arrays_zip(xs.alias("x"), ys.alias("y"))).alias("i", "p")).select("s_suppkey", F.col("i").cast("long").alias("i"), F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


PAGES = [(0, 0, 9, 4), (1, 1, 5, 2), (2, 1, 3, 1), (3, 4, 9, 4), (4, 0, 8, 8), (5, 1, 4, 4), (6, 1, 2, 2), (7, 5, 4, 4), (8, 1, 8, 8)]


@query("select * from (values ('f', 0, 0, 0, 'data'), ('f', 1, 0, 1, 'data'), ('f', 2, 0, 2, 'data'), ('f', 3, 0, 0, 'mask'), ('f', 4, 1, 0, 'data'), ('f', 5, 1, 1, 'data'), ('f', 6, 1, 2, 'data'), ('f', 7, 1, 1, 'mask')) t(file, page, image, level, role)")
def overview_levels(spark, d):
    p = spark.createDataFrame([("f", *r) for r in PAGES], "file string, page int, sft int, width int, height int")
    return pages.levels(p).select("file", "page", F.col("image").cast("int").alias("image"), F.col("level").cast("int").alias("level"), "role")


@query(f"with {TREE_SQL} select r_name || '/' || n_name as array_path, (32600 + n_regionkey)::int as epsg from tree")
def crs_lookup(spark, d):
    t = _tree(spark, d)
    code = (F.col("n_regionkey") + 32600).cast("string")
    spelled = F.when(F.col("n_regionkey") % 4 == 0, code).when(F.col("n_regionkey") % 4 == 1, F.concat(code, F.lit(".0"))).when(F.col("n_regionkey") % 4 == 2, F.concat(F.lit('"'), code, F.lit('"'))).otherwise(F.concat(F.lit("["), code, F.lit("]")))
    own = t.select(F.concat_ws("/", "r_name", "n_name").alias("array_path"), F.lit('{"grid_mapping":"crs"}').alias("attrs"))
    maps = t.select(F.concat_ws("/", "r_name", F.lit("crs")).alias("array_path"), F.concat(F.lit('{"spatial_epsg":'), spelled, F.lit("}")).alias("attrs")).distinct()
    return raster.crs_of(own.unionByName(maps)).select("array_path", "epsg")


@query(f"with {CELLS_SQL} select i0, i1, round(v::double, 4) + 0.0::double as emb, round(i0 * 0.5 + 100, 4) as vec from cells")
def raster_with_coordinates(spark, d):
    m = embeddings(spark, d)
    n = m.array("emb")["shape"][0]
    axis = window.encode_cells(spark.range(n).select(F.col("id").alias("i0"), (F.col("id") * 0.5 + 100).alias("value")), "vec", "<f8", [n], [64])
    arrays = m.arrays.unionByName(spark.createDataFrame([("vec", "<f8", [n], [64], ["vec"], None, None, None, "{}", "explicit", None)], schema.ARRAYS))
    both = m.with_(arrays=arrays, chunks=m.chunks.unionByName(axis))
    return raster.raster(both, "emb").select("i0", "i1", (F.round("value", 4) + 0.0).alias("emb"), F.round("vec", 4).alias("vec"))


@query(f"with {CELLS_SQL} select i0, i1, round(v::double, 4) + 0.0::double as emb, round(v::double * 2 + 1, 4) + 0.0::double as twice from cells")
def raster_stack(spark, d):
    m = embeddings(spark, d)
    n, k = m.array("emb")["shape"]
    cells = embedding_cells(spark, d).select("i0", "i1", F.col("value"))
    more = window.encode_cells(cells, "twice", "<f4", [n, k], [25, 64])
    row = ("twice", "<f4", [n, k], [25, 64], ["vec", "dim"], None, None, None, '{"scale_factor": 2, "add_offset": 1}', "explicit", None)
    both = m.with_(arrays=m.arrays.unionByName(spark.createDataFrame([row], schema.ARRAYS)), chunks=m.chunks.unionByName(more))
    out = raster.raster_stack(both)
    return out.select("i0", "i1", (F.round("emb", 4) + 0.0).alias("emb"), (F.round("twice", 4) + 0.0).alias("twice"))


@query("select 'label' as array_path, (count(distinct member) > 1)::int as shared, (count(distinct h) > 1)::int as differs from (select vec_id % 2 as member, sum(label + 0) as h from embeddings group by all)")
def concat_values_check(spark, d):
    """Shared arrays of two members compared by their decoded cells."""
    e = _t(spark, d, "embeddings")
    half = lambda k: e.filter(F.col("vec_id") % 2 == k).select(F.floor(F.col("vec_id") / 2).alias("i0"), F.col("label").cast("int").alias("value"))
    n = half(0).agg(F.max("i0") + 1).first()[0]
    row = ("label", "<i4", [n], [64], ["vec"], None, None, None, "{}", "explicit", None)
    ms = [Manifest(spark.createDataFrame([], schema.FILES), spark.createDataFrame([row], schema.ARRAYS), window.encode_cells(half(k), "label", "<i4", [n], [64])) for k in (0, 1)]
    differing = combine.shared_differences(ms, "time")
    return spark.createDataFrame([("label", 1, int("label" in differing))], "array_path string, shared int, differs int")


@query("select strftime(time_bucket(interval '6 hours', ts), '%Y-%m-%d %H') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def stream_windowed_series(spark, d):
    """The stream of events, read to its end, as counts and sums by type and window."""
    import uuid

    from .streaming.append import windowed_series

    kind = _t(spark, d, "events").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"series_{uuid.uuid4().hex}"
    run = windowed_series(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))


from . import catalog_files  # noqa: E402, F401 - registers the queries over real files
