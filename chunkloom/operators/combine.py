"""Combination: one path dictionary, concatenation along a dimension, layers, attributes."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid
from ..manifest import Manifest
from ..schema import VIRTUAL
from .listing import affine_chunks


def merge_tables(members: DataFrame) -> DataFrame:
    """(member, file_id, uri, ...) -> the ordered distinct uris with new_id from 1 on.

    The order is that of first use: member, then file_id. Sizes that disagree are an error
    row's business (`table_conflicts`), nulls give way to values.
    """
    first = members.groupBy("uri").agg(
        F.min(F.struct("member", "file_id")).alias("seen"), F.max("etag").alias("etag"), F.max("size").alias("size"), F.max("mtime").alias("mtime")
    )
    # One numbering over the distinct files: the dictionary, which is small beside the chunks.
    return first.select(F.row_number().over(Window.orderBy("seen")).cast("long").alias("new_id"), "uri", "etag", "size", "mtime")


def table_conflicts(members: DataFrame) -> DataFrame:
    return members.groupBy("uri").agg(F.count_distinct("size").alias("n_sizes")).filter("n_sizes > 1")


def remap(chunks: DataFrame, members: DataFrame, merged: DataFrame) -> DataFrame:
    """Chunk rows (member, file_id, ...) with the merged table's ids; missing and inline rows keep none."""
    ids = members.join(merged.select("uri", "new_id"), "uri").select("member", "file_id", "new_id")
    own = chunks.join(ids, ["member", "file_id"], "left")
    return own.withColumn("file_id", F.when(F.col("state") == VIRTUAL, F.col("new_id"))).drop("new_id")


@dataclass(frozen=True)
class Members:
    """Manifests that are to be combined, as one set of tables with a member column (0, 1, ...)."""

    files: DataFrame
    arrays: DataFrame
    chunks: DataFrame  # of a formula's arrays there are none
    attrs: list[dict]
    names: list[str]
    held: tuple = ()

    @staticmethod
    def of(ms: list[Manifest] | Members, what: str = "this") -> Members:
        if isinstance(ms, Members):
            return ms
        if not ms:
            raise ValueError(f"{what} needs a manifest at least")
        put = lambda get: reduce(DataFrame.unionByName, [get(m.root(what)).withColumn("member", F.lit(i)) for i, m in enumerate(ms)])
        names = [str(m.provenance.get("path", f"layer{i}")).rsplit("/", 1)[-1].split(".")[0] for i, m in enumerate(ms)]
        held = tuple({id(h): h for m in ms for h in m.held}.values())
        return Members(put(lambda m: m.files), put(lambda m: m.arrays), put(lambda m: m.chunks), [m.attrs for m in ms], names, held)

    def every_chunk(self) -> DataFrame:
        return self.chunks.unionByName(affine_chunks(self.arrays))

    def member(self, i: int) -> Manifest:
        own = lambda df: df.filter(F.col("member") == i).drop("member")
        return Manifest(own(self.files), own(self.arrays), own(self.chunks), self.attrs[i])


def key_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys that only one side has."""
    left, right = a.select("array_path").distinct().withColumn("a", F.lit(1)), b.select("array_path").distinct().withColumn("b", F.lit(1))
    return left.join(right, "array_path", "full").filter(F.col("a").isNull() | F.col("b").isNull()).select("array_path", F.when(F.col("b").isNull(), "left").otherwise("right").alias("side"))


def _height(extents: list[int], most: int) -> int:
    """The largest number up to `most` that divides all extents; without extents, `most`."""
    whole = math.gcd(*extents)
    if not whole:
        return most
    low = [k for k in range(1, math.isqrt(whole) + 1) if whole % k == 0]
    return max(k for d in low for k in (d, whole // d) if k <= most)


def one_grid(ms: Members, dim: str) -> Members:
    """Members whose arrays differ only in the chunks' rows along `dim`, their first dimension, put on
    one chunk grid where their bytes allow that.

    Rows of a formula without codecs follow each other in the file, so they are cut anew: as the
    members with chunks of their own are cut, else by a number that divides all extents but the
    last member's, at most the longest there was. A last member's only chunk may be a short one:
    the reader fills what it lacks.
    """
    arrays = ms.arrays
    rest = lambda c: F.slice(c, 2, F.size(c))
    rows = arrays.filter(F.array_position("dims", dim) == 1).withColumn("_n", F.element_at("shape", 1)).withColumn("_old", F.element_at("chunks", 1))
    mixed = rows.groupBy("array_path").agg(F.count_distinct(rest(F.col("chunks"))).alias("_rest"), F.count_distinct("_old").alias("_olds"))
    mixed = mixed.filter("_rest = 1 and _olds > 1").select("array_path")
    if mixed.isEmpty():
        return ms
    last = arrays.agg(F.max("member")).first()[0]
    alone = F.forall(F.zip_with(rest(F.col("shape")), rest(F.col("chunks")), lambda n, c: n <= c), lambda x: x)
    follow = (F.col("_n") <= F.col("_old")) | (F.element_at("affine.strides", 1) == F.col("affine.chunkbytes"))
    plain = F.col("compressor").isNull() & (F.coalesce(F.size("filters"), F.lit(0)) <= 0)
    formula = F.coalesce((F.col("map_kind") == "affine") & plain & alone & follow, F.lit(False))
    # In one dimension a filter's columns may be the chunk's rows.
    ends = (F.col("member") == last) & (F.col("_n") <= F.col("_old")) & ((F.size("shape") > 1) | (F.coalesce(F.size("filters"), F.lit(0)) <= 0))
    short = (F.col("map_kind") == "explicit") & (ends | (F.col("_n") == 0))
    rows = rows.join(mixed, "array_path").withColumn("_formula", formula).withColumn("_short", short)
    own = F.collect_set(F.when(~F.col("_formula") & ~F.col("_short"), F.col("_old")))
    before = F.collect_set(F.when(F.col("_formula") & (F.col("member") < last), F.col("_n")))
    most = F.max(F.when(F.col("_formula"), F.col("_old")))
    per = rows.groupBy("array_path").agg(own.alias("_own"), before.alias("_before"), most.alias("_most"))
    step = F.when(F.size("_own") == 1, F.array_max("_own")).when((F.size("_own") == 0) & F.col("_most").isNotNull(), F.udf(_height, "long")("_before", "_most"))
    per = per.withColumn("_step", step).select("array_path", "_step")
    fits = F.col("_formula") | (F.col("_short") & (F.col("_n") <= F.col("_step")))
    line = grid.quotient(F.col("affine.chunkbytes"), F.col("_old"))
    cut = rows.join(per, "array_path").filter(F.col("_step").isNotNull() & (F.col("_old") != F.col("_step")) & fits)
    cut = cut.select("member", "array_path", "_step", "_formula", line.alias("_line"), (F.col("affine.base") + F.col("_n") * line).alias("_end"))
    # A small row for an array of a member, as the members' names are: joined as they are, not found anew.
    cut = arrays.sparkSession.createDataFrame(cut.collect(), cut.schema)
    size = F.col("_step") * F.col("_line")
    strides = F.transform("affine.strides", lambda s, i: F.when(i == 0, size).otherwise(s))
    anew = F.when(F.col("_formula"), F.struct(F.col("affine.file_id").alias("file_id"), F.col("affine.base").alias("base"), strides.alias("strides"), size.alias("chunkbytes")))
    put = arrays.join(cut.drop("_end"), ["member", "array_path"], "left")
    put = put.withColumn("chunks", F.when(F.col("_step").isNull(), F.col("chunks")).otherwise(F.concat(F.array("_step"), rest(F.col("chunks")))))
    put = put.withColumn("affine", F.coalesce(anew, "affine"))
    made = put.filter("_formula").select(*arrays.columns)
    listed = affine_chunks(made).join(cut.select("member", "array_path", "_end"), ["member", "array_path"])
    listed = listed.withColumn("nbytes", F.least("nbytes", F.col("_end") - F.col("offset"))).select(*ms.chunks.columns)
    put = put.withColumn("map_kind", F.when(F.col("_formula"), "explicit").otherwise(F.col("map_kind"))).withColumn("affine", F.when(~F.coalesce("_formula", F.lit(False)), F.col("affine")))
    return replace(ms, arrays=put.select(*arrays.columns), chunks=ms.chunks.unionByName(listed))


def concat_faults(arrays: DataFrame, dim: str, check: str = "shape") -> DataFrame:
    """Why the members' arrays (member, array_path, ...) cannot be concatenated: (array_path, fault).

    Arrays with the dimension must agree in all but its extent, and members before the last
    must end on a chunk's edge. Arrays without it are shared: with `check` other than none
    they must agree in type, shape, chunks, dimensions and attributes.
    """
    at = F.array_position("dims", dim)
    rows = arrays.withColumn("at", at.cast("int")).withColumn("repeats", F.size(F.filter("dims", lambda d: d == dim)))
    members = arrays.select("member").distinct().count()
    rest = lambda c: F.transform(c, lambda x, i: F.when(i == F.col("at") - 1, F.lit(0).cast("long")).otherwise(x))
    text = lambda c: F.coalesce(F.to_json(F.struct(c.alias("v"))), F.lit(""))
    differ = lambda c: F.count_distinct(text(c)) > 1
    last = rows.select(F.max("member")).first()[0]
    extent, step = F.element_at("shape", F.col("at")), F.element_at("chunks", F.col("at"))
    misaligned = F.bool_or((F.col("at") > 0) & (F.col("member") < last) & (F.when(F.col("at") > 0, extent % step) != 0))
    fault = (
        F.when(F.count("*") != members, "not in every member").when(F.max("repeats") > 1, "dimension repeated")
        .when(differ(F.col("dims")), "dimensions differ").when(differ(F.col("dtype")), "types differ")
        .when((F.max("at") > 0) & differ(F.col("chunks")), "chunk shapes differ")
        .when((F.max("at") > 0) & (differ(F.col("compressor")) | differ(F.col("filters"))), "codecs differ")
        .when((F.max("at") > 0) & differ(F.col("fill_value")), "fill values differ")
        .when((F.max("at") > 0) & differ(rest(F.col("shape"))), "other dimensions differ")
        .when(F.coalesce(misaligned, F.lit(False)), "a member ends inside a chunk")
        .when((F.max("at") == 0) & F.lit(check != "none") & (differ(F.col("shape")) | differ(F.col("chunks")) | differ(F.col("attrs"))), "shared arrays differ")
    )
    return rows.groupBy("array_path").agg(fault.alias("fault")).filter(F.col("fault").isNotNull())


def shift_along(arrays: DataFrame, chunks: DataFrame, dim: str) -> tuple[DataFrame, DataFrame]:
    """Arrays of the concatenation, and the members' chunk rows moved to their places in it.

    A member's chunks move by the chunks of all members before it along the dimension;
    arrays without the dimension are taken from the first member.
    """
    g = grid.grid_size(F.col("shape"), F.col("chunks"))
    a = arrays.withColumn("at", F.array_position("dims", dim).cast("int")).withColumn("grid", g)
    a = a.filter((F.col("at") > 0) | (F.col("member") == 0))
    along = lambda c: F.when(F.col("at") > 0, F.element_at(c, F.col("at")))
    before = Window.partitionBy("array_path").orderBy("member").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("array_path")
    a = a.withColumn("shift", F.coalesce(F.sum(along("grid")).over(before), F.lit(0))).withColumn("extent", F.sum(along("shape")).over(whole)).withColumn("steps", F.sum(along("grid")).over(whole))
    put = lambda c, v: F.when(F.col("at") > 0, F.transform(c, lambda x, i: F.when(i == F.col("at") - 1, F.col(v)).otherwise(x))).otherwise(F.col(c))
    new_grid = put("grid", "steps")
    moves = a.select("member", "array_path", "at", "grid", "shift", new_grid.alias("new_grid"))
    index = F.transform(grid.delinearize(F.col("chunk_lin"), F.col("grid")), lambda x, i: F.when(i == F.col("at") - 1, x + F.col("shift")).otherwise(x))
    moved = chunks.join(moves, ["member", "array_path"]).withColumn("chunk_lin", grid.linearize(index, F.col("new_grid")))
    moved = moved.drop("at", "grid", "shift", "new_grid")
    shaped = a.filter(F.col("member") == 0).withColumn("shape", put("shape", "extent")).drop("at", "grid", "shift", "extent", "steps", "member")
    return shaped, moved


def attr_conflicts(attrs: DataFrame) -> DataFrame:
    """(member, key, value) -> keys whose values differ between members; absence is no conflict."""
    return attrs.groupBy("key").agg(F.count_distinct("value").alias("n_values")).filter("n_values > 1")


def merge_attrs(members: list[dict], attrs: dict | None = None) -> dict:
    """All members' group attributes; a key that differs is an error unless `attrs` settles it."""
    out: dict = {}
    for own in members:
        for k, v in own.items():
            if k in out and out[k] != v and k not in (attrs or {}):
                raise ValueError(f"attribute {k!r} differs; give attrs= to settle it")
            out[k] = v
    return out | (attrs or {})


def _one_table(ms: Members) -> DataFrame:
    bad = table_conflicts(ms.files).limit(1).collect()
    if bad:
        raise ValueError(f"conflicting sizes for {bad[0]['uri']!r}")
    return merge_tables(ms.files)


def _explicit(arrays: DataFrame) -> DataFrame:
    return arrays.withColumn("map_kind", F.lit("explicit")).withColumn("affine", F.lit(None).cast(arrays.schema["affine"].dataType))


def concat(ms: list[Manifest] | Members, dim: str, check: str = "shape", attrs: dict | None = None) -> Manifest:
    """Members, in order, stacked along a named dimension, contiguous ones cut to one chunk grid.
    check: shape, values or none."""
    if check not in ("shape", "values", "none"):
        raise ValueError(f"check={check!r}")
    ms = Members.of(ms, "concat")
    if ms.arrays.filter(F.array_contains("dims", dim)).isEmpty():
        raise ValueError(f"no array has a dimension {dim!r}")
    ms = one_grid(ms, dim)
    arrays = ms.arrays
    bad = concat_faults(arrays, dim, check).orderBy("array_path").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['array_path']}: {bad[0]['fault']}")
    if check == "values":
        different = shared_differences(ms, dim)
        if different:
            raise ValueError(f"shared arrays differ in values: {', '.join(different)}")
    merged = _one_table(ms)
    shaped, moved = shift_along(arrays, ms.every_chunk(), dim)
    chunks = remap(moved, ms.files, merged)
    first = [c for c in ms.chunks.columns if c != "member"]
    return Manifest(merged.withColumnRenamed("new_id", "file_id"), _explicit(shaped), chunks.select(*first), merge_attrs(ms.attrs, attrs), {"concat": dim, "members": len(ms.names)}, ms.held)


def shared_differences(ms: list[Manifest] | Members, dim: str) -> list[str]:
    """Arrays without the dimension whose decoded cells differ between members."""
    from ..plans.window import array_hash

    ms, out = Members.of(ms), []
    for r in ms.arrays.filter((F.col("member") == 0) & ~F.array_contains("dims", dim)).select("array_path").orderBy("array_path").collect():
        one = array_hash(ms.member(0), r[0])
        if any(array_hash(ms.member(i), r[0]) != one for i in range(1, len(ms.names))):
            out.append(r[0])
    return out


def merge(ms: list[Manifest] | Members, names: list[str] | None = None, attrs: dict | None = None) -> Manifest:
    """Members as layers: a member of one array gives its name, one of several `name/path`."""
    ms = Members.of(ms, "merge")
    names = names or ms.names
    if len(names) != len(ms.names) or len(set(names)) != len(names) or not all(n and "/" not in n for n in names):
        raise ValueError("names must be as many as the members, different, not empty and without /")
    merged = _one_table(ms)
    given = ms.files.sparkSession.createDataFrame(list(enumerate(names)), "member int, name string")
    layers = ms.arrays.groupBy("member").agg((F.count("*") == 1).alias("alone")).join(given, "member")
    label = lambda d: d.join(layers, "member").withColumn(
        "array_path", F.when(F.col("alone"), F.col("name")).otherwise(F.concat_ws("/", "name", "array_path"))
    )
    first = lambda d: [c for c in d.columns if c != "member"]
    arrays = label(_explicit(ms.arrays)).select(*first(ms.arrays))
    chunks = label(remap(ms.every_chunk(), ms.files, merged)).select(*first(ms.chunks))
    return Manifest(merged.withColumnRenamed("new_id", "file_id"), arrays, chunks, merge_attrs(ms.attrs, attrs), {"merge": json.dumps(names)}, ms.held)
