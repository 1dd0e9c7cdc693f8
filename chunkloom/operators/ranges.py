"""Ordered-sequence operators over byte ranges: coalescing, runs, routing, as-of, deltas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Keys are worked on in stretches of their order, so a key of very many rows is not one task's; what
#: a stretch leaves to the next is a row.
STRETCH = 1 << 30


def _keys(by: str | list[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _across(keys: list[str]):
    """What all stretches before a stretch leave to it."""
    return Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)


def islands(ranges: DataFrame, maxgap: int, by: str | list[str] = "uri", stretch: int = STRETCH) -> DataFrame:
    """Adds island, the offset at which the island of a range begins: ranges of a file that lie
    within maxgap of what came before (by offset).

    What crosses the border of two stretches is the furthest end and the last beginning.
    """
    keys, rows = _keys(by), ranges.withColumn("_at", F.expr(f"offset div {stretch}"))
    w, across = Window.partitionBy(*keys, "_at").orderBy("offset", "nbytes"), _across(keys)
    ends = rows.groupBy(*keys, "_at").agg(F.max(F.col("offset") + F.col("nbytes")).alias("_far")).withColumn("_far", F.max("_far").over(across))
    inside = F.max(F.col("offset") + F.col("nbytes")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(ends, [*keys, "_at"]).withColumn("_end", F.greatest(inside, "_far"))  # of nulls and a number, the number
    rows = rows.withColumn("_new", F.when(F.col("_end").isNull() | (F.col("offset") > F.col("_end") + maxgap), F.col("offset")))
    begun = rows.groupBy(*keys, "_at").agg(F.max("_new").alias("_last")).withColumn("_last", F.max("_last").over(across))
    rows = rows.join(begun, [*keys, "_at"]).withColumn("island", F.coalesce(F.max("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_last"))
    return rows.select(*ranges.columns, "island")


def coalesce_plan(ranges: list[tuple[int, int]], maxgap: int, maxblock: int | None) -> list[tuple[int, int]]:
    """Greedy blocks (offset, nbytes) of sorted ranges: a block grows while the gap is at most
    maxgap and the block at most maxblock; a single longer range stays whole."""
    out: list[list[int]] = []
    for offset, nbytes in sorted(ranges):
        end = offset + nbytes
        if out and offset - out[-1][1] <= maxgap and (maxblock is None or max(end, out[-1][1]) - out[-1][0] <= maxblock):
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([offset, end])
    return [(s, e - s) for s, e in out]


def coalesce_ranges(ranges: DataFrame, maxgap: int, maxblock: int | None = None, by: str = "uri") -> DataFrame:
    """Blocks to fetch: (by, block_offset, block_nbytes, n_ranges).

    Without maxblock the islands are the blocks, and the JVM does it all. With it, islands,
    whose borders every block respects, are dealt out and folded in order, one running block
    in memory at a time.
    """
    marked = islands(ranges.select(by, "offset", "nbytes"), maxgap, by)
    if maxblock is None:
        end = F.max(F.col("offset") + F.col("nbytes"))
        return marked.groupBy(by, "island").agg(F.min("offset").alias("block_offset"), (end - F.min("offset")).alias("block_nbytes"), F.count("*").alias("n_ranges")).drop("island")
    schema = pa.schema([(by, pa.string()), ("block_offset", pa.int64()), ("block_nbytes", pa.int64()), ("n_ranges", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, end, n, out = None, 0, 0, 0, []
        for b in batches:
            for key, island, offset, nbytes in zip(*(b.column(i).to_pylist() for i in range(4))):
                stop = offset + nbytes
                if now == (key, island) and offset - end <= maxgap and max(stop, end) - start <= maxblock:
                    end, n = max(end, stop), n + 1
                    continue
                if now is not None:
                    out.append((now[0], start, end - start, n))
                now, start, end, n = (key, island), offset, stop, 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now[0], start, end - start, n), schema)], schema=schema)

    dealt = marked.select(by, "island", "offset", "nbytes").repartition(by, "island").sortWithinPartitions(by, "island", "offset", "nbytes")
    return dealt.mapInArrow(run, f"{by} string, block_offset long, block_nbytes long, n_ranges long")


def readahead_runs(chunks: DataFrame, most: int = 32) -> DataFrame:
    """Runs of virtual chunks that follow each other in grid order in one file, at most `most` long."""
    # A run is an island of the chunk numbers, each a range of one.
    numbers = chunks.filter("state = 'virtual'").select("array_path", "file_id", F.col("chunk_lin").alias("offset"), F.lit(1).alias("nbytes"), F.col("nbytes").alias("size"))
    marked = islands(numbers, 0, ["array_path", "file_id"], 1 << 22).select("array_path", "file_id", F.col("offset").alias("chunk_lin"), F.col("size").alias("nbytes"), F.col("island").alias("run"))
    part = marked.withColumn("part", F.expr(f"(chunk_lin - run) div {most}"))
    return part.groupBy("array_path", "file_id", "run", "part").agg(F.min("chunk_lin").alias("first_chunk"), F.count("*").alias("n_chunks"), F.sum("nbytes").alias("nbytes")).drop("run", "part")


def route(uris: DataFrame, bindings: DataFrame) -> DataFrame:
    """The binding (prefix, target) with the longest prefix of each uri; null without one.

    Uris are joined on their own prefixes, cut at the lengths that bindings have, so it is an
    equi-join; the lengths are a handful.
    """
    lengths = [r[0] for r in bindings.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]
    keys = uris.select("uri").distinct().select("uri", F.explode(F.array(*[F.substring("uri", 1, n) for n in lengths])).alias("prefix")).distinct()
    best = keys.join(bindings, "prefix").groupBy("uri").agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("b"))
    return uris.join(best, "uri", "left").select(uris["*"], F.col("b.prefix").alias("prefix"), F.col("b.target").alias("target"))


def as_of(probes: DataFrame, points: DataFrame, by: str, at: str, point: str, stretch: int = STRETCH) -> DataFrame:
    """For each probe the nearest point of its key at or before it (null without one).

    Both sides are merged into one ordered sequence per key and stretch, so each row is read once;
    a stretch's last point goes on to those behind it.
    """
    left = probes.select(by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(points.schema[point].dataType).alias("_point"))
    right = points.select(by, F.col(point).alias("_at"), F.lit(0).alias("_side"), F.col(point).alias("_point"))
    both = left.unionByName(right).withColumn("_order", F.col("_at")).withColumn("_at", F.expr(f"_order div {stretch}"))
    w = Window.partitionBy(by, "_at").orderBy("_order", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_found", F.last("_point", ignorenulls=True).over(w))
    carried = both.groupBy(by, "_at").agg(F.max("_point").alias("_last")).withColumn("_last", F.max("_last").over(_across([by])))
    out = both.filter("_side = 1").join(carried, [by, "_at"])
    return out.select(by, F.col("_order").alias(at), F.coalesce("_found", "_last").alias(point))


def overlaps(ranges: DataFrame, windows: DataFrame, by: str, width: int) -> DataFrame:
    """Pairs of a range (offset, nbytes) and a window (lo, hi) of one key that share bytes.

    Both are filed under the cells of `width` bytes that they touch and meet there; a pair is
    reported in the first cell that both touch.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor((hi - 1) / width)))
    r = ranges.filter("nbytes > 0").withColumn("cell", cells(F.col("offset"), F.col("offset") + F.col("nbytes")))
    w = windows.filter("hi > lo").withColumn("cell", cells(F.col("lo"), F.col("hi")))
    both = r.join(w, [by, "cell"]).filter((F.col("offset") < F.col("hi")) & (F.col("lo") < F.col("offset") + F.col("nbytes")))
    return both.filter(F.col("cell") == F.greatest(F.floor(F.col("offset") / width), F.floor(F.col("lo") / width))).drop("cell")


def exclusive_sum(value: Column, by: str | list[str], order: str) -> Column:
    """Sum of the values before each row."""
    by = [by] if isinstance(by, str) else by
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def delta_encode(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    prev = F.lag(value, 1, 0).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("delta", F.col(value) - prev)


def delta_decode(rows: DataFrame, by: str, order: str, value: str = "delta", stretch: int = 1 << 22) -> DataFrame:
    """Running sums by a whole-number order; a stretch's total goes on to those behind it."""
    put = rows.withColumn("_at", F.expr(f"`{order}` div {stretch}"))
    totals = put.groupBy(by, "_at").agg(F.sum(value).alias("_sum")).withColumn("_sum", F.coalesce(F.sum("_sum").over(_across([by])), F.lit(0)))
    inside = F.sum(value).over(Window.partitionBy(by, "_at").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return put.join(totals, [by, "_at"]).withColumn("decoded", inside + F.col("_sum")).select(*rows.columns, "decoded")


def undo_predictor(cells: DataFrame, by: list[str], order: str, value: str, bits: int) -> DataFrame:
    """Horizontal differencing undone: running sums per row and band, modulo 2^bits."""
    total = F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("decoded", F.pmod(total, F.lit(1 << bits)))


def register_udtf(spark, name: str = "coalesce_ranges") -> None:
    """The fold as a table function of SQL, over a table of (uri, offset, nbytes):
    select * from coalesce_ranges(table(t) partition by uri order by (offset, nbytes), maxgap, maxblock)."""
    from pyspark.sql.functions import udtf

    class CoalesceRanges:
        def __init__(self):
            self.block = None

        def eval(self, row, maxgap: int, maxblock: int):
            offset, stop = row["offset"], row["offset"] + row["nbytes"]
            if self.block is not None:
                uri, start, end, n = self.block
                if offset - end <= maxgap and max(stop, end) - start <= maxblock:
                    self.block = (uri, start, max(stop, end), n + 1)
                    return
                yield uri, start, end - start, n
            self.block = (row["uri"], offset, stop, 1)

        def terminate(self):
            if self.block is not None:
                uri, start, end, n = self.block
                yield uri, start, end - start, n

    spark.udtf.register(name, udtf(CoalesceRanges, returnType="uri string, block_offset long, block_nbytes long, n_ranges long"))
