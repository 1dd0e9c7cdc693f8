"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion into a no-op sink after one warm-up on the smallest tables;
checks of the results stand beside the times, so a fast wrong answer fails.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    import numpy as np

    from chunkloom import api, catalog, samples, schema, typed
    from chunkloom.operators import listing
    from chunkloom.sources import base, hdf5

    q = catalog.queries()
    tmp = tempfile.mkdtemp()

    def affine(spark, d):
        rows = [(f"a{i}", "<i4", [640_000], [128], ["x"], None, None, None, "{}", "affine", (1, 0, [512], 512)) for i in range(50)]
        return listing.storage_size(listing.affine_chunks(spark.createDataFrame(rows, schema.ARRAYS)))

    def kerchunk(spark, d):
        path = f"{tmp}/refs.json"
        if not os.path.exists(path):
            n = 250_000
            doc = {"zarr_format": 2, "shape": [n], "chunks": [1], "dtype": "<f4", "compressor": None, "fill_value": None, "order": "C", "filters": None}
            with open(path, "w") as f:
                json.dump({"version": 1, "refs": {"v/.zarray": json.dumps(doc)} | {f"v/{i}": ["s3://b/f", i * 100, 100] for i in range(n)}}, f)
        return api.load(spark, path).chunks.groupBy("state").count()

    def enumerate_chunks(n):
        """One file's chunk index read to its end, without a table: what a scan's task does."""
        path = f"{tmp}/{n}.h5"
        with open(path, "wb") as f:
            f.write(samples.H5Writer().file({"v": samples.Dataset(np.zeros(n * 4, "<i4"), (4,))}))

        def run():
            return sum(1 for a in hdf5.parse(base.Reader(path), {}) for _ in a.places)

        assert run() == n
        return run

    grid = np.arange(1600 * 1600, dtype="<f4").reshape(1600, 1600)
    with open(f"{tmp}/grid.tif", "wb") as f:
        f.write(samples.tiff([samples.TiffPage(grid, (32, 32), codec="deflate")]))
    rng = np.random.default_rng(3)
    spots = [(int(y) * 32, int(x) * 32) for y, x in zip(rng.permutation(48), rng.permutation(48))]

    def scattered():
        a = typed.open_tiff(f"{tmp}/grid.tif")
        return sum(int((a[y : y + 32, x : x + 32] == grid[y : y + 32, x : x + 32]).all()) for y, x in spots)

    series = []
    for k in range(12):
        series.append(f"{tmp}/part{k:02}.h5")
        with open(series[-1], "wb") as f:
            f.write(samples.H5Writer().file({"v": samples.Dataset(grid[:200, :200] + k, (20, 20), "fixed", True, True)}))

    def scan_12(spark, d):
        return api.scan_series(spark, series).chunks.groupBy("member").count()

    def window_of_12(spark, d):
        return api.read_window(api.concat(api.scan_series(spark, series), "dim_0"), "v", [(150, 2300), (30, 170)])

    def vast(spark, d):
        row = ("v", "<i4", [400_000, 400_000], [4, 4], ["y", "x"], "7", None, None, "{}", "explicit", None)
        m = api.Manifest(spark.createDataFrame([], schema.FILES), spark.createDataFrame([row], schema.ARRAYS), spark.createDataFrame([], schema.CHUNKS))
        return api.read_window(m, "v", [(399_000, 399_003), (5, 6)])

    work = {name: q[name] for name in ("chunk_location", "chunk_state_counts", "storage_size", "window_read_sum", "full_reduction", "point_select", "fill_missing", "concat_time", "coalesce_gap", "coalesce_maxblock", "readahead_runs", "range_overlap", "asof_access_point", "validate_files", "validate_consistency", "kerchunk_rows", "kerchunk_json_refs", "raster_with_coordinates", "raster_layers", "h5_btree1", "h5_extensible_array", "tiff_deflate_predictor", "zip_read", "save_load_native")}
    work |= {"affine_250k": affine, "kerchunk_json_load_250k": kerchunk, "scan_12_files": scan_12, "window_of_12_files": window_of_12, "window_of_10e10_chunks": vast}
    for name, f in work.items():
        f(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for name, f in work.items():
        began = time.time()
        f(spark, SF).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    for name, f in {"scattered_48_chunks": scattered, **{f"enumerate_{n}_chunks": enumerate_chunks(n) for n in (500, 2000, 4000)}}.items():
        f()
        began = time.time()
        assert f() in (48, 500, 2000, 4000)
        times[name] = round(time.time() - began, 5)
    cells = q["full_reduction"](spark, SF).first()["n"]
    e = spark.read.parquet(f"{SF}/embeddings.parquet").agg(F.sum(F.size("embedding"))).first()[0]
    assert cells == e, (cells, e)
    assert affine(spark, SF).agg(F.sum("bytes")).first()[0] == 50 * 5000 * 512
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
