"""Access checks, refusals, archives, newer HDF5 structures, typed reads: what no SQL can say."""

import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom import api, samples, typed
from chunkloom.functions import codecs, crs
from chunkloom.plans import fetch, window
from chunkloom.sources import base, jp2, zips


@pytest.fixture
def registries():
    """What a test registers is gone after it."""
    transports, checks, known, formats = dict(fetch._TRANSPORTS), list(fetch._CHECKS), dict(codecs._REGISTRY), dict(api._FORMATS)
    yield
    fetch._TRANSPORTS.clear()
    fetch._TRANSPORTS.update(transports)
    fetch._CHECKS[:] = checks
    codecs._REGISTRY.clear()
    codecs._REGISTRY.update(known)
    api._FORMATS.clear()
    api._FORMATS.update(formats)


def matrix(shape=(60, 50), dtype="<u2"):
    return np.arange(int(np.prod(shape)), dtype=dtype).reshape(shape)


def grid(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[tuple(r[f"i{d}"] for d in range(len(shape)))] = r["value"]
    return out


def test_authorize_holds_in_tasks(spark, tmp_path, registries):
    (tmp_path / "a.tif").write_bytes(samples.tiff([samples.TiffPage(matrix(), (16, 16))]))
    m = api.scan(spark, str(tmp_path / "a.tif"))
    assert m.chunks.count() == 16
    api.authorize(lambda uri: False)
    with pytest.raises(Exception, match="may not be read"):
        api.read_window(m, "0/data").collect()
    with pytest.raises(Exception, match="may not be read"):
        window.chunk_bytes(m).collect()


def test_transports_and_codecs_travel(spark, tmp_path, registries):
    body = samples.tiff([samples.TiffPage(matrix(), (16, 16), codec="deflate")])
    api.register_transport("store://", lambda uri, o, n: body[o : o + n], lambda uri: len(body), inflight=4)
    api.register_codec("zlib", lambda d, c, x: bytes(len(__import__("zlib").decompress(d))))  # decodes to zeros
    got = grid(api.read_window(api.scan(spark, "store://x/a.tif"), "0/data"), (60, 50))
    assert not got.any()
    with pytest.raises(ValueError, match="no transport for other://"):
        fetch.object_size("other://a")


def test_a_format_of_ones_own(spark, tmp_path, registries):
    kept = {}
    api.register_format("memory", lambda m, path: kept.__setitem__(path, m), lambda spark, path: kept[path])
    (tmp_path / "a.tif").write_bytes(samples.tiff([samples.TiffPage(matrix())]))
    m = api.scan(spark, str(tmp_path / "a.tif"))
    api.save(m, "p", "memory")
    assert api.load(spark, "p", "memory") is m and m.provenance["scanned_at"] > 0 and m.provenance["driver"] == "geotiff"
    with pytest.raises(ValueError, match="format 'none'"):
        api.load(spark, "p", "none")


def test_zip_names_stay_inside(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("sub/", "")
        z.writestr("sub/ok.txt", "ok")
    rows = zips.members(spark, [str(tmp_path / "a.zip")])
    assert [(r["name"], r["size"]) for r in zips.extract(rows, str(tmp_path / "out")).collect()] == [("sub/ok.txt", 2)]
    for name in ("../up.txt", "/abs.txt", "a/../../b", "c:\\x", "..\\y"):
        with pytest.raises(base.FormatError):
            zips.safe_name(name)
        with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
            z.writestr(name, "bad")
        with pytest.raises(Exception, match="outside of its folder"):
            zips.extract(zips.members(spark, [str(tmp_path / "b.zip")]), str(tmp_path / "out")).collect()
    assert sorted(os.listdir(tmp_path / "out")) == ["sub"]


def test_zip_ranges_in_one_pass(tmp_path):
    data = bytes(np.random.default_rng(1).integers(0, 9, 400_000, dtype=np.uint8))
    (tmp_path / "a.zip").write_bytes(samples.archive([("x", data), ("y", data)], lambda i: i == 1))
    r = base.Reader(str(tmp_path / "a.zip"))
    ranges = [(0, 5), (5, 0), (100, 1000), (200_000, 70_000), (399_990, 10)]
    for _, method, comp, full, head in zips.central_directory(r):
        assert list(zips.Member(r, method, comp, full, head).read_many(ranges)) == [data[o : o + n] for o, n in ranges]
        with pytest.raises(ValueError, match="ascend"):
            list(zips.Member(r, method, comp, full, head).read_many([(10, 5), (12, 1)]))


@pytest.mark.parametrize("index", ["btree1", "fixed", "extensible", "btree2", "implicit"])
def test_hdf5_chunk_indexes(spark, tmp_path, index):
    for shape, chunks in (((5, 7), (2, 3)), ((900,), (2,)), ((130, 6), (1, 3))):
        a = matrix(shape, "<f4")
        packed, absent = index != "implicit", () if index == "implicit" else (1,)
        (tmp_path / "a.h5").write_bytes(samples.H5Writer().file({"v": samples.Dataset(a, chunks, index, packed, packed, fill=-1.0, absent=absent)}))
        want = a.astype(float)
        if absent:
            at = np.unravel_index(1, [-(-n // c) for n, c in zip(shape, chunks)])
            want[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))] = -1
        m = api.scan(spark, str(tmp_path / "a.h5"))
        assert np.array_equal(grid(api.read_window(m, "v"), shape), want)
        m.release()


def test_hdf5_dense_group_and_attributes(spark, tmp_path):
    tree = {f"dataset_{i:03}": samples.Dataset(matrix((3,), "<i4") + i) for i in range(60)}
    (tmp_path / "a.h5").write_bytes(samples.H5Writer().file(tree, {f"a{i}": i for i in range(20)}, dense=True))
    m = api.scan(spark, str(tmp_path / "a.h5"))
    assert m.arrays.count() == 60 and m.attrs == {f"a{i}": i for i in range(20)}


def test_views_of_groups(spark, tmp_path):
    (tmp_path / "a.h5").write_bytes(samples.H5Writer().file({"g": ({"v": samples.Dataset(matrix((4, 4), "<i4"))}, {"t": "x"})}))
    m = api.scan(spark, str(tmp_path / "a.h5"))
    view = m.group("/g/")
    assert [r["array_path"] for r in view.arrays.collect()] == ["v"] and np.array_equal(grid(api.read_window(view, "v"), (4, 4)), matrix((4, 4)))
    for refused in (lambda: api.save(view, str(tmp_path / "s")), lambda: api.merge([view]), lambda: api.concat([view], "dim_0")):
        with pytest.raises(ValueError, match="whole manifest"):
            refused()
    with pytest.raises(KeyError):
        m.group("nothing")


def test_typed_reads(tmp_path):
    a = matrix()
    path = str(tmp_path / "a.tif")
    (tmp_path / "a.tif").write_bytes(samples.tiff([samples.TiffPage(a, (16, 16), codec="lzw", predictor=True)], big=True))
    t = typed.open_tiff(path, "<u2")
    assert np.array_equal(t[:], a) and np.array_equal(t[5:20, 7], a[5:20, 7]) and t[-1, -1] == a[-1, -1] and np.array_equal(t[..., 3], a[..., 3])
    assert typed.tiff_eltype(path) == "<u2"
    with pytest.raises(TypeError):
        typed.open_tiff(path, "<f4")
    kept = typed.cached(typed.open_tiff(path), str(tmp_path / "cache"))
    assert np.array_equal(kept[3:40], a[3:40])
    os.rename(path, path + ".gone")
    assert np.array_equal(kept[3:40], a[3:40])  # from the cache
    with pytest.raises(FileNotFoundError):
        typed.open_tiff(path)
    cache = typed.Readahead(100)
    for k in range(30):
        cache.put(k, bytes(10))
    assert cache.size == 100 and cache.get(0) is None and cache.get(29)


def test_typed_hdf5(tmp_path):
    a = matrix()
    tree = {"g": ({"v": samples.Dataset(a, (16, 16), "extensible", True, True, {"units": "m"}), "s": samples.Dataset(["a", "bé", ""])}, {"t": "x"})}
    (tmp_path / "a.h5").write_bytes(samples.H5Writer().file(tree))
    with typed.h5open(str(tmp_path / "a.h5")) as f:
        assert f.exists("g/v") and not f.exists("g/w") and f.is_group("g") and not f.is_group("g/v") and f.dims("g/v") == (60, 50)
        assert f.attr_string("g", "t") == "x" and f.attr_string("g/v", "units") == "m" and f.read_strings("g/s") == ["a", "bé", ""]
        assert f.read_elements("g/v", [(0, 0), (59, 49), (0, 0)], "<f8").tolist() == [0.0, 2999.0, 0.0]
        assert np.array_equal(f.open_array("g/v", "<u2")[10:33, 1:49], a[10:33, 1:49]) and np.array_equal(f.read("g/v", "<i8"), a)
        with pytest.raises(TypeError):
            f.open_array("g/v", "<i4")
        with pytest.raises(IndexError):
            f.read_elements("g/v", [(60, 0)])
    with pytest.raises(ValueError, match="closed"):
        f.exists("g")


def test_jp2_tile_alone(tmp_path):
    import base64

    (tmp_path / "a.jp2").write_bytes(samples.jp2([[b"abc"], [b"de", b"f"], [b"g"], [b"h"]], 2))
    a = typed.open_jp2(str(tmp_path / "a.jp2"))
    assert a.counts == (2, 2) and typed.jp2_eltype(str(tmp_path / "a.jp2")) == "|u1"
    header = base64.b64decode(json.loads(a._compressor)["header"])
    (tmp_path / "b.j2k").write_bytes(jp2.standalone(header, a.chunk_bytes([1])[0]))
    one = typed.open_jp2(str(tmp_path / "b.j2k"))
    assert one.shape == (64, 64) and one.counts == (1, 1)
    with pytest.raises(codecs.UnsupportedCodec, match="JPEG 2000"):
        a[0:1, 0:1]


def test_window_of_a_vast_array(spark):
    """Three cells of 10^10 chunks: the chunks are generated from the window."""
    from chunkloom import manifest

    n = 10**5
    row = ("v", "<i4", [n * 4, n * 4], [4, 4], ["y", "x"], "7", None, None, "{}", "explicit", None)
    m = manifest.from_rows(spark, [], [row], [("v", n * n - 1, "inline", None, None, None, np.arange(16, dtype="<i4").tobytes())])
    cells = api.read_window(m, "v", [(4 * n - 1, 4 * n), (4 * n - 3, 4 * n)]).collect()
    assert sorted((r["i1"], r["value"]) for r in cells) == [(4 * n - 3, 13), (4 * n - 2, 14), (4 * n - 1, 15)]
    assert {r["value"] for r in api.read_window(m, "v", [(0, 1), (0, 3)]).collect()} == {7}
    points = spark.createDataFrame([(4 * n - 1, 4 * n - 1), (4 * n - 1, 4 * n - 1), (0, 0), (-1, 0)], "i0 long, i1 long")
    assert sorted(r["value"] for r in api.read_points(m, "v", points).collect()) == [7, 15, 15]


def test_concat_of_many_files_keeps_a_plan_of_fixed_size(spark, tmp_path):
    paths = []
    for k in range(40):
        paths.append(str(tmp_path / f"p{k:02}.tif"))
        with open(paths[-1], "wb") as f:
            f.write(samples.tiff([samples.TiffPage(matrix((4, 6)) + 24 * k, (2, 2))]))
    few, many = (api.concat(api.scan_series(spark, p), "y") for p in (paths[:3], paths))
    size = lambda m: m.chunks._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(few) == size(many)
    assert np.array_equal(grid(api.read_window(many, "0/data"), (160, 6)), matrix((160, 6)))


@pytest.mark.parametrize("heights", [(100, 100, 56), (30, 45, 7)])
def test_concat_cuts_contiguous_members_to_one_grid(spark, tmp_path, heights):
    whole, paths, at = matrix((sum(heights), 6)), [], 0
    for k, h in enumerate(heights):
        paths.append(str(tmp_path / f"p{k}.tif"))
        (tmp_path / f"p{k}.tif").write_bytes(samples.tiff([samples.TiffPage(whole[at : at + h], rows=10)]) + b"beyond")
        at += h
    m = api.concat(api.scan_series(spark, paths, chunkbytes=25 * 6 * 2), "y")
    assert np.array_equal(grid(api.read_window(m, "0/data"), whole.shape), whole)
    assert m.chunks.agg(F.sum("nbytes")).first()[0] == whole.nbytes and m.chunks.count() <= sum(heights) // 15 + 2


def test_concat_of_contiguous_hdf5_of_different_extents(spark, tmp_path):
    heights = (20, 0, 15)
    whole, paths, at = matrix((sum(heights), 6), "<i4"), [], 0
    for k, h in enumerate(heights):
        paths.append(str(tmp_path / f"p{k}.h5"))
        tree = {"v": samples.Dataset(whole[at : at + h], scales=("y", "x")), "y": samples.Dataset(np.arange(h, dtype="<i8"), attrs={"CLASS": "DIMENSION_SCALE"}), "x": samples.Dataset(np.arange(6, dtype="<i8"), attrs={"CLASS": "DIMENSION_SCALE"})}
        with open(paths[-1], "wb") as f:
            f.write(samples.H5Writer().file(tree, {}))
        at += h
    m = api.concat(api.scan_series(spark, paths), "y")
    assert np.array_equal(grid(api.read_window(m, "v"), whole.shape), whole)


def test_concat_takes_a_short_last_member(spark, tmp_path):
    whole = matrix((107, 6))
    for k, rows in enumerate((whole[:50], whole[50:100], whole[100:])):
        (tmp_path / f"p{k}.tif").write_bytes(samples.tiff([samples.TiffPage(rows, rows=25, codec="lzw", predictor=True)]))
    paths = [str(tmp_path / f"p{k}.tif") for k in range(3)]
    assert np.array_equal(grid(api.read_window(api.concat(api.scan_series(spark, paths), "y"), "0/data"), whole.shape), whole)
    with pytest.raises(ValueError, match="chunk shapes differ"):
        api.concat(api.scan_series(spark, paths[::-1]), "y")


def test_missing_by_no_bytes_and_short_parts(spark, tmp_path):
    from chunkloom import manifest

    row = ("v", "<i4", [4], [2], ["x"], "9", '{"id":"zlib"}', None, "{}", "explicit", None)
    m = manifest.from_rows(spark, [(1, str(tmp_path / "none"), None, None, None)], [row], [("v", 0, "virtual", 1, 0, 0, None)])
    assert [r["value"] for r in api.read_window(m, "v").collect()] == [9, 9, 9, 9]
    api.save(m.with_(chunks=m.chunks.filter(F.lit(False))), str(tmp_path / "k.parq"), record_size=10)
    import pyarrow.parquet as pq

    part = str(tmp_path / "k.parq/v/refs.0.parq")
    pq.write_table(pq.read_table(part).slice(0, 1), part)
    with pytest.raises(Exception, match="1 of 2 references"):
        api.load(spark, str(tmp_path / "k.parq"))


def test_access_modes_and_costs(spark, tmp_path):
    path = str(tmp_path / "a.tif")
    (tmp_path / "a.tif").write_bytes(samples.tiff([samples.TiffPage(matrix((300, 300)), (16, 16))]))
    for mode in base.ACCESS:
        assert api.scan(spark, path, access=mode).chunks.count() == 361
    with pytest.raises(Exception, match="access='no'"):
        api.scan(spark, path, access="no").chunks.count()
    with pytest.raises(ValueError, match="not local"):
        base.Reader("http://x/a.tif", mode="local")
    assert api.scan_cost(spark, [path]).first()["requests"] >= 1
    head, tail, size = fetch.fetch_ends(path, 4)
    whole = (tmp_path / "a.tif").read_bytes()
    assert (head, tail, size) == (whole[:4], whole[-4:], len(whole)) and fetch.fetch_ends(path, 10**9) == (whole, whole, len(whole))


def test_blocks_in_flight():
    import threading

    now, most, lock = [0], [0], threading.Lock()

    def get(uri, o, n):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        threading.Event().wait(0.02)
        with lock:
            now[0] -= 1
        return bytes([o % 251]) * n

    access = fetch.Access({"m://": fetch.Transport(get, lambda u: 1 << 20, maxgap=0, inflight=8)})
    got = access.ranges("m://x", [(o * 1000, 10) for o in range(48)][::-1])
    assert [b[0] for b in got] == [o * 1000 % 251 for o in range(48)][::-1] and 4 <= most[0] <= 8
    one = fetch.limited(access, 1)
    most[0] = 0
    one.ranges("m://x", [(o * 1000, 10) for o in range(8)])
    assert most[0] == 1


def test_grid_mappings():
    assert crs.grid_mapping(4326)["grid_mapping_name"] == "latitude_longitude" and crs.grid_mapping(3857)["grid_mapping_name"] == "mercator"
    assert crs.grid_mapping(32733)["false_northing"] == 10000000.0 and "UTM zone 33S" in crs.grid_mapping(32733)["crs_wkt"]
    assert crs.grid_mapping(25832)["longitude_of_central_meridian"] == 9.0 and crs.grid_mapping(None, {3075: 11}) == {"grid_mapping_name": "albers_conical_equal_area"}
    assert crs.grid_mapping(None) == {}


def blosc_frame(data, typesize, blocksize, kind, flags):
    """A frame of the given stream format; split blocks where the flags do not say otherwise."""
    import struct
    import zlib

    import pyarrow as pa
    import zstandard

    pack = {1: lambda b: pa.Codec("lz4_raw").compress(b, asbytes=True), 3: zlib.compress, 4: zstandard.ZstdCompressor().compress}[kind]
    blocks = []
    for at in range(0, len(data), blocksize):
        b = data[at : at + blocksize]
        n = len(b) // typesize
        if flags & 4:
            m = n - n % 8
            bits = np.unpackbits(np.frombuffer(b, np.uint8, m * typesize).reshape(m, typesize), axis=1, bitorder="little")
            b = np.packbits(bits.T, axis=1, bitorder="little").tobytes() + b[m * typesize :]
        elif flags & 1:
            b = np.frombuffer(b, np.uint8, n * typesize).reshape(n, typesize).T.tobytes() + b[n * typesize :]
        streams = typesize if not flags & 16 and len(b) == blocksize and blocksize // typesize >= 128 else 1
        own, size = b"", len(b) // streams
        for k in range(streams):
            part = b[k * size : (k + 1) * size]
            packed = pack(part)
            packed = packed if len(packed) < size else part
            own += struct.pack("<i", len(packed)) + packed
        blocks.append(own)
    starts, at = b"", 16 + 4 * len(blocks)
    for b in blocks:
        starts += struct.pack("<I", at)
        at += len(b)
    return struct.pack("<BBBBIII", 2, 1, flags | kind << 5, typesize, len(data), blocksize, at) + starts + b"".join(blocks)


@pytest.mark.parametrize("kind", [1, 3, 4])
@pytest.mark.parametrize("flags", [0, 1, 4, 16, 17, 20])
def test_blosc_frames(kind, flags):
    from chunkloom.functions import blosc

    for n in (10, 1000, 5003):
        a = (np.arange(n) * 3 % 1001).astype("<i4").tobytes()
        assert blosc.decompress(blosc_frame(a, 4, 4096, kind, flags)) == a
    import struct

    assert blosc.decompress(struct.pack("<BBBBIII", 2, 1, 2, 4, 8, 8, 24) + b"12345678") == b"12345678"


def test_blosclz_matches():
    from chunkloom.functions import blosc

    # a run of 4 literals; a match of 3 at distance 4; a match of 9 + 10 at distance 1 (a repeated byte)
    assert blosc.blosclz(bytes([3]) + b"abcd" + bytes([1 << 5, 3]), 7) == b"abcdabc"
    assert blosc.blosclz(bytes([0]) + b"x" + bytes([7 << 5, 10, 0]), 20) == b"x" * 20


def test_stretches_change_nothing(spark):
    import random

    from chunkloom.operators import ranges

    rng = random.Random(2)
    rows = sorted({(u, rng.randrange(3000)): (u, rng.randrange(3000), rng.choice([0, 1, 5, 30, 900])) for u in "ab" for _ in range(300)}.values())
    df = spark.createDataFrame(rows, "uri string, offset long, nbytes long")
    plain = []
    for u in "ab":
        end = island = None
        for o, n in sorted((o, n) for x, o, n in rows if x == u):
            island = o if end is None or o > end + 3 else island
            end = max(end or 0, o + n)
            plain.append((u, island))
    points = df.filter("nbytes = 30").select("uri", F.col("offset").alias("p"))
    near = lambda u, o: max((p for x, p, n in rows if x == u and n == 30 and p <= o), default=None)
    for stretch in (7, 100, 10**6):
        assert sorted((r["uri"], r["island"]) for r in ranges.islands(df, 3, "uri", stretch).collect()) == sorted(plain)
        got = ranges.as_of(df, points, "uri", "offset", "p", stretch).collect()
        assert len(got) == len(rows) and all(r["p"] == near(r["uri"], r["offset"]) for r in got)
        numbered = spark.createDataFrame([("a", i, i % 7 - 3) for i in range(500)], "k string, i long, delta long")
        assert {r["i"]: r["decoded"] for r in ranges.delta_decode(numbered, "k", "i", stretch=stretch).collect()} == {i: sum(j % 7 - 3 for j in range(i + 1)) for i in range(500)}
