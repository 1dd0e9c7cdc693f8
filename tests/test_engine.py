"""Sources, codecs, saved formats and manifest operators on hand-made files."""

import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom import api, manifest, schema
from chunkloom.functions import codecs, geo
from chunkloom.operators import ranges
from chunkloom.plans import fetch, window
from chunkloom.sources import base, zips


def tiff(pages, big=False):
    """Little-endian TIFF of (tags, chunks): tags {tag: (type, values)}, chunks of bytes, by strips or tiles."""
    out = bytearray(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 0) if big else struct.pack("<HI", 42, 0)))
    link = 8 if big else 4
    codes = {3: "H", 4: "I", 12: "d", 2: "s", 16: "Q"}
    for tags, chunks, tiled in pages:
        places = []
        for c in chunks:
            places.append(len(out))
            out += c
        tags = dict(tags) | {(324 if tiled else 273): (4, places), (325 if tiled else 279): (4, [len(c) for c in chunks])}
        at = len(out)
        out[link : link + (8 if big else 4)] = struct.pack("<Q" if big else "<I", at)
        n, word = len(tags), 8 if big else 4
        extra_at, extra = at + (8 if big else 2) + n * (20 if big else 12) + word, b""
        body = struct.pack("<Q" if big else "<H", n)
        for tag, (kind, values) in sorted(tags.items()):
            raw = values.encode() + b"\0" if kind == 2 else struct.pack(f"<{len(values)}{codes[kind]}", *values)
            count = len(raw) if kind == 2 else len(values)
            body += struct.pack("<HHQ" if big else "<HHI", tag, kind, count)
            if len(raw) <= word:
                body += raw.ljust(word, b"\0")
            else:
                body += struct.pack("<Q" if big else "<I", extra_at + len(extra))
                extra += raw
        out += body
        link = len(out)
        out += b"\0" * word + extra
    return bytes(out)


def image_tags(w, h, dtype, **more):
    d = np.dtype(dtype)
    fmt = {"u": 1, "i": 2, "f": 3}[d.kind]
    return {256: (4, [w]), 257: (4, [h]), 258: (3, [d.itemsize * 8]), 277: (3, [1]), 339: (3, [fmt])} | {int(k[1:]): v for k, v in more.items()}


def tiled(a, th, tw, encode):
    h, w = a.shape
    out = []
    for y in range(0, h, th):
        for x in range(0, w, tw):
            b = np.zeros((th, tw), a.dtype)
            part = a[y : y + th, x : x + tw]
            b[: part.shape[0], : part.shape[1]] = part
            out.append(encode(b))
    return out


def grid(df, shape):
    rows = df.collect()
    out = np.full(shape, np.nan)
    for r in rows:
        out[tuple(r[f"i{d}"] for d in range(len(shape)))] = np.nan if r["value"] is None else r["value"]
    return out


@pytest.mark.parametrize("codec", ["none", "deflate", "predictor", "zstd", "bigtiff"])
def test_tiff_window(spark, tmp_path, codec):
    a = (np.arange(150 * 97) * 7 % 5003).astype("<u2").reshape(97, 150)
    more, enc = {}, bytes
    if codec in ("deflate", "bigtiff"):
        more, enc = {"t259": (3, [8])}, lambda b: zlib.compress(b.tobytes())
    elif codec == "predictor":
        more, enc = {"t259": (3, [8]), "t317": (3, [2])}, lambda b: zlib.compress(np.diff(b, axis=1, prepend=np.zeros((48, 1), b.dtype)).astype("<u2").tobytes())
    elif codec == "zstd":
        import zstandard

        more, enc = {"t259": (3, [50000])}, lambda b: zstandard.ZstdCompressor().compress(b.tobytes())
    data = tiff([(image_tags(150, 97, "<u2", t322=(4, [64]), t323=(4, [48]), **more), tiled(a, 48, 64, (lambda b: b.tobytes()) if codec == "none" else enc), True)], codec == "bigtiff")
    (tmp_path / "a.tif").write_bytes(data)
    m = api.scan(spark, str(tmp_path / "a.tif"))
    assert [r["array_path"] for r in m.arrays.collect()] == ["0/data"]
    assert np.array_equal(grid(api.read_window(m, "0/data", [(40, 97), (60, 150)]), (97, 150))[40:, 60:], a[40:, 60:])
    points = spark.createDataFrame([(96, 149), (0, 0), (200, 3)], "i0 long, i1 long")
    assert {(r["i0"], r["value"]) for r in api.read_points(m, "0/data", points).collect()} == {(96, int(a[96, 149])), (0, int(a[0, 0]))}


def test_tiff_pyramid_affine_and_geo(spark, tmp_path):
    a = np.arange(36, dtype="<f4").reshape(4, 9)
    geo_tags = {"t33550": (12, [2.0, 3.0, 0.0]), "t33922": (12, [0, 0, 0, 100000.0, 500000.0, 0]), "t34735": (3, [1, 1, 0, 2, 1025, 0, 1, 1, 3072, 0, 1, 32610]), "t42113": (2, "9999")}
    pages = [(image_tags(9, 4, "<f4", t278=(3, [2]), **geo_tags), [a[:2].tobytes(), a[2:].tobytes()], False)]
    pages += [(image_tags(w, h, "<f4", t254=(4, [1]), t278=(3, [h])), [np.full((h, w), w, "<f4").tobytes()], False) for w, h in ((5, 2), (3, 1))]
    (tmp_path / "p.tif").write_bytes(tiff(pages))
    m = api.scan(spark, str(tmp_path / "p.tif"))
    rows = {r["array_path"]: r for r in m.arrays.collect()}
    assert rows["0/data"]["map_kind"] == "affine" and rows["2/data"]["shape"] == [1, 3] and rows["1/data"]["fill_value"] == "9999.0"
    assert np.array_equal(grid(api.read_window(m, "0/data"), (4, 9)), a)
    cells = api.raster(m, "0/data", [(1, 2), (0, 2)]).orderBy("i1").collect()
    assert [(r["x"], r["y"]) for r in cells] == [(100001.0, 499995.5), (100003.0, 499995.5)]
    assert json.loads(rows["0/spatial_ref"]["attrs"])["spatial_epsg"] == 32610
    with pytest.raises(Exception, match="no level 7"):
        api.scan(spark, str(tmp_path / "p.tif"), level=7).arrays.collect()


def test_tiff_refusals(spark, tmp_path):
    (tmp_path / "j.tif").write_bytes(tiff([(image_tags(2, 2, "<u2", t259=(3, [7])), [b"12345678"], False)]))
    with pytest.raises(Exception, match="JPEG"):
        api.scan(spark, str(tmp_path / "j.tif")).arrays.collect()
    with pytest.raises(base.FormatError, match="no driver"):
        api.scan(spark, "x.grib")


def hdf5():
    """A superblock 0 file: /g/v (i4 7x11, chunks 3x4, shuffle and deflate, B-tree), /line (f8, contiguous)."""
    buf = bytearray(2048)

    def put(data, align=8):
        while len(buf) % align:
            buf.append(0)
        at = len(buf)
        buf.extend(data)
        return at

    def message(kind, body):
        body += b"\0" * (-len(body) % 8)
        return struct.pack("<HHB3x", kind, len(body), 0) + body

    def header(msgs):
        body = b"".join(msgs)
        return put(struct.pack("<BxHII4x", 1, len(msgs), 1, len(body)) + body)

    space = lambda dims: message(1, struct.pack("<BBB5x", 1, len(dims), 0) + struct.pack(f"<{len(dims)}Q", *dims))
    i4 = struct.pack("<BBBBI", 0x10, 8, 0, 0, 4) + struct.pack("<HH", 0, 32)
    f8 = struct.pack("<BBBBI", 0x11, 0x20, 63, 0, 8) + struct.pack("<HHBBBBI", 0, 64, 52, 11, 0, 52, 1023)
    attr = lambda name, text: message(12, struct.pack("<BxHHH", 1, len(name) + 1, 8, 8) + (name + "\0").encode().ljust(-(-(len(name) + 1) // 8) * 8, b"\0") + struct.pack("<BBBBI", 0x13, 0, 0, 0, len(text)) + struct.pack("<BBB5x", 1, 0, 0) + text.encode())

    v = (np.arange(77) * 3 - 50).astype("<i4").reshape(7, 11)
    entries = []
    for y in range(0, 7, 3):
        for x in range(0, 11, 4):
            if (y, x) == (3, 4):
                continue  # never written
            b = np.full((3, 4), -1, "<i4")
            part = v[y : y + 3, x : x + 4]
            b[: part.shape[0], : part.shape[1]] = part
            data = zlib.compress(np.frombuffer(b.tobytes(), np.uint8).reshape(12, 4).T.tobytes())
            entries.append((y, x, put(data), len(data)))
    node = b"TREE" + struct.pack("<BBHQQ", 1, 0, len(entries), 2**64 - 1, 2**64 - 1)
    for y, x, at, n in entries:
        node += struct.pack("<IIQQQQ", n, 0, y, x, 0, at)
    tree = put(node + struct.pack("<IIQQQ", 0, 0, 9, 12, 4))
    filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHI4x", 2, 0, 0, 1, 4) + struct.pack("<HHHHI4x", 1, 0, 0, 1, 6)
    fill = message(5, struct.pack("<BBBBi", 2, 1, 0, 1, 4) + struct.pack("<i", -9999))
    layout = message(8, struct.pack("<BBBQ3I", 3, 2, 3, tree, 3, 4, 4))
    dv = header([space([7, 11]), message(3, i4), fill, layout, message(11, filters), attr("units", "m")])
    line = np.linspace(0, 1, 5)
    dl = header([space([5]), message(3, f8), message(8, struct.pack("<BBQQ", 3, 1, put(line.tobytes()), 40))])

    def group(links):
        heap_data, offsets = bytearray(8), []
        for name, _ in links:
            offsets.append(len(heap_data))
            heap_data += name.encode() + b"\0"
            heap_data += b"\0" * (-len(heap_data) % 8)
        seg = put(bytes(heap_data))
        heap = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap_data), 2**64 - 1, seg))
        snod = put(b"SNOD" + struct.pack("<BxH", 1, len(links)) + b"".join(struct.pack("<QQII16x", o, a, 0, 0) for o, (_, a) in zip(offsets, links)))
        t = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, 2**64 - 1, 2**64 - 1) + struct.pack("<QQQ", 0, snod, 0))
        return header([message(0x11, struct.pack("<QQ", t, heap))])

    root = group([("g", group([("v", dv)])), ("line", dl)])
    head = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, 2**64 - 1, len(buf), 2**64 - 1) + struct.pack("<QQII16x", 0, root, 0, 0)
    buf[: len(head)] = head
    v[3:6, 4:8] = -9999
    return bytes(buf), v, line


def test_hdf5(spark, tmp_path):
    data, v, line = hdf5()
    (tmp_path / "a.nc").write_bytes(data)
    m = api.scan(spark, str(tmp_path / "a.nc")).persist()
    rows = {r["array_path"]: r for r in m.arrays.collect()}
    assert set(rows) == {"g/v", "line"} and json.loads(rows["g/v"]["attrs"]) == {"units": "m"} and rows["g/v"]["fill_value"] == "-9999"
    assert json.loads(rows["g/v"]["compressor"])["id"] == "zlib" and rows["line"]["map_kind"] == "affine"
    assert np.array_equal(grid(api.read_window(m, "g/v"), (7, 11)), v)
    assert np.array_equal(grid(api.read_window(m, "line", [(1, 4)]), (5,))[1:4], line[1:4])
    assert [r["array_path"] for r in api.scan(spark, str(tmp_path / "a.nc"), group="g").arrays.collect()] == ["g/v"]
    status, issues, summary = api.validate(m)
    assert summary.first()["passed"] and issues.count() == 0
    with pytest.raises(ValueError, match="missing"):
        api.validate(api.replace_prefix(m, str(tmp_path), "/nowhere"), strict=True)
    (tmp_path / "old.nc").write_bytes(b"CDF\x01" + b"\0" * 100)
    with pytest.raises(Exception, match="classic NetCDF"):
        api.scan(spark, str(tmp_path / "old.nc")).arrays.collect()


@pytest.mark.parametrize("format", ["native", "zarr_manifest", "kerchunk_json", "kerchunk_parquet"])
def test_saved_formats_round_trip(spark, tmp_path, format):
    data, v, _ = hdf5()
    (tmp_path / "a.h5").write_bytes(data)
    m = api.scan(spark, str(tmp_path / "a.h5")).persist()
    if format != "zarr_manifest":
        m = api.set_chunk(m, "g/v", 4, data=codecs.encode_chunk(np.full((3, 4), 5, "<i4"), '{"id":"zlib","level":6}', ['{"id":"shuffle","elementsize":4}']))
    path = str(tmp_path / ("m.json" if format == "kerchunk_json" else "m"))
    api.save(m, path, format, **({"record_size": 4} if format == "kerchunk_parquet" else {}))
    assert api.format_of(path) == format
    back = api.load(spark, path)
    want = v.copy()
    if format != "zarr_manifest":
        want[3:6, 4:8] = 5
    assert np.array_equal(grid(api.read_window(back, "g/v"), (7, 11)), want)
    assert {r["array_path"]: r["bytes"] for r in api.storage_size(back.chunks).collect()}["g/v"] == {r["array_path"]: r["bytes"] for r in api.storage_size(m.chunks).collect()}["g/v"]


def test_kerchunk_shapes(spark, tmp_path):
    (tmp_path / "data.bin").write_bytes(b"\x07\x08")
    doc = {"version": 1, "templates": {"u": str(tmp_path)}, "refs": {
        ".zgroup": '{"zarr_format":2}', "arr/.zarray": json.dumps({"zarr_format": 2, "shape": [5], "chunks": [1], "dtype": "|u1", "compressor": None, "fill_value": 255, "order": "C", "filters": None}),
        "arr/0": ["{{u}}/data.bin", 0, 1], "arr/1": ["{{u}}/data.bin"], "arr/2": "A", "arr/3": "base64:AA=="}}
    (tmp_path / "k.json").write_text(json.dumps(doc))
    m = api.load(spark, str(tmp_path / "k.json"))
    rows = {r["chunk_lin"]: r for r in m.chunks.collect()}
    assert rows[1]["nbytes"] == schema.WHOLE_OBJECT and bytes(rows[2]["inline"]) == b"A" and bytes(rows[3]["inline"]) == b"\0" and 4 not in rows
    with pytest.raises(Exception, match="whole-object"):
        api.read_window(m, "arr").collect()
    assert [r["value"] for r in api.read_window(m.with_(chunks=m.chunks.filter("chunk_lin != 1")), "arr").orderBy("i0").collect()] == [7, 255, 65, 0, 255]
    (tmp_path / "bad.json").write_text('{"version":2,"refs":{}}')
    with pytest.raises(ValueError, match="version 2"):
        api.load(spark, str(tmp_path / "bad.json"))


def series(spark, k, n, base_path):
    a = (np.arange(4 * n) + 1000 * k).astype("<i4").reshape(4, n)
    parts, chunks = b"", []
    for y in range(0, 4, 2):
        for x in range(0, n, 3):
            b = np.ascontiguousarray(a[y : y + 2, x : x + 3]).tobytes()
            chunks.append(("h", len(chunks), "virtual", 1, len(parts), len(b), None))
            parts += b
    f = base_path / f"s{k}.bin"
    f.write_bytes(parts)
    arrays = [("h", "<i4", [4, n], [2, 3], ["y", "time"], None, None, None, "{}", "explicit", None)]
    return manifest.from_rows(spark, [(1, str(f), None, len(parts), None)], arrays, chunks, {"title": "s"}), a


def test_concat_and_merge(spark, tmp_path):
    (m1, a1), (m2, a2) = series(spark, 0, 6, tmp_path), series(spark, 1, 9, tmp_path)
    both = api.concat([m1, m2], "time")
    assert np.array_equal(grid(api.read_window(both, "h", [(1, 3), (4, 8)]), (4, 15))[1:3, 4:8], np.hstack([a1, a2])[1:3, 4:8])
    assert both.files.count() == 2 and both.attrs == {"title": "s"}
    layers = api.merge([m1, m2], ["a", "b"])
    assert sorted(r[0] for r in layers.arrays.select("array_path").collect()) == ["a", "b"]
    assert np.array_equal(grid(api.read_window(layers, "b"), (4, 9)), a2)
    with pytest.raises(ValueError, match="no array"):
        api.concat([m1, m2], "z")
    bad, _ = series(spark, 2, 7, tmp_path)
    with pytest.raises(ValueError, match="ends inside a chunk"):
        api.concat([bad, m1], "time")
    with pytest.raises(ValueError, match="differs"):
        api.merge([m1, m2.with_(attrs={"title": "t"})], ["a", "b"])


def test_zip_members(spark, tmp_path):
    rng = np.random.default_rng(1)
    big = rng.integers(0, 4, 300_000, np.uint8).tobytes()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.xml", b"<a/>" * 50, zipfile.ZIP_DEFLATED)
        z.writestr("d/big.bin", big, zipfile.ZIP_DEFLATED)
        z.writestr("plain", b"x" * 1000, zipfile.ZIP_STORED)
    rows = zips.members(spark, [str(tmp_path / "z.zip")]).persist()
    assert {(r["name"], r["method"], r["uncompressed"]) for r in rows.collect()} == {("a.xml", 8, 200), ("d/big.bin", 8, 300_000), ("plain", 0, 1000)}
    assert {r["name"]: bytes(r["data"]) for r in zips.read_members(rows).collect()}["d/big.bin"] == big
    r = base.Reader(str(tmp_path / "z.zip"))
    entry = next(e for e in zips.central_directory(r) if e[0] == "d/big.bin")
    m = zips.Member(r, *entry[1:], span=50_000)
    assert m.read(299_000, 1000) == big[299_000:] and m.read(120_001, 77) == big[120_001:120_078] and len(m.points) > 3
    assert zips.extract(rows, str(tmp_path / "out")).count() == 3 and (tmp_path / "out/d/big.bin").read_bytes() == big


def test_jp2_tiles(spark, tmp_path):
    siz = struct.pack(">HIIIIIIIIH", 0, 150, 97, 0, 0, 64, 48, 0, 0, 1) + bytes([15, 1, 1])
    body = b"\xff\x4f" + struct.pack(">HH", 0xFF51, 2 + len(siz)) + siz
    sizes = []
    for t in range(9):
        part = b"\xff\x93" + bytes([t]) * (5 + t)
        body += struct.pack(">HHHIBB", 0xFF90, 10, t, 12 + len(part), 0, 1) + part
        sizes.append(12 + len(part))
    body += b"\xff\xd9"
    box = b"\0\0\0\x0cjP  \r\n\x87\n" + struct.pack(">I4s", 8 + len(body), b"jp2c") + body
    for name, data in (("a.jp2", box), ("a.j2k", body)):
        (tmp_path / name).write_bytes(data)
        m = api.scan(spark, str(tmp_path / name))
        assert m.array("0/data")["chunks"] == [48, 64] and m.array("0/data")["dtype"] == "<u2"
        assert [r["nbytes"] for r in m.chunks.orderBy("chunk_lin").collect()] == sizes
    with pytest.raises(Exception, match="JPEG 2000"):
        api.read_window(m, "0/data").collect()


def test_data_source(spark, tmp_path):
    data, _, _ = hdf5()
    (tmp_path / "a.h5").write_bytes(data)
    spark.dataSource.register(api.refs_data_source())
    rows = spark.read.format("array_refs").load(str(tmp_path / "a.h5"))
    assert rows.filter("kind = 'chunk'").count() == 8


CASES = [
    ([], 0, None, []), ([(5, 3)], 0, None, [(5, 3)]), ([(0, 4), (4, 4)], 0, None, [(0, 8)]), ([(0, 4), (10, 2)], 5, None, [(0, 4), (10, 2)]), ([(0, 4), (9, 2)], 5, None, [(0, 11)]),
    ([(0, 4), (4, 4), (8, 4)], 0, 8, [(0, 8), (8, 4)]), ([(0, 50), (50, 1)], 0, 10, [(0, 50), (50, 1)]), ([(8, 2), (0, 2)], 6, None, [(0, 10)]), ([(0, 10), (2, 3)], 0, None, [(0, 10)]), ([(3, 0), (3, 4)], 0, None, [(3, 4)]),
]


@pytest.mark.parametrize("given, gap, most, want", CASES)
def test_coalesce_plan(given, gap, most, want):
    assert ranges.coalesce_plan(given, gap, most) == want


def test_fetch_ranges_is_naive(tmp_path):
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 5000, np.uint8).tobytes()
    (tmp_path / "x").write_bytes(data)
    for _ in range(50):
        r = [(int(o), int(n)) for o, n in zip(rng.integers(0, 4900, 12), rng.integers(0, 100, 12))]
        assert fetch.fetch_ranges(str(tmp_path / "x"), r) == [data[o : o + n] for o, n in r]
    with pytest.raises(EOFError):
        fetch.fetch_range(str(tmp_path / "x"), 4990, 20)


def test_codecs_and_types():
    rng = np.random.default_rng(2)
    a = rng.integers(-1000, 1000, (6, 10)).astype("<i2")
    for comp, filters in ((None, None), ('{"id":"zlib"}', ['{"id":"shuffle","elementsize":2}']), ('{"id":"zstd"}', ['{"id":"tiff_predictor"}', '{"id":"fletcher32","verify":true}'])):
        assert np.array_equal(codecs.decode_chunk(codecs.encode_chunk(a, comp, filters), "<i2", [6, 10], comp, filters), a)
    p = codecs.predictor(np.array([10, 2, 255, 189], np.uint8).tobytes(), np.dtype("u1"), 4, 1, True)
    assert list(p) == [10, 12, 11, 200]
    with pytest.raises(codecs.UnsupportedCodec, match="blosc"):
        codecs.decode_chunk(b"", "<i4", [1], '{"id":"blosc"}', None)
    codecs.register_codec("twice", lambda d, c, x: d[: len(d) // 2])
    assert codecs.decode_chunk(b"\1\0\0\0\1\0\0\0", "<i4", [1], '{"id":"twice"}', None)[0] == 1
    with pytest.raises(schema.UnsupportedType, match="big-endian"):
        schema.check_dtype(">f4")
    assert np.isnan(schema.fill_of("<f4", "NaN")) and geo.parse_nodata(" nan ") != 0 and geo.parse_nodata("x") is None
    keys = geo.decode_geokeys([1, 1, 0, 3, 1024, 0, 1, 1, 3078, 34736, 1, 0, 1026, 34737, 13, 0], [500000.0], "UTM Zone 10N|")
    assert keys == {1024: 1, 3078: 500000.0, 1026: "UTM Zone 10N"}


def test_lzw_chunk():
    def encode(data):  # clear, literals, end: no table needed
        bits = "".join(f"{c:09b}" for c in [256, *data[:250], 257])
        return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")

    data = bytes(range(200))
    assert codecs.lzw(encode(data)) == data


def test_missing_and_edges(spark):
    cells = spark.createDataFrame([(y, x, float(y * 13 + x)) for y in range(7) for x in range(13)], "i0 long, i1 long, value double")
    rows = window.encode_cells(cells, "a", "<f8", [7, 13], [3, 5], compressor='{"id":"zlib"}')
    arrays = [("a", "<f8", [7, 13], [3, 5], ["y", "x"], "NaN", '{"id":"zlib"}', None, "{}", "explicit", None)]
    m = manifest.Manifest(spark.createDataFrame([], schema.FILES), spark.createDataFrame(arrays, schema.ARRAYS), rows.filter("chunk_lin != 4"))
    g = grid(api.read_window(m, "a", [(2, 7), (4, 13)]), (7, 13))
    assert g[6, 12] == 90 and np.isnan(g[4, 7]) and np.isnan(g[0, 0]) and g[2, 4] == 30
    assert api.read_window(m, "a", [(3, 3), None]).count() == 0
    assert m.chunks.filter(F.col("state") == "inline").count() == 8


def test_lookups_and_download(spark, tmp_path):
    from chunkloom.operators import listing

    data, _, _ = hdf5()
    (tmp_path / "a.h5").write_bytes(data)
    m = api.scan(spark, str(tmp_path / "a.h5")).persist()
    assert listing.exists(m, "g") and listing.is_group(m, "g") and listing.is_array(m, "g/v") and not listing.exists(m, "h")
    assert listing.dimensions(m, "g/v") == {"dim_0": 7, "dim_1": 11} and listing.attribute(m, "g/v", "units") == "m"
    assert listing.lookup(m, "g/v/.zarray")["chunks"] == [3, 4] and listing.lookup(m, "g/.zgroup") == {"zarr_format": 2} and listing.lookup(m, "x/.zgroup") is None
    assert listing.lookup(m, "g/v/0.1")["chunk_lin"] == 1 and listing.lookup(m, "g/v/1.1") is None and listing.lookup(m, "g/v/9.9") is None
    assert listing.keys(m, "line") == [".zarray", ".zattrs", "0"] and not listing.is_initialized(m, "g/v", 4)
    to = fetch.download("file://" + str(tmp_path / "a.h5"), str(tmp_path))
    assert open(to, "rb").read() == data == fetch.fetch_all(str(tmp_path / "a.h5"))


def test_http_ranges(tmp_path):
    import http.server
    import threading

    body = bytes(range(256)) * 40
    fails = [2]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if fails[0]:
                fails[0] -= 1
                self.send_error(503)
                return
            lo, hi = map(int, self.headers["Range"][6:].split("-"))
            part = body[lo : hi + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {lo}-{lo + len(part) - 1}/{len(body)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    uri = f"http://127.0.0.1:{server.server_port}/f"
    assert fetch.fetch_range(uri, 100, 50) == body[100:150] and fetch.object_size(uri) == len(body)
    assert fetch.fetch_ranges(uri, [(9000, 10), (0, 5)]) == [body[9000:9010], body[:5]]
    server.shutdown()
