"""Zip archives: members as rows, and members' bytes read, by access points where deflated."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import FormatError, Reader


def central_directory(r: Reader) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, method, compressed, uncompressed, header offset) of each member."""
    n = min(r.size, 65536 + 22)
    tail = r.at(r.size - n, n)
    k = tail.rfind(b"PK\5\6")
    if k < 0:
        raise FormatError(f"{r.uri}: no end of a central directory")
    disk, cd_disk, here, total, size, at = struct.unpack_from("<HHHHII", tail, k + 4)
    if k >= 20 and tail[k - 20 : k - 16] == b"PK\6\7":
        (where,) = struct.unpack_from("<Q", tail, k - 12)
        rec = r.at(where, 56)
        disk, cd_disk, here, total, size, at = struct.unpack_from("<IIQQQQ", rec, 16)
    if disk or cd_disk or here != total:
        raise FormatError(f"{r.uri}: archives of several disks are not supported")
    data, p = r.at(at, size), 0
    for _ in range(total):
        if data[p : p + 4] != b"PK\1\2":
            raise FormatError(f"{r.uri}: the central directory is broken")
        flags, method = struct.unpack_from("<HH", data, p + 8)
        comp, full = struct.unpack_from("<II", data, p + 20)
        ln, le, lc = struct.unpack_from("<HHH", data, p + 28)
        (head,) = struct.unpack_from("<I", data, p + 42)
        name = data[p + 46 : p + 46 + ln].decode("utf-8" if flags & 2048 else "cp437")
        extra, q = data[p + 46 + ln : p + 46 + ln + le], 0
        while q + 4 <= len(extra):
            kind, size_ = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                v = list(struct.unpack_from(f"<{size_ // 8}Q", extra, q + 4))
                full = v.pop(0) if full == 0xFFFFFFFF else full
                comp = v.pop(0) if comp == 0xFFFFFFFF else comp
                head = v.pop(0) if head == 0xFFFFFFFF else head
            q += 4 + size_
        yield name, method, comp, full, head
        p += 46 + ln + le + lc


def data_offset(r: Reader, header: int) -> int:
    head = r.at(header, 30)
    if head[:4] != b"PK\3\4":
        raise FormatError(f"{r.uri}: no member at {header}")
    ln, le = struct.unpack_from("<HH", head, 26)
    return header + 30 + ln + le


class Member:
    """One member, read at any offset. A deflated one keeps copies of the inflating state every
    `span` bytes, so a read begins at the nearest one at or before it."""

    def __init__(self, r: Reader, method: int, comp: int, full: int, header: int, span: int = 4 << 20):
        if method not in (0, 8):
            raise FormatError(f"{r.uri}: compression method {method} is not supported")
        self.r, self.method, self.comp, self.full, self.span = r, method, comp, full, span
        self.start = data_offset(r, header)
        self.points: list[tuple[int, int, object]] = [(0, 0, zlib.decompressobj(-15))]  # out, in, state

    def read(self, offset: int = 0, n: int | None = None) -> bytes:
        n = self.full - offset if n is None else n
        if offset < 0 or n < 0 or offset + n > self.full:
            raise EOFError(f"{self.r.uri}: {n} bytes at {offset} of a member of {self.full}")
        if self.method == 0:
            return self.r.at(self.start + offset, n)
        out, pos, state = max((p for p in self.points if p[0] <= offset), key=lambda p: p[0])
        state, got = state.copy(), []
        while out < offset + n:
            chunk = self.r.at(self.start + pos, min(64 << 10, max(512, self.span // 16), self.comp - pos))
            data = state.decompress(chunk)
            pos += len(chunk)
            if data and out < offset + n and out + len(data) > offset:
                got.append(data[max(0, offset - out) : offset + n - out])
            out += len(data)
            if out - self.points[-1][0] >= self.span:
                self.points.append((out, pos, state.copy()))
            if not chunk and not data:
                raise EOFError(f"{self.r.uri}: the member ends early")
        return b"".join(got)


    def read_many(self, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
        """The bytes of many ranges (offset, n), ascending and apart, in one pass over the member."""
        end = 0
        for offset, n in ranges:
            if offset < end or n < 0:
                raise ValueError("ranges must ascend and not overlap")
            end = offset + n
        if end > self.full:
            raise EOFError(f"{self.r.uri}: a range reaches past the member's {self.full} bytes")
        if self.method == 0:
            for offset, n in ranges:
                yield self.r.at(self.start + offset, n)
            return
        state, pos, out, held = zlib.decompressobj(-15), 0, 0, b""  # held: what was inflated from `out` on
        for offset, n in ranges:
            while out + len(held) < offset + n:
                if out + len(held) <= offset:
                    out, held = out + len(held), b""
                chunk = self.r.at(self.start + pos, min(64 << 10, self.comp - pos))
                more = state.decompress(chunk)
                pos += len(chunk)
                if not chunk and not more:
                    raise EOFError(f"{self.r.uri}: the member ends early")
                held += more
            cut = offset - out
            yield held[cut : cut + n]
            out, held = offset + n, held[cut + n :]


def members(spark: SparkSession, uris: list[str]) -> DataFrame:
    """uri, name, method, compressed, uncompressed, header_offset and data_offset of each member."""
    from ..plans import fetch

    access = fetch.current()
    names = ["uri", "name", "method", "compressed", "uncompressed", "header_offset", "data_offset"]
    types = [pa.string(), pa.string(), *[pa.int64()] * 5]

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                r = Reader(uri, access=access)
                rows = [(uri, *m, data_offset(r, m[4])) for m in central_directory(r)]
                cols = zip(*rows) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)

    src = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(max(1, len(uris)), "uri")
    return src.mapInArrow(run, "uri string, name string, method long, compressed long, uncompressed long, header_offset long, data_offset long")


def read_members(rows: DataFrame) -> DataFrame:
    """uri, name and data of member rows (from `members`, filtered), a stream per member."""
    from ..plans import fetch

    access = fetch.current()

    def run(batches):
        readers: dict[str, Reader] = {}
        for b in batches:
            for m in b.to_pylist():
                r = readers.get(m["uri"]) or Reader(m["uri"], access=access)
                readers = {m["uri"]: r}
                data = Member(r, m["method"], m["compressed"], m["uncompressed"], m["header_offset"]).read()
                yield pa.RecordBatch.from_arrays([pa.array([m["uri"]]), pa.array([m["name"]]), pa.array([data], pa.binary())], names=["uri", "name", "data"])

    return rows.mapInArrow(run, "uri string, name string, data binary")


def safe_name(name: str) -> str:
    """A member's name as a path below a folder; one that leads elsewhere is refused."""
    parts = name.replace("\\", "/").split("/")
    if not name or "\0" in name or parts[0] == "" or ":" in parts[0] or ".." in parts:
        raise FormatError(f"the member {name!r} would be written outside of its folder")
    return "/".join(p for p in parts if p not in ("", "."))


def extract(rows: DataFrame, directory: str) -> DataFrame:
    """Members written below a directory that executors share, under a temporary name until whole.
    Folder entries are skipped; a name that leads out of the directory is an error."""
    import os

    from ..plans import fetch

    access = fetch.current()

    def run(batches):
        for b in batches:
            for m in b.to_pylist():
                if m["name"].endswith("/"):
                    continue
                to = os.path.join(directory, safe_name(m["name"]))
                r = Reader(m["uri"], access=access)
                member = Member(r, m["method"], m["compressed"], m["uncompressed"], m["header_offset"])
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(to + ".part", "wb") as f:
                    for at in range(0, member.full, 4 << 20):
                        f.write(member.read(at, min(4 << 20, member.full - at)))
                os.replace(to + ".part", to)
                yield pa.RecordBatch.from_arrays([pa.array([m["name"]]), pa.array([member.full], pa.int64())], names=["name", "size"])

    return rows.mapInArrow(run, "name string, size long")


def inflate_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """uri, name, offset, n and data of byte ranges (uri, name, offset, n) of member rows. A member's
    ranges are read in one pass, in order of their offsets; overlapping ones in further passes."""
    from ..plans import fetch

    access = fetch.current()
    asked = ranges.select("uri", "name", F.col("offset").cast("long").alias("offset"), F.col("n").cast("long").alias("n"))
    own = rows.select("uri", "name", "method", "compressed", "uncompressed", "header_offset").join(asked, ["uri", "name"])
    dealt = own.repartition("uri", "name").sortWithinPartitions("uri", "name", "offset", "n")
    kind = pa.schema([("uri", pa.string()), ("name", pa.string()), ("offset", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def run(batches):
        for b in batches:
            todo = b.to_pylist()
            while todo:
                m, end, now, later = todo[0], 0, [], []
                for r in todo:
                    same = (r["uri"], r["name"]) == (m["uri"], m["name"])
                    if same and r["offset"] >= end:
                        now.append(r)
                        end = r["offset"] + r["n"]
                    else:
                        later.append(r)
                member = Member(Reader(m["uri"], access=access), m["method"], m["compressed"], m["uncompressed"], m["header_offset"])
                for r, data in zip(now, member.read_many([(r["offset"], r["n"]) for r in now])):
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("uri", "name", "offset", "n")} | {"data": data}], schema=kind)
                todo = later

    return dealt.mapInArrow(run, "uri string, name string, offset long, n long, data binary")
