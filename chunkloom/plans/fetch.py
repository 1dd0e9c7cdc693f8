"""Byte ranges of files, on executors: local paths, http(s), object stores, and what users add.

Transports and access checks are registered on the driver. A task gets them as an `Access`, a
snapshot that travels with the task's function, so that what may be read, and how, is the same
everywhere. Ranges of a file are read in blocks, several in flight where the transport likes
that, never more than INFLIGHT_BYTES at once.
"""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from ..operators.ranges import coalesce_plan

#: Bytes that one task has in flight at most (one longer block excepted).
INFLIGHT_BYTES = 256 << 20


@dataclass(frozen=True)
class Transport:
    """How objects below a prefix are read. fetch(uri, offset, nbytes) gives bytes, size(uri) an
    int or None where there is no object."""

    fetch: Callable[[str, int, int], bytes]
    size: Callable[[str], int | None]
    maxgap: int = 64 << 10  # ranges so close are read together
    maxblock: int = 16 << 20
    inflight: int = 1  # blocks that are asked for at once


def _path(uri: str) -> str:
    return uri[len("file://") :] if uri.startswith("file://") else uri[5:] if uri.startswith("file:") else uri


def _local(uri: str, offset: int, nbytes: int) -> bytes:
    with open(_path(uri), "rb") as f:
        f.seek(offset)
        data = f.read(nbytes)
    if len(data) != nbytes:
        raise EOFError(f"{uri}: {nbytes} bytes at {offset} reach past the end")
    return data


def _local_size(uri: str) -> int | None:
    try:
        return os.path.getsize(_path(uri))
    except OSError:
        return None


def _http(uri: str, headers: dict, retries: int = 3):
    """GET with growing waits after server errors and lost connections; never after a client error."""
    for k in range(retries + 1):
        try:
            return urllib.request.urlopen(urllib.request.Request(uri, headers=headers), timeout=60)
        except urllib.error.HTTPError as e:
            if e.code < 500 or k == retries:
                raise
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            if k == retries:
                raise
        time.sleep(min(8.0, 0.25 * 2**k))


def http_transport(headers: dict[str, str] | None = None, inflight: int = 32) -> Transport:
    """Ranges over http(s), with headers of one's own (a token, say) on every request."""
    own = dict(headers or {})

    def fetch(uri: str, offset: int, nbytes: int) -> bytes:
        with _http(uri, own | {"Range": f"bytes={offset}-{offset + nbytes - 1}"}) as r:
            data = r.read()
            if r.status == 200:  # the server sent the whole object
                data = data[offset : offset + nbytes]
        if len(data) != nbytes:
            raise EOFError(f"{uri}: got {len(data)} of {nbytes} bytes at {offset}")
        return data

    def size(uri: str) -> int | None:
        try:
            with _http(uri, own | {"Range": "bytes=0-0"}) as r:
                total = r.headers.get("Content-Range", "").rpartition("/")[2]
                return int(total) if total.isdigit() else int(r.headers.get("Content-Length") or 0) or None
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            return None

    return Transport(fetch, size, inflight=inflight)


_OPEN: dict[tuple, object] = {}  # file systems that this process has opened


def object_transport(inflight: int = 16, **options) -> Transport:
    """Whatever pyarrow opens by uri. With options, an S3 file system made of them: region,
    endpoint_override, anonymous, access_key, secret_key, session_token, role_arn and so on;
    without, pyarrow's own chain of credentials."""

    def opened(uri: str):
        import pyarrow.fs as pafs

        if not options:
            return pafs.FileSystem.from_uri(uri)
        key = tuple(sorted(options.items()))
        if key not in _OPEN:
            _OPEN[key] = pafs.S3FileSystem(**options)
        return _OPEN[key], uri.partition("://")[2]

    def fetch(uri: str, offset: int, nbytes: int) -> bytes:
        fs, path = opened(uri)
        with fs.open_input_file(path) as f:
            data = f.read_at(nbytes, offset)
        if len(data) != nbytes:
            raise EOFError(f"{uri}: {nbytes} bytes at {offset} reach past the end")
        return data

    def size(uri: str) -> int | None:
        import pyarrow.fs as pafs

        fs, path = opened(uri)
        info = fs.get_file_info(path)
        return info.size if info.type == pafs.FileType.File else None

    return Transport(fetch, size, inflight=inflight)


@dataclass(frozen=True)
class Access:
    """Transports by prefix (the longest that fits is taken) and checks that every uri must pass."""

    transports: dict[str, Transport] = field(default_factory=dict)
    checks: tuple[Callable[[str], bool], ...] = ()

    def resolve(self, uri: str) -> Transport:
        for check in self.checks:
            if not check(uri):
                raise PermissionError(f"{uri} may not be read")
        fits = [p for p in self.transports if uri.startswith(p)]
        if "://" in uri and not uri.startswith("file://") and not any(fits):
            raise ValueError(f"{uri}: no transport for {uri.partition('://')[0]}://; there are {', '.join(sorted(p for p in self.transports if p))}")
        return self.transports[max(fits, key=len)]

    def size(self, uri: str) -> int | None:
        return self.resolve(uri).size(uri)

    def range(self, uri: str, offset: int, nbytes: int) -> bytes:
        transport = self.resolve(uri)
        return transport.fetch(uri, offset, nbytes) if nbytes else b""

    def blocks(self, uri: str, plan: list[tuple[int, int]]) -> Iterator[bytes]:
        """The blocks (offset, nbytes) in order, as many in flight as transport and memory allow."""
        t = self.resolve(uri)
        if t.inflight <= 1 or len(plan) <= 1:
            for offset, nbytes in plan:
                yield t.fetch(uri, offset, nbytes)
            return
        with ThreadPoolExecutor(min(t.inflight, len(plan))) as pool:
            at = 0
            while at < len(plan):
                end, held = at, 0
                while end < len(plan) and end - at < t.inflight and (end == at or held + plan[end][1] <= INFLIGHT_BYTES):
                    held += plan[end][1]
                    end += 1
                yield from pool.map(lambda b: t.fetch(uri, *b), plan[at:end])
                at = end

    def ranges(self, uri: str, ranges: list[tuple[int, int]]) -> list[bytes]:
        """The ranges' bytes in the order asked, read in as few blocks as the transport likes."""
        t = self.resolve(uri)
        out: list[bytes | None] = [b"" if n == 0 else None for _, n in ranges]
        todo = sorted((o, n, i) for i, (o, n) in enumerate(ranges) if n)
        plan = coalesce_plan([(o, n) for o, n, _ in todo], t.maxgap, t.maxblock)
        k = 0
        for (start, size), block in zip(plan, self.blocks(uri, plan)):
            while k < len(todo) and todo[k][0] + todo[k][1] <= start + size and todo[k][0] >= start:
                o, n, i = todo[k]
                out[i] = block[o - start : o - start + n]
                k += 1
        return out

    def ends(self, uri: str, nbytes: int) -> tuple[bytes, bytes, int]:
        """The first and the last nbytes of an object (fewer of a smaller one), and its size."""
        size = self.size(uri)
        if size is None:
            raise FileNotFoundError(uri)
        n = min(nbytes, size)
        if 2 * n >= size:
            whole = self.range(uri, 0, size)
            return whole[:n], whole[size - n :], size
        head, tail = self.blocks(uri, [(0, n), (size - n, n)])
        return head, tail, size

    def all(self, uri: str) -> bytes:
        size = self.size(uri)
        if size is None:
            raise FileNotFoundError(uri)
        block = self.resolve(uri).maxblock
        return b"".join(self.blocks(uri, [(at, min(block, size - at)) for at in range(0, size, block)]))


#: What is registered in this process; tasks get a snapshot.
_TRANSPORTS: dict[str, Transport] = {"": Transport(_local, _local_size, maxblock=256 << 20)}
_TRANSPORTS |= {s: http_transport() for s in ("http://", "https://")} | {s: object_transport() for s in ("s3://", "gs://", "hdfs://", "viewfs://")}
_CHECKS: list[Callable[[str], bool]] = []


def current() -> Access:
    """A snapshot for a task's function; what is registered later does not change it."""
    return Access(dict(_TRANSPORTS), tuple(_CHECKS))


def register_transport(prefix: str, fetch: Callable | Transport, size: Callable | None = None, maxgap: int = 64 << 10, maxblock: int = 16 << 20, inflight: int = 1) -> None:
    """Objects whose uri begins with the prefix are read by the transport; a longer prefix wins."""
    _TRANSPORTS[prefix] = fetch if isinstance(fetch, Transport) else Transport(fetch, size, maxgap, maxblock, inflight)


def authorize(check: Callable[[str], bool]) -> None:
    """Every uri must pass the check before it is read, on the driver and in tasks."""
    _CHECKS.append(check)


def limited(access: Access, inflight: int) -> Access:
    """The access with no more blocks in flight than that: tasks side by side share what a server allows."""
    return replace(access, transports={p: replace(t, inflight=max(1, min(t.inflight, inflight))) for p, t in access.transports.items()})


def fetch_range(uri: str, offset: int, nbytes: int) -> bytes:
    return current().range(uri, offset, nbytes)


def object_size(uri: str) -> int | None:
    return current().size(uri)


def fetch_ranges(uri: str, ranges: list[tuple[int, int]]) -> list[bytes]:
    return current().ranges(uri, ranges)


def fetch_ends(uri: str, nbytes: int) -> tuple[bytes, bytes, int]:
    return current().ends(uri, nbytes)


def fetch_all(uri: str) -> bytes:
    return current().all(uri)


def download(uri: str, directory: str, block: int = 64 << 20) -> str:
    """A file copied to a directory in blocks, under a temporary name until it is whole."""
    access = current()
    size = access.size(uri)
    if size is None:
        raise FileNotFoundError(uri)
    to = os.path.join(directory, f"{zlib.crc32(uri.encode()):08x}-{uri.rstrip('/').rsplit('/', 1)[-1]}")
    with open(to + ".part", "wb") as f:
        for data in access.blocks(uri, [(at, min(block, size - at)) for at in range(0, size, block)]):
            f.write(data)
    os.replace(to + ".part", to)
    return to
