"""Members of zip and tar archives as file rows, one at a time, and a row for what a limit leaves out.

An archive is opened by itself and a member is read in chunks up to its limit, whatever size it declares; rows leave the
task whenever ``FLUSH`` bytes have gathered, so a task holds one archive, one member and a few megabytes of rows.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Levels of nesting, members of an archive, unpacked to packed bytes, bytes of a member, and unpacked bytes of an archive with all in it.
CAPS = {"depth": 2, "entries": 1000, "ratio": 100, "member": 10 << 20, "bytes": 100 << 20}
FLUSH, CHUNK = 4 << 20, 1 << 16
LIMIT = "archive-limit"
_DAMAGED = (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, RuntimeError, NotImplementedError, ValueError, zlib.error)
_SCHEMA = pa.schema([("path", pa.string()), ("content", pa.string()), ("size", pa.int64()), ("error", pa.string())])


def is_archive(data: bytes) -> bool:
    return data[:4] == b"PK\x03\x04" or data[:2] == b"\x1f\x8b" or data[257:262] == b"ustar"


class _Reader:
    """Members of one file's archive and of those inside it, under common limits."""

    def __init__(self, caps: dict):
        self.caps, self.unpacked = caps, 0

    def read(self, f, packed: int | None) -> tuple[bytes | None, str | None]:
        """The content of a member, or which limit it passes."""
        parts, size = [], 0
        while chunk := f.read(CHUNK):
            size += len(chunk)
            self.unpacked += len(chunk)
            if size > self.caps["member"]:
                return None, f"{LIMIT}: member over {self.caps['member']} bytes"
            if packed is not None and size > self.caps["ratio"] * max(packed, 1) and size > CHUNK:
                return None, f"{LIMIT}: unpacks over {self.caps['ratio']} times"
            if self.unpacked > self.caps["bytes"]:
                return None, f"{LIMIT}: archive over {self.caps['bytes']} bytes"
            parts.append(chunk)
        return b"".join(parts), None

    def members(self, label: str, data: bytes, depth: int) -> Iterator[tuple[str, bytes | None, str | None]]:
        """(path, content, error) of the members of an archive, nested ones behind the archive that holds them."""
        seen = 0
        for name, opened, packed, left in self._zip(data) if data[:4] == b"PK\x03\x04" else self._tar(data):
            if seen >= self.caps["entries"]:
                more = f"{left} members" if left is not None else "all further members"
                yield label, None, f"{LIMIT}: {more} over {self.caps['entries']} left out"
                return
            seen += 1
            path = f"{label}!{name}"
            try:
                with opened() as f:
                    content, error = self.read(f, packed)
            except _DAMAGED as e:
                content, error = None, type(e).__name__
            yield path, content, error
            if self.unpacked > self.caps["bytes"]:
                return
            if content is not None and is_archive(content):
                if depth >= self.caps["depth"]:
                    yield path, None, f"{LIMIT}: nested deeper than {self.caps['depth']}"
                else:
                    yield from self.safe(path, content, depth + 1)

    def safe(self, label: str, data: bytes, depth: int) -> Iterator[tuple[str, bytes | None, str | None]]:
        try:
            yield from self.members(label, data, depth)
        except _DAMAGED as e:
            yield label, None, type(e).__name__

    @staticmethod
    def _zip(data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            for n, info in enumerate(infos):
                yield info.filename, lambda i=info: z.open(i), info.compress_size, len(infos) - n

    @staticmethod
    def _tar(data: bytes):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, lambda m=m: t.extractfile(m), None, None


def expand_archives(files: DataFrame, caps: dict | None = None) -> DataFrame:
    """files(path, bytes) to (path, content, size, error): one row per member with an archive!member path.

    Content is UTF-8 with replacement. ``error`` is null, the kind of damage, or begins with ``archive-limit``: one row for each member over
    a limit and one for the members that an archive has beyond its limit. Files that are no archives, and nulls, give no row.
    """
    caps = {**CAPS, **(caps or {})}

    def work(batches):
        out, weight = [], 0
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("bytes")):
                path, data = path.as_py(), data.as_py() or b""
                if not is_archive(data):
                    continue
                for name, content, error in _Reader(caps).safe(path, data, 1):
                    size = len(data) if name == path else 0 if content is None else len(content)
                    out.append((name, None if content is None else content.decode("utf-8", "replace"), size, error))
                    weight += 64 + (len(content) if content else 0)
                    if weight >= FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
                        out, weight = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    return files.select("path", "bytes").mapInArrow(work, "path string, content string, size long, error string")


def pack_archives(files: DataFrame) -> DataFrame:
    """files(path, content) to (path.zip, bytes): one stored member ``content`` and a nested archive ``inner`` with the same."""

    def zipped(members: dict[str, bytes]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, data in members.items():
                z.writestr(zipfile.ZipInfo(name), data)
        return out.getvalue()

    def work(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                data = (content.as_py() or "").encode()
                whole = zipped({"content": data, "inner": zipped({"content": data})})
                yield pa.RecordBatch.from_arrays([pa.array([f"{path.as_py()}.zip"]), pa.array([whole], pa.binary())], ["path", "bytes"])

    return files.select("path", "content").mapInArrow(work, "path string, bytes binary")
