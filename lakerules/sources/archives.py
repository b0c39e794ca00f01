"""Archive members and archive packing as Spark jobs.

* :func:`list_members` turns ``(archive, content)`` rows -- e.g. from
  ``spark.read.format("binaryFile")`` -- into one row per member, in ``mapInPandas`` tasks. A
  reader chain picks the reader by extension (first that accepts wins; a reader that fails is
  skipped); an unreadable archive yields one row with ``error`` set and no member.
* :func:`pack_groups` builds one archive per group from ``(archive, member, content)`` rows:
  rows are repartitioned by archive and sorted within partitions, and each task streams its
  archives one after another, so no group is gathered by ``groupBy``.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER_SCHEMA = "archive string, member string, size bigint, mtime timestamp, pos bigint, error string"
PACK_SCHEMA = "archive string, n_members bigint, content binary"

Reader = Callable[[bytes], list[tuple[str, int, tuple]]]


def _date_tuple_ts(t) -> datetime | None:
    """Timestamp of a (y, m, d, h, mi, s) tuple with the same clamping/rollover as the column form."""
    if not t:
        return None
    y = max(1970, min(t[0], 9999))
    m = max(1, min(t[1] if len(t) > 1 else 1, 12))
    d = t[2] if len(t) > 2 else 1
    h = max(0, min(t[3] if len(t) > 3 else 0, 23))
    mi = max(0, min(t[4] if len(t) > 4 else 0, 59))
    s = max(0, min(t[5] if len(t) > 5 else 0, 59))
    day = (datetime(y, m, 1) - datetime(1970, 1, 1)).days + d - 1
    if day < 0:
        day %= 365
    if day > 2932896:
        return None
    return datetime.fromtimestamp(day * 86400 + h * 3600 + mi * 60 + s, tz=timezone.utc).replace(tzinfo=None)


def read_zip(data: bytes) -> list[tuple[str, int, tuple]]:
    """Members of a zip: names decoded as UTF-8 first, the format default when that fails."""
    try:
        zf = zipfile.ZipFile(io.BytesIO(data), "r", metadata_encoding="utf-8")
    except (TypeError, UnicodeDecodeError):
        zf = zipfile.ZipFile(io.BytesIO(data), "r")
    with zf:
        return [(i.filename, i.file_size, i.date_time) for i in zf.infolist()]


def read_tar(data: bytes) -> list[tuple[str, int, tuple]]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tf:
        out = []
        for m in tf.getmembers():
            name = m.name + ("/" if m.isdir() else "")
            t = datetime.fromtimestamp(m.mtime, tz=timezone.utc).timetuple()[:6]
            out.append((name, m.size if m.isfile() else 0, t))
        return out


def default_readers() -> list[tuple[str, Reader]]:
    return [(".zip", read_zip)]


def list_members(archives: DataFrame, readers: list[tuple[str, Reader]] | None = None,
                 path_col: str = "archive", content_col: str = "content") -> DataFrame:
    """``archive, member, size, mtime, pos, error`` for every archive row."""
    chain = list(readers or default_readers())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf[path_col], pdf[content_col]):
                members, error = None, None
                for ext, reader in chain:
                    if not str(path).lower().endswith(ext):
                        continue
                    try:
                        members = reader(bytes(content))
                        break
                    except Exception as e:  # this reader cannot read it: try the next one
                        error = f"{type(e).__name__}: {e}"
                if members is None:
                    rows.append((path, None, None, None, None, error or "no reader"))
                    continue
                for pos, (name, size, t) in enumerate(members):
                    rows.append((path, name, int(size), _date_tuple_ts(t), pos, None))
            yield pd.DataFrame(rows, columns=["archive", "member", "size", "mtime", "pos", "error"])

    return archives.select(F.col(path_col), F.col(content_col)).mapInPandas(run, MEMBER_SCHEMA)


def read_archives(spark: SparkSession, pattern: str, readers=None) -> DataFrame:
    """List members of archive files on storage (content is read inside the tasks)."""
    # same path form as ``inventory.scan_files`` (local 'file:' scheme dropped) so plans join
    files = (spark.read.format("binaryFile").load(pattern)
             .select(F.regexp_replace("path", r"^file:", "").alias("archive"), "content"))
    return list_members(files, readers)


def _zip_bytes(items: list[tuple[str, bytes]]) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, data in items:
            if name.endswith("/"):
                zf.writestr(name, b"")
            else:
                zf.writestr(name, data or b"")
    return buf.getvalue()


def _tar_bytes(items: list[tuple[str, bytes]]) -> bytes:
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as tf:
        for name, data in items:
            info = tarfile.TarInfo(name.rstrip("/"))
            if name.endswith("/"):
                info.type = tarfile.DIRTYPE
                tf.addfile(info)
            else:
                info.size = len(data or b"")
                tf.addfile(info, io.BytesIO(data or b""))
    return buf.getvalue()


PACKERS = {"zip": _zip_bytes, "tar": _tar_bytes}


def pack_groups(rows: DataFrame, fmt: str = "zip") -> DataFrame:
    """One archive per ``archive`` value from ``archive, member, content`` rows (content may be
    NULL for directory entries ending in '/')."""
    packer = PACKERS[fmt]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, items, out = None, [], []
        for pdf in batches:
            for a, m, c in zip(pdf["archive"], pdf["member"], pdf["content"]):
                if a != current and current is not None:
                    out.append((current, len(items), packer(items)))
                    items = []
                current = a
                items.append((m, None if c is None else bytes(c)))
            if len(out) >= 16:
                yield pd.DataFrame(out, columns=["archive", "n_members", "content"])
                out = []
        if current is not None:
            out.append((current, len(items), packer(items)))
        if out:
            yield pd.DataFrame(out, columns=["archive", "n_members", "content"])

    return (rows.select("archive", "member", "content").repartition("archive")
            .sortWithinPartitions("archive", "member").mapInPandas(run, PACK_SCHEMA))
