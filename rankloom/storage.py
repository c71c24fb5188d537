"""Small files and existence checks on whatever file system a path names. With a session that is Hadoop's file system,
the same that Spark reads and writes; without one, the local disk."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import SparkSession


def join(root: str | Path, *parts: str) -> str:
    """A path below `root`; an address such as s3a://bucket/x stays one."""
    return "/".join([str(root).rstrip("/") or "/", *parts])


def tidy(path: str | Path) -> str | Path:
    """An address as text, anything else as a local path."""
    return str(path) if "://" in str(path) else Path(path)


def _hadoop(path: str | Path):
    """The file system and the path in it; none for the local disk, whose files may be edited by hand and so are read
    without Hadoop's checksums."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None, None
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return (None, None) if fs.getUri().getScheme() == "file" else (fs, p)


def _local(path: str | Path) -> Path:
    return Path(re.sub("^file:/*", "/", str(path)))


def exists(path: str | Path) -> bool:
    fs, p = _hadoop(path)
    return _local(path).exists() if fs is None else fs.exists(p)


def complete(path: str | Path) -> bool:
    """Whether a table was written there to its end."""
    return exists(join(path, "_SUCCESS"))


def read_bytes(path: str | Path) -> bytes:
    fs, p = _hadoop(path)
    if fs is None:
        return _local(path).read_bytes()
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def read_text(path: str | Path) -> str:
    return read_bytes(path).decode()


def write_text(path: str | Path, text: str) -> None:
    """Written under another name first, so a reader never sees half a file."""
    fs, p = _hadoop(path)
    if fs is None:
        _local(path).parent.mkdir(parents=True, exist_ok=True)
        part = _local(f"{path}.part")
        part.write_text(text)
        part.replace(_local(path))
        return
    part = _hadoop(f"{path}.part")[1]
    out = fs.create(part, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    fs.delete(p, False)
    fs.rename(part, p)


def children(path: str | Path) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    fs, p = _hadoop(path)
    if fs is None:
        return sorted(x.name for x in _local(path).iterdir()) if _local(path).is_dir() else []
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def files(root: str | Path, suffix: str = "") -> list[str]:
    """Paths of all files below `root`, relative to it, in the order of their parts."""
    fs, p = _hadoop(root)
    if fs is None:
        found = [x.relative_to(_local(root)).as_posix() for x in _local(root).rglob("*") if x.is_file()]
    elif not fs.exists(p):
        found = []
    else:
        base, every, found = p.toUri().getPath() if p.isAbsolute() else fs.makeQualified(p).toUri().getPath(), fs.listFiles(p, True), []
        while every.hasNext():
            found.append(every.next().getPath().toUri().getPath()[len(base.rstrip("/")) + 1 :])
    return sorted((f for f in found if f.endswith(suffix)), key=lambda f: f.split("/"))
