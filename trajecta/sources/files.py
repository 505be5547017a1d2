"""Small files on whatever file system Spark reaches, by Hadoop's interface, and file systems for readers in Python."""

from __future__ import annotations

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import SparkSession


def file_system(path: str) -> tuple[FileSystem, str]:
    """pyarrow's file system of a path or URI, for data sources, whose readers run in Python."""
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write to a name beside the path and rename, so readers see the whole file or none."""
    where, fs = _at(spark, path)
    aside, _ = _at(spark, path + ".part")
    out = fs.create(aside, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(where, False)
    if not fs.rename(aside, where):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file, None where there is none."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file; False where another writer was first. A reader may see it before its text is there."""
    where, fs = _at(spark, path)
    if fs.exists(where):
        return False
    try:
        out = fs.create(where, False)
    except Exception as e:
        if "exist" in str(e):
            return False
        raise
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, none where there is no folder."""
    where, fs = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
