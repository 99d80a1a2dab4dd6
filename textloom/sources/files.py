"""Small text files by the Hadoop file system, so that any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a file or folder matches the pattern."""
    where, system = _place(spark, pattern)
    found = system.globStatus(where)
    return found is not None and len(found) > 0


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A whole text file, written anew; folders are made."""
    where, system = _place(spark, path)
    out = system.create(where, True)
    try:
        out.write(text.encode("utf-8"))
    finally:
        out.close()


class Appended:
    """A text file to which lines are added, through one open stream: what it held before is copied once.

    What was added is handed on to the store with each ``add``; stores that show a file only once it is whole do so at ``close``.
    """

    def __init__(self, spark: SparkSession, path: str):
        before = read_text(spark, path) if exists(spark, path) else ""
        where, system = _place(spark, path)
        self.out = system.create(where, True)
        self.add(before)

    def add(self, text: str) -> None:
        self.out.write(text.encode("utf-8"))
        self.out.hflush()

    def close(self) -> None:
        self.out.close()


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The data files that match a pattern or stand in folders that do, in the order of their names; none is opened."""
    where, system = _place(spark, pattern)
    out, open_ = [], list(system.globStatus(where) or [])
    while open_:
        found = open_.pop()
        if found.getPath().getName().startswith(("_", ".")):
            continue
        if found.isDirectory():
            open_ += list(system.listStatus(found.getPath()))
        else:
            out.append(found.getPath().toString())
    return sorted(out)


def read_text(spark: SparkSession, path: str) -> str:
    """A whole text file; a missing one is an error."""
    where, system = _place(spark, path)
    source = system.open(where)
    try:
        return bytes(source.readAllBytes()).decode("utf-8")
    finally:
        source.close()


def move(spark: SparkSession, path: str, to: str) -> None:
    """The file or folder to another place of the same store, whose folders are made; it must not be taken."""
    (where, system), (place, _) = _place(spark, path), _place(spark, to)
    system.mkdirs(place.getParent())
    if not system.rename(where, place):
        raise OSError(f"can't move {path} to {to}")


def delete(spark: SparkSession, path: str) -> None:
    """Without the file or folder, if it is there."""
    where, system = _place(spark, path)
    system.delete(where, True)
