"""A folder on whatever file system Spark is configured for, and how its parquet files are told apart."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


# Writer options: a third of a table of facts are keys and file names, which this codec keeps smaller than the default one.
COMPACT = {"compression": "zstd"}


def bloom_filters(columns: Iterable[str]) -> dict[str, str]:
    """Writer options for columns that are looked up by value.

    Rows of one key lie in a file among many whose least and greatest keys enclose it; a bloom filter of each row
    group lets a look-up skip those that do not hold it. Columns that a file keeps as a dictionary need none and get none.
    """
    return {"parquet.bloom.filter.adaptive.enabled": "true"} | {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}


class Folder:
    """Small control files; data goes through DataFrame readers and writers."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def names(self, suffix: str = "") -> list[str]:
        if not self._fs.exists(self._path):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path))
        return sorted(n for n in found if n.endswith(suffix) and not n.startswith((".", "_")))

    def stamp(self) -> tuple[tuple[str, int, int], ...]:
        """Name, size and time of what lies in the folder: tells whether it has changed."""
        found = self._fs.listStatus(self._path) if self._fs.exists(self._path) else []
        return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found))

    def size(self) -> int:
        """Bytes of all files below, or of the file that the path is."""
        return self._fs.getContentSummary(self._path).getLength() if self._fs.exists(self._path) else 0

    def holds(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a file under a hidden name, then rename it, so that no reader meets half of it."""
        target, draft = self._at(name), self._at(f".{name}.draft")
        if self._fs.exists(target):
            raise FileExistsError(target.toString())
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if not self._fs.rename(draft, target):
            raise OSError(f"cannot rename {draft.toString()} to {target.toString()}")

    def delete(self, name: str | None = None) -> bool:
        return self._fs.delete(self._path if name is None else self._at(name), True)
