"""A data source over SQLite files: ``spark.read.format("sqlite")``.

Options: ``path`` (a file, folder or pattern on any file system that all executors reach), ``dbtable`` or ``query`` (run
by SQLite itself, joins and filters included), ``key`` (a whole-number column to cut ranges by, the row id by default)
and ``partitions`` (ranges of each file, 1 by default). The schema must be given; only its columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marlstone.sources.paths import found, opened


class KeyRange(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        self.path, self.n = options["path"], int(options.get("partitions", 1))
        self.source = f"({options['query']})" if "query" in options else _quoted(options["dbtable"])
        self.key = _quoted(options["key"]) if "key" in options else "_rowid_"

    def _open(self, path: str):
        import sqlite3

        system, at = opened(path)
        if system.type_name == "local":
            return sqlite3.connect(f"file:{at}?mode=ro&immutable=1", uri=True)
        con = sqlite3.connect(":memory:")
        with system.open_input_stream(at) as f:
            con.deserialize(f.read())
        return con

    def partitions(self) -> list[KeyRange]:
        out = []
        for path in found(self.path):
            with self._open(path) as con:
                first, last = con.execute(f"SELECT min({self.key}), max({self.key}) FROM {self.source}").fetchone()
            if first is not None:
                step = -(-(last - first + 1) // self.n)
                out += [KeyRange(path, k, min(last, k + step - 1)) for k in range(first, last + 1, step)]
        return out or [KeyRange("", 0, -1)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        if not partition.path:
            return
        fields = ", ".join(map(_quoted, self.columns))
        with self._open(partition.path) as con:
            yield from con.execute(f"SELECT {fields} FROM {self.source} WHERE {self.key} BETWEEN ? AND ?", (partition.first, partition.last))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
