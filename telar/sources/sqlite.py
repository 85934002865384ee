"""Read-only scan of a table of an SQLite file, as a Python data source named ``sqlite_ro``.

Options: ``path``, ``table``, and ``partitions`` to read in parallel by ranges of rowid. The file must be reachable from the executors.
"""

from __future__ import annotations

import os
import sqlite3
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TYPES = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}


def connect(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> str:
        with connect(self.options["path"]) as c:
            columns = c.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{n}` {_TYPES.get((t or 'TEXT').upper(), 'string')}" for _, n, t, *_ in columns)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], schema.fieldNames(), int(self.options.get("partitions", "1")))


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], n: int):
        self.path, self.table, self.columns, self.n = path, table, columns, n

    def partitions(self):
        with connect(self.path) as c:
            low, high = c.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high + 1 - low) // self.n)
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition):
        with connect(self.path) as c:
            yield from c.execute(f"select {', '.join(map(_quoted, self.columns))} from {_quoted(self.table)} where rowid >= ? and rowid < ?", (partition.low, partition.high))
