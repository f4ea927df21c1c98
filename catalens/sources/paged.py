"""A Parquet table read as a paged feed: a stream that takes page after page, in row order, and stops at a short one.

    spark.dataSource.register(PagedTable)
    spark.readStream.format("paged_table").option("size", 100).load(path)

The offset is the number of rows taken, so a restart goes on after the last committed row: a page
that was short and has been filled since gives its new rows only. Footers tell how many rows there
are; a task takes TASK_ROWS rows of whole pages and reads the row groups under them once, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    store, where = _store(path)
    info = store.get_file_info(where)
    if info.is_file:
        return [where]
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(where)) if f.path.endswith(".parquet"))


#: Rows of a task, as whole pages.
TASK_ROWS = 1 << 17


@dataclass
class Pages(InputPartition):
    #: (file, its row group, rows to leave out at its start, rows to take, the first of them counted over all files).
    parts: list[tuple[str, int, int, int, int]]


class PagedReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int, schema: StructType):
        self.path, self.size, self.names = path, size, schema.names

    def _groups(self) -> Iterator[tuple[str, int, int]]:
        store, _ = _store(self.path)
        for name in _files(self.path):
            with store.open_input_file(name) as f:
                meta = pq.ParquetFile(f).metadata
                for g in range(meta.num_row_groups):
                    yield name, g, meta.row_group(g).num_rows

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": sum(n for _, _, n in self._groups())}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        """The pages that hold the rows ``start`` to ``end``; the first and the last may be short."""
        stretch = max(1, TASK_ROWS // self.size) * self.size
        tasks: dict[int, list] = {}
        at = 0
        for name, group, n in self._groups():
            low, high = max(at, start["rows"]), min(at + n, end["rows"])
            for k in range(low // stretch, -(-high // stretch) if high > low else 0):
                first, last = max(low, k * stretch), min(high, (k + 1) * stretch)
                tasks.setdefault(k, []).append((name, group, first - at, last - first, first))
            at += n
        return [Pages(parts) for _, parts in sorted(tasks.items())]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for name, group, skip, take, at in partition.parts:
            with store.open_input_file(name) as f:
                for batch in pq.ParquetFile(f).iter_batches(row_groups=[group], columns=self.names[:-1]):
                    rows = batch.slice(min(skip, batch.num_rows), take)
                    skip = max(0, skip - batch.num_rows)
                    if rows.num_rows:
                        numbers = pa.array(np.arange(at, at + rows.num_rows) // self.size, pa.int64())
                        yield pa.record_batch([*rows.columns, numbers], names=self.names)
                        at, take = at + rows.num_rows, take - rows.num_rows
                    if not take:
                        break


class PagedTable(DataSource):
    """Options: ``path`` (or load(path)), ``size`` (rows of a page, 100). Adds the column ``page``."""

    @classmethod
    def name(cls) -> str:
        return "paged_table"

    def schema(self) -> StructType:
        store, _ = _store(self.options["path"])
        with store.open_input_file(_files(self.options["path"])[0]) as f:
            fields = from_arrow_schema(pq.ParquetFile(f).schema_arrow).fields
        return StructType([*fields, StructField("page", LongType())])

    def streamReader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options["path"], int(self.options.get("size", 100)), schema)
