"""The stored log as a streaming source whose offset is the log position.

The history after a position and what is appended later are one stream: a batch is what lies between
two positions, so a restart goes on from the last one, and a file that brings rows again brings nothing new.
Batches are read in pages: a partition is a run of row groups with about ``page`` rows, found from
file footers, which are read once per file. Files need log_id; rows of a batch that appears later than a higher position
are not taken, as the log only grows at its end.

    spark.dataSource.register(LogStream)
    spark.readStream.format("tickloom_log").schema(schema).option("path", path).option("since", 500).load()
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PAGE = 512


class Page(InputPartition):
    """Row groups of files, and the positions that count."""

    def __init__(self, groups: list[tuple[str, int]], after: int, upto: int):
        super().__init__((tuple(groups), after, upto))
        self.groups, self.after, self.upto = groups, after, upto


class LogStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tickloom_log"

    def schema(self) -> str:
        raise ValueError("give the log's schema with .schema(...)")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogReader(schema, self.options["path"], int(self.options.get("since", 0)), int(self.options.get("page", PAGE)))


class LogReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, path: str, since: int, page: int):
        self.columns, self.arrow = schema.names, to_arrow_schema(schema)
        self.path, self.since, self.page = path, since, page
        # file -> (row group, least position, greatest position, rows)
        self.footers: dict[str, list[tuple[int, int, int, int]]] = {}

    def _files(self) -> tuple[fs.FileSystem, list[str]]:
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = ("_", ".")
        return system, sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet") and not any(p.startswith(hidden) for p in f.path[len(root) :].split("/")))

    def _look(self) -> None:
        """Footers of files not seen yet."""
        system, files = self._files()
        for path in files:
            if path in self.footers:
                continue
            with system.open_input_file(path) as source:
                meta = pq.ParquetFile(source).metadata
                column = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == "log_id")
                groups = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    held = group.column(column).statistics
                    if group.num_rows and held is not None and held.has_min_max:
                        groups.append((g, held.min, held.max, group.num_rows))
                    elif group.num_rows:
                        groups.append((g, -(1 << 62), (1 << 62), group.num_rows))
                self.footers[path] = groups

    def initialOffset(self) -> dict:
        return {"log_id": self.since}

    def latestOffset(self) -> dict:
        self._look()
        tops = [high for groups in self.footers.values() for _, _, high, _ in groups if high < 1 << 62]
        return {"log_id": max([self.since, *tops])}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self._look()
        after, upto = start["log_id"], end["log_id"]
        near = sorted((low, path, g, n) for path, groups in self.footers.items() for g, low, high, n in groups if high > after and low <= upto)
        pages, held, count = [], [], 0
        for _, path, g, n in near:
            held.append((path, g))
            count += n
            if count >= self.page:
                pages.append(Page(held, after, upto))
                held, count = [], 0
        return pages + ([Page(held, after, upto)] if held else [])

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        for path, g in partition.groups:
            system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
            with system.open_input_file(path) as source:
                rows = pq.ParquetFile(source).read_row_group(g, columns=self.columns)
            at = rows.column("log_id")
            rows = rows.filter(pc.and_(pc.greater(at, partition.after), pc.less_equal(at, partition.upto)))
            yield from rows.select(self.columns).cast(self.arrow).to_batches()

    def commit(self, end: dict) -> None:
        pass


def log_stream(spark, path: str, schema: StructType, since: int = 0, page: int = PAGE):
    """The log's rows after a position, now and later, as a stream."""
    spark.dataSource.register(LogStream)
    return spark.readStream.format(LogStream.name()).schema(schema).option("path", path).option("since", since).option("page", page).load()
