"""The ends of growing files of lines, as a data source: of each file only a bounded number of bytes before its end is read, by one task for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.shared import ship_code

#: Bytes read before the end of a file where nothing else is asked: a fixed value.
TAIL_BYTES = 5 * 1024 * 1024
FORMAT = "line_tails"


class Tail(InputPartition):
    """What one task reads: bytes from start to stop of a file; stop is its size when the query was planned, so that a retried task reads the same lines."""

    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


class TailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("most", TAIL_BYTES))
        if self.most < 1:
            raise ValueError("the bytes to read of each file must be positive")

    def partitions(self) -> list[Tail]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(root)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        lines = [f for f in files if f.is_file and f.size and not f.base_name.startswith(("_", "."))]
        return [Tail(f.path, max(0, f.size - self.most), f.size) for f in sorted(lines, key=lambda f: f.path)] or [Tail("", 0, 0)]

    def read(self, partition: Tail):
        from pyarrow import fs

        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as file:
            # One byte more tells whether the first line begins where the tail does.
            before = min(1, partition.start)
            data = file.read_at(partition.stop - partition.start + before, partition.start - before)
        at = 0
        if before:
            at = data.find(b"\n") + 1
            if not at:
                return  # one line, longer than the tail
        while at < len(data):
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end
            line = data[at:end].removesuffix(b"\r")
            if line.strip():
                yield partition.path, partition.start - before + at, line.decode("utf-8", errors="replace")
            at = end + 1


class LineTails(DataSource):
    """file, offset (bytes), value of the whole lines within the last bytes (option most) of each file under a path; empty lines, and a line that begins before the tail, are left out."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, offset long, value string"

    def reader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def line_tails(spark: SparkSession, path: str, most: int = TAIL_BYTES) -> DataFrame:
    """Rows of LineTails. path: a URI (or an absolute path) of a file or a folder, which all executors can read."""
    ship_code(spark)
    spark.dataSource.register(LineTails)
    return spark.read.format(FORMAT).option("most", str(most)).load(path)
