"""Raw gray frames as a data source: a row for each width x height bytes of a file.

spark.dataSource.register(GraySource)
spark.read.format("gray").option("width", 640).option("height", 480).load(folder)

Tasks read ranges of whole frames; what a file has beyond its last whole frame is left. Paths may be of
any file system that pyarrow knows.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Frames(InputPartition):
    def __init__(self, uri: str, first: int, count: int):
        self.uri, self.first, self.count = uri, first, count


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class GrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.size = int(options["width"]) * int(options["height"])
        self.per_task = max(1, int(options.get("taskbytes", 64 << 20)) // max(1, self.size))
        if self.size < 1:
            raise ValueError("frames need a width and a height")

    def partitions(self):
        from pyarrow import fs

        system, path = _open(self.uri)
        info = system.get_file_info(path)
        files = system.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        scheme = self.uri.split("://")[0] + "://" if "://" in self.uri else ""
        out = []
        for f in sorted((f for f in files if f.is_file and (f.extension == "gray" or f.path == path)), key=lambda f: f.path):
            n = f.size // self.size
            out += [Frames(scheme + f.path, i, min(self.per_task, n - i)) for i in range(0, n, self.per_task)]
        return out or [Frames("", 0, 0)]

    def read(self, partition):
        if not partition.count:
            return
        system, path = _open(partition.uri)
        with system.open_input_file(path) as f:
            f.seek(partition.first * self.size)
            for i in range(partition.first, partition.first + partition.count):
                yield partition.uri, i, f.read(self.size)


class GraySource(DataSource):
    @classmethod
    def name(cls):
        return "gray"

    def schema(self):
        return "path string, frame bigint, pixels binary"

    def reader(self, schema):
        return GrayReader({k.lower(): v for k, v in self.options.items()})
