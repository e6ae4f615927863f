"""Zipped document archives and legislature addresses."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Archives by legislature.
ARCHIVES = {15: "scrutins/Scrutins_XV.json.zip", 16: "scrutins/Scrutins.json.zip", 17: "scrutins/Scrutins.json.zip"}


def archive_path(legislature: Column) -> Column:
    """Path of a legislature's archive; any other legislature is an error."""
    known = F.create_map(*[F.lit(x) for k, v in ARCHIVES.items() for x in (k, f"{k}/loi/{v}")])
    return F.when(legislature.isin(*ARCHIVES), F.element_at(known, legislature)).otherwise(F.raise_error(F.concat(F.lit("unknown legislature "), legislature.cast("string"))))


def _source():
    """The data source's class, made here so that it travels to executors by value."""
    import pyarrow as pa
    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Entries(InputPartition):
        def __init__(self, archive: str, first: int, last: int):
            self.archive, self.first, self.last = archive, first, last

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.entries, self.size = options["path"], int(options.get("entries", 2000)), int(options.get("bytes", 64 << 20))

        @staticmethod
        def opened(path: str):
            files, at = fs.FileSystem.from_uri(path)
            f = files.open_input_file(at)
            return io.BytesIO(f.read()) if f.size() < 1 << 16 else f  # zipfile seeks before the start of very small files

        def archives(self) -> list[str]:
            files, at = fs.FileSystem.from_uri(self.path)
            if files.get_file_info(at).type == fs.FileType.File:
                return [self.path]
            prefix = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else self.path[: self.path.index("://") + 3]
            return [prefix + x.path for x in files.get_file_info(fs.FileSelector(at)) if x.path.endswith(".zip")]

        def partitions(self):
            """Ranges of each archive's entries, from its directory at the end of the file."""
            out = []
            for archive in self.archives():
                with self.opened(archive) as f, zipfile.ZipFile(f) as z:
                    sizes = [x.file_size for x in z.infolist()]
                first, held = 0, 0
                for i, n in enumerate(sizes):
                    if i > first and (i - first >= self.entries or held + n > self.size):
                        out.append(Entries(archive, first, i))
                        first, held = i, 0
                    held += n
                if sizes:
                    out.append(Entries(archive, first, len(sizes)))
            return out or [Entries("", 0, 0)]

        def read(self, part):
            names = ["archive", "category", "uid", "raw", "content_hash"]
            rows, size = [], 0
            if part.archive:
                with self.opened(part.archive) as f, zipfile.ZipFile(f) as z:
                    for info in z.infolist()[part.first : part.last]:
                        parts = info.filename.split("/")
                        if parts[0] != "json" or not info.filename.endswith(".json"):
                            continue
                        raw = z.read(info)
                        rows.append((part.archive, parts[1] if len(parts) > 2 else "", parts[-1][:-5], raw.decode(), hashlib.sha256(raw).hexdigest()))
                        size += len(raw)
                        if len(rows) >= 500 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)
                            rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)

    class ZippedJson(DataSource):
        @classmethod
        def name(cls):
            return "zipped_json"

        def schema(self):
            return "archive string, category string, uid string, raw string, content_hash string"

        def reader(self, schema):
            return Reader(self.options)

    return ZippedJson


def read_zips(spark: SparkSession, path: str, entries: int = 2000, size: int = 64 << 20) -> DataFrame:
    """(archive, category, uid, raw, content_hash) of every JSON entry of the zip file, or the folder of them, at `path`.

    Entries are json/<name>.json or json/<category>/<name>.json; the name is the uid. An archive's directory is read
    once and its entries are dealt to tasks in ranges of at most `entries` entries and `size` bytes, or one larger
    entry. A task opens the file where it lies and reads its own entries; no archive is ever whole in memory.
    Paths are those that Arrow's file systems know: local ones, hdfs:// and object stores.
    """
    spark.dataSource.register(_source())
    where = path if "://" in path else "file://" + os.path.abspath(path)
    return spark.read.format("zipped_json").option("entries", entries).option("bytes", size).load(where)
