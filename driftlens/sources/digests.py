"""A data source of file digests: files are streamed into SHA-256 in chunks, whatever their size.

    spark.dataSource.register(FileDigests)
    spark.read.format("file_digests").option("exclude", '["old/"]').load(folder)

Rows: path (below the folder, with ``/``), folder (the path's parts but the last), size, sha256, error. The driver
lists the folder (names and sizes); files are dealt to partitions of about ``partitionBytes`` bytes, the largest
first, and a partition holds one chunk of one file at a time. A file that can't be read is a row with an error.

What is left out is never opened and, below an excluded folder, never listed: folders of ``exclude`` (a JSON list of
path prefixes), and files that a pushed filter on path or folder rules out (equality, membership, prefixes and their
negations), where Spark's session pushes filters to Python sources
(``spark.sql.python.filterPushdown.enabled`` and the option ``pushdown``; ``digests`` sets it). Without that, Spark
filters rows that were read.

Files are reached by Arrow's file systems: local and mounted paths, and the stores whose libraries are there.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not, StringStartsWith

CHUNK = 1 << 20
SCHEMA = "path string, folder string, size bigint, sha256 string, error string"


def digest_of(system: fs.FileSystem, path: str, chunk: int = CHUNK) -> tuple[str, int]:
    """Lowercase hex SHA-256 and size of a file, a chunk at a time."""
    digest, size = hashlib.sha256(), 0
    with system.open_input_stream(path, buffer_size=None) as stream:
        while data := stream.read(chunk):
            digest.update(data)
            size += len(data)
    return digest.hexdigest(), size


class Files(InputPartition):
    def __init__(self, uri: str, files: list[tuple[str, int]]):
        self.uri, self.files = uri, files


def column_of(f: Filter) -> str | None:
    name = getattr(f, "attribute", None)
    return name[0] if name and len(name) == 1 and name[0] in ("path", "folder") else None


def allows(f: Filter, path: str) -> bool:
    """Whether a pushed filter lets a file through."""
    if isinstance(f, Not):
        return not allows(f.child, path)
    value = path if column_of(f) == "path" else path.rpartition("/")[0]
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    return value.startswith(f.value)


def known(f: Filter) -> bool:
    own = f.child if isinstance(f, Not) else f
    if isinstance(own, In) and any(v is None for v in own.value):
        return False
    return isinstance(own, (EqualTo, In, StringStartsWith)) and column_of(own) is not None and getattr(own, "value", None) is not None


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.options, self.filters = options["path"].rstrip("/"), options, []
        self.exclude = [str(x) for x in json.loads(options.get("exclude", "[]"))]

    def listed(self, system: fs.FileSystem, top: str) -> Iterator[tuple[str, int]]:
        """(path, size) below the folder; hidden files and names that begin with ``_`` are left out, as Spark's readers do."""
        folders = [top]
        while folders:
            for info in system.get_file_info(fs.FileSelector(folders.pop())):
                path = info.path.removeprefix(top).lstrip("/")
                if info.base_name.startswith((".", "_")):
                    continue
                if info.type == fs.FileType.Directory:
                    if not any((path + "/").startswith(x) for x in self.exclude):
                        folders.append(info.path)
                elif not any(path.startswith(x) for x in self.exclude) and all(allows(f, path) for f in self.filters):
                    yield path, info.size

    def partitions(self) -> list[Files]:
        system, top = fs.FileSystem.from_uri(self.uri)
        files = sorted(self.listed(system, top), key=lambda x: (-x[1], x[0]))
        most = int(self.options.get("partitionbytes", self.options.get("partitionBytes", 128 << 20)))
        number = max(1, min(len(files), -(-sum(s + CHUNK for _, s in files) // most)))
        parts = [(0, k, []) for k in range(number)]  # the next file goes to the lightest
        for path, size in files:
            total, k, own = heapq.heappop(parts)
            own.append((path, size))
            heapq.heappush(parts, (total + size + CHUNK, k, own))
        return [Files(self.uri, own) for _, _, own in parts]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, top = fs.FileSystem.from_uri(partition.uri)
        for path, size in partition.files:
            folder = path.rpartition("/")[0]
            try:
                sha, size = digest_of(system, f"{top}/{path}")
                yield path, folder, size, sha, None
            except Exception as e:  # a file that went or can't be read is a row, not the end of the job
                yield path, folder, size, None, f"{type(e).__name__}: {e}"[:300]


class PushingReader(Reader):
    """Spark refuses a reader that takes filters where the session doesn't push them, so this one is asked for by an option."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if known(f):
                self.filters.append(f)
            else:
                yield f


class FileDigests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return (PushingReader if self.options.get("pushdown") == "true" else Reader)(dict(self.options))


def digests(spark, folder: str, exclude: list[str] | None = None, **options):
    """The source's rows of a folder (a path or address)."""
    spark.dataSource.register(FileDigests)
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("file_digests").options(pushdown=pushes, exclude=json.dumps(exclude or []), **options).load(uri)
