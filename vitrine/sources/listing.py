"""Every object under a prefix (S5, S6), as a Python data source.

Spark's file sources hide names that begin with ``_`` or ``.``; an object store has no
such names. This source lists folders through pyarrow's file systems (local, hdfs,
s3, gcs) in the tasks: the folders right below the prefix (one per model version) are
dealt over ``partitions`` tasks, each of which walks its folders. Nothing is read but
names, lengths and times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "prefix_listing"
SCHEMA = "key string, length long, modified timestamp"


def file_system(uri: str):
    """pyarrow file system and path of a qualified name."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    if re.match(r"[a-z0-9]+:/", uri):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


@dataclass
class Folders(InputPartition):
    names: list[str]


class ListingReader(DataSourceReader):
    def __init__(self, root: str, partitions: int):
        self.root, self.partitions_wanted = root, partitions

    def _walk(self, fs, folder: str, base: str, recursive: bool) -> Iterator[tuple]:
        from pyarrow.fs import FileSelector

        for f in fs.get_file_info(FileSelector(folder, recursive=recursive, allow_not_found=True)):
            if f.is_file:
                yield f.path[len(base):].lstrip("/"), f.size, f.mtime

    def partitions(self) -> list[Folders]:
        from pyarrow.fs import FileSelector

        fs, base = file_system(self.root)
        folders = sorted(f.base_name for f in fs.get_file_info(FileSelector(base, allow_not_found=True)) if not f.is_file)
        n = max(1, min(self.partitions_wanted, len(folders)))
        # the files right in the prefix are listed with the first partition, under the empty name
        return [Folders([""] * (k == 0) + folders[k::n]) for k in range(n)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        fs, base = file_system(self.root)
        for name in partition.names:
            yield from self._walk(fs, f"{base.rstrip('/')}/{name}" if name else base, base, recursive=bool(name))


class PrefixListing(DataSource):
    """Options ``path`` (qualified) and ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"], int(self.options.get("partitions", "64")))
