"""A streaming source whose offsets are listings of a folder: a micro-batch carries the paths that changed.

An offset names a listing, which is written to the state folder before Spark hears of the offset. A
batch is planned from the two listings of its offsets, so that a batch that is run again after a restart
carries the same changes, whatever has happened to the folder since. Listings older than the last
committed one are removed.

Rows: path, change (added, modified or deleted), size and modified (milliseconds; null where the path is
gone). Several changes of one path between two listings are one; a file that comes and goes between two
listings is none. Names that begin with a dot or an underscore are left out, as are folders. An empty
or missing folder is an empty listing.

Listing is done by the driver, as Spark's own file source does it, and holds one entry per file; the
changed paths are dealt to tasks in runs of ``PATHS``.
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Changed paths of a task.
PATHS = 1000

SCHEMA = "path string, change string, size long, modified long"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^\w+:", uri) is None:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", uri))


Listing = dict[str, tuple[int, int]]


def list_folder(root: str) -> Listing:
    """Size and time of change in milliseconds of every file below a folder."""
    store, base = _store(root)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
    hidden = re.compile(r"(^|/)[._]")
    return {f.path: (f.size, f.mtime_ns // 1_000_000) for f in found if f.is_file and not hidden.search(f.path.removeprefix(base).lstrip("/"))}


def changes(before: Listing, after: Listing) -> list[tuple[str, str, int | None, int | None]]:
    """What became of the paths of two listings, by path."""
    out = [(p, "modified" if p in before else "added", *x) for p, x in after.items() if before.get(p) != x]
    return sorted(out + [(p, "deleted", None, None) for p in before if p not in after])


class Listings:
    """Numbered listings in a folder; number 0 is empty and not stored."""

    def __init__(self, state: str):
        self._store, self._base = _store(state)
        self._store.create_dir(self._base)

    def _path(self, n: int) -> str:
        return f"{self._base}/listing-{n:012d}.json.gz"

    def numbers(self) -> list[int]:
        names = [f.base_name for f in self._store.get_file_info(fs.FileSelector(self._base))]
        return sorted(int(m[1]) for name in names if (m := re.fullmatch(r"listing-(\d+)\.json\.gz", name)))

    def read(self, n: int) -> Listing:
        if n == 0:
            return {}
        with self._store.open_input_stream(self._path(n), compression=None) as f:
            return {p: (size, ms) for p, size, ms in json.loads(gzip.decompress(f.read()))}

    def write(self, n: int, listing: Listing) -> None:
        """Under a name that no reader looks for, then moved, so that no listing is ever seen in part."""
        content = gzip.compress(json.dumps([(p, *x) for p, x in sorted(listing.items())]).encode())
        with self._store.open_output_stream(f"{self._path(n)}.part", compression=None) as f:
            f.write(content)
        self._store.move(f"{self._path(n)}.part", self._path(n))

    def forget(self, before: int) -> None:
        for n in self.numbers():
            if n < before:
                self._store.delete_file(self._path(n))


class _Paths(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, state: str):
        self._root, self._listings = root, Listings(state)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last = max(self._listings.numbers(), default=0)
        now = list_folder(self._root)
        if now != self._listings.read(last):
            last += 1
            self._listings.write(last, now)
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = changes(self._listings.read(start["listing"]), self._listings.read(end["listing"]))
        return [_Paths(rows[at : at + PATHS]) for at in range(0, len(rows), PATHS)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        self._listings.forget(end["listing"])


class ListingSource(DataSource):
    """Options: ``path``, the folder to list, and ``state``, the folder that keeps its listings."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options["state"])


def changed_files(spark: SparkSession, root: str, state: str) -> DataFrame:
    """The stream of changes below a folder; ``state`` belongs to one query, like its checkpoint."""
    spark.dataSource.register(ListingSource)
    return spark.readStream.format("listing").option("path", root).option("state", state).load()
