"""A streaming source over stored responses of a vulnerability list: one folder a day of crawling, read in date order.

``spark.readStream.format("stored_feed").option("path", folder).option("since", "2024-01-01").load()`` gives day, file, body: a row
a stored response.  Offsets are days, so a query that starts again goes on behind the last day that it finished; the driver
only lists names, files are read by tasks.  A batch takes all days that are there and new.  A day's folder must be whole when it
appears, and stay: what is added to a day that was read is not seen, and without its last day the source would begin again.
"""

from __future__ import annotations

import datetime
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..shipping import by_value
from . import feeds

FORMAT = "stored_feed"
PREFIX = "day="
#: Bytes of responses that a task reads, or one response.
TASK_BYTES = 64 << 20


@dataclass
class Files(InputPartition):
    """(day, path) of the files that one task reads."""

    files: tuple[tuple[str, str], ...]


class StoredFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "day string, file string, body string"

    def streamReader(self, schema: StructType) -> StoredFeedReader:
        return StoredFeedReader(self.options["path"], self.options.get("since"))


def _system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class StoredFeedReader(DataSourceStreamReader):
    """An offset is the last day that was read; to begin with, the day before the first one wanted."""

    def __init__(self, path: str, since: str | None):
        self.path = path.rstrip("/")
        first = datetime.date.fromisoformat(since) if since else datetime.date.min + datetime.timedelta(1)
        self.first = (first - datetime.timedelta(1)).isoformat()

    def initialOffset(self) -> dict:
        return {"day": self.first}

    def _days(self) -> list[str]:
        """Days that have a folder, in order; folders of other names are none."""
        from pyarrow import fs

        system, root = _system(self.path)
        names = [i.base_name.removeprefix(PREFIX) for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory and i.base_name.startswith(PREFIX)]
        return sorted(n for n in names if _is_day(n))

    def latestOffset(self) -> dict:
        return {"day": max([self.first, *self._days()])}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        from pyarrow import fs

        system, root = _system(self.path)
        out, size = [[]], 0
        for day in (d for d in self._days() if start["day"] < d <= end["day"]):
            there = [i for i in system.get_file_info(fs.FileSelector(f"{root}/{PREFIX}{day}")) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
            for info in sorted(there, key=lambda i: i.path):
                if out[-1] and size + info.size > TASK_BYTES:
                    out, size = [*out, []], 0
                out[-1].append((day, info.path))
                size += info.size
        return [Files(tuple(f)) for f in out if f]

    def read(self, partition: Files) -> Iterator[tuple[str, str, str]]:
        system, _ = _system(self.path)
        for day, path in partition.files:
            with system.open_input_stream(path) as f:
                yield day, path.rsplit("/", 1)[-1], f.read().decode("utf-8", errors="replace")

    def commit(self, end: dict) -> None:
        """Nothing to do: stored responses stay."""

    def stop(self) -> None:
        """Nothing is open."""


def _is_day(name: str) -> bool:
    try:
        return datetime.date.fromisoformat(name).isoformat() == name
    except ValueError:
        return False


def stream(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """day, file, body of the responses stored from a day on (all without one), as a stream."""
    with by_value(sys.modules[__name__]):
        spark.dataSource.register(StoredFeed)
    s = spark.readStream.format(FORMAT).option("path", path)
    return (s.option("since", since) if since else s).load()


def new_items(responses: DataFrame, since: str, pages_col: str = "body") -> DataFrame:
    """day and the list rows (feeds.list_rows) of stored pages that were disclosed on a date or later.

    Rows whose date can't be read are kept, as they may be new; rows alike are kept as often as they are there.
    """
    return feeds.list_rows(responses, pages_col, ("day",)).filter(_fresh(F.col("disclosed"), since))


def _fresh(disclosed: Column, since: str) -> Column:
    return F.coalesce(disclosed.try_cast("date") >= F.lit(since).cast("date"), F.lit(True))
