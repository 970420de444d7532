"""Polls of an updated-since listing as a stream: a Python data source whose offsets are the cursor.

A poll reads the items that were updated since the cursor less an overlap, as an index lags behind what it lists, and moves the cursor
to the newest it has read. It takes at most `most` items behind the cursor; where more are there the cursor is pinned at the last item
taken (items of one instant are taken together), so nothing is skipped. A window is read whole or not at all: a task that finds other
than the planned number of items fails the batch, and the next attempt reads the same window from the checkpoint.

The listing is a folder of captured items in Parquet (id, updated_us, body) that any pyarrow file system can read; planning reads one
column within the window. Overlaps repeat items, so rows go through a log that knows them (`streaming.tables.append_checked`).
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Spark plans a Python source in processes that may not know the driver's sys.path: its classes travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Seconds that are read again before the cursor (fixed value), and items of one poll where a caller says nothing.
OVERLAP, MOST = 300, 200
ITEM = "id long, updated_us long, body string"


def _listing(path: str) -> ds.Dataset:
    files, place = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return ds.dataset(place, filesystem=files, format="parquet", exclude_invalid_files=True)


@dataclass
class Window(InputPartition):
    """Items updated from `low` to `high`, both included, and how many there are."""

    low: int
    high: int
    hits: int

    def __init__(self, low: int, high: int, hits: int):
        self.low, self.high, self.hits = low, high, hits
        super().__init__((low, high))


class CursorReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.start = int(options.get("since_us", 0))
        self.most = int(options.get("most", MOST))
        self.overlap = int(options.get("overlap_seconds", OVERLAP)) * 1_000_000
        self.splits = int(options.get("splits", 4))
        self.cursor: int | None = None

    def initialOffset(self) -> dict:
        return {"cursor": self.start}

    def _updated(self, low: int, high: int | None = None) -> pa.ChunkedArray:
        """Sorted instants of the items in [low, high]."""
        inside = pc.field("updated_us") >= low
        inside = inside if high is None else inside & (pc.field("updated_us") <= high)
        return _listing(self.path).to_table(columns=["updated_us"], filter=inside).column("updated_us").sort()

    def latestOffset(self) -> dict:
        """Where the cursor stands after one more poll. Spark asks again with each trigger; a restart goes on from the checkpoint."""
        cursor = self.start if self.cursor is None else self.cursor
        behind = self._updated(cursor + 1)
        if len(behind):
            self.cursor = behind[min(self.most, len(behind)) - 1].as_py()
        return {"cursor": self.cursor if self.cursor is not None else cursor}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        self.cursor = end["cursor"]
        if start["cursor"] == end["cursor"]:
            return []
        instants = self._updated(start["cursor"] - self.overlap, end["cursor"])
        cuts = sorted({instants[len(instants) * k // self.splits - 1].as_py() for k in range(1, self.splits + 1) if len(instants) * k // self.splits})
        lows = [start["cursor"] - self.overlap, *[c + 1 for c in cuts[:-1]]]
        count = lambda low, high: pc.sum(pc.and_(pc.greater_equal(instants, low), pc.less_equal(instants, high))).as_py()
        return [Window(low, high, count(low, high)) for low, high in zip(lows, cuts, strict=True)]

    def read(self, window: Window):
        inside = (pc.field("updated_us") >= window.low) & (pc.field("updated_us") <= window.high)
        seen = 0
        for batch in _listing(self.path).to_batches(columns=["id", "updated_us", "body"], filter=inside, batch_size=4096):
            seen += batch.num_rows
            yield batch
        if seen != window.hits:
            raise ValueError(f"the listing has {seen} items where {window.hits} were planned: the window is read again")

    def commit(self, end: dict) -> None:
        pass


class CursorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "heronry_cursor"

    def schema(self) -> str:
        return ITEM

    def streamReader(self, schema) -> CursorReader:
        return CursorReader(self.options)


def polled(spark: SparkSession, path: str, since_us: int, most: int = MOST, overlap_seconds: int = OVERLAP) -> DataFrame:
    """The listing as a stream of items."""
    spark.dataSource.register(CursorSource)
    return spark.readStream.format("heronry_cursor").option("since_us", since_us).option("most", most).option("overlap_seconds", overlap_seconds).load(path)
