"""A hook that runs after each micro-batch has been committed: it has a time limit, and nothing it does can fail or delay the stream."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: Seconds that a hook may take (fixed value).
LIMIT = 10.0


class AfterPublication(StreamingQueryListener):
    """Calls hook(status) for every batch with rows of the named query. `outcomes` holds (batch, rows, outcome) in order, where outcome is
    ok, late (the limit was reached; the hook is left to itself) or what it failed with."""

    def __init__(self, name: str, hook: Callable[[dict], None] | None, limit: float = LIMIT):
        self.name, self.hook, self.limit = name, hook, limit
        self.outcomes: list[tuple[int, int, str]] = []
        self._ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name != self.name or not progress.numInputRows:
            return
        status = {"batch": progress.batchId, "rows": progress.numInputRows, "at": progress.timestamp}
        self.outcomes.append((status["batch"], status["rows"], self._called(status)))

    def _called(self, status: dict) -> str:
        if self.hook is None:
            return "none"
        pool = ThreadPoolExecutor(1)
        try:
            pool.submit(self.hook, status).result(self.limit)
            return "ok"
        except Late:
            return "late"
        except Exception as error:  # whatever a hook raises is its own matter
            return f"failed: {type(error).__name__}"
        finally:
            pool.shutdown(wait=False)

    def onQueryTerminated(self, event) -> None:
        self._ended.set()

    def wait(self, seconds: float = 60.0) -> None:
        """Until the listener has heard of the query's end; batches come before it."""
        self._ended.wait(seconds)


def run_with_hook(stream: DataFrame, target: str, checkpoint: str, name: str, hook, limit: float = LIMIT) -> list[tuple[int, int, str]]:
    """Append what the stream has now to target, with the hook after each batch. What became of the hook, batch by batch."""
    spark: SparkSession = stream.sparkSession
    listener = AfterPublication(name, hook, limit)
    spark.streams.addListener(listener)
    try:
        stream.writeStream.queryName(name).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        listener.wait()
    finally:
        spark.streams.removeListener(listener)
    return sorted(listener.outcomes)

