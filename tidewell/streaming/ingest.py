"""The landing folder's lines go to the events table in micro-batches.

There is no watermark: events of any age count. Delivery is at least once: a batch that is
run again after a crash appends its events again, with the ids and times that were landed,
so they are one event each when the table is read as final or compacted.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewell.config import EngineConfig
from tidewell.sources.events_table import write_events
from tidewell.sources.payloads import single_events, valid


def start(spark: SparkSession, landing: str, table: str, checkpoint: str, once: bool = False, config: EngineConfig = EngineConfig(), archive: str | None = None) -> StreamingQuery:
    """Runs until stopped; with `once`, until all that has landed is in the table.

    With `archive`, a folder outside of `landing`, files go there once a later batch has been
    committed; without, they stay.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", config.batch_files)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    lines = reader.text(landing)

    def commit(batch: DataFrame, _: int) -> None:
        write_events(batch, table)

    writer = valid(single_events(lines, config=config)).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{config.flush_seconds} seconds")
    return writer.start()


def delay_ms(failures: int, ceiling_ms: int) -> int:
    """How long to wait after so many failures before: a second, doubled each time, up to the ceiling."""
    return min(ceiling_ms, 1000 << min(max(failures, 0), 31))


def supervised(begin: Callable[[], StreamingQuery], config: EngineConfig = EngineConfig(), sleep: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Starts the query again after a failure, from its checkpoint, `max_retries` times at most in a row without progress."""
    failures = 0
    while True:
        query = begin()
        try:
            query.awaitTermination()
            return query
        except Exception:
            failures = 0 if query.lastProgress and query.lastProgress["numInputRows"] else failures + 1
            if failures > config.max_retries:
                raise
            sleep(delay_ms(failures - 1, config.backoff_ceiling_ms) / 1000)


class Progress(StreamingQueryListener):
    """Events read, batches and failures so far, with the last batch's duration."""

    def __init__(self) -> None:
        self.events = self.batches = self.failures = self.last_ms = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.events += event.progress.numInputRows
        self.batches += 1
        self.last_ms = event.progress.batchDuration

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failures += event.exception is not None
