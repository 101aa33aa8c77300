"""Debug levels of the relay's log, and a listener that logs the progress of streaming queries."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

log = logging.getLogger("weirflow")
_level = 0


def set_debug(level: int) -> None:
    """0: warnings only; 1: what happens; 2 and above: more and more detail."""
    global _level
    _level = level
    log.setLevel(logging.WARNING if level < 1 else logging.INFO if level < 2 else logging.DEBUG)


def debug(level: int, message: str, *parts: object) -> None:
    """Logs a message if the debug level is at least ``level``."""
    if _level >= level:
        log.log(logging.INFO if level < 2 else logging.DEBUG, message, *parts)


class ProgressListener(StreamingQueryListener):
    """Logs the start, each batch and the end of every streaming query of a session."""

    def onQueryStarted(self, event) -> None:
        debug(1, "query %s started", event.id)

    def onQueryProgress(self, event) -> None:
        debug(2, "query %s: batch %s, %s rows", event.progress.id, event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        debug(3, "query %s is idle", event.id)

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            log.warning("query %s failed: %s", event.id, event.exception)
        else:
            debug(1, "query %s ended", event.id)


def listen(spark: SparkSession) -> ProgressListener:
    listener = ProgressListener()
    spark.streams.addListener(listener)
    return listener
