"""What running streams report: batches, rows and failures, kept for a look from outside."""

from __future__ import annotations

import threading
from collections import deque
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass(frozen=True)
class Beat:
    """A sign of life of a stream: started, a batch with its rows and milliseconds, or ended with an error or none."""

    at: datetime
    run: str
    kind: str
    batch: int | None = None
    rows: int | None = None
    took: int | None = None
    error: str | None = None


class Progress(StreamingQueryListener):
    """Keeps the last `most` beats of all streams of a session."""

    def __init__(self, most: int = 1000):
        self.beats: deque[Beat] = deque(maxlen=most)
        self.changed = threading.Condition()

    def follow(self, spark: SparkSession) -> Progress:
        spark.streams.addListener(self)
        return self

    def leave(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self)

    def _add(self, **beat) -> None:
        with self.changed:
            self.beats.append(Beat(datetime.now(UTC), **beat))
            self.changed.notify_all()

    def wait(self, kind: str, seconds: float = 30.0) -> Beat | None:
        """The last beat of a kind, waited for."""
        find = lambda: next((b for b in reversed(self.beats) if b.kind == kind), None)
        with self.changed:
            self.changed.wait_for(find, seconds)
            return find()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._add(run=str(event.runId), kind="started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._add(run=str(p.runId), kind="batch", batch=p.batchId, rows=p.numInputRows, took=p.batchDuration)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._add(run=str(event.runId), kind="idle")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._add(run=str(event.runId), kind="ended", error=event.exception)
