"""Progress of streaming queries: rows so far, and the rate over the last minute."""

from __future__ import annotations

import time
from collections import deque

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Add with ``spark.streams.addListener``. ``summary`` has what a progress line shows; ``errors`` the last failures."""

    def __init__(self, seconds: float = 60.0, errors: int = 10):
        self.seconds, self.rows, self.batches = seconds, 0, 0
        self.recent: deque[tuple[float, int]] = deque()
        self.errors: deque[str] = deque(maxlen=errors)

    def seen(self, rows: int, now: float | None = None) -> None:
        now = time.time() if now is None else now
        self.rows, self.batches = self.rows + rows, self.batches + 1
        self.recent.append((now, rows))
        while self.recent and now - self.recent[0][0] > self.seconds:
            self.recent.popleft()

    def summary(self, now: float | None = None) -> dict:
        now = time.time() if now is None else now
        recent = [(t, n) for t, n in self.recent if now - t <= self.seconds]
        span = now - recent[0][0] if recent else 0.0
        return {"rows": self.rows, "batches": self.batches, "rows_per_sec": sum(n for _, n in recent[1:]) / span if span > 0 else 0.0, "errors": list(self.errors)}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.seen(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.errors.append(event.exception)
