"""How long each step of a search takes, and how many rows it hands on.

Spark runs lazily, so a step has a time of its own only where it ends in something that is written: a
collector ends every step with a checkpoint and counts its rows on the way by an observation, without a
second action.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cotejo.session import cut


class Timings:
    """Steps in the order in which they ended."""

    def __init__(self) -> None:
        self._open: dict[str, float] = {}
        self._done: list[tuple[str, float, int | None]] = []

    def start(self, label: str) -> None:
        self._open[label] = time.perf_counter()

    def end(self, label: str, rows: int | None = None) -> None:
        """Ends a step; one that was never started is ignored."""
        if label in self._open:
            self._done.append((label, round((time.perf_counter() - self._open.pop(label)) * 1000, 2), rows))

    def step(self, label: str, df: DataFrame) -> DataFrame:
        """``df``, checkpointed: a step from here to when it is written."""
        seen = Observation(f"{label}-{uuid.uuid4().hex[:8]}")
        self.start(label)
        done = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        self.end(label, seen.get["rows"])
        return done

    def table(self, spark: SparkSession) -> DataFrame:
        """(place, label, ms, rows): milliseconds with two decimals."""
        rows = [(k, *done) for k, done in enumerate(self._done, 1)]
        return spark.createDataFrame(rows, "place int, label string, ms double, rows long")

    def reset(self) -> None:
        self._open.clear()
        self._done.clear()


def step(timings: Timings | None, label: str, df: DataFrame) -> DataFrame:
    """``df`` at the end of a step: checkpointed, and timed where there is a collector."""
    return cut(df) if timings is None else timings.step(label, df)
