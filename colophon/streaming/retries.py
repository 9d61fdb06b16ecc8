"""Retries kept as a stream's state: each failed key counts its attempts and has a timer for its next one.

Nothing rereads the registry: the state is the key's attempts and when it is due, and the timer gives it out again.  State and
timers are in the state store of the stream's checkpoint, so a restart, or a replayed micro-batch, goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import WAITS
from ..operators.provider import hint_of, kind_of

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DUE = "name string, action string, attempts int, due timestamp"


def wait_before(kind: str, hint: float | None, attempt: int) -> float:
    """Seconds until a key is tried again, without chance."""
    first, growth, most, extra = WAITS["rate_limit" if kind == "quota" else kind]
    wait = min(first * attempt if growth == "add" else first * 2 ** (attempt - 1), most or float("inf"))
    return (hint or wait) if extra else wait


class _Retries(StatefulProcessor):
    """Of outcomes (name, error, at): OK and ERROR_PERMANENT end a key, ERROR sets its timer, and the timer says RETRY."""

    def __init__(self, max_attempts: int):
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "attempts int, due long")

    def _timers_off(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        outcomes = pd.concat(list(rows)).sort_values("at", kind="stable")
        attempts = self.state.get()[0] if self.state.exists() else 0
        out = []
        for error, at in zip(outcomes["error"], outcomes["at"], strict=True):
            self._timers_off()
            if pd.isna(error):
                out.append((key[0], "OK", 0, pd.NaT))
                attempts = 0
                self.state.clear()
                continue
            attempts += 1
            if attempts >= self.max_attempts:
                out.append((key[0], "ERROR_PERMANENT", attempts, pd.NaT))
                attempts = 0
                self.state.clear()
                continue
            try:
                hint = hint_of(error)
            except ValueError:
                hint = None
            due = pd.Timestamp(at) + pd.Timedelta(seconds=wait_before(kind_of(error), hint, attempts))
            milliseconds = max(int(due.timestamp() * 1000), timerValues.getCurrentProcessingTimeInMs() + 1)
            self.state.update((attempts, milliseconds))
            self.handle.registerTimer(milliseconds)
            out.append((key[0], "ERROR", attempts, due))
        yield pd.DataFrame(out, columns=["name", "action", "attempts", "due"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield pd.DataFrame([(key[0], "RETRY", self.state.get()[0], pd.NaT)], columns=["name", "action", "attempts", "due"])

    def close(self) -> None:
        pass


def enable(spark: SparkSession) -> None:
    """State with timers needs this store; call it before a stream of `track` starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def track(outcomes: DataFrame, max_attempts: int = 3) -> DataFrame:
    """DUE: what becomes of each outcome, and RETRY for each failed key when its time has come.

    outcomes: a stream of name, error (null where the item went well) and at (timestamp).  A key's rows of one micro-batch are
    taken in order of `at`; there are few, as a key is tried again only when it is due.
    """
    keyed = outcomes.select("name", "error", "at").groupBy("name")
    return keyed.transformWithStateInPandas(statefulProcessor=_Retries(max_attempts), outputStructType=DUE, outputMode="Append", timeMode="ProcessingTime")
