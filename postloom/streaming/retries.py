"""Retries with time: what failed comes again after a delay, a bounded number of times, as a stateful stream.

Attempts are held by key.  A failed attempt sets a timer; when the watermark passes it the row is sent again.  An attempt that is not
answered within the patience counts as failed when its own timer fires.  A key that is done or given up holds no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds before each further attempt, as many as there may be; seconds that an attempt may stay unanswered.
DELAYS, PATIENCE = (20, 20), 300
_OUT = "id string, attempt int, event string, at timestamp"


class _Retry(StatefulProcessor):
    def __init__(self, delays: tuple[int, ...], patience: int):
        self.delays, self.patience = delays, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.call = handle, handle.getValueState("call", "attempt int, sent boolean")

    def close(self) -> None:
        pass

    def _wait(self, attempt: int, sent: bool, until: int) -> None:
        """One timer for a key: of the answer if sent, or of the next attempt."""
        self._stop()
        self.call.update((attempt, sent))
        self.handle.registerTimer(until)

    def _stop(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.call.clear()

    def _send(self, attempt: int, at: int) -> tuple[int, str, int]:
        self._wait(attempt, True, at + 1000 * self.patience)
        return attempt, "send", at

    def _fail(self, attempt: int, at: int) -> list[tuple[int, str, int]]:
        if attempt > len(self.delays):
            self._stop()
            return [(attempt, "given up", at)]
        self._wait(attempt, False, at + 1000 * self.delays[attempt - 1])
        return []

    @staticmethod
    def _frame(key: tuple, said: list[tuple[int, str, int]]) -> Iterator[pd.DataFrame]:
        if said:
            attempts, events, at = zip(*said, strict=True)
            yield pd.DataFrame({"id": key[0], "attempt": pd.Series(attempts, dtype="int32"), "event": events, "at": pd.to_datetime(pd.Series(at), unit="ms")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        said: list[tuple[int, str, int]] = []
        told = pd.concat(list(rows)).sort_values(["ms", "attempt"], kind="stable")
        for status, attempt, at in zip(told["status"], told["attempt"], told["ms"], strict=True):
            held = self.call.get() if self.call.exists() else None
            if status == "new" and held is None:
                said.append(self._send(1, int(at)))
            elif held is None or not held[1] or int(attempt) != held[0]:
                continue  # an answer to an attempt that is settled already
            elif status == "done":
                self._stop()
                said.append((held[0], "done", int(at)))
            elif status == "failed":
                said += self._fail(held[0], int(at))
        yield from self._frame(key, said)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        attempt, sent = self.call.get()
        yield from self._frame(key, self._fail(attempt, at) if sent else [self._send(attempt + 1, at)])


def retried(told: DataFrame, delays: tuple[int, ...] = DELAYS, patience: int = PATIENCE, late: str = "0 seconds") -> DataFrame:
    """(id, attempt, event, at) of a stream (id, status, attempt, at): when to send each attempt, when it was done or given up.

    ``status`` is ``new`` for a row to be sent first, and ``done`` or ``failed`` for the answer to an attempt; other values, answers to attempts that
    are settled and news of a row under way are ignored, as are null ids, attempts of answers and times.  A row may come
    ``late`` by so much.  The session needs the RocksDB state store.
    """
    ms = F.unix_millis(F.col("at").cast("timestamp")).alias("ms")
    rows = told.where("id is not null and at is not null and (status = 'new' or attempt is not null)").withWatermark("at", late)
    rows = rows.select(F.col("id").cast("string").alias("id"), F.col("status"), F.coalesce(F.col("attempt").cast("int"), F.lit(0)).alias("attempt"), ms, "at")
    return rows.groupBy("id").transformWithStateInPandas(_Retry(delays, patience), _OUT, "Append", "EventTime")
