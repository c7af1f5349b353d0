"""Keyed state of streaming run-length encoding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


class IntervalProcessor(StatefulProcessor):
    """The open interval of a key and its samples that the watermark has not passed.

    A timer always stands at the first waiting sample, so all that the watermark has passed
    are encoded in the batch that moved it.
    """

    def __init__(self, key: str, held: str, interval: str, idle: int | None) -> None:
        self.idle = idle
        self.held = StructType.fromDDL(held)
        self.interval = StructType.fromDDL(interval)
        self.columns = [key, *self.interval.names]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.interval)
        self.waiting = handle.getListState("waiting", self.held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part[self.held.names].astype(object)
            found = part.where(part.notna(), None).values.tolist()
            if found:
                self.waiting.appendList([tuple(r) for r in found])
                earliest = min(r[0] for r in found)
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in held if r[0] <= passed]
        if ready:
            rest = [r for r in held if r[0] > passed]
            self.waiting.clear()
            if rest:
                self.waiting.appendList([tuple(r) for r in rest])
                self._wake(min(r[0] for r in rest))
        current = tuple(self.open.get()) if self.open.exists() else None
        done = []
        for t, label, *_ in sorted(ready, key=_place):
            if current and label == current[2] and not self._silent(current, t):
                current = (current[0], t, label, current[3] + 1)
                continue
            if current:
                done.append(current)
            current = (t, t, label, 1)
        if current and self.idle is not None and passed >= current[1] + self.idle:
            # whatever follows comes after the watermark, hence too late to join
            done.append(current)
            current = None
        if current is None:
            self.open.clear()
        elif ready:
            self.open.update(current)
            if self.idle is not None:
                self._wake(current[1] + self.idle)
        if done:
            yield pd.DataFrame([(*key, *iv) for iv in done], columns=self.columns).astype(
                {"b": "int64", "e": "int64", "n": "int64"}
            )

    def close(self) -> None:
        pass

    def _silent(self, current: tuple, t: int) -> bool:
        return self.idle is not None and t - current[1] > self.idle

    def _wake(self, t: int) -> None:
        """A timer for the millisecond in which the watermark has passed ``t``."""
        self.handle.registerTimer(-(-t // 1000))


def _place(row: tuple) -> list[tuple]:
    """Order of a sample: time, then the order columns, nulls first as Spark sorts them."""
    return [(v is not None, v if v is not None else 0) for i, v in enumerate(row) if i != 1]
