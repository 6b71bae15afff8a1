"""Alerts on a stream: each minute is scored as it closes, against the minutes before it that the query's state keeps.

The state is a list of up to HISTORY closed minutes, the open ones, and the newest time, by key; it lives in the checkpoint, so a query that stops and
starts again knows its history and fires no alert twice. Records are counted by minute within each task first: a few rows a batch reach a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from datetime import UTC, datetime
from statistics import fmean, stdev

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.anomaly import SEVERITY, Detector

HISTORY = 240  # minutes that alerts look back on
POINT = "key string, epoch long, label string, value long, baseline_mean double, baseline_sd double, zscore double, direction string, severity string"


def use_state_store(spark: SparkSession) -> None:
    """State with lists and maps needs the RocksDB store; a session that names a store keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def minute_parts(records: DataFrame, by: Column | None = None) -> DataFrame:
    """key, epoch, n: records by minute, counted within batches of a task. Their sums are the counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pa.Table.from_batches([batch]).group_by(["key", "epoch"]).aggregate([([], "count_all")]).select(["key", "epoch", "count_all"]).rename_columns(["key", "epoch", "n"]).to_batches()

    key = F.lit("all") if by is None else F.coalesce(by.cast("string"), F.lit(""))
    rows = records.filter("ts is not null").select(key.alias("key"), (F.floor(F.unix_timestamp("ts") / 60) * 60).alias("epoch"))
    return rows.mapInArrow(counted, "key string, epoch long, n long")


def score_next(history: list[int], value: int, d: Detector) -> tuple[float, float, float] | None:
    """Baseline mean and sd of the values before ``value`` and its z-score, or None with too few of them."""
    before = history[-d.window :] if d.method == "rolling" else history
    if len(before) < max(d.min_history, 1):
        return None
    if d.method == "rolling":
        mean, sd = fmean(before), stdev(before) if len(before) > 1 else 0.0
    else:
        mean, var = float(before[0]), 0.0
        for v in before:
            step = v - mean
            mean, var = mean + d.alpha * step, (1 - d.alpha) * var + d.alpha * step * step
        sd = var**0.5
    return mean, sd, (value - mean) / (sd if sd > 0 else 1.0)


class MinuteAlerts(StatefulProcessor):
    """Counts open minutes, closes those that the newest time has left behind by the delay, in order, and scores them. A late row is added to its minute, which isn't scored again."""

    def __init__(self, detector: Detector, delay: int, fill_gaps: bool):
        self.detector, self.delay, self.fill_gaps = detector, delay, fill_gaps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closed = handle.getListState("closed", "epoch long, n long")
        self.open = handle.getMapState("open", "epoch long", "n long")
        self.newest = handle.getValueState("newest", "epoch long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        history = {int(e): int(n) for e, n in self.closed.get()} if self.closed.exists() else {}
        first, last = (min(history), max(history)) if history else (0, None)
        fresh: dict[int, int] = {}
        for part in rows:
            for epoch, n in zip(part["epoch"].tolist(), part["n"].tolist(), strict=True):
                fresh[epoch] = fresh.get(epoch, 0) + n
        if not fresh:
            return
        newest = max(*fresh, int(self.newest.get()[0]) if self.newest.exists() else min(fresh))
        for epoch, n in fresh.items():
            if last is None or epoch > last:
                was = self.open.getValue((epoch,))[0] if self.open.containsKey((epoch,)) else 0
                self.open.updateValue((epoch,), (int(was) + n,))
            elif epoch >= first:
                history[epoch] = history.get(epoch, 0) + n
        minutes = sorted(history.items())
        ready = sorted(int(e) for (e,) in self.open.keys() if e + 60 + self.delay <= newest)
        found = []
        for epoch in ready:
            n = int(self.open.getValue((epoch,))[0])
            self.open.removeKey((epoch,))
            if self.fill_gaps and minutes:  # an empty minute is no spike, so only those that this one looks back on are needed
                minutes += [(e, 0) for e in range(max(minutes[-1][0] + 60, epoch - 60 * HISTORY), epoch, 60)]
            scored = score_next([v for _, v in minutes[-HISTORY:]], n, self.detector)
            if scored and scored[2] >= self.detector.limit:
                mean, sd, z = scored
                grade = next((name for least, name in SEVERITY if abs(z) >= least), "low")
                found.append((key[0], epoch, datetime.fromtimestamp(epoch, UTC).strftime("%Y-%m-%d %H:%M"), n, round(mean, 2), round(sd, 2), round(z, 2), "up", grade))
            minutes.append((epoch, n))
        if minutes:
            self.closed.put(minutes[-HISTORY:])
        self.newest.update((newest,))
        if found:
            yield pd.DataFrame(found, columns=[x.split()[0] for x in POINT.split(", ")])

    def close(self) -> None:
        pass


def alerts(records: DataFrame, detector: Detector = Detector(), delay_seconds: int = 120, by: Column | None = None, fill_gaps: bool = False) -> DataFrame:
    """Flagged minutes of a stream of records as rows of POINT, for outputMode append; by the values of ``by``, or all together.

    A minute closes when one that begins ``delay_seconds`` or more after its end has come; with a delay of -60 at the end of the batch that
    brings it, for streams that end.
    """
    use_state_store(records.sparkSession)
    d = replace(detector, mode="spikes", window=min(detector.window, HISTORY - 1))
    return minute_parts(records, by).groupBy("key").transformWithStateInPandas(MinuteAlerts(d, delay_seconds, fill_gaps), POINT, "Append", "None")
