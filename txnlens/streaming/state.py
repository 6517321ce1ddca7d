"""Keyed stream state with event-time timers: overdue events and unmatched labels, first-write-wins labels that expire, account velocity.

Every operator decides by event time only, so a stream that is stopped and started again, or read again from the start, says
the same. State is bounded by the settings: a key's timer clears what no later row can need. Rows behind the watermark are
dropped by Spark before they reach a key. The state store must be RocksDB (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3600
_US = 1_000_000


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this state store; set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


def _times(micros: list[int | None]) -> pd.Series:
    return pd.Series([None if m is None else np.datetime64(m, "us") for m in micros], dtype="datetime64[us]")


def _texts(values: list[str | None]) -> pd.Series:
    return pd.Series(values, dtype=object)


RECONCILED = "feedback_id string, outcome string, event_time timestamp, label_time timestamp, label int"


class _Reconcile(StatefulProcessor):
    """State of an id: its events and labels by time, each with what has been said about it."""

    def __init__(self, grace: int, wait: int, keep: int):
        self.grace, self.wait, self.keep = grace, wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # said: 0 nothing yet, 1 joined, 2 overdue
        self.events = handle.getMapState("events", "at long", "said int")
        self.labels = handle.getMapState("labels", "at long, label int", "joined boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = {k[0]: v[0] for k, v in self.events.iterator()}
        labels = {tuple(k): v[0] for k, v in self.labels.iterator()}
        known_events, known_labels = dict(events), dict(labels)
        timers = set()
        for batch in rows:
            for at, is_label, label in zip(_micros(batch["at"]).tolist(), batch["is_label"].tolist(), batch["label"].tolist(), strict=True):
                if is_label:
                    labels.setdefault((at, int(label)), False)
                    timers.add(at + self.wait)
                else:
                    events.setdefault(at, 0)
                    timers.add(at + self.grace)
                timers.add(at + self.keep)
        out = []
        for (at, label), joined in sorted(labels.items()):
            before = [e for e in events if e <= at]
            if before and not joined:
                labels[at, label] = True
                out.append(("joined", max(before), at, label))
            for e in before:
                events[e] = 1
        for e, said in events.items():
            if known_events.get(e) != said:
                self.events.updateValue((e,), (said,))
        for k, joined in labels.items():
            if known_labels.get(k) is not joined:
                self.labels.updateValue(k, (joined,))
        now = timerValues.getCurrentWatermarkInMs()
        for t in timers:  # one timer an instant; what is due already waits for the next advance
            self.handle.registerTimer(max(-(-t // 1000), now + 1))
        yield self._rows(key[0], out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        out = []
        for (at,), (said,) in list(self.events.iterator()):
            if said == 0 and at + self.grace <= now:
                said = 2
                self.events.updateValue((at,), (2,))
                out.append(("overdue", at, None, None))
            if at + self.keep <= now and said:
                self.events.removeKey((at,))
        for (at, label), (joined,) in list(self.labels.iterator()):
            if not joined and at + self.wait <= now:
                self.labels.removeKey((at, label))
                out.append(("unmatched", None, at, label))
            elif joined and at + self.keep <= now:
                self.labels.removeKey((at, label))
        yield self._rows(key[0], out)

    @staticmethod
    def _rows(feedback_id: str, out: list[tuple]) -> pd.DataFrame:
        label = pd.array([r[3] for r in out], dtype="Int32")
        return pd.DataFrame({"feedback_id": _texts([feedback_id] * len(out)), "outcome": _texts([r[0] for r in out]), "event_time": _times([r[1] for r in out]), "label_time": _times([r[2] for r in out]), "label": label})


def reconcile(events: DataFrame, labels: DataFrame, grace: timedelta = timedelta(days=7), lateness: timedelta = timedelta(hours=1), keep: timedelta = timedelta(days=30)) -> DataFrame:
    """(feedback_id, outcome, event_time, label_time, label) as each becomes certain.

    ``joined``: a label at or after its event; an event may get several. ``overdue``: the watermark has passed an event's
    grace and no valid label has come; if one comes later, ``joined`` follows. ``unmatched``: the watermark has passed a
    label by the lateness and no event at or before it has come. An id is forgotten ``keep`` after its events and labels,
    so a label that comes later than that is unmatched. Repeats of an event, or of a label with its time, count once; rows
    without an id, a time or, if labels, a label are left out.
    """
    if keep < grace:
        raise ValueError("events must be kept for their grace at least")
    delay = f"{int(lateness.total_seconds() * 1000)} milliseconds"
    e = events.select("feedback_id", F.col("event_time").cast("timestamp").alias("at"), F.lit(False).alias("is_label"), F.lit(0).alias("label"))
    y = labels.select("feedback_id", F.col("label_time").cast("timestamp").alias("at"), F.lit(True).alias("is_label"), F.col("label").cast("int").alias("label"))
    both = e.withWatermark("at", delay).unionByName(y.withWatermark("at", delay)).filter("feedback_id is not null and at is not null and label is not null")
    us = lambda d: int(d / timedelta(microseconds=1))
    return both.groupBy("feedback_id").transformWithStateInPandas(_Reconcile(us(grace), us(lateness), us(keep)), RECONCILED, "Append", "EventTime")


SETTLED = "feedback_id string, label int, label_time timestamp, outcome string"


class _Settle(StatefulProcessor):
    """State of an id: the label that came first, until it expires."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "label int, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["label_time", "label"], kind="stable")
        labels, outcomes = batch["label"].tolist(), []
        first = self.first.get() if self.first.exists() else None
        for label, at in zip(labels, _micros(batch["label_time"]).tolist(), strict=True):
            if first is None:
                first = (int(label), at)
                self.first.update(first)
                self.handle.registerTimer(max(-(-(at + self.keep) // 1000), timerValues.getCurrentWatermarkInMs() + 1))
                outcomes.append("accepted")
            else:
                outcomes.append("duplicate" if first[0] == int(label) else "conflict")
        yield pd.DataFrame({"feedback_id": _texts([key[0]] * len(batch)), "label": labels, "label_time": batch["label_time"].tolist(), "outcome": _texts(outcomes)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())


def settle_labels(labels: DataFrame, keep: timedelta = timedelta(days=90), lateness: timedelta = timedelta(hours=1)) -> DataFrame:
    """(feedback_id, label, label_time, outcome): accepted, duplicate or conflict, by the first label of each id.

    Within a batch labels go by time, then by value. An id is forgotten once the watermark is ``keep`` after its first
    label, as the stored labels are by their retention; state is the ids of that time. Rows without an id, a label or a
    time are left out.
    """
    src = labels.select("feedback_id", F.col("label").cast("int").alias("label"), F.col("label_time").cast("timestamp").alias("label_time")).filter("feedback_id is not null and label is not null and label_time is not null")
    src = src.withWatermark("label_time", f"{int(lateness.total_seconds() * 1000)} milliseconds")
    return src.groupBy("feedback_id").transformWithStateInPandas(_Settle(int(keep / timedelta(microseconds=1))), SETTLED, "Append", "EventTime")


VELOCITY = "account string, timestamp timestamp, amount double, transactions long, amount_sum double"


class _Velocity(StatefulProcessor):
    """State of an account: sums by second, an entry an hour, and the rows that wait for the watermark, an entry an hour too.

    A row comes out once the watermark has passed its second, when all that came before it is known. Sums over a range of
    seconds are differences of running sums over what is kept, so a row costs a binary search, however many there are.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "hour long", "at array<long>, n array<long>, v array<double>")
        self.waiting = handle.getMapState("waiting", "hour long", "at array<long>, amount array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        at, amount = _micros(batch["timestamp"]), batch["amount"].to_numpy(np.float64)
        hours = at // (_US * HOUR)
        for hour in np.unique(hours).tolist():
            some = hours == hour
            old = self.waiting.getValue((hour,)) if self.waiting.containsKey((hour,)) else ([], [])
            self.waiting.updateValue((hour,), (list(old[0]) + at[some].tolist(), list(old[1]) + [None if a != a else a for a in amount[some].tolist()]))
            old = self.sums.getValue((hour,)) if self.sums.containsKey((hour,)) else ([], [], [])
            seconds = np.concatenate([np.array(old[0], np.int64), at[some] // _US])
            n, v = np.concatenate([np.array(old[1], np.int64), np.ones(some.sum(), np.int64)]), np.concatenate([np.array(old[2], np.float64), np.nan_to_num(amount[some])])
            used, place = np.unique(seconds, return_inverse=True)
            self.sums.updateValue((hour,), (used.tolist(), np.bincount(place, n).astype(np.int64).tolist(), np.bincount(place, v).tolist()))
        self._wake(int(at.min()) // _US, timerValues)
        return iter(())

    def _wake(self, second: int, timerValues) -> None:
        self.handle.registerTimer(max((second + 1) * 1000, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        ready_at: list[int] = []
        ready: list[float | None] = []
        later = None
        for (hour,), (at, amount) in sorted(self.waiting.iterator()):
            if hour * HOUR >= now:
                later = min(at) if later is None else min(later, min(at))
                continue
            out = [t // _US < now for t in at]
            ready_at += [t for t, o in zip(at, out, strict=True) if o]
            ready += [a for a, o in zip(amount, out, strict=True) if o]
            rest = [(t, a) for t, a, o in zip(at, amount, out, strict=True) if not o]
            if rest:
                self.waiting.updateValue((hour,), ([t for t, _ in rest], [a for _, a in rest]))
                later = min(t for t, _ in rest) if later is None else min(later, min(t for t, _ in rest))
            else:
                self.waiting.removeKey((hour,))
        hours = sorted((h[0], s) for h, s in self.sums.iterator())
        seconds = np.concatenate([np.zeros(0, np.int64), *[np.array(s[0], np.int64) for _, s in hours]])
        n = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[np.array(s[1], np.int64) for _, s in hours]]))])
        v = np.concatenate([[0.0], np.cumsum(np.concatenate([np.zeros(0), *[np.array(s[2], np.float64) for _, s in hours]]))])
        for hour, _ in hours:  # no row to come is before the watermark
            if (hour + 1) * HOUR <= now - self.seconds:
                self.sums.removeKey((hour,))
        if later is not None:
            self._wake(later // _US, timerValues)
        t = np.array(ready_at, np.int64)
        to, since = np.searchsorted(seconds, t // _US), np.searchsorted(seconds, t // _US - self.seconds)
        amounts = pd.array([None if a is None else float(a) for a in ready], dtype="Float64")
        yield pd.DataFrame({"account": _texts([key[0]] * len(t)), "timestamp": t.astype("datetime64[us]"), "amount": amounts, "transactions": n[to] - n[since], "amount_sum": v[to] - v[since]})


def velocity(transactions: DataFrame, seconds: int = 86400, lateness: timedelta = timedelta(minutes=10)) -> DataFrame:
    """(account, timestamp, amount, transactions, amount_sum): what each account did in the ``seconds`` whole seconds before.

    Rows come out when the watermark has passed them, with all rows that are no later than the lateness counted, so they
    equal the batch windows whatever the order of arrival. Sums are exact to rounding. A null amount adds nothing, null
    accounts are one account, rows without a time are left out.
    """
    src = transactions.select(F.col("origin_account_id").cast("string").alias("account"), F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("amount").cast("double").alias("amount")).filter("timestamp is not null")
    src = src.withWatermark("timestamp", f"{int(lateness.total_seconds() * 1000)} milliseconds")
    return src.groupBy("account").transformWithStateInPandas(_Velocity(seconds), VELOCITY, "Append", "EventTime")
