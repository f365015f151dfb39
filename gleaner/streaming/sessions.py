"""Session calibration and guarded model updates on a feedback stream.

Events wait in keyed state until the watermark has passed them and are then
applied in (ts, event_id) order, so the result does not depend on arrival order
and equals the batch fold over the same events.  An event older than the
watermark comes out marked ``late`` and is not applied.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from gleaner import config as C
from gleaner.operators import updates
from gleaner.operators.rules import PRESETS

OUTPUT = (
    "session_id long, ts timestamp, event_id long, policy_shift string, threshold double,"
    " min_context int, token_budget int, streak int, late boolean"
)
_POLICY = "threshold double, min_context int, token_budget int, streak int"


def next_policy(state: tuple, shift: str, base: tuple) -> tuple:
    """One event on (threshold, min_context, token_budget, streak)."""
    threshold, floor, budget, streak = state
    if shift == "more_conservative":
        return (
            max(C.MIN_THRESHOLD, threshold - C.THRESHOLD_STEP_DOWN),
            min(C.MAX_MIN_CONTEXT, floor + C.MIN_CONTEXT_STEP),
            min(C.MAX_TOKEN_BUDGET, budget + C.TOKEN_BUDGET_STEP),
            0,
        )
    if shift == "more_aggressive":
        if streak + 1 >= C.STREAK_FOR_RELAXATION:
            return (min(C.MAX_THRESHOLD, threshold + C.THRESHOLD_STEP_UP), floor, budget, 0)
        return (threshold, floor, budget, streak + 1)
    if shift == "reset":
        return (*base, 0)
    return state


# Events wait in parts by the minute they happened in.
MINUTE_US = 60_000_000


class InOrder(StatefulProcessor):
    """Applies the events of a key in (time, id) order once the watermark has passed them.

    Events wait in a map from (minute, part) to the rows that one batch brought for that
    minute: each row is written once and read once, however many wait.  A key has one
    timer, at the end of its earliest waiting minute.  Subclasses say what an event is
    (``entry``, a list that begins with microseconds and id) and what it does (``apply``).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "minute long, part long", "rows string")
        self.parts = handle.getValueState("parts", "n long")
        self.timer = handle.getValueState("timer", "at long")

    def entry(self, row) -> list:
        raise NotImplementedError

    def apply(self, key, events: list[list]) -> pd.DataFrame | None:
        """Rows for events in order; the state is read and updated here."""
        raise NotImplementedError

    def late(self, key, events: list[list]) -> pd.DataFrame | None:
        """Rows for events behind the watermark, which are not applied."""
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        behind: list[list] = []
        fresh: dict[int, list[list]] = {}
        for frame in rows:
            for row in frame.itertuples(index=False):
                event = self.entry(row)
                if event[0] // 1000 < watermark:
                    behind.append(event)
                else:
                    fresh.setdefault(event[0] // MINUTE_US, []).append(event)
        if fresh:
            part = self.parts.get()[0] if self.parts.exists() else 0
            for minute, events in fresh.items():
                self.waiting.updateValue((minute, part), (json.dumps(events),))
            self.parts.update((part + 1,))
            self._wake_at(min(fresh))
        out = self.late(key, behind) if behind else None
        if out is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        places = sorted(tuple(k) for k in self.waiting.keys())
        due = [k for k in places if (k[0] + 1) * MINUTE_US // 1000 <= watermark]
        ready: list[list] = []
        for place in due:
            ready += json.loads(self.waiting.getValue(place)[0])
            self.waiting.removeKey(place)
        if len(due) < len(places):
            self._wake_at(places[len(due)][0])
        else:
            self.parts.clear()
        if ready:
            out = self.apply(key, sorted(ready, key=lambda e: e[:2]))
            if out is not None:
                yield out

    def _wake_at(self, minute: int) -> None:
        """One timer per key: at the end of the earliest waiting minute."""
        at = (minute + 1) * MINUTE_US // 1000
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is not None and held <= at:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


class Calibration(InOrder):
    """Keyed state: the current policy, and the events waiting for the watermark."""

    def __init__(self, base: tuple = PRESETS[C.DEFAULT_PRESET]):
        self.base = base

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.policy = handle.getValueState("policy", _POLICY)

    def entry(self, row) -> list:
        return [row.ts.value // 1000, row.event_id, row.policy_shift]

    def apply(self, key, events: list[list]) -> pd.DataFrame:
        state, out = self._current(), []
        for us, event_id, shift in events:
            state = next_policy(state, shift, self.base)
            out.append((pd.Timestamp(us, unit="us"), event_id, shift, *state, False))
        self.policy.update(state)
        return self._rows(key, out)

    def late(self, key, events: list[list]) -> pd.DataFrame:
        state = self._current()
        return self._rows(key, [(pd.Timestamp(us, unit="us"), event_id, shift, *state, True) for us, event_id, shift in events])

    def _current(self) -> tuple:
        return tuple(self.policy.get()) if self.policy.exists() else (*self.base, 0)

    @staticmethod
    def _rows(key, rows: list) -> pd.DataFrame:
        names = ["ts", "event_id", "policy_shift", "threshold", "min_context", "token_budget", "streak", "late"]
        frame = pd.DataFrame(rows, columns=names)
        frame.insert(0, "session_id", key[0])
        return frame.astype({"min_context": "int32", "token_budget": "int32", "streak": "int32"})


UPDATES = (
    "session_id long, ts timestamp, event_id long, accepted boolean, outcome string, coef_distance double,"
    " canary_before double, canary_after double, accepted_updates long, rejected_updates long, weights array<double>"
)


class GuardedUpdates(InOrder):
    """Keyed state: weights, canary recall and counters of a session; a reset clears them.

    The step is that of the batch replay (``operators.updates.Lockstep``), with one life.
    """

    def __init__(self, base: Sequence[float], canary: Sequence[Sequence[float]]):
        self.base = np.array(base, dtype=float)
        self.canary = np.array(canary, dtype=float).reshape(-1, len(self.base) - 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.model = handle.getValueState("model", "weights array<double>, recall double, accepted long, rejected long")

    def entry(self, row) -> list:
        labels = [
            [int(x["label_no"]), [float(v) for v in x["x"]], float(bool(x["relevant"])), float(x["weight"] or 0.0) * pull(x["provenance"])]
            for x in (row.labels if row.labels is not None else ())
            if x["x"] is not None
        ]
        return [row.ts.value // 1000, row.event_id, row.policy_shift, sorted(labels)]

    def apply(self, key, events: list[list]) -> pd.DataFrame | None:
        life = ("session", 0)
        state = updates.Lockstep(self.base, self.canary)
        at = state.rows_of([life])
        if self.model.exists():
            weights, state.recall[0], state.counts[0, 0], state.counts[0, 1] = self.model.get()
            state.weights[0] = weights
        out = []
        for us, event_id, shift, labels in events:
            if shift == "reset":
                state = updates.Lockstep(self.base, self.canary)
                at = state.rows_of([life])
                continue
            if not labels:
                continue
            _, x, y, strength = zip(*labels, strict=True)
            verdict, *figures = state.propose(at, np.array([len(labels)]), np.array(x), np.array(y), np.array(strength))
            found = [float(f[0]) for f in figures]
            counts = state.counts[0].tolist()
            out.append((key[0], pd.Timestamp(us, unit="us"), event_id, bool(verdict[0] == 0), updates.VERDICTS[verdict[0]], *found, *counts, state.weights[0].tolist()))
        self.model.update((state.weights[0].tolist(), float(state.recall[0]), *state.counts[0].tolist()))
        return pd.DataFrame(out, columns=[f.split()[0] for f in UPDATES.split(", ")]) if out else None


def pull(provenance: str | None) -> float:
    return C.WEIGHT_BY_PROVENANCE.get(provenance, C.DEFAULT_LABEL_WEIGHT)


def _ordered(events: DataFrame, columns: list[str], delay: str, processor: StatefulProcessor, output: str) -> DataFrame:
    # The watermark sits on a copy of the time: Spark drops late rows of the
    # watermarked column itself, and here they are to come out marked.
    return (
        events.withColumn("_mark", F.col("ts"))
        .withWatermark("_mark", delay)
        .select("session_id", "ts", "event_id", "policy_shift", *columns)
        .groupBy("session_id")
        .transformWithStateInPandas(
            statefulProcessor=processor,
            outputStructType=StructType.fromDDL(output),
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def calibrate_stream(
    decided: DataFrame, delay: str = "10 minutes", base: tuple = PRESETS[C.DEFAULT_PRESET]
) -> DataFrame:
    """``decided``: a stream of session_id, ts, event_id, policy_shift (see
    ``operators.sessions.attribute``, which works on streams as it is).

    Needs the RocksDB state store provider.
    """
    return _ordered(decided, [], delay, Calibration(base), OUTPUT)


def update_stream(
    labelled: DataFrame, base: Sequence[float], canary: Sequence[Sequence[float]], delay: str = "10 minutes"
) -> DataFrame:
    """Guarded model updates on a stream: the rows of ``operators.updates.replay``.

    ``labelled``: session_id, ts, event_id, policy_shift and ``labels``, an array of
    (label_no, x, relevant, weight, provenance); one row per event.  Labels without
    features are left out, events behind the watermark are not applied.
    """
    return _ordered(labelled, ["labels"], delay, GuardedUpdates(base, canary), UPDATES)


def labels_with_features(
    labels: DataFrame, decisions: DataFrame, delay: str = "10 minutes", horizon: str = "1 hour"
) -> DataFrame:
    """Feedback labels joined with the logged decisions that carry their features.

    ``labels``: session_id, ts, event_id, chunk_id, ...; ``decisions``: session_id, ts,
    chunk_id, x.  A label is about the decisions of the last ``horizon`` before it.  Both
    sides are streams with a watermark of ``delay``, so the state of either is dropped
    once the other can no longer reach it; a label without any such decision gives no
    row.  If a chunk was decided upon several times, each gives a row with
    ``decided_at``; the latest is the one to learn from.
    """
    left = labels.withWatermark("ts", delay).alias("l")
    logged = decisions.select(
        F.col("session_id").alias("_session"), F.col("chunk_id").alias("_chunk"), F.col("ts").alias("decided_at"), "x"
    )
    right = logged.withWatermark("decided_at", delay).alias("d")
    about = (
        (F.col("l.session_id") == F.col("d._session"))
        & (F.col("l.chunk_id") == F.col("d._chunk"))
        & (F.col("d.decided_at") <= F.col("l.ts"))
        & (F.col("d.decided_at") >= F.col("l.ts") - F.expr(f"interval {horizon}"))
    )
    return left.join(right, about).select("l.*", "d.decided_at", "d.x")


ROCKSDB = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
