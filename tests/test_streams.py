import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import updates as u
from gleaner.operators.scoring import LogisticModel, Scaler
from gleaner.streaming import sessions as s

START = dt.datetime(2024, 1, 1)
MODEL = LogisticModel(Scaler((0.0,) * 9, (1.0,) * 9), (3.0,) + (0.0,) * 12, 0.0)
LABEL = "label_no int, x array<double>, relevant boolean, weight double, provenance string"
EVENTS = f"session_id long, ts timestamp, event_id long, policy_shift string, labels array<struct<{LABEL.replace(' array', ':array').replace(' int', ':int').replace(' boolean', ':boolean').replace(' double', ':double').replace(' string', ':string')}>>"


def run(stream, tmp_path):
    (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out"))
        .trigger(availableNow=True).start().awaitTermination(180)
    )


def test_updates_on_a_stream_equal_the_batch_replay(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        session, ts = rng.randint(1, 3), START + dt.timedelta(seconds=20 * i)
        if rng.random() < 0.04:
            rows.append((session, ts, i, "reset", []))
            continue
        labels = [
            (k, None if rng.random() < 0.1 else [rng.gauss(0, 1) for _ in range(13)], rng.random() < 0.5, 1.0, rng.choice(["explicit_user_mark", "x"]))
            for k in range(rng.randint(0, 2))
        ]
        rows.append((session, ts, i, "none", labels))
    canary = [[1.0] + [rng.gauss(0, 0.3) for _ in range(12)] for _ in range(10)]
    first, second = rows[:60], rows[60:]
    rng.shuffle(first)
    rng.shuffle(second)
    flush = [(9, START + dt.timedelta(days=1), 900, "none", [])]
    late = [(1, START, 901, "none", [(0, [1.0] * 13, True, 1.0, "x")])]
    source = str(tmp_path / "in")
    for part in (first, second, flush, late):  # each run begins at the checkpoint of the one before
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        run(s.update_stream(spark.readStream.schema(EVENTS).parquet(source), MODEL.vector(), canary, "1 minute"), tmp_path)
    got = {(r.session_id, r.event_id): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    events = spark.createDataFrame(rows, EVENTS)
    flat = events.select("session_id", "ts", "event_id", "policy_shift", F.explode_outer("labels").alias("l"))
    batch = u.replay(flat.select("*", "l.*").filter("l is not null or policy_shift = 'reset'"), MODEL, canary).collect()
    assert got.keys() == {(r.session_id, r.event_id) for r in batch} and len(got) > 50
    for r in batch:
        own = got[r.session_id, r.event_id]
        assert (own.accepted, own.outcome, own.accepted_updates, own.rejected_updates) == (r.accepted, r.outcome, r.accepted_updates, r.rejected_updates)
        assert own.weights == pytest.approx(r.weights, abs=1e-9) and own.ts == r.ts


def test_labels_meet_early_and_late_decisions(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    labels = "session_id long, ts timestamp, event_id long, chunk_id string"
    decisions = "session_id long, ts timestamp, chunk_id string, x array<double>"
    batches = [
        ([(1, at(30), 1, "a"), (1, at(31), 2, "b"), (1, at(32), 3, "never")], [(1, at(10), "a", [1.0])]),
        ([], [(1, at(29), "b", [2.0]), (1, at(40), "a", [9.0])]),  # arrives after its label; after the label's time
        ([(1, at(200), 4, "a")], [(2, at(199), "a", [3.0]), (1, at(20), "never", [4.0])]),  # beyond the horizon; in time for its label
        ([(9, at(900), 9, "z")], [(9, at(900), "q", [0.0])]),
        ([(1, at(33), 5, "a")], []),  # behind the watermark
    ]
    for given, logged in batches:
        spark.createDataFrame(given, labels).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
        spark.createDataFrame(logged, decisions).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
        left = spark.readStream.schema(labels).parquet(str(tmp_path / "l"))
        right = spark.readStream.schema(decisions).parquet(str(tmp_path / "d"))
        run(s.labels_with_features(left, right, "5 minutes", "1 hour"), tmp_path)
    got = {(r.event_id, tuple(r.x)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(1, (1.0,)), (2, (2.0,))} <= got <= {(1, (1.0,)), (2, (2.0,)), (3, (4.0,))}


class Values:
    """Stand-ins for keyed state that count what is read."""

    def __init__(self):
        self.held, self.reads = {}, 0

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[0]

    def update(self, value):
        self.held[0] = value

    def clear(self):
        self.held.clear()

    def keys(self):
        return iter(list(self.held))

    def updateValue(self, key, value):
        self.held[key] = value

    def getValue(self, key):
        self.reads += 1
        return self.held[key]

    def removeKey(self, key):
        del self.held[key]


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Values())

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Values())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_each_waiting_event_is_read_once():
    import pandas as pd

    rng, handle, processor = random.Random(1), Handle(), s.Calibration()
    processor.init(handle)
    zero = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    rows = [(pd.Timestamp(START) + pd.Timedelta(milliseconds=rng.randrange(3_600_000)), i, rng.choice(["more_conservative", "more_aggressive", "reset"])) for i in range(100_000)]
    frame = pd.DataFrame(rows, columns=["ts", "event_id", "policy_shift"])
    for part in range(10):
        assert not list(processor.handleInputRows((1,), iter([frame[part::10]]), Clock(0)))
        assert len(handle.timers) == 1
    out, waiting = [], handle.states["waiting"]
    for now in range(zero, zero + 3_700_000, 200_000):
        for at in [t for t in handle.timers if t <= now]:
            handle.timers.discard(at)
            out += list(processor.handleExpiredTimer((1,), Clock(now), None))
    assert waiting.reads == 60 * 10 and not waiting.held and not handle.timers
    got = pd.concat(out)
    assert got["event_id"].tolist() == [r[1] for r in sorted(rows)] and len(got) == 100_000
    state = (*s.PRESETS["balanced"], 0)
    for _, _, shift in sorted(rows):
        state = s.next_policy(state, shift, s.PRESETS["balanced"])
    assert got.iloc[-1]["threshold"] == pytest.approx(state[0])
