import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import sessions as s
from gleaner.streaming.sessions import calibrate_stream, next_policy

START = dt.datetime(2024, 1, 1)
DECIDED = "session_id long, ts timestamp, event_id long, policy_shift string"
BASE = (0.5, 2, 2000)


def log(kinds, session=1, every=60):
    return [(session, START + dt.timedelta(seconds=every * i), i, k) for i, k in enumerate(kinds)]


def states(df, **options):
    return {(r.session_id, r.event_id): (tuple(r.before), tuple(r.after)) for r in s.calibrate(df, **options).collect()}


def brute(rows):
    at, out = {}, {}
    for session, ts, i, shift in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        before = at.get(session, (*BASE, 0))
        at[session] = next_policy(before, shift, BASE)
        out[session, i] = (before, at[session])
    return out


def test_bounds(spark):
    rows = log(["more_conservative"] * 200, 1) + log(["more_aggressive"] * 200, 2) + log(["more_aggressive"] * 2 + ["more_conservative"], 3)
    got = states(spark.createDataFrame(rows, DECIDED))
    assert got[1, 199][1][:3] == (0.15, 6, 6000)
    assert got[2, 199][1][0] == 0.85
    assert got[3, 1][1] == (0.5, 2, 2000, 2) and got[3, 2][1] == (0.45, 3, 2200, 0)


def test_hot_session_is_folded_in_blocks(spark):
    rng = random.Random(4)
    kinds = ["more_conservative", "more_aggressive", "more_aggressive", "more_aggressive", "none", "reset"]
    rows = []
    for i in range(1500):  # one session holds most of the log
        rows.append((1 if rng.random() < 0.7 else rng.randint(2, 5), START + dt.timedelta(seconds=i // 4), i, rng.choices(kinds, [3, 9, 9, 9, 2, 0.3])[0]))
    got = states(spark.createDataFrame(rows, DECIDED).repartition(5), slices=4, block_events=8)
    want = brute(rows)
    assert got.keys() == want.keys()
    for key, pair in got.items():
        for a, b in zip(pair, want[key]):
            assert a == pytest.approx(b, abs=1e-9)


def test_prefix_does_not_change(spark):
    rows = log(["more_conservative", "more_aggressive", "none"] * 10)
    short = states(spark.createDataFrame(rows[:12], DECIDED))
    long = states(spark.createDataFrame(rows, DECIDED))
    assert all(long[k] == v for k, v in short.items())


EVENTS = "session_id long, ts timestamp, event_id long, event_type string, improved boolean, cited array<string>, chunk_id string, grounded boolean"


def test_attribution_and_history(spark):
    kinds = [
        ("regenerate", None, None, None, None), ("thumbs_down", None, None, None, None), ("retry", False, ["x"], None, None),
        ("retry", True, ["b", "a"], None, None), ("mark_irrelevant", None, None, "z", None), ("accept", None, None, None, True),
        ("accept", None, None, None, False), ("reset", None, None, None, None),
    ]
    df = spark.createDataFrame([(1, START + dt.timedelta(minutes=i), i, *k) for i, k in enumerate(kinds)], EVENTS)
    got = {r.event_id: r for r in s.adapt(df).collect()}
    assert [got[i].policy_shift for i in range(8)] == ["none", "none", "none", "more_conservative", "none", "more_aggressive", "none", "reset"]
    assert [(x.chunk_id, x.relevant, x.provenance) for x in got[3].labels] == [("a", True, "counterfactual_restore"), ("b", True, "counterfactual_restore")]
    assert got[4].labels[0].provenance == "explicit_user_mark" and not got[4].labels[0].relevant
    assert got[0].history.startswith("no update: regenerated")
    assert got[3].history.splitlines()[0] == "verified failure: more conservative — threshold 0.50->0.45, min_context 2->3, token_budget 2000->2200"
    assert got[4].history == "label recorded: z relevant=False (confidence=high, provenance=explicit_user_mark)"
    assert got[5].history.startswith("success recorded (1/3") and got[7].after.threshold == 0.5
    assert s.label_store(s.attribute(df)).count() == 3
    with pytest.raises(Exception, match="unhandled feedback event type"):
        s.attribute(df.withColumn("event_type", F.lit("odd"))).collect()


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    kinds = ["more_conservative", "more_aggressive", "more_aggressive", "none"]
    rows = [(rng.randint(1, 3), START + dt.timedelta(seconds=20 * i), i, rng.choice(kinds)) for i in range(120)]
    first, second = rows[:60], rows[60:]
    rng.shuffle(first)
    rng.shuffle(second)
    flush = [(9, START + dt.timedelta(days=1), 900, "none")]
    late = [(1, START, 901, "more_conservative")]
    source = str(tmp_path / "in")
    for part in (first, second, flush, late):
        spark.createDataFrame(part, DECIDED).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(DECIDED).parquet(source)
        (
            calibrate_stream(stream, "1 minute").writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out"))
            .trigger(availableNow=True).start().awaitTermination(180)
        )
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {(r.session_id, r.event_id): (r.threshold, r.min_context, r.token_budget, r.streak) for r in out if not r.late}
    want = {k: after for k, (_, after) in brute(rows).items()}
    assert {k: v for k, v in got.items() if k[0] != 9} == want
    assert [r.event_id for r in out if r.late] == [901]
