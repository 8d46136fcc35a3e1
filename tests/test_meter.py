"""The speed meter against a walk from sample to sample, in transfers of all densities, and spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from mediacat.operators import telemetry
from mediacat.operators.telemetry import GATE_SECONDS, NEW_WEIGHT, WINDOW_SECONDS


def walked(samples):
    """Speeds by event, one sample after another."""
    last, kept, speed, out = None, [], None, {}
    for us, event, total in sorted(samples):
        if last is None or us - last >= GATE_SECONDS * 1e6:
            last = us
            kept = [x for x in kept if us - x[0] <= WINDOW_SECONDS * 1e6] + [(us, total)]
            if len(kept) < 2:
                speed = None
            else:
                rate = max(total - kept[0][1], 0) / ((us - kept[0][0]) / 1e6)
                speed = rate if speed is None else NEW_WEIGHT * rate + (1 - NEW_WEIGHT) * speed
        out[event] = speed
    return out


def made():
    rnd = random.Random(2)
    event, transfers = 0, {}

    def add(name, gaps, start):
        nonlocal event
        us, total, rows = start, 0, []
        for gap in gaps:
            us += int(gap * 1e6)
            total += rnd.randint(-5, 100)
            event += 1
            rows.append((us, event, total))
        transfers[name] = rows

    add(1, [rnd.choice([0.01, 0.02, 0.013]) for _ in range(9000)], 59_900_000)  # dense, over many blocks without a pause
    add(2, [0.01] * 7000, 0)
    add(3, [rnd.expovariate(1) for _ in range(300)], 10**15)
    add(4, [rnd.choice([0.0, 0.03, 0.05, 2.9, 3.0, 3.1, 59.0, 120.0]) for _ in range(400)], 123)
    add(5, [rnd.choice([1000.0, 0.04, 20_000.0]) for _ in range(60)], 5)  # over many runs of blocks
    add(6, [2.95] * 700, 0)  # a few samples a block, averages over many blocks
    add(7, [0.0] * 40, 60_000_000)
    add(8, [rnd.choice([0.001, 0.049, 0.051]) for _ in range(4000)], -90_000_000)
    add(9, [0.5], 0)
    return transfers


@pytest.mark.parametrize("run_blocks", [256, 2])
def test_against_a_walk(spark, monkeypatch, run_blocks):
    monkeypatch.setattr(telemetry, "RUN_BLOCKS", run_blocks)
    transfers = made()
    rows = [(t, e, us, float(total)) for t, samples in transfers.items() for us, e, total in samples]
    df = spark.createDataFrame(rows, "transfer_id long, event_id long, us long, cumulative_bytes double")
    df = df.select("transfer_id", "event_id", F.timestamp_micros("us").alias("ts"), "cumulative_bytes").repartition(5)
    got = {(r.transfer_id, r.event_id): r.speed for r in telemetry.speed_meter(df).collect()}
    assert len(got) == len(rows)
    for t, samples in transfers.items():
        for e, speed in walked(samples).items():
            assert got[t, e] == (None if speed is None else pytest.approx(speed, rel=1e-9, abs=1e-9)), (t, e)


def test_plan_has_no_python_and_reads_by_blocks(spark):
    df = spark.createDataFrame([(1, 1, 0.0)], "transfer_id long, event_id long, cumulative_bytes double").withColumn("ts", F.timestamp_micros("event_id"))
    plan = telemetry.speed_meter(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_b#" in line for line in windows)
