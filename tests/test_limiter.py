import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from scanforge.streaming import limiter

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def walked(rows, n, width):
    """One source after the other, request by request."""
    kept, state = [], {}
    for i, s, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        used, end = state.get(s, (0, None))
        if end is None or t > end:
            used, end = 0, t + timedelta(seconds=width)
        if used < n:
            used += 1
            kept.append(i)
        state[s] = (used, end)
    return sorted(kept)


def limited(spark, rows, n, width, parts=4):
    df = spark.createDataFrame(rows, "id long, source string, ts timestamp").repartition(parts)
    return sorted(r["id"] for r in limiter.rate_limit(df, n=n, window_seconds=width, order=["id"]).collect())


@pytest.mark.parametrize(("n", "width", "span"), [(1, 60, 4000), (3, 60, 4000), (2, 7, 4000), (2, 1000, 4000), (5, 0.25, 60)])
def test_same_as_walking_the_requests(spark, n, width, span):
    rng = random.Random(width)
    rows = []
    for i in range(900):
        source = "busy" if i % 3 == 0 else rng.choice(["a", "b", "c", None, "rare" + str(i % 40)])
        rows.append((i, source, START + timedelta(seconds=rng.choice([rng.randrange(span), rng.random() * span]))))
    rows += [(5000 + i, "busy", START + timedelta(seconds=100)) for i in range(50)]  # ties
    rows += [(6000 + i, "busy", None) for i in range(3)]
    assert limited(spark, rows, n, width) == walked(rows, n, width)


def test_end_of_a_window_is_inside(spark):
    rows = [(i, "s", START + timedelta(seconds=x)) for i, x in enumerate([0, 60, 60.000001, 120, 120.000001, 120.000002, 500])]
    assert limited(spark, rows, 1, 60) == [0, 2, 5, 6] == walked(rows, 1, 60)


def test_before_1970_and_empty(spark):
    rows = [(i, "s", datetime(1969, 12, 31, 23, 59, tzinfo=timezone.utc) + timedelta(seconds=x)) for i, x in enumerate(range(0, 200, 7))]
    assert limited(spark, rows, 2, 30) == walked(rows, 2, 30)
    assert limited(spark, [], 2, 30) == []


def test_rounds_grow_with_the_logarithm_of_the_chain(spark, monkeypatch):
    kept, real = [], limiter._kept
    monkeypatch.setattr(limiter, "_kept", lambda df: kept.append(1) or real(df))
    times = spark.range(0, 300).select(F.struct(F.lit("s").alias("source")).alias("_s"), (F.col("id") * 100).alias("_t"))
    assert limiter.window_starts(times, 100).count() == 150  # every second one
    assert len(kept) <= 18  # 8 levels and one empty, as many marks


def test_no_window_by_source_over_the_requests(spark):
    times = spark.range(0, 10).select(F.struct(F.lit("s").alias("source")).alias("_s"), F.col("id").alias("_t"))
    plan = limiter.successors(times, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "Python" not in plan
