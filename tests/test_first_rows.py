"""The first n rows without a task that holds them (O-21, O-24)."""

import datetime as dt
import random

import pytest

from gradewell.operators import sample


def low(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("n", [1, 7, 250, 499, 2_000, 2_999, 3_000, 9_999])
def test_equals_a_plain_sort(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(5)]), rng.choice([None, -0.5, 0.25, 9.0]), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "a int, b double, i int").repartition(5)
    got = sample.first_rows(df, n, ["a", "b", "i"], task_rows=40).collect()
    assert sorted(map(tuple, got), key=low) == sorted(rows, key=low)[:n]


@pytest.mark.parametrize("n", [100, 950, 1_700, 2_300])
def test_equal_rows_and_ties(spark, n):
    rows = [("a", 1)] * 900 + [("b", 2)] * 900 + [("b", 3)] * 300 + [(None, None)] * 400
    df = spark.createDataFrame(rows, "k string, v int").repartition(3)
    got = [tuple(r) for r in sample.first_rows(df, n, ["k"], task_rows=50).collect()]
    assert len(got) == n
    keys = sorted((r[:1] for r in rows), key=low)[:n]
    assert sorted((r[:1] for r in got), key=low) == keys
    assert all(got.count(r) <= rows.count(r) for r in set(got))


def test_dates_and_texts_are_keys(spark):
    rows = [(dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i % 50), f"é{i}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "at timestamp, t string, i int")
    got = sample.first_rows(df, 123, ["at", "t"], task_rows=10).collect()
    assert sorted(map(tuple, got)) == sorted(sorted(rows, key=lambda r: (r[0], r[1].encode()))[:123])


def test_no_rows_none_wanted_and_more_than_there_are(spark):
    df = spark.range(30)
    assert sample.first_rows(df.limit(0), 5, ["id"]).count() == 0
    assert sample.first_rows(df, 0, ["id"]).count() == 0
    assert sample.first_rows(df, 31, ["id"]).count() == 30


def test_a_large_sample_is_the_small_one(spark, monkeypatch):
    df = spark.range(2_000).withColumnRenamed("id", "k")
    want = sorted(r.k for r in sample.shuffle_sample(df, 700, "k", 42).collect())
    monkeypatch.setattr(sample, "TASK_ROWS", 60)
    assert sorted(r.k for r in sample.shuffle_sample(df, 700, "k", 42).collect()) == want
