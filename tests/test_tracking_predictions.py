"""Live reward tracking (O-58) and the prediction store (O-33)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gradewell.operators import predictions, rewards
from gradewell.sources import readers
from gradewell.streaming import tracking

KIND = "at timestamp, g string, reward double, gate double"
NOON = dt.datetime(2026, 1, 1, 12)


def rows_at(*rows):
    return [(None if m is None else NOON + dt.timedelta(minutes=m), g, r, gate) for m, g, r, gate in rows]


def arrive(spark, folder, name, rows):
    """One file, put there whole."""
    out = f"{folder}-{name}"
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(out)
    part = next(f for f in os.listdir(out) if f.startswith("part-"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{out}/{part}", f"{folder}/{name}.parquet")


def track(spark, tmp_dir, **options):
    stream = readers.stream_examples(spark, f"{tmp_dir}/in", KIND, fmt="parquet", files_per_batch=1)
    job = tracking.track_rewards(
        stream, f"{tmp_dir}/out", f"{tmp_dir}/state", "at", ["g"], "reward", "gate", available_now=True, **options
    )
    job.await_all()


def shown(frame):
    return sorted((str(r.window_start), str(r.g), r.n, r.mean_reward, r.min_reward, r.max_reward, r.gate_rate) for r in frame.collect())


def test_tracking_equals_the_batch_result_and_goes_on_after_a_restart(spark, tmp_dir):
    files = [
        rows_at((0, "a", 1.0, 1.0), (5, "a", None, 0.0), (70, "b", 2.0, 1.0)),
        rows_at((1, "a", 4.0, 1.0), (80, None, 3.0, 0.0)),
        rows_at((75, "b", 8.0, 0.0), (2, "a", -1.0, 1.0)),
    ]
    for i, rows in enumerate(files[:2]):
        arrive(spark, f"{tmp_dir}/in", f"f{i}", rows)
    track(spark, tmp_dir)
    batch = lambda n: tracking.figures(
        tracking.running_rewards(spark.createDataFrame(sum(files[:n], []), KIND), "at", ["g"], "reward", "gate", "1 hour"), ["g"]
    )
    assert shown(tracking.current_rewards(spark, f"{tmp_dir}/out", ["g"])) == shown(batch(2))
    arrive(spark, f"{tmp_dir}/in", "f2", files[2])
    track(spark, tmp_dir)
    assert shown(tracking.current_rewards(spark, f"{tmp_dir}/out", ["g"])) == shown(batch(3))
    assert {(r.g, r.seen, r.late) for r in tracking.late_rows(spark, f"{tmp_dir}/out", ["g"]).collect()} == {("a", 4, 0), ("b", 2, 0), (None, 1, 0)}
    history = tracking.reward_history(spark, f"{tmp_dir}/out", ["g"]).filter("g = 'a'").orderBy("batch").collect()
    assert [r.n for r in history] == [2, 3, 4]  # a running count, a row for each batch that changed it


def test_late_rows_are_counted_not_added(spark, tmp_dir):
    arrive(spark, f"{tmp_dir}/in", "f0", rows_at((0, "a", 1.0, 1.0), (300, "b", 1.0, 1.0)))
    track(spark, tmp_dir, watermark="30 minutes")
    arrive(spark, f"{tmp_dir}/in", "f1", rows_at((1, "a", 9.0, 1.0), (2, "a", 9.0, 1.0), (301, "a", 5.0, 1.0), (None, "b", 1.0, 1.0)))
    track(spark, tmp_dir, watermark="30 minutes")
    late = {r.g: (r.seen, r.late) for r in tracking.late_rows(spark, f"{tmp_dir}/out", ["g"]).collect()}
    assert late == {"a": (4, 2), "b": (2, 1)}
    got = shown(tracking.current_rewards(spark, f"{tmp_dir}/out", ["g"]))
    assert [r[1:4] for r in got] == [("a", 1, 1.0), ("a", 1, 5.0), ("b", 1, 1.0)]


def counting(folder):
    """A predictor that leaves a file for each text it gets."""

    def factory():
        import hashlib
        import pathlib

        def predict(texts):
            for t in texts:
                if t == "bad":
                    raise ValueError("no prediction")
                pathlib.Path(folder, hashlib.sha256(t.encode()).hexdigest()).touch(exist_ok=False)
            return [[float(len(t)), 0.0, 0.0] for t in texts]

        return predict

    os.makedirs(folder)
    return factory


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, t string")


def test_only_unseen_texts_are_sent(spark, tmp_dir):
    store = predictions.PredictionStore(spark, f"{tmp_dir}/store", "m1")
    assert store.read().collect() == []
    factory = counting(f"{tmp_dir}/seen")
    store.update(texts(spark, "a", "bb", "a", None, ""), "t", factory)
    assert len(os.listdir(f"{tmp_dir}/seen")) == 2
    every = texts(spark, "bb", "ccc", "a", "ccc", "")
    found = store.update(every, "t", factory)  # touch(exist_ok=False) fails on a text sent twice
    assert len(os.listdir(f"{tmp_dir}/seen")) == 3
    store.update(every, "t", factory)
    assert [tuple(r) for r in store.history().orderBy("run").collect()] == [(0, 2), (1, 1)]
    joined = rewards.with_teacher(every, "t", found)
    assert {r.t: r.probs[0] for r in joined.collect()} == {"a": 1.0, "bb": 2.0, "ccc": 3.0, "": pytest.approx(1 / 3)}


def test_a_failed_run_leaves_nothing(spark, tmp_dir):
    store = predictions.PredictionStore(spark, f"{tmp_dir}/store")
    factory = counting(f"{tmp_dir}/seen")
    store.update(texts(spark, "a"), "t", factory)
    with pytest.raises(Exception):
        store.update(texts(spark, "fine", "bad"), "t", factory)
    assert len(store.runs()) == 1 and os.listdir(f"{tmp_dir}/store/parts") == store.runs()
    # a driver lost before its entry was written
    store.read().write.parquet(f"{tmp_dir}/store/parts/lost")
    assert store.read().count() == 1
    assert store.clean() == 1 and os.listdir(f"{tmp_dir}/store/parts") == store.runs()


def test_overlapping_runs_and_other_models(spark, tmp_dir):
    store = predictions.PredictionStore(spark, f"{tmp_dir}/store", "m1")
    factory = counting(f"{tmp_dir}/seen")
    store.update(texts(spark, "a", "b"), "t", factory)
    twin = store.read()
    twin.write.parquet(f"{tmp_dir}/store/parts/twin")
    store._commit("twin")
    assert store.read().count() == 2
    with pytest.raises(ValueError):
        predictions.PredictionStore(spark, f"{tmp_dir}/store", "m2").read()
    assert store.read().select(F.count_distinct("text_key")).first()[0] == 2
