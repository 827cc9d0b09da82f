"""Row index, slices, samples (O-20..O-24) and group analytics (O-47..O-52)."""

import pytest
from pyspark.sql import functions as F

from gradewell.operators import analyze, sample
from gradewell.sources.readers import pick_splits


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_row_index_dense_and_partition_independent(spark, parts):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(parts)
    idx, n = sample.with_row_index(df, ["k"])
    rows = idx.collect()
    assert n == 1000
    assert sorted(r.row_index for r in rows) == list(range(1000))
    assert all(r.row_index == r.k for r in rows)


def test_take_skip_disjoint_and_complete(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "k")
    out = sample.take_skip_split(df, ["k"]).collect()
    train = {r.k for r in out if r.split == "train"}
    val = {r.k for r in out if r.split == "validation"}
    assert len(train) == int(0.8 * 103) and len(out) == 103
    assert train | val == set(range(103)) and not train & val and max(train) < min(val)
    est = sample.take_skip_split(df, ["k"], estimated_total=50).collect()
    assert sum(r.split == "train" for r in est) == 40 and sum(r.split == "validation" for r in est) == 10


@pytest.mark.parametrize(
    "spec,n,bounds",
    [("val[:10%]", 1000, (0, 100)), ("train[:100]", 1000, (0, 100)), ("train[80%:]", 10, (8, 10)),
     ("train", 7, (0, 7)), ("train[-2:]", 7, (5, 7)), ("train[:5%]", 10, (0, 0))],
)
def test_slice_bounds(spec, n, bounds):
    assert sample.SliceSpec.parse(spec).bounds(n) == bounds


def test_slice_split_rows(spark):
    df = spark.range(0, 20).withColumnRenamed("id", "k")
    assert [r.k for r in sample.slice_split(df, "x[:25%]", ["k"]).orderBy("k").collect()] == [0, 1, 2, 3, 4]


def test_shuffle_sample_independent_of_partitioning(spark):
    base = spark.range(0, 500).withColumnRenamed("id", "k")
    a = [r.k for r in sample.shuffle_sample(base.repartition(1), 20, "k").collect()]
    b = [r.k for r in sample.shuffle_sample(base.repartition(7), 20, "k").collect()]
    assert sorted(a) == sorted(b) and len(a) == 20


def test_cap_and_filter(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(10)], "k int, token_len int")
    assert [r.k for r in sample.cap(df, 3, ["k"]).collect()] == [0, 1, 2]
    assert sample.cap(df, 0, ["k"]).count() == 10
    assert sample.filter_token_len(df, 50).count() == 6  # inclusive


@pytest.mark.parametrize(
    "names,expected",
    [(["train_sft", "test_sft", "train", "test"], ("train_sft", "test_sft")),
     (["train", "validation", "test"], ("train", "validation")),
     (["train"], ("train", None)), (["test"], ("test", None)),
     (["my_train", "my_valid"], ("my_train", "my_valid"))],
)
def test_pick_splits_golden(names, expected):
    assert pick_splits(names) == expected


def test_group_advantage(spark):
    rows = [(1, 1, 0.1), (1, 2, 0.5), (1, 3, 0.9), (2, 1, 0.3), (3, 1, 0.2), (3, 2, 0.2)]
    df = spark.createDataFrame(rows, "g int, c int, reward double")
    for materialize in (False, True):
        out = {(r.g, r.c): r.advantage for r in analyze.group_advantage(df, "g", materialize=materialize).collect()}
        assert sum(out[(1, c)] for c in (1, 2, 3)) == pytest.approx(0.0, abs=1e-12)
        assert out[(1, 3)] == pytest.approx(0.4 / (0.4 + 1e-4))
        assert out[(2, 1)] == 0.0 and out[(3, 1)] == 0.0 and out[(3, 2)] == 0.0


def test_best_of_group_ties(spark):
    rows = [(1, 5, 9, 0.5), (1, 3, 1, 0.5), (1, 3, 0, 0.5), (1, 1, 1, 0.4), (2, 1, 1, 0.1)]
    df = spark.createDataFrame(rows, "g int, a int, b int, reward double")
    out = {r.g: r for r in analyze.best_of_group(df, "g", "reward", ["a", "b"]).collect()}
    assert (out[1].a, out[1].b, out[1].n_generations) == (3, 0, 4)
    assert (out[2].a, out[2].reward) == (1, 0.1)


def test_best_checkpoint_and_curve(spark):
    log = spark.createDataFrame(
        [(1, 2.0, None, None, None), (2, 1.5, 0.1, None, 0.9), (3, None, None, None, 0.5), (4, 1.0, None, 0.2, 0.5)],
        "step long, loss double, reward double, kl double, eval_loss double",
    )
    best = analyze.best_checkpoint(log).first()
    assert (best.best_step, best.best_eval_loss, best.n_evaluations, best.last_eval_step) == (3, 0.5, 3, 4)
    assert [r.step for r in analyze.training_curve(log).orderBy("step").collect()] == [1, 2, 4]
    assert [r.step for r in analyze.last_checkpoints(log, 2).collect()] == [4, 3]


def test_accuracy_list_truth(spark):
    df = spark.createDataFrame(
        [(" Yes ", ["yes", "y"], "success"), ("no", ["yes"], "success"), ("ERROR: x", ["x"], "error")],
        "model_answer string, ground_truth array<string>, processing_status string",
    )
    row = analyze.accuracy(df).first()
    assert (row.n_samples, row.n_success, row.n_error, row.n_correct) == (3, 2, 1, 1)
    assert row.accuracy == pytest.approx(1 / 3, abs=1e-6)


def test_reward_summary_rollup_and_cube(spark):
    df = spark.createDataFrame(
        [("a", "x", 1.0, 1.0), ("a", "y", 0.0, 0.0), ("b", "x", 0.5, 1.0)], "s string, t string, reward double, gate double"
    )
    roll = analyze.reward_summary(df, ["s"], "reward", [], grouping="rollup").collect()
    assert sorted(((r.s, r.n, r.is_total) for r in roll), key=str) == sorted([("a", 2, 0), ("b", 1, 0), (None, 3, 1)], key=str)
    cube = analyze.reward_summary(df, ["s", "t"], "reward", [], grouping="cube").collect()
    assert len(cube) == 3 + 2 + 2 + 1
    total = [r for r in cube if r.is_total == 3][0]
    assert total.n == 3 and total.mean_reward == 0.5 and total.gate_rate == pytest.approx(2 / 3, abs=1e-6)


def test_number_results_skips_and_limit(spark):
    from gradewell.operators.compare import number_results

    rows = [(i, None if i in (1, 4) else f"img/{i}.png", "error" if i == 3 else "success", "a", "boom" if i == 3 else None) for i in range(8)]
    df = spark.createDataFrame(rows, "k int, image_path string, processing_status string, model_answer string, error_message string")
    out = {r.k: r for r in number_results(df, ["k"]).collect()}
    assert sorted(out) == [0, 2, 3, 5, 6, 7]
    assert [out[k].sample_id for k in (0, 2, 3, 5, 6, 7)] == [0, 1, 2, 3, 4, 5]
    assert [out[k].dataset_index for k in (0, 2, 3)] == [0, 2, 3]
    assert out[3].model_answer == "ERROR: boom"
    limited = number_results(df, ["k"], max_samples=3).collect()
    assert sorted(r.k for r in limited) == [0, 2, 3]


def test_row_index_joins_other_columns(spark):
    df = spark.createDataFrame([(i % 7, i, f"t{i}") for i in range(50)], "a int, b int, text string")
    idx, n = sample.with_row_index(df, ["a", "b"], "place")
    rows = idx.orderBy("place").collect()
    assert n == 50 and [(r.a, r.b) for r in rows] == sorted((i % 7, i) for i in range(50))
    assert all(r.text == f"t{r.b}" for r in rows)


def test_slices_may_overlap(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    out = sample.split_by_slices(df, {"a": "x[:60%]", "b": "x[4:]", "none": "x[:0]"}, ["k"]).collect()
    assert sorted((r.split, r.k) for r in out) == [("a", k) for k in range(6)] + [("b", k) for k in range(4, 10)]


def test_three_way_split(spark):
    train, held = spark.range(11).withColumnRenamed("id", "k"), spark.range(100, 103).withColumnRenamed("id", "k")
    out = sample.three_way_split(train, held, ["k"]).collect()
    assert sorted(r.k for r in out if r.split == "test") == [100, 101, 102]
    assert sum(r.split == "train" for r in out) == 8 and sum(r.split == "validation" for r in out) == 3


def test_best_of_group_string_ties_and_exact_order(spark):
    rows = [(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.5000004), (2, "z", 0.1), (2, "y", 0.1), (3, "n", None)]
    df = spark.createDataFrame(rows, "g int, id string, reward double")
    got = {r.g: (r.id, r.reward, r.n_generations) for r in analyze.best_of_group(df, "g", "reward", ["id"]).collect()}
    assert got == {1: ("c", 0.5000004, 3), 2: ("y", 0.1, 2), 3: ("n", None, 1)}


@pytest.mark.parametrize("seed", range(4))
def test_every_row_is_numbered_once(spark, seed):
    """Null and repeated keys, rows that are equal altogether, maps."""
    import random

    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), {"m": rng.randint(0, 1)}) for _ in range(rng.randint(1, 120))]
    df = spark.createDataFrame(rows, "k int, t string, m map<string,int>").repartition(5)
    indexed, n = sample.with_row_index(df, ["k"])
    got = sorted(indexed.collect(), key=lambda r: r.row_index)
    assert n == len(rows) and [r.row_index for r in got] == list(range(n))
    assert [r.k for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    text = lambda r: repr((r[0], r[1], r[2]))
    assert sorted(map(text, got)) == sorted(map(text, rows))
    keys, n = sample.with_row_index(df.select("k"), ["k"])
    assert n == len(rows) and sorted(r.row_index for r in keys.collect()) == list(range(n))


def test_many_equal_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sample, "_COPIES", 10)
    df = spark.range(100).selectExpr("if(id < 95, 7, cast(null as int)) as k", "if(id < 95, 'x', 'y') as t")
    got = sorted(sample.with_row_index(df, ["k"])[0].collect(), key=lambda r: r.row_index)
    assert [(r.k, r.t, r.row_index) for r in got] == [(None, "y", i) for i in range(5)] + [(7, "x", i) for i in range(5, 100)]


def test_results_of_repeated_samples_keep_their_numbers(spark):
    rows = [(1, "p", "ok", "a", None), (1, "p", "ok", "a", None), (1, None, "ok", "b", None), (None, "q", "error", "c", "bad"), (2, "r", "ok", "d", None)]
    df = spark.createDataFrame(rows, "id int, image_path string, processing_status string, model_answer string, error_message string")
    from gradewell.operators import compare

    got = compare.number_results(df, ["id"]).collect()
    assert sorted(r.sample_id for r in got) == [0, 1, 2, 3]
    assert {(r.id, r.sample_id, r.dataset_index) for r in got if r.id != 1} == {(None, 0, 0), (2, 3, 4)}
    assert sorted(r.dataset_index for r in got if r.id == 1) in ([1, 2], [2, 3])
    assert len(compare.number_results(df, ["id"], max_samples=2).collect()) == 2
