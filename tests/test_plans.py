"""Plan shapes the scale design depends on, and a hot-group correctness check."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradewell.operators import analyze, rewards
from gradewell.plans.catalog import QUERIES
from gradewell.streaming.streams import stream_finance_rewards
from gradewell.sources.readers import stream_examples

from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _executed_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    try:
        return plan.finalPhysicalPlan().toString()
    except Exception:  # noqa: BLE001
        return plan.toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_products_or_row_udfs(spark, name):
    plan = _executed_plan(QUERIES[name](spark, SF_SMALL))
    for node in FORBIDDEN:
        assert node not in plan, (name, node)


@pytest.mark.parametrize("name", ["q_group_advantage", "q_best_of_group", "q_reward_summary", "q_finance_reward", "q_flatten_turns"])
def test_group_operators_use_no_window(spark, name):
    assert "Window" not in _executed_plan(QUERIES[name](spark, SF_SMALL))


def test_best_of_group_reduces_before_the_shuffle(spark):
    """A hot group sends one row per task: one exchange, below it a partial step."""
    from gradewell.operators import analyze

    df = spark.range(1000).selectExpr("id % 3 as g", "cast(id as double) as reward", "id")
    plan = _executed_plan(analyze.best_of_group(df, "g", "reward", ["id"]))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_min" in plan[plan.index("Exchange hashpartitioning") :]


@pytest.mark.parametrize("name", ["q_accuracy", "q_status_counts"])
def test_counting_builds_without_work(spark, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"build-{name}", name)
    QUERIES[name](spark, SF_SMALL)
    jobs = tracker.getJobIdsForGroup(f"build-{name}")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 1  # the footer read that gives the table's schema


def test_generations_join_no_prompt_text(spark):
    for name in ("q_news_from_prompt", "q_prompt_completion"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        join = plan.index("Join Inner")
        assert "lineitem" not in plan or "completion" not in plan
        assert "prompt#" not in plan[join : plan.index("\n", join)]


def test_scans_read_only_used_columns(spark):
    plan = _executed_plan(QUERIES["q_finance_reward"](spark, SF_SMALL))
    assert "l_quantity" not in plan and "l_shipdate" not in plan and "o_totalprice" not in plan


def test_hot_group_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    hot = pd.DataFrame({"g": 0, "c": np.arange(3000), "reward": rng.random(3000).round(3)})
    cold = pd.DataFrame({"g": np.repeat(np.arange(1, 1501), 4), "c": np.tile(np.arange(4), 1500), "reward": rng.random(6000).round(3)})
    pdf = pd.concat([hot, cold], ignore_index=True)  # one group holds a third of the rows
    df = spark.createDataFrame(pdf).repartition(7)
    got = analyze.group_advantage(df, "g", materialize=True).toPandas().sort_values(["g", "c"]).reset_index(drop=True)
    stats = pdf.groupby("g")["reward"].agg(["mean", "std", "min", "max", "count"])
    exp = pdf.join(stats, on="g")
    flat = (exp["count"] <= 1) | (exp["min"] == exp["max"])
    exp["advantage"] = np.where(flat, 0.0, (exp["reward"] - exp["mean"]) / (exp["std"] + 1e-4))
    exp = exp.sort_values(["g", "c"]).reset_index(drop=True)
    assert np.allclose(got["advantage"].to_numpy(), exp["advantage"].to_numpy(), atol=1e-9)
    best = analyze.best_of_group(df, "g", "reward", ["c"]).toPandas().set_index("g").sort_index()
    brute = pdf.sort_values(["g", "reward", "c"], ascending=[True, False, True]).groupby("g").head(1).set_index("g").sort_index()
    assert (best["c"].to_numpy() == brute["c"].to_numpy()).all()
    assert best.loc[0, "n_generations"] == 3000


def test_stream_finance_rewards_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "gens")
    os.makedirs(src)
    rows = [
        {"prompt_id": 1, "completion": "<REASONING>Revenue growth is strong; thus up.</REASONING>\n<SENTIMENT>positive</SENTIMENT>\n<CONFIDENCE>0.8</CONFIDENCE>"},
        {"prompt_id": 2, "completion": "no tags"},
    ]
    pd.DataFrame(rows).to_json(os.path.join(src, "1.json"), orient="records", lines=True)
    teacher = rewards.teacher_probabilities(
        spark.createDataFrame([(1, "news", [0.0, 0.0, 1.0]), (2, "", [1.0, 0.0, 0.0])], "prompt_id long, text string, logits array<double>"),
        "prompt_id",
    )
    schema = "prompt_id long, completion string"
    q = stream_finance_rewards(stream_examples(spark, src, schema), teacher, "prompt_id", os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"), available_now=True)
    q.awaitTermination(120)
    streamed = sorted((r.prompt_id, round(r.finance_reward, 9)) for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect())
    batch = sorted((r.prompt_id, round(r.finance_reward, 9)) for r in rewards.finance_reward(spark.read.schema(schema).json(src), teacher, "prompt_id").collect())
    assert streamed == batch and batch[1] == (2, 0.0) and batch[0][1] > 0
