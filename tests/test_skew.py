"""Joins on hot prompt keys (O-44, O-45)."""

import pytest
from pyspark.sql import functions as F

from gradewell.operators import rewards, skew


@pytest.fixture()
def tables(spark):
    rows = [(None if i % 11 == 0 else 0 if i % 3 == 0 else i, i, f"it is {i % 4}") for i in range(3_000)]
    refs = [(i, str(i % 4)) for i in range(0, 2_500)]
    return spark.createDataFrame(rows, "p bigint, i int, completion string"), spark.createDataFrame(refs, "p bigint, reference string")


def shown(df):
    return sorted(map(str, df.collect()))


def test_hot_keys_are_those_with_a_share(spark, tables):
    left, _ = tables
    want = spark.createDataFrame([(0,), (None,)], "p bigint").select(F.xxhash64("p").alias("h")).collect()
    assert skew.hot_keys(left, "p", 0.05) == sorted(r.h for r in want)
    assert skew.hot_keys(left, ["i"], 0.05) == []
    assert skew.hot_keys(left.limit(0), "p") == []
    with pytest.raises(ValueError, match="share"):
        skew.hot_keys(left, "p", 0)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_same_rows_as_the_plain_join_and_spread(spark, tables, how):
    left, right = tables
    hot = skew.hot_keys(left, "p", 0.05)
    assert shown(skew.salted_join(left, right, "p", hot, how, salts=8)) == shown(left.join(right, "p", how))
    assert shown(skew.salted_join(left, right, "p", [], how)) == shown(left.join(right, "p", how))
    dealt = left.withColumn("s", F.pmod(F.xxhash64("p", "i", "completion"), F.lit(8))).filter("p = 0")
    counts = [r["count"] for r in dealt.groupBy("s").count().collect()]
    assert len(counts) == 8 and max(counts) < 2 * min(counts)


def test_rewards_do_not_change(tables):
    left, right = tables
    hot = skew.hot_keys(left, "p", 0.05)
    assert hot
    assert shown(rewards.score_verifiable(left, right, "p", hot=hot)) == shown(rewards.score_verifiable(left, right, "p"))
