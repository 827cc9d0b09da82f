"""Results do not depend on how the work is partitioned."""

import pytest

from gradewell.plans.catalog import QUERIES

from conftest import SF_SMALL

NAMES = ["q_group_advantage", "q_best_of_group", "q_number_results", "q_take_skip", "q_reward_summary", "q_verifiable_reward"]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", NAMES)
def test_partition_count_independent(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for parts in (1, 4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            results.append(_rows(QUERIES[name](spark, SF_SMALL)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]
    assert len(results[0]) > 0
