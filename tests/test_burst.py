"""Burst states merged in any order equal one pass; features equal the array form."""

import random

import numpy as np
from pyspark.sql import functions as F

from sigspark.functions import burst
from sigspark.operators import features


def test_states_merge_in_any_order():
    rng = np.random.default_rng(3)
    v = rng.normal(size=500) * np.exp(-((np.arange(500) - 300) / 60) ** 2)
    cuts = [0, 7, 100, 101, 320, 500]
    parts = [burst.state_of(np.arange(a, b), v[a:b]) for a, b in zip(cuts, cuts[1:])]
    whole = burst.features(burst.state_of(np.arange(500), v), 1000.0)
    for seed in range(5):
        random.Random(seed).shuffle(parts)
        assert np.allclose(burst.features(burst.merged([burst.merged(parts[:2]), *parts[2:]]), 1000.0), whole)
    assert burst.features(burst.state_of(np.arange(0), np.zeros(0)), 1.0) == (None,) * 9
    assert np.allclose(burst.features(burst.merged([burst.state_of(np.arange(0), np.zeros(0)), *parts]), 1000.0), whole)


def test_sql_aggregate_equals_array_form(spark):
    rng = np.random.default_rng(5)
    arrays = [(rng.normal(size=n) * (1 + 3 * (i % 2))).tolist() for i, n in enumerate((1, 2, 40, 333))] + [[0.0] * 5]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "k int, samples array<double>")
    want = {r.k: r for r in features.burst_features_array(df, rate=500.0).collect()}
    burst.register(spark)
    df.select("k", F.posexplode("samples").alias("i", "v")).createOrReplaceTempView("burst_samples")
    parts = "SELECT k, burst_partial(i, v) AS part FROM burst_samples GROUP BY k, i DIV 16"
    got = spark.sql(f"SELECT k, burst_final(burst_merge(part), 500D) AS b FROM ({parts}) GROUP BY k").collect()
    assert len(got) == len(arrays)
    for r in got:
        assert np.allclose([r.b[c] for c in burst.FEATURES], [want[r.k][c] for c in burst.FEATURES], atol=1e-12)
