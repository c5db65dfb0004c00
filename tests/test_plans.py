"""Scans, salted joins and ranks against brute force, on skewed groups."""

import random

from pyspark.sql import functions as F

from mediaspark.plans.skew import block_scan, group_rank, hot_join, salted_join, top_per_group


def skewed(rng):
    rows = [("hot", i + 1, rng.randrange(100)) for i in range(400)]
    return rows + [(f"p{g}", i + 1, rng.randrange(100)) for g in range(20) for i in range(rng.randrange(1, 30))]


def test_block_scan_equals_plain_running_values(spark):
    rows = skewed(random.Random(5))
    df = spark.createDataFrame(rows, "g string, n int, x int")
    out = {}
    for block in (16, 10_000):
        scan = block_scan(
            df, ["g"], "n",
            {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "lo": ("min", F.col("x")), "c": ("count", F.lit(1))},
            {"p": F.col("x")}, block=block,
        )
        out[block] = sorted(tuple(r) for r in scan.collect())
    assert out[16] == out[10_000]
    expected = []
    for g in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == g)
        for i, r in enumerate(own):
            before = [x for _, _, x in own[:i]]
            expected.append((*r, sum(before), max(before, default=None), min(before, default=None), i, before[-1] if before else None))
    assert out[16] == sorted(expected)


def test_salted_join_matches_plain_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(300)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, salted_join(left, right, ["k"], how, salts=5).collect()))
        assert a == sorted(map(str, left.join(right, ["k"], how).collect()))


def test_group_rank_over_many_partitions(spark):
    rng = random.Random(1)
    names = [f"n{rng.randrange(10**6):06d}" for _ in range(500)]
    df = spark.createDataFrame([("hot" if i % 3 else "cold", n) for i, n in enumerate(sorted(set(names)))], "g string, n string")
    got = group_rank(df, ["g"], ["n"]).collect()
    for g in ("hot", "cold"):
        own = sorted((r["rank"], r["n"]) for r in got if r["g"] == g)
        assert [r for r, _ in own] == list(range(1, len(own) + 1))
        assert [n for _, n in own] == sorted(n for _, n in own)


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    top = top_per_group(df, ["g"], [F.desc("id")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in top.collect()) == [994, 995, 996, 997, 998, 999]


def test_hot_join_copies_hot_keys_only(spark):
    rows = skewed(random.Random(6))
    left = spark.createDataFrame(rows, "g string, n int, x int")
    right = spark.createDataFrame([(g, i) for i, g in enumerate(sorted({r[0] for r in rows})) if g != "p3"], "g string, wide int")
    counts = left.groupBy("g").agg(F.count("*").alias("n"))
    got = hot_join(left, right, "g", counts, ["n"], rows=50)
    assert sorted(map(tuple, got.select("g", "n", "x", "wide").collect())) == sorted(map(tuple, left.join(right, "g").select("g", "n", "x", "wide").collect()))
