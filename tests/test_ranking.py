import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from wavehold.plans import quantiles as q, ranking as r


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; values repeat."""
    rng = np.random.default_rng(0)
    data = [(int(k), ("hot" if k % 3 else f"g{k % 5}"), float(np.round(rng.normal(), 1))) for k in range(3000)]
    return spark.createDataFrame(data, "id long, g string, v double").repartition(7)


def test_row_number_and_running_sum_match_plain_windows(skewed):
    w = Window.partitionBy("g").orderBy("id")
    d = r.blocked_row_number(skewed, ["g"], ["id"], r.id_block("id", 100), "n")
    assert d.withColumn("m", F.row_number().over(w)).where("n <> m").isEmpty()
    d = r.blocked_running_sum(skewed, ["g"], ["id"], r.id_block("id", 100), {"s": F.col("v")})
    assert d.count() == 3000
    assert d.withColumn("m", F.sum("v").over(w)).where("abs(s - m) > 1e-9").isEmpty()


def test_lead_crosses_empty_blocks(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 5, 900, 905, 5000)] + [("b", 2)], "g string, id long")
    d = {(x["g"], x["id"]): x["next_id"] for x in r.blocked_lead(df, ["g"], ["id"], r.id_block("id", 100), ["id"]).collect()}
    assert d == {("a", 1): 5, ("a", 5): 900, ("a", 900): 905, ("a", 905): 5000, ("a", 5000): None, ("b", 2): None}


def test_null_keys_form_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 900), ("a", 3)], "g string, id long")
    out = {(x["g"], x["id"]): x["n"] for x in r.blocked_row_number(df, ["g"], ["id"], r.id_block("id", 100), "n").collect()}
    assert out == {(None, 1): 1, (None, 900): 2, ("a", 3): 1}


def test_rank_shuffles_the_rows_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), F.lit("payload").alias("p"))
        ranked = r.blocked_row_number(df, ["g"], ["id"], r.id_block("id", 10), "n")
        plan = ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = [line for line in plan.splitlines() if "Exchange" in line and "p#" in line]
    assert plan.count("Exchange hashpartitioning") <= 4 and len(rows) <= 1


def test_value_block_never_decreases(spark):
    rng = np.random.default_rng(1)
    near = np.array([2.0**k for k in range(-40, 41)])
    v = np.concatenate([rng.normal(size=500), near, -near, np.nextafter(near, 0), [0.0, 1e-310, -1e-310, 1e300, -1e300]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    b = [x["b"] for x in df.orderBy("v").select(r.value_block(F.col("v")).alias("b")).collect()]
    assert b == sorted(b)


@pytest.mark.parametrize("kind", ["linear", "higher"])
def test_refinement_is_exact(skewed, kind):
    probs = {"a": 0.0, "b": 0.2, "c": 0.5, "d": 0.99, "e": 1.0}
    out = {x["g"]: x for x in q.refine_quantiles(skewed, ["g"], "v", probs, kind, 20).collect()}
    pdf = skewed.toPandas()
    for g, part in pdf.groupby("g"):
        for name, p in probs.items():
            assert out[g][name] == pytest.approx(np.quantile(part["v"], p, method=kind), abs=1e-12)


def test_hot_groups_take_the_refined_path(skewed):
    a = q.exact_quantiles(skewed, ["g"], "v", {"m": 0.5}, limit=500).collect()
    b = q.exact_quantiles(skewed, ["g"], "v", {"m": 0.5}).collect()
    assert {x["g"]: x["m"] for x in a} == pytest.approx({x["g"]: x["m"] for x in b})


def test_higher_is_numpys_higher(spark):
    v = [0.1, 0.05, 0.2, 0.4, 0.11, 0.3, 0.9]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert q.exact_quantiles(df, [], "v", {"x": 0.2}, "higher").first()["x"] == np.quantile(v, 0.2, method="higher")


@pytest.mark.parametrize("odd", [[float("inf")], [float("-inf"), float("inf")], [float("nan")], [1.7e308, -1.7e308], [5e-324]])
def test_refinement_ends_on_odd_values(spark, odd):
    values = [float(k % 37) for k in range(300)] + odd
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = q.exact_quantiles(df, [], "v", {"x": 0.5, "y": 0.9}, "higher", limit=16).first()
    ranked = sorted(values, key=lambda z: (z != z, z))
    assert [got["x"], got["y"]] == [ranked[-(-5 * (len(values) - 1) // 10)], ranked[-(-9 * (len(values) - 1) // 10)]]


def burst(spark, kind="timestamp"):
    """A recording with 40,000 samples in one second, most of them in one millisecond, beside quiet ones."""
    hot = spark.range(40_000).select(
        F.lit("hot").alias("g"), F.lit(0).alias("null_key"), F.col("id").alias("event_id"),
        (F.lit(1_700_000_000_000_000) + F.when(F.col("id") % 10 < 9, F.col("id") % 7).otherwise(F.col("id") * 25)).alias("us"))
    quiet = spark.range(600).select(
        F.concat(F.lit("q"), (F.col("id") % 20).cast("string")), F.lit(None).cast("int"), F.col("id") + 100_000, F.lit(1_700_000_000_000_000) + F.col("id") * 3_600_000_000)
    return hot.union(quiet).withColumn("ts", F.timestamp_micros("us").cast(kind)).repartition(5)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_density_blocks_follow_bursts(spark, kind):
    d = burst(spark, kind)
    order = ["g", "ts", "event_id"]
    b = d.withColumn("b", r.density_block(d, order, width=1000))
    sizes = [x["count"] for x in b.groupBy("b").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 4000
    # blocks never decrease along the order
    assert b.withColumn("last", F.lag("b").over(Window.partitionBy("null_key").orderBy(*order))).where("last > b").isEmpty()
    n = r.blocked_row_number(d, ["g"], ["ts", "event_id"], r.density_block(d, order, width=1000), "n")
    assert n.withColumn("m", F.row_number().over(Window.partitionBy("g").orderBy("ts", "event_id"))).where("n <> m").isEmpty()


def test_density_blocks_are_bounded_and_need_rows(spark):
    d = burst(spark)
    sizes = d.groupBy(r.density_block(d, ["g", "ts", "event_id"], width=10, most=8).alias("b")).count().collect()
    assert 4 <= len(sizes) <= 8
    none = d.limit(0)
    assert none.withColumn("b", r.density_block(none, ["g", "ts"])).isEmpty()
    same = spark.range(5000).select(F.lit("a").alias("g"), F.lit(1).alias("n"))
    assert same.groupBy(r.density_block(same, ["g", "n"], width=100).alias("b")).count().count() <= 2


def test_density_blocks_with_null_keys(spark):
    d = burst(spark).select("null_key", "event_id")
    n = r.blocked_row_number(d, ["null_key"], ["event_id"], r.density_block(d, ["null_key", "event_id"], width=500), "n")
    w = Window.partitionBy("null_key").orderBy("event_id")
    assert n.count() == 40_600 and n.withColumn("m", F.row_number().over(w)).where("n <> m").isEmpty()
