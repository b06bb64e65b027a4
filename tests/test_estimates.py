"""Sketches within their stated bounds, the bootstrap's weights and coverage, densities against
NumPy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitlens.operators import balance, bootstrap, sketches
from tests.helpers import assert_same


# -- sketches -------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def events(spark):
    """60,000 clients in two arms and some in both, several days each."""
    return spark.range(240000).selectExpr(
        "id % 60000 as client_id", "if(id % 60000 < 33000, 'Control', 'Test') as variation",
        "concat('step_', 1 + id % 3) as process_step", "id % 7 = 0 as finish",
        "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 5 as int)) as date_time",
    ).unionByName(spark.range(3000).selectExpr(
        "id as client_id", "'Test' as variation", "'step_1' as process_step", "true as finish",
        "timestamp_ntz'2024-01-09' as date_time")).repartition(6)


def near(got, want):
    assert abs(got - want) <= sketches.THETA_ERROR * want, (got, want)


def test_distinct_clients_within_the_bound(events):
    daily = sketches.client_sketches(events, "variation", "process_step")
    for by, got in ((["variation", "process_step"], sketches.step_clients(daily)),
                    (["variation", "day"], sketches.daily_clients(daily))):
        rows = events.withColumn("day", F.col("date_time").cast("date").cast("string"))
        exact = {tuple(r[c] for c in by): r.n for r in rows.groupBy(*by).agg(F.count_distinct("client_id").alias("n")).collect()}
        found = {tuple(r[c] for c in by): r.n_clients for r in got.collect()}
        assert set(found) == set(exact)
        for k in exact:
            near(found[k], exact[k])


def test_finishers_and_overlap(events):
    found = sketches.client_sketches(events, "variation", "finish")
    for r in sketches.finisher_rate(found).collect():
        own = events.where(F.col("variation") == r.variation)
        near(r.total_clients, own.select("client_id").distinct().count())
        near(r.clients_finished, own.where("finish").select("client_id").distinct().count())
    # an intersection's error is that of the union
    overlap = sketches.arm_overlap(found).first().n_overlap
    assert abs(overlap - 3000) <= sketches.THETA_ERROR * 60000
    one_arm = found.where("variation = 'Test'")
    assert sketches.arm_overlap(one_arm).first().n_overlap == 0
    assert sketches.arm_overlap(found.limit(0)).first().n_overlap == 0


def test_null_and_empty_groups(spark):
    schema = "client_id long, variation string, process_step string, date_time timestamp_ntz"
    df = spark.createDataFrame([(None, "Test", "start", None), (1, None, "start", None)], schema)
    df = df.withColumn("date_time", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = sketches.step_clients(sketches.client_sketches(df, "variation", "process_step")).collect()
    assert [tuple(r) for r in got] == [(None, "start", 1)]


def test_quantiles_within_the_rank_error(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.lognormal(3, 2, 30000), np.full(9000, 5.0), -rng.random(1000)])
    df = spark.createDataFrame([(float(v), i % 11) for i, v in enumerate(values)], "v double, day int")
    one = sketches.quantiles(sketches.value_sketches(df, "v")).first()
    many = sketches.quantiles(sketches.merged_values(sketches.value_sketches(df, "v", "day"))).first()
    ordered = np.sort(values)
    for r in (one, many):
        assert r.n == len(values)
        for name, p in sketches.PROBS.items():
            below, upto = (np.searchsorted(ordered, r[name], side) / len(values) for side in ("left", "right"))
            assert below - sketches.KLL_RANK_ERROR <= p <= upto + sketches.KLL_RANK_ERROR
            assert r[name] in ordered
    small = sketches.quantiles(sketches.value_sketches(df.where("day < 1").unionByName(spark.createDataFrame([(None, 0)], df.schema)), "v")).first()
    own = np.sort(values[::11])
    assert small.n == len(own) <= sketches.KLL_K
    assert [small[name] for name in sketches.PROBS] == [own[max(1, math.ceil(p * len(own))) - 1] for p in sketches.PROBS.values()]


# -- bootstrap ------------------------------------------------------------------------------
def weights(spark, rows, replicates):
    df = spark.range(rows).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    df = df.select("id", "r", bootstrap.poisson(bootstrap.draw(F.col("id"), F.col("r").cast("long"))).alias("w"))
    out = np.zeros((rows, replicates), int)
    for r in df.collect():
        out[r.id, r.r] = r.w
    return out


def test_weights_are_poisson_and_unrelated(spark):
    w = weights(spark, 1500, 60)
    n = w.size
    for k in range(5):
        p = math.exp(-1) / math.factorial(k)
        assert abs((w == k).mean() - p) < 5 * math.sqrt(p * (1 - p) / n)
    x = w - 1.0
    for shift in (1, 2, 7):  # neighbouring rows and neighbouring replicates
        assert abs((x[shift:] * x[:-shift]).mean()) < 5 / math.sqrt(n)
        assert abs((x[:, shift:] * x[:, :-shift]).mean()) < 5 / math.sqrt(n)
    # sums over rows vary as those of independent weights do
    assert 0.6 < x.sum(axis=0).var() / len(x) < 1.5


def test_reruns_agree_whatever_the_partitioning(spark):
    rows = [(i, "ab"[i % 2], float(i % 13), None if i % 5 == 0 else float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, u double, v double")
    want = bootstrap.intervals(df, "id", ["g"], ["u", "v"]).toPandas()
    assert_same(bootstrap.intervals(df.repartition(7, "u"), "id", ["g"], ["u", "v"]).toPandas(), want)
    assert len(want) == 4 and (want.ci_low <= want["mean"]).all() and (want["mean"] <= want.ci_high).all()
    assert dict(zip(want[want.g == "a"].metric, want[want.g == "a"].n)) == {"u": 150, "v": 120}


def test_replicate_means_against_plain_sums(spark):
    rows = [(i, "ab"[i % 2] if i % 9 else None, float(i % 13)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, g string, u double")
    w = weights(spark, 80, 20)
    got = {(r.g, r.replicate): r.u for r in bootstrap.replicate_means(df, "id", ["g"], ["u"], 20).collect()}
    for g in ("a", "b", None):
        own = [(i, u) for i, x, u in rows if x == g]
        for k in range(20):
            total = sum(int(w[i, k]) for i, _ in own)
            want = sum(w[i, k] * u for i, u in own) / total if total else None
            assert got[g, k] == pytest.approx(want)


def test_coverage(spark):
    """About 95 % of the intervals of many samples hold the true mean."""
    rng = random.Random(6)
    rows = [(s * 200 + i, s, rng.expovariate(1.0)) for s in range(120) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g int, u double")
    got = bootstrap.intervals(df, "id", ["g"], ["u"]).collect()
    assert 0.86 <= np.mean([r.ci_low <= 1.0 <= r.ci_high for r in got]) <= 0.99


# -- density --------------------------------------------------------------------------------
def test_density_against_the_unbinned_kernel(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "Control" if i % 3 else "Test", float(round(v, 3)), None if i % 4 == 0 else float(i % 30))
            for i, v in enumerate(rng.normal(45, 12, 900))]
    rows += [(9000, None, 30.0, 1.0), (9001, "Single", 30.0, 2.0)]
    df = spark.createDataFrame(rows, "client_id long, variation string, clnt_age double, clnt_tenure_yr double")
    got = balance.density(df).toPandas()
    assert set(got.variation) == {"Control", "Test"}
    for (arm, metric), own in got.groupby(["variation", "metric"]):
        x = np.array([r[2 if metric == "clnt_age" else 3] for r in rows if r[1] == arm], float)
        x = x[~np.isnan(x)]
        h = x.std(ddof=1) * len(x) ** -0.2
        own = own.sort_values("point")
        at = own.x.to_numpy()
        want = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
        assert len(at) == balance.GRID and own.n.iloc[0] == len(x) and own.bandwidth.iloc[0] == pytest.approx(h, abs=1e-6)
        assert at[0] == pytest.approx(x.min() - 3 * h, abs=1e-5) and at[-1] == pytest.approx(x.max() + 3 * h, abs=1e-5)
        assert np.abs(own.density.to_numpy() - want).max() < 0.01 * want.max()
        assert np.trapezoid(own.density, at) == pytest.approx(1, abs=0.01)
