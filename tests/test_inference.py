"""Tests against brute force and printed tables."""

import math
import os
import random
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from fieldtally.functions import tails
from fieldtally.operators import inference, ranks
from fieldtally.operators.summaries import run_season_means
from fieldtally.sources import views


def average_ranks(values):
    ordered = sorted(values)
    first = {}
    for place, value in enumerate(ordered, start=1):
        first.setdefault(value, []).append(place)
    return [sum(first[v]) / len(first[v]) for v in values]


# Two-sided critical values of Student's t (fixed values): t, degrees, p.
@pytest.mark.parametrize(
    "t,df,p",
    [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (2.042, 30, 0.05), (1.960, 1e9, 0.05)],
)
def test_student_table(t, df, p):
    assert tails.student_two_sided(t, df) == pytest.approx(p, rel=2e-3)
    assert tails.student_two_sided(-t, df) == tails.student_two_sided(t, df)


@pytest.mark.parametrize("df", [1e7, 1e9, 1e12])
@pytest.mark.parametrize("t", [0.5, 1.75, 3.0, 5.0])
def test_many_degrees_of_freedom(t, df):
    assert tails.student_two_sided(t, df) == pytest.approx(2 * tails.normal_upper(t), rel=2e-5)


def test_tail_ends():
    assert tails.student_two_sided(0.0, 5) == 1.0
    assert tails.student_two_sided(float("inf"), 5) == 0.0
    assert math.isnan(tails.student_two_sided(1.0, 0))
    assert tails.normal_upper(1.645) == pytest.approx(0.05, rel=1e-3)
    assert tails.normal_upper(0.0) == 0.5


@pytest.mark.parametrize("a", [0.5, 1.0, 3.7, 19.9, 20.0, 25.0, 400.0])
def test_log_gamma_ratio(a):
    assert tails.log_gamma_ratio(a) == pytest.approx(math.lgamma(a + 0.5) - math.lgamma(a), abs=1e-12 * max(1, a))


@pytest.mark.parametrize("t", [0.3, 1.0, 2.0, 5.0, 9.0])
def test_student_tail_has_no_switch(t):
    """Against the expansion around the normal tail, which is exact to 1 / df squared."""
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    for df in (1e6, 9.9e7, 1e8, 1.01e8, 1e10):
        first = density * t * (t * t + 1) / 4
        second = density * t * (3 * t**6 - 7 * t**4 - 5 * t * t - 3) / 96
        expected = 2 * (tails.normal_upper(t) + first / df + second / df**2)
        assert tails.student_two_sided(t, df) == pytest.approx(expected, rel=1e-10)
    falling = [tails.student_two_sided(t, df) for df in (1, 2, 5, 10, 1e3, 1e5, 9e7, 1.1e8, 1e10)]
    assert falling == sorted(falling, reverse=True)


def test_student_tail_against_closed_forms():
    for t in (0.1, 0.999, 1.0, 1.001, 3.0, 40.0, 1e4):
        assert tails.student_two_sided(t, 1) == pytest.approx(2 * math.atan2(1, t) / math.pi, rel=1e-10)
        root = math.sqrt(2 + t * t)
        assert tails.student_two_sided(t, 2) == pytest.approx(2 / (root * (root + t)), rel=1e-10)
        c = math.sqrt(4 + t * t)
        assert tails.student_two_sided(t, 4) == pytest.approx(1 - t / c * (1 + 2 / (c * c)), abs=1e-12)


def test_closed_forms_of_the_tail():
    for t in (0.3, 1.0, 2.5):
        assert tails.student_two_sided(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-12)
        assert tails.student_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)


def test_workers_do_not_need_the_package(tmp_path):
    """A session started elsewhere, whose workers cannot import this package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "elsewhere.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from fieldtally.functions.tails import normal_upper_p, student_two_sided_p\n"
        "from fieldtally.session import local_session\n"
        "spark = local_session(1)\n"
        "rows = spark.createDataFrame([(0.0, 5.0)], 't double, df double')\n"
        "print(rows.select(student_two_sided_p('t', 'df'), normal_upper_p('t')).first())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180
    )
    assert "=1.0" in done.stdout and "=0.5" in done.stdout, done.stderr[-2000:]


def samples(seed, count, places):
    rng = random.Random(seed)
    return [
        (f"r{i}", "ab"[i % 2], "xy"[rng.randrange(2)], round(rng.gauss(i % 2, 1), places)) for i in range(count)
    ]


@pytest.mark.parametrize("places", [0, 1, 6])
def test_average_rank_by_brute_force(spark, places):
    rows = samples(places, 400, places)
    df = spark.createDataFrame(rows, "run_id string, grp string, test string, v double")
    got = {r.run_id: r.rank for r in ranks.average_rank(df, ["test"], "v").collect()}
    assert len(got) == len(rows)
    for test in "xy":
        part = [r for r in rows if r[2] == test]
        for r, rank in zip(part, average_ranks([p[3] for p in part])):
            assert got[r[0]] == rank


def test_rank_of_a_hot_value(spark):
    """Nearly all rows share one value: they are dealt over pieces, and none is lost."""
    df = spark.range(5000).selectExpr("id", "CASE WHEN id < 4000 THEN 1.0D ELSE CAST(id AS DOUBLE) END AS v")
    got = ranks.average_rank(df, [], "v")
    assert got.count() == 5000
    assert got.filter("v = 1").select("rank").distinct().collect()[0][0] == 2000.5
    assert got.filter("v = 4999").first()["rank"] == 5000.0


def test_missing_values_have_no_rank(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0), (4, float("nan"))], "id int, v double")
    assert {r.id: r.rank for r in ranks.average_rank(df, [], "v").collect()} == {1: 2.0, 3: 1.0}


@pytest.mark.parametrize("places", [0, 2])
def test_mann_whitney_by_brute_force(spark, places):
    rows = samples(7 + places, 120, places)
    df = spark.createDataFrame(rows, "run_id string, grp string, test string, v double")
    found = {r.test: r for r in inference.mann_whitney(df, "grp", "a", "b", "v", ["test"]).collect()}
    other = {r.test: r for r in inference.mann_whitney(df, "grp", "b", "a", "v", ["test"]).collect()}
    for test in "xy":
        a = [r[3] for r in rows if r[1] == "a" and r[2] == test]
        b = [r[3] for r in rows if r[1] == "b" and r[2] == test]
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        ties = [(a + b).count(v) for v in set(a + b)]
        n = len(a) + len(b)
        variance = len(a) * len(b) / 12 * (n + 1 - sum(t**3 - t for t in ties) / (n * (n - 1)))
        z = (u - len(a) * len(b) / 2 - 0.5) / math.sqrt(variance)
        row = found[test]
        assert (row.n_a, row.n_b, row.u) == (len(a), len(b), u)
        assert row.z == pytest.approx(z, abs=1e-12)
        assert row.p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=1e-12)
        assert row.u + other[test].u == len(a) * len(b)


def test_welch_by_hand(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 9.0]
    rows = [("a", v) for v in a] + [("b", v) for v in b] + [("c", 100.0)]
    row = inference.welch(spark.createDataFrame(rows, "g string, v double"), "g", "a", "b", "v").first()
    va, vb = 5 / 3 / 4, 13 / 3
    assert (row.n_a, row.n_b, row.mean_a, row.mean_b) == (4, 3, 2.5, 5.0)
    assert row.t == pytest.approx(-2.5 / math.sqrt(va + vb))
    assert row.df == pytest.approx((va + vb) ** 2 / (va**2 / 3 + vb**2 / 2))
    assert row.p == pytest.approx(tails.student_two_sided(row.t, row.df))


def test_welch_without_spread_has_no_p(spark):
    rows = [("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)]
    row = inference.with_verdict(
        inference.welch(spark.createDataFrame(rows, "g string, v double"), "g", "a", "b", "v")
    ).first()
    assert row.mean_diff == -1.0 and row.t is None and row.p is None and row.verdict is None


@pytest.mark.parametrize("seed", [1, 2])
def test_spearman_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(t, rng.choice([0.3, 0.5, 0.7]), float(rng.randrange(40))) for t in "xy" for _ in range(60)]
    found = {
        r.test: r
        for r in inference.spearman(
            spark.createDataFrame(rows, "test string, a double, b double"), "a", "b", ["test"]
        ).collect()
    }
    for test in "xy":
        part = [r for r in rows if r[0] == test]
        x, y = average_ranks([r[1] for r in part]), average_ranks([r[2] for r in part])
        mx, my = sum(x) / len(x), sum(y) / len(y)
        rho = sum((p - mx) * (q - my) for p, q in zip(x, y)) / math.sqrt(
            sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y)
        )
        assert found[test].rho == pytest.approx(rho, abs=1e-12)
        assert found[test].t == pytest.approx(rho * math.sqrt(58 / (1 - rho * rho)), abs=1e-9)


def test_spearman_of_a_perfect_order(spark):
    rows = [(float(i), float(i * i)) for i in range(10)]
    row = inference.spearman(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    assert (row.n, row.rho, row.p) == (10, 1.0, 0.0)


def test_plot_rows_are_refused(spark):
    rows = spark.createDataFrame([("r1", 1.0), ("r1", 2.0), ("r2", 1.0)], "run_id string, v double")
    with pytest.raises(ValueError, match="r1"):
        inference.require_run_unit(rows)
    assert inference.require_run_unit(rows.dropDuplicates(["run_id"])).count() == 2


def test_tests_refuse_a_run_that_counts_twice(spark):
    """Inside their own plan: no job before the query runs, no answer when it does."""
    rows = [(f"r{i}", "ab"[i % 2], float(i), float(i * i)) for i in range(8)]
    once = spark.createDataFrame(rows, "run_id string, g string, v double, w double")
    twice = once.unionByName(once.filter("run_id = 'r3'"))
    tests = {
        "welch": lambda df, **k: inference.welch(df, "g", "a", "b", "v", **k),
        "ranks": lambda df, **k: inference.mann_whitney(df, "g", "a", "b", "v", **k),
        "rho": lambda df, **k: inference.spearman(df, "v", "w", **k),
    }
    for name, test in tests.items():
        known = test(once).collect()
        assert known and known == test(once.drop("run_id")).collect()
        with pytest.raises(Exception, match="run 'r3' has several rows"):
            test(twice).collect()
        # Also where the repeated row has no value, and not where another test or side has it.
        with pytest.raises(Exception, match="run 'r3' has several rows"):
            test(once.unionByName(spark.createDataFrame([("r3", "b", None, None)], once.schema))).collect()
        assert test(twice, run=None).first() != known[0] or name == "rho"
        assert test(once.unionByName(spark.createDataFrame([(None, "a", 1.0, 1.0)] * 2, once.schema))).collect() == known
    both = twice.withColumn("g", F.when(F.rand() < 2, F.lit("a"))).dropDuplicates(["run_id"])
    assert inference.welch(both.unionByName(both.withColumn("g", F.lit("b"))), "g", "a", "b", "v").first().mean_diff == 0
    assert inference.welch(once.withColumn("k", F.lit(1)).unionByName(once.withColumn("k", F.lit(2))), "g", "a", "b", "v", ["k"]).count() == 2


def test_the_check_needs_no_exchange_after_the_same_reduction(spark, folder):
    runs = run_season_means(views.harvest(spark, folder), ["strategy"], ["grain_tha"])
    pair = ("strategy", "threshold", "calendar", "grain_tha", ["season"])

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    checked, plain = (inference.welch_statistics(runs, *pair, run=run) for run in ("run_id", None))
    assert exchanges(checked) == exchanges(plain)


def test_missing_values_are_left_out_of_tests(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 5.0)]
    gaps = [("a", None), ("b", float("nan"))]
    full = spark.createDataFrame(rows, "g string, v double")
    with_gaps = spark.createDataFrame(rows + gaps, "g string, v double")
    for test in (inference.welch, inference.mann_whitney):
        assert test(full, "g", "a", "b", "v").first() == test(with_gaps, "g", "a", "b", "v").first()
