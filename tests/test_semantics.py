"""Missing values, ties, empty groups: where engines differ by default."""

import math

import pytest
from pyspark.sql import functions as F

from fieldtally.functions import keys
from fieldtally.operators import summaries as ops
from fieldtally.operators import windows
from fieldtally.operators.analysis import analyze

SCHEMA = (
    "run_id string, strategy string, season int, plot_x int, plot_y int, grain_tha double, pest_loss_tha double, "
    "spray_count int, resistant_fraction double, cost_per_spray double"
)


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(run="none_0", strategy="none", season=1, x=0, y=0, grain=2.0, loss=1.0, sprays=0, rf=0.0, cost=100.0):
    return (run, strategy, season, x, y, grain, loss, sprays, rf, cost)


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_rows_without_a_key_are_left_out(spark):
    found = ops.season_summary(log(spark, [row(), row(strategy=None)]), ["strategy"])
    assert [r.strategy for r in found.collect()] == ["none"]


def test_nan_key_is_left_out(spark):
    rows = spark.createDataFrame([(0.1, 1, 2.0), (float("nan"), 1, 3.0)], "rate double, season int, grain_tha double")
    assert only(ops.season_summary(rows, ["rate"])).rate == 0.1


def test_missing_measures_are_skipped(spark):
    found = ops.season_summary(log(spark, [row(grain=2.0), row(grain=float("nan")), row(grain=None)]), ["strategy"])
    assert only(found).grain_tha == 2.0


def test_nan_becomes_null(spark):
    rows = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "a double, b int")
    assert keys.nan_to_null(rows).filter("a IS NULL").count() == 1


def test_sd_of_one_row_is_missing(spark):
    found = only(ops.mean_sd(log(spark, [row()]), ["strategy"], {"grain_tha": "grain"}))
    assert found.grain_mean == 2.0 and found.grain_sd is None


def test_sample_and_population_sd(spark):
    data = log(spark, [row(grain=1.0), row(grain=3.0)])
    found = only(
        ops.summarize(data, ["strategy"], a=("grain_tha", "std"), b=("grain_tha", "std_pop"))
    )
    assert math.isclose(found.a, math.sqrt(2)) and math.isclose(found.b, 1.0)


def test_sum_of_nothing_is_zero(spark):
    found = ops.run_total(log(spark, [row(grain=None)]), ["strategy"])
    assert only(found).profit == 0.0


def test_fixation_is_first_crossing_even_if_left_again(spark):
    data = log(spark, [row(season=s, rf=v) for s, v in ((1, 0.5), (2, 0.99), (3, 0.4), (4, 1.0))])
    found = only(ops.fixation(data, ["strategy"]))
    assert (found.fixation_season, found.max_season, found.final_mean_rf) == (2, 4, 1.0)


def test_never_fixated_is_null(spark):
    found = only(ops.fixation(log(spark, [row(rf=0.98999)]), ["strategy"]))
    assert found.fixation_season is None


def test_flat_and_balanced_profit_agree_only_on_balanced_logs(spark):
    even = log(spark, [row(run=f"none_{r}", x=x, grain=1.0 + r + x) for r in range(2) for x in range(2)])
    flat, balanced = ops.profit_summary(even, ["strategy"]), ops.balanced_profit(even, ["strategy"])
    assert only(flat).cumulative_profit == only(balanced).cumulative_profit
    uneven = even.union(log(spark, [row(run="none_0", x=5, grain=9.0)]))
    flat, balanced = ops.profit_summary(uneven, ["strategy"]), ops.balanced_profit(uneven, ["strategy"])
    assert only(flat).cumulative_profit != only(balanced).cumulative_profit


def test_profit_uses_the_cost_of_each_row(spark):
    found = only(ops.season_profit(log(spark, [row(grain=1.0, sprays=2, cost=110.5)]), ["strategy"]))
    assert found.net_profit == 3000.0 - 221.0


def test_last_by_season_does_not_depend_on_row_order(spark):
    data = log(spark, [row(season=3, grain=7.0), row(season=1, grain=1.0), row(season=2, grain=5.0)])
    found = only(ops.terminal_mean(data, ["strategy"]))
    assert (found.season, found.terminal_grain_tha) == (3, 7.0)


def test_early_mean_counts_runs_once(spark):
    rows = [row(run="none_0", season=1, grain=2.0), row(run="none_0", season=2, grain=4.0),
            row(run="none_1", season=6, grain=9.0), row(run="none_1", season=7, grain=100.0)]
    assert only(ops.early_mean(log(spark, rows), ["strategy"])).early_grain_tha == 6.0


def test_mean_of_season_sds(spark):
    rows = [row(season=s, sprays=v) for s, v in ((1, 1), (1, 3), (2, 4), (2, 4))]
    found = only(ops.mean_of_season_sds(log(spark, rows), ["strategy"]))
    assert found.spray_count_mean == 3.0
    assert math.isclose(found.spray_count_mean_sd, math.sqrt(2) / 2)


def test_duplicates_and_conservation(spark):
    data = log(spark, [row(), row(), row(x=1, grain=3.0)])
    assert only(ops.duplicate_keys(data, ["run_id", "season", "plot_x", "plot_y"])).n_rows == 2
    found = only(ops.conservation(data, ["strategy"], expected=3.0))
    assert (found.min_total, found.max_total, found.n_violations) == (3.0, 4.0, 1)
    assert only(ops.conservation_violations(data, expected=3.0)).total_tha == 4.0


def test_frontier_is_null_where_everything_fixates(spark):
    rows = spark.createDataFrame(
        [(7, 0.1, 1, 1.0), (14, 0.1, 1, 1.0), (7, 0.5, 1, 1.0), (14, 0.5, 1, 0.2), (21, 0.5, 1, 0.1)],
        "interval int, rate double, season int, resistant_fraction double",
    )
    found = {r.rate: r.min_interval for r in ops.fixation_free_frontier(rows, "interval", "rate").collect()}
    assert found == {0.1: None, 0.5: 14}


def test_plateau(spark):
    rows = [row(season=s, rf=v) for s, v in ((1, 0.0), (2, 0.3), (3, 0.5), (4, 0.501), (5, 0.502))]
    found = only(ops.rf_plateau(log(spark, rows), ["strategy"], last=2))
    assert math.isclose(found.mean_change, 0.001) and not found.still_climbing
    assert only(ops.rf_plateau(log(spark, rows[:1]), ["strategy"])).mean_change is None


def test_best_and_worst_break_ties_by_key(spark):
    rows = spark.createDataFrame(
        [("s", "a", 5.0), ("s", "b", 5.0), ("s", "c", 1.0), ("s", "d", 1.0)],
        "strategy string, pattern string, cumulative_profit double",
    )
    found = only(windows.best_and_worst(rows, ["strategy"], ["pattern"]))
    assert (found.best_pattern, found.worst_pattern) == ("a", "c")
    places = windows.rank_by_profit(rows, ["strategy"], ["pattern"]).orderBy("place").collect()
    assert [r.pattern for r in places] == ["a", "b", "c", "d"]


def test_analysis_equals_its_parts(spark):
    rows = [row(run=f"none_{r}", season=s, x=r, grain=r + s / 4, rf=s / 2) for r in range(3) for s in (1, 2)]
    data = log(spark, rows)
    found = analyze(data, ["strategy"])
    assert found.fixation.collect() == ops.fixation(data, ["strategy"]).collect()
    assert found.profit.collect() == ops.profit_summary(data, ["strategy"]).collect()
    assert found.seasons.collect() == ops.season_summary(data, ["strategy"]).orderBy("season").collect()


def test_daily_monitors_without_sprays(spark):
    rows = spark.createDataFrame([(1, 0.5, None), (1, 0.25, None)], "day int, pest_load double, sprayed int")
    found = only(ops.daily_monitors(rows))
    assert (found.mean_load, found.max_load, found.total_sprays, found.any_spray) == (0.375, 0.5, 0, 0)


@pytest.mark.parametrize("value,key", [(0.30000000000000004, 0.3), (0.1, 0.1), (0.49999, 0.5)])
def test_condition_keys_are_rounded(spark, value, key):
    rows = spark.createDataFrame([(value,)], "v double")
    assert only(rows.select(keys.condition_key("v").alias("k"))).k == key


def test_run_id_parts(spark):
    rows = spark.createDataFrame([("calendar_17",), ("no_spray_3",), ("run",), ("a_b",)], "run_id string")
    parts = rows.select(keys.run_strategy("run_id").alias("s"), keys.run_number("run_id").alias("n")).collect()
    assert [tuple(p) for p in parts] == [
        ("calendar", 17), ("no_spray", 3), (None, None), (None, None),
    ]


def test_distinct_counts_leave_missing_out(spark):
    rows = spark.createDataFrame([("a", 1), (None, 1), ("b", 2)], "k string, v int")
    assert tuple(only(ops.distinct_counts(rows, ["k", "v"]))) == (2, 2)
    assert sorted(r.k for r in ops.distinct_values(rows, "k").collect()) == ["a", "b"]


def test_wallet_and_profit_change(spark):
    rows = [row(season=1, grain=1.0), row(season=2, grain=2.0), row(season=3, grain=1.5)]
    seasons = windows.run_seasons(log(spark, rows), ["strategy"])
    money = [r.end_money for r in windows.wallet(seasons).orderBy("season").collect()]
    assert money == [8000.0, 14000.0, 18500.0]
    changes = windows.profit_change(seasons).orderBy("season").collect()
    # Season 2 earns more than season 1, but less than season 1 with the starting money.
    assert [r.declined for r in changes] == [False, True, True]
    assert [r.previous_profit for r in changes] == [0.0, 8000.0, 6000.0]


def test_summary_orders_nothing_but_trajectory_does(spark):
    data = log(spark, [row(season=s, rf=s / 4) for s in (3, 1, 2)])
    assert [r.season for r in windows.trajectory(data, ["strategy"]).collect()] == [1, 2, 3]
    assert ops.season_summary(data, ["strategy"]).filter(F.col("season") == 2).count() == 1
