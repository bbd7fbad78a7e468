"""Published results that need no lost log, as sums of fixed rules.

A calendar run sprays the same number of times on every plot and season, which
makes its resistance deterministic; a crop without pests grows a fixed amount.
"""

import pytest
from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.functions import economics
from fieldtally.functions.schedule import scheduled_compound
from fieldtally.operators import design, replay, summaries, windows
from fieldtally.operators.joins import with_compound
from fieldtally.sources import views
from fieldtally.sources.contracts import CONTRACTS, contract, pattern_names

# Mean resistance by spray interval, seasons 1 to 6: interval, sprays, values (fixed values).
BY_INTERVAL = (
    (5, 15, (0.5100, 1, 1, 1, 1, 1)),
    (7, 10, (0.2600, 0.7470, 1, 1, 1, 1)),
    (10, 7, (0.1100, 0.4545, 0.7818, 1, 1, 1)),
    (14, 5, (0.0700, 0.2565, 0.4937, 0.7190, 0.9330, 1)),
    (21, 3, (0.0300, 0.0885, 0.2041, 0.3439, 0.4767, 0.6028)),
    (28, 2, (0.0200, 0.0490, 0.0866, 0.1522, 0.2446, 0.3324)),
)
# Resistance after 30 seasons of 5 sprays by immigration rate (fixed values).
BY_IMMIGRATION = ((0.3, 0.833), (0.5, 0.500), (0.7, 0.357), (0.9, 0.278), (1.0, 0.250))
# Fixation season by rotation pattern, 5 sprays a season (fixed values).
BY_PATTERN = {
    "ABBB": 6, "BBBA": 6, "BBAB": 6, "BABB": 7, "ABB": 6, "AB": 8, "REACTIVE": 12, "AAAB": 10, "BAA": 11,
}


def seasons_of(spark, runs, seasons, compound="starfarm"):
    """A ledger with the same sprays every season: ``runs`` maps run to sprays."""
    rows = spark.createDataFrame(list(runs.items()), "run_id string, spray_count int")
    return rows.select(
        "run_id",
        F.lit(0).alias("plot_x"),
        F.lit(0).alias("plot_y"),
        F.explode(F.sequence(F.lit(1), F.lit(seasons))).alias("season"),
        F.lit(compound).alias("pesticide_choice"),
        "spray_count",
    )


def test_resistance_by_interval(spark):
    ledger = seasons_of(spark, {str(i): n for i, n, _ in BY_INTERVAL}, 6)
    found = replay.replay_rf(with_compound(ledger, views.compounds(spark)))
    got = {(r.run_id, r.season): r.resistant_fraction for r in found.collect()}
    for interval, _, values in BY_INTERVAL:
        for season, value in enumerate(values, start=1):
            assert round(got[str(interval), season], 4) == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("rate,value", BY_IMMIGRATION)
def test_resistance_by_immigration(spark, rate, value):
    ledger = with_compound(seasons_of(spark, {"a": 5}, 30), views.compounds(spark))
    last = replay.replay_rf(ledger, immigration=rate).filter("season = 30").first()
    assert round(last.resistant_fraction, 3) == value


def test_fixation_by_pattern(spark):
    fixed_patterns = [p for p in BY_PATTERN if p != fixed.REACTIVE]
    ledger = seasons_of(spark, {p: 5 for p in fixed_patterns}, 30).withColumn(
        "pesticide_choice", scheduled_compound("run_id", "season")
    )
    dims = views.compounds(spark)
    pools = replay.replay_rf(with_compound(ledger, dims))
    found = {r.run_id: r.fixation_season for r in summaries.fixation(pools, ["run_id"]).collect()}
    assert found == {p: BY_PATTERN[p] for p in fixed_patterns}


def test_reactive_fixation(spark):
    """The choice feeds back into the pools; here season by season, as the rule runs."""
    dims = views.compounds(spark)
    choice = [fixed.COMPOUND_A]
    for season in range(1, 13):
        rows = [("r", 0, 0, s, c, 5) for s, c in enumerate(choice, start=1)]
        ledger = spark.createDataFrame(
            rows, "run_id string, plot_x int, plot_y int, season int, pesticide_choice string, spray_count int"
        )
        pools = replay.replay_rf(with_compound(ledger, dims)).collect()
        last = max(pools, key=lambda r: r.season)
        choice.append(fixed.COMPOUND_B if last.pool_b < last.pool_a else fixed.COMPOUND_A)
        if last.resistant_fraction >= 0.99:
            break
    assert season == BY_PATTERN[fixed.REACTIVE]
    # The same choices follow from the pools of the whole ledger.
    replayed = replay.reactive_compound(replay.replay_rf(with_compound(ledger, dims))).orderBy("season")
    assert [r.reactive_choice for r in replayed.collect()] == choice[:season]


def test_reactive_flag_needs_equal_pressure(spark):
    """With one pressure for both compounds the fold alone follows the rule."""
    ledger = seasons_of(spark, {"r": 5}, 6).withColumn("selection_pressure", F.lit(0.02))
    found = replay.replay_rf(ledger, reactive=True).orderBy("season").collect()
    assert [r.pesticide_choice for r in found] == [fixed.COMPOUND_A, fixed.COMPOUND_B] * 3


def test_pest_free_growth(spark):
    days = spark.range(1, 76).select(
        F.lit(1).alias("plot_id"),
        F.col("id").cast("int").alias("day"),
        F.lit(28.0).alias("t_mean"),
        F.lit(18.0).alias("solar_rad"),
    )
    clean = windows.growth_accumulation(days.withColumn("pest_load", F.lit(0.0))).filter("day = 75").first()
    assert clean.biomass == pytest.approx(770.688, abs=1e-9)
    assert clean.biomass_loss == 0.0
    infested = windows.growth_accumulation(days.withColumn("pest_load", F.col("day") / 75))
    total = infested.select("day", economics.to_tha(F.col("biomass") + F.col("biomass_loss")).alias("t"))
    assert total.filter("day = 75").first().t == pytest.approx(4.0075776, abs=1e-9)
    ripe = windows.heat_accumulation(days).agg(F.min("maturity_day")).first()[0]
    assert ripe == 75


def test_loss_share(spark):
    rows = spark.createDataFrame([(2.25, 1.75), (0.0, 0.0)], "grain_tha double, pest_loss_tha double")
    shares = [r[0] for r in rows.select(economics.yield_loss_share()).collect()]
    assert shares == [0.4375, None]


def test_patterns(spark):
    expected = (
        "AB BA AAB ABA ABB BAA BAB BBA AAAB AABA AABB ABAA ABBA ABBB BAAA BAAB BABB BBAA BBAB BBBA"
    ).split()
    assert list(pattern_names()) == expected
    assert sorted(r.rotation_pattern for r in design.rotation_patterns(spark).collect()) == sorted(expected)


def test_contract_sizes():
    grid = [c for c in CONTRACTS.values() if c.plots > 1]
    single = [c for c in CONTRACTS.values() if c.plots == 1 and c.repeats]
    assert (len(grid), sum(c.expected_rows for c in grid)) == (29, 22_224_000)
    assert (len(single), sum(c.expected_rows for c in single)) == (11, 4_440)
    assert contract("harvest_grid_output").expected_rows == 36_000
    assert contract("sensitivity_output_interval_immigration_grid").expected_rows == 2_880_000
    assert contract("sensitivity_output_adaptive_farmer_longhorizon").expected_rows == 480_000


def test_design_rows(spark):
    log = contract("sensitivity_output_interval_immigration_grid")
    cells = design.contract_design(spark, log)
    assert cells.agg(F.sum("expected_rows")).first()[0] == log.expected_rows
    assert cells.distinct().count() == cells.count() == 64 * 15 * 30
