"""Rules of growth, spraying, resistance and adaptation against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.functions import growth, resistance, schedule
from fieldtally.operators import adaptive, audit, replay, spatial, windows


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_load_bands(spark):
    loads = [0.0, 0.099, 0.1, 0.4, 0.401, 0.7, 0.701, 1.0]
    rows = spark.createDataFrame([(v,) for v in loads], "pest_load double").orderBy("pest_load")
    assert [r[0] for r in rows.select(growth.load_band()).collect()] == [
        "healthy", "healthy", "light", "light", "moderate", "moderate", "overwhelmed", "overwhelmed",
    ]
    assert one(spark, growth.load_band(0.5, False)) == "fallow"


def test_infection_day_is_strict(spark):
    assert one(spark, growth.infection_day(80.1, 27.1)) is True
    assert one(spark, growth.infection_day(80.0, 28.0)) is False
    assert one(spark, growth.infection_day(81.0, 27.0)) is False
    assert one(spark, growth.infection_day(81.0, 28.0, False)) is False


def test_growth_factor_has_a_floor(spark):
    assert one(spark, growth.growth_factor(1.0, 0.7)) == 0.5
    assert one(spark, growth.growth_factor(0.5, 0.6)) == pytest.approx(0.7)
    assert one(spark, growth.heat_units(8.0)) == 0.0


@pytest.mark.parametrize(
    "strategy,since,load,spray",
    [("none", 99, 1.0, False), ("calendar", 13, 1.0, False), ("calendar", 14, 0.0, True),
     ("threshold", 7, 0.3, False), ("threshold", 7, 0.301, True), ("threshold", 6, 0.9, False)],
)
def test_spray_decision(spark, strategy, since, load, spray):
    assert one(spark, schedule.should_spray(F.lit(strategy), since, load)) is spray


@pytest.mark.parametrize(
    "pattern,letters",
    [("AB", "ABABAB"), ("BAA", "BAABAA"), ("ABBB", "ABBBAB"), ("REACTIVE", "A?????")],
)
def test_scheduled_compounds(spark, pattern, letters):
    names = {fixed.COMPOUND_A: "A", fixed.COMPOUND_B: "B", None: "?"}
    seasons = spark.range(1, 7).select(schedule.scheduled_compound(F.lit(pattern), "id"))
    assert "".join(names[r[0]] for r in seasons.collect()) == letters


def test_calendar_has_no_cooldown(spark):
    assert one(spark, schedule.should_spray(F.lit("calendar"), 1, 0.0, interval=1)) is True


def test_season_factor_equals_single_sprays(spark):
    rows = [(b, n) for b in range(12) for n in range(12)]
    got = spark.createDataFrame(rows, "b int, n int").select("b", "n", resistance.season_factor("b", "n").alias("f"))
    for r in got.collect():
        weights = [0.5 if i <= 3 else 1.0 if i <= 7 else 2.5 for i in range(r.b + 1, r.b + r.n + 1)]
        assert r.f == sum(weights)


def test_effective_rf(spark):
    rows = spark.createDataFrame([(c, 0.5, 0.75) for c in fixed.COMPOUNDS], "c string, a double, b double")
    got = {r.c: r.rf for r in rows.select("c", resistance.effective_rf("c", "a", "b", 1.0).alias("rf")).collect()}
    assert got == {"starfarm": 0.75, "etofenprox": 1.0, "neonicotinoid": 1.0}
    got = {r.c: r.rf for r in rows.select("c", resistance.effective_rf("c", "a", "b").alias("rf")).collect()}
    assert got == {"starfarm": 0.75, "etofenprox": 0.5, "neonicotinoid": 0.75}


def replay_by_hand(seasons, immigration, fitness, spillover):
    a = b = rf = 0.0
    lifetime, last, out = 0, None, []
    pressure = {"starfarm": 0.02, "etofenprox": 0.015, "neonicotinoid": 0.025}
    for season, compound, sprays in seasons:
        for _ in range(0 if last is None else season - last):
            if immigration > 0 or fitness > 0:
                a *= (1 - immigration) * (1 - fitness)
                b *= (1 - immigration) * (1 - fitness)
                rf = max(a, b)
        for _ in range(sprays):
            lifetime += 1
            gain = pressure[compound] * (0.5 if lifetime <= 3 else 1.0 if lifetime <= 7 else 2.5)
            if compound != "neonicotinoid":
                a = min(1.0, a + gain)
            if compound != "etofenprox":
                b = min(1.0, b + gain)
            if compound == "etofenprox":
                rf = min(1.0, a + b * spillover)
            elif compound == "neonicotinoid":
                rf = min(1.0, b + a * spillover)
            else:
                rf = max(a, b)
        out.append((season, a, b, rf))
        last = season
    return out


@pytest.mark.parametrize(
    "immigration,fitness,spillover", [(0.05, 0.0, 0.0), (0.2, 0.1, 0.5), (0.0, 0.0, 0.25), (1.0, 0.0, 0.0)]
)
def test_replay_by_hand(spark, immigration, fitness, spillover):
    rng = random.Random(5)
    rows, expected = [], {}
    for plot in range(12):
        numbers = sorted(rng.sample(range(1, 15), 9))
        seasons = [(s, rng.choice(fixed.COMPOUNDS), rng.randrange(0, 12)) for s in numbers]
        rows += [("r", plot, 0, *s) for s in seasons]
        for season, *state in replay_by_hand(seasons, immigration, fitness, spillover):
            expected[plot, season] = state
    rng.shuffle(rows)
    ledger = spark.createDataFrame(
        rows, "run_id string, plot_x int, plot_y int, season int, pesticide_choice string, spray_count int"
    )
    from fieldtally.operators.joins import with_compound
    from fieldtally.sources.views import compounds

    found = replay.replay_rf(
        with_compound(ledger, compounds(spark)), immigration=immigration, fitness_cost=fitness, spillover=spillover
    ).collect()
    assert len(found) == len(expected)
    for r in found:
        assert (r.pool_a, r.pool_b, r.resistant_fraction) == pytest.approx(expected[r.plot_x, r.season], abs=1e-12)


def test_spaced_days_by_hand(spark):
    rng = random.Random(3)
    rows = [(p, d, rng.random()) for p in range(20) for d in range(1, 76) if rng.random() < 0.8]
    got = {}
    found = replay.spaced_days(
        spark.createDataFrame(rows, "plot_id int, day int, pest_load double"), F.col("pest_load") > 0.5
    )
    for r in found.orderBy("plot_id", "day").collect():
        got.setdefault(r.plot_id, []).append(r.day)
    for p in range(20):
        last, taken = 0, []
        for _, d, load in sorted(r for r in rows if r[0] == p):
            if load > 0.5 and d - last >= 7:
                last = d
                taken.append(d)
        assert got[p] == taken


def adapt_by_hand(strategy, profits, rule):
    interval, threshold, money, last, previous = 14, 0.3, 5000.0, 0.0, 0.0
    out = []
    for profit in profits:
        out.append((interval, threshold, strategy))
        money += profit
        felt = money - last
        if felt < previous:
            if rule == "backoff":
                if strategy == "calendar" and interval < 28:
                    interval = min(28, interval + 2)
                elif strategy == "threshold" and threshold < 0.5:
                    threshold = min(0.5, threshold + 0.05)
            elif rule == "escalate":
                if strategy == "calendar" and interval > 1:
                    interval = max(1, interval - 2)
                elif strategy == "threshold" and threshold > 0.1:
                    threshold = max(0.1, threshold - 0.05)
            else:
                strategy = {"calendar": "threshold", "threshold": "none", "none": "calendar"}[strategy]
        previous, last = felt, money
    return out


@pytest.mark.parametrize("rule", ["backoff", "escalate", "swap"])
def test_adaptive_rules_by_hand(spark, rule):
    rng = random.Random(11)
    rows, expected = [], {}
    for i, strategy in enumerate(fixed.STRATEGIES * 3):
        profits = [float(rng.randrange(-4000, 9000)) for _ in range(25)]
        run = f"{strategy}_{i}"
        rows += [(run, strategy, s, p) for s, p in enumerate(profits, start=1)]
        expected[run] = adapt_by_hand(strategy, profits, rule)
    seasons = spark.createDataFrame(rows, "run_id string, strategy string, season int, profit double")
    function = {"backoff": adaptive.backoff, "escalate": adaptive.escalation, "swap": adaptive.strategy_swaps}[rule]
    for r in function(seasons).collect():
        interval, threshold, strategy = expected[r.run_id][r.season - 1]
        if rule == "swap":
            assert r.strategy_in_force == strategy
        else:
            assert r.interval_in_force == interval
            assert r.threshold_in_force == pytest.approx(threshold, abs=1e-9)


def test_start_beyond_the_limit_stays(spark):
    rows = [("calendar_0", "calendar", s, p) for s, p in ((1, 9000.0), (2, 1.0), (3, 0.0))]
    seasons = spark.createDataFrame(rows, "run_id string, strategy string, season int, profit double")
    found = adaptive.backoff(seasons, start_interval=40).orderBy("season").collect()
    assert [r.interval_in_force for r in found] == [40, 40, 40]


def test_resistance_trigger_looks_after_decay(spark):
    rows = [("calendar_0", "calendar", s, 0.0, rf) for s, rf in ((1, 0.52), (2, 0.53), (3, 0.9), (4, 0.1))]
    seasons = spark.createDataFrame(rows, "run_id string, strategy string, season int, profit double, mean_rf double")
    found = adaptive.strategy_swaps(seasons, adaptive.resistance_trigger()).orderBy("season").collect()
    assert [r.strategy_in_force for r in found] == ["calendar", "calendar", "threshold", "none"]
    assert [r.swaps_before for r in found] == [0, 0, 1, 2]


def test_plot_positions(spark):
    cells = spark.range(100).selectExpr("CAST(id % 10 AS INT) AS plot_x", "CAST(id DIV 10 AS INT) AS plot_y")
    counts = cells.groupBy(spatial.plot_position().alias("p"), spatial.neighbour_count().alias("n")).count()
    assert {(r.p, r.n): r["count"] for r in counts.collect()} == {
        ("corner", 3): 4, ("edge", 5): 32, ("interior", 8): 64,
    }
    rings = cells.groupBy(spatial.outbreak_ring().alias("r")).count()
    assert {r.r: r["count"] for r in rings.collect()} == {"centre": 1, "neighbour": 8, "corner": 4, "other": 87}


def field(spark, seed, top=0.5):
    rng = random.Random(seed)
    loads = {(x, y): rng.random() * top for x in range(10) for y in range(10)}
    rows = [("r", x, y, v) for (x, y), v in loads.items()]
    return loads, spark.createDataFrame(rows, "run_id string, plot_x int, plot_y int, pest_load double")


def around(x, y):
    return [
        (x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)
        if (i or j) and 0 <= x + i < 10 and 0 <= y + j < 10
    ]


def test_neighbours_by_hand(spark):
    loads, df = field(spark, 1)
    for r in spatial.neighbour_agg(df, "pest_load", function=F.max).collect():
        near = [loads[c] for c in around(r.plot_x, r.plot_y)]
        assert (r.n_neighbours, r.neighbour_value) == (len(near), max(near))
        assert r.pest_load == loads[r.plot_x, r.plot_y]


@pytest.mark.parametrize("top", [0.5, 1.5])
def test_diffusion_by_hand(spark, top):
    loads, df = field(spark, 2, top)
    after = {(r.plot_x, r.plot_y): r.load_after for r in spatial.diffuse(df).collect()}
    for (x, y), load in loads.items():
        received = sum(loads[c] * 0.1 / len(around(*c)) for c in around(x, y))
        assert after[x, y] == pytest.approx(min(1.0, load * 0.9 + received), abs=1e-12)
    if top < 1:
        assert sum(after.values()) == pytest.approx(sum(loads.values()), abs=1e-9)


def test_neighbours_that_are_not_logged(spark):
    rows = [("r", 0, 0, 0.5), ("r", 0, 1, None), ("r", 5, 5, 0.25), ("s", 1, 1, 0.75)]
    df = spark.createDataFrame(rows, "run_id string, plot_x int, plot_y int, pest_load double")
    found = {(r.run_id, r.plot_x, r.plot_y): r for r in spatial.neighbour_agg(df, "pest_load").collect()}
    assert len(found) == 4
    assert found["r", 0, 1].neighbour_value == 0.5 and found["r", 0, 0].n_neighbours == 0


@pytest.mark.parametrize("function", [F.avg, F.sum, F.min, F.max])
def test_neighbours_of_a_sparse_grid(spark, function):
    """Against a plain walk over the eight cells; missing plots, edges and other grids do not count."""
    rng = random.Random(9)
    cells = {(r, x, y): rng.choice([None, float("nan"), 0.25, 0.5, 2.0]) for r in "rs" for x in range(10) for y in range(10) if rng.random() < 0.6}
    rows = [(r, x, y, v) for (r, x, y), v in cells.items()] + [("r", 10, 3, 9.0), ("r", -1, 0, 9.0), ("r", None, 1, 9.0)]
    df = spark.createDataFrame(rows, "run_id string, plot_x int, plot_y int, pest_load double")
    found = {(r.run_id, r.plot_x, r.plot_y): (r.neighbour_value, r.n_neighbours) for r in spatial.neighbour_agg(df, "pest_load", function=function).collect()}
    plain = {F.avg: lambda v: sum(v) / len(v), F.sum: sum, F.min: min, F.max: max}[function]
    assert found.keys() == cells.keys()
    for (r, x, y), (value, n) in found.items():
        near = [cells.get((r, a, b)) for a in (x - 1, x, x + 1) for b in (y - 1, y, y + 1) if (a, b) != (x, y)]
        near = [v for v in near if v is not None and v == v]
        assert n == len(near) and value == (plain(near) if near else None)
    with pytest.raises(ValueError, match="avg"):
        spatial.neighbour_agg(df, "pest_load", function=F.median)


def test_repeated_days_are_refused(spark):
    days = spark.createDataFrame(
        [(p, d, 0.5, 1, 1, 30.0, 18.0) for p in (1, 2) for d in (1, 2, 3)],
        "plot_id int, day int, pest_load double, sprayed int, season int, t_mean double, solar_rad double",
    )
    twice = days.unionByName(days.filter("plot_id = 2 AND day = 2"))
    for operator in (
        windows.cumulative_exposure, windows.days_above, windows.days_since_spray, windows.spray_numbers,
        windows.heat_accumulation, windows.growth_accumulation,
    ):
        assert operator(days).count() == 6 and len(operator(days).collect()) == 6
        with pytest.raises(Exception, match=r"\(2\) has several rows on day 2"):
            operator(twice).collect()


def test_any_compound_survives_the_ledger(spark):
    log = spark.createDataFrame(
        [("r", "none", 0, 0, 1, c, 1, 2.0, 0.1, 100.0) for c in ("zineb", "copper", None)] + [("r", "none", 0, 0, 2, "zineb", 1, 2.0, 0.1, 100.0)]
        + [("r", "none", 0, 0, 3, None, 1, 2.0, 0.1, 100.0)],
        "run_id string, strategy string, plot_x int, plot_y int, season int, pesticide_choice string, spray_count int, "
        "grain_tha double, resistant_fraction double, cost_per_spray double",
    )
    found = replay.season_ledger(log)
    assert {r.season: r.pesticide_choice for r in found.collect()} == {1: "copper", 2: "zineb", 3: None}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_running_days(spark):
    rows = [(1, d, load, s) for d, load, s in ((1, 0.5, 0), (2, 0.25, 1), (5, 0.75, 0), (6, 0.5, 1), (8, 0.0, 0))]
    days = spark.createDataFrame(rows, "plot_id int, day int, pest_load double, sprayed int").withColumn(
        "season", F.when(F.col("day") < 5, 1).otherwise(2)
    )
    days = windows.cumulative_exposure(days)
    days = windows.days_above(days)
    days = windows.days_since_spray(days)
    days = windows.spray_numbers(days).orderBy("day")
    found = days.collect()
    assert [r.cumulative_exposure for r in found] == [0.5, 0.75, 1.5, 2.0, 2.0]
    assert [r.days_above_threshold for r in found] == [1, 1, 2, 3, 3]
    assert [r.days_since_spray for r in found] == [1, 2, 3, 4, 2]
    assert [r.lifetime_sprays for r in found] == [0, 1, 1, 2, 2]
    assert [r.season_sprays for r in found] == [0, 1, 0, 1, 1]


@pytest.mark.parametrize(
    "told,found,limit,whole,ok",
    [(5, 5.4, 0.0, True, True), (5, 5.5, 9.0, True, False), (0.01, 0.0, 0.02, False, True),
     (0.03, 0.0, 0.02, False, False), (101.0, 100.0, 0.02, False, True), (103.0, 100.0, 0.02, False, False),
     (9974.9, 10024.0, 5.0, False, True)],
)
def test_tolerances(spark, told, found, limit, whole, ok):
    assert one(spark, audit.within_tolerance(told, found, limit, whole)) is ok


def test_missing_figures_fail_the_audit(spark):
    told = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    found = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    checks = audit.check(found, told, ["k"], {"v": 0.1})
    assert [r.k for r in audit.discrepancies(checks).collect()] == ["b"]
    verdict = audit.audit_verdict(checks).first()
    assert (verdict.n_checks, verdict.n_discrepancies, verdict.passed) == (2, 1, False)
    assert audit.audit_verdict(checks.filter("k = 'z'")).first().passed is True


def test_vacuous_tolerances(spark):
    told = spark.createDataFrame([(0.02, False), (5.0, False), (5.0, True)], "tolerance double, whole boolean")
    assert audit.vacuous_tolerances(told).count() == 2
    assert audit.vacuous_tolerances(told, whole="whole").count() == 1


def test_policy_audit_finds_wrong_rows(spark):
    logged = spark.createDataFrame(
        [("r", 1, "calendar", 0.3), ("r", 2, "none", 0.35), ("r", 3, "none", None)],
        "run_id string, season int, strategy string, threshold double",
    )
    rule = spark.createDataFrame(
        [("r", 1, "calendar", 0.3 + 1e-12), ("r", 2, "threshold", 0.35), ("r", 3, "none", 0.3)],
        "run_id string, season int, plan string, limit double",
    )
    wrong = audit.policy_audit(logged, rule, ["run_id", "season"], {"strategy": "plan", "threshold": "limit"})
    assert sorted(r.season for r in wrong.collect()) == [2, 3]
