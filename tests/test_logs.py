"""Readers, writers, routing and contracts."""

import os

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import joins
from fieldtally.session import broadcast_if_small, new_folder, shared_folder
from fieldtally.sources import logs, views
from fieldtally.sources.contracts import (
    CONTRACTS,
    Contract,
    common_columns,
    config_file_name,
    conform,
    contract,
    present_keys,
    register,
    require_columns,
    to_common,
    with_derived,
)

GRID = contract("harvest_grid_output")
HEADER = ",".join(GRID.columns)


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as out:
        out.write(text)
    return path


def test_read_checks_the_header(spark, tmp_path):
    path = write(tmp_path, "a.csv", "run_id,season\nnone_0,1\n")
    with pytest.raises(ValueError, match="resistant_fraction"):
        logs.read_log(spark, path, GRID)
    assert logs.read_log(spark, path, GRID, required=["season"]).first().season == 1


def test_read_takes_types_from_the_contract_and_names_from_the_header(spark, tmp_path):
    columns = ["season", "run_id", "grain_tha", "note"]
    path = write(tmp_path, "a.csv", ",".join(columns) + "\n1,none_0,NaN,x\n2,none_0,2,y\n")
    log = logs.read_log(spark, path, GRID, required=["season"])
    assert dict(log.dtypes) == {"season": "int", "run_id": "string", "grain_tha": "double", "note": "string"}
    assert [r.grain_tha for r in log.orderBy("season").collect()] == [None, 2.0]


def test_booleans_are_read(spark, tmp_path):
    log = contract("sensitivity_output_adaptive_farmer_rotation_grid")
    line = "calendar_0,calendar,true,false,14,etofenprox,1,0,0,2.5,0.5,5,0.1,110.6"
    path = write(tmp_path, "a.csv", ",".join(log.columns) + "\n" + line + "\n")
    row = logs.read_log(spark, path, log).filter("adaptive_profit_mode = true").first()
    assert (row.adaptive_profit_mode, row.rotation_mode, row.calendar_interval) == (True, False, 14)


def test_dirty_log_is_split(spark, tmp_path):
    good = "none_0,none,1,0,0,2.0,1.0,0,0.0,100.0"
    text = "\n".join([HEADER, good, "none_0,none,1,0", HEADER, good + ",9", good.replace("1,0,0", "x,0,0"), good])
    raw = logs.read_dirty_log(spark, write(tmp_path, "a.csv", text + "\n"), GRID)
    clean = logs.clean_log(raw)
    assert clean.columns == list(GRID.columns) and clean.count() == 2
    reasons = logs.quarantine(raw, GRID).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in reasons} == {"repeated header": 2, "malformed": 3}


def test_file_names_spell_out_the_run(spark, tmp_path):
    name = config_file_name("starfarm", 60, 3, 100)
    write(tmp_path, name + ".csv", "run_id\nnone_0\n")
    write(tmp_path, "harvest_output.csv", "run_id\nnone_1\n")
    rows = spark.read.option("header", True).csv(str(tmp_path))
    found = {r.run_id: r for r in logs.with_file_config(rows).collect()}
    assert tuple(found["none_0"])[1:] == ("starfarm", 60, 3, 100)
    assert tuple(found["none_1"])[1:] == (None, None, None, None)
    assert name in CONTRACTS


def test_configurations_are_parsed_once_a_file_and_pick_the_files(spark):
    path = new_folder(spark, "configs")
    rows = spark.createDataFrame(
        [(f"none_{i}", config_file_name("starfarm", e, 3, 100) + ".csv") for i, e in enumerate((60, 60, 70, 80))] + [("none_9", "harvest_output")],
        "run_id string, dataset string",
    )
    log = Contract("config_log", ("run_id",), ())
    logs.write_routed(rows, path, "csv")
    found = logs.read_config_logs(spark, path, log)
    told = {r.run_id: tuple(r)[1:] for r in found.collect()}
    assert told == {
        "none_0": ("starfarm", 60, 3, 100), "none_1": ("starfarm", 60, 3, 100), "none_2": ("starfarm", 70, 3, 100),
        "none_3": ("starfarm", 80, 3, 100), "none_9": (None, None, None, None),
    }
    few = logs.read_config_logs(spark, path, log, F.col("file_efficacy_pct") > 60)
    assert sorted(r.run_id for r in few.collect()) == ["none_2", "none_3"]
    # Only files of that name are opened, and no row's own text is matched.
    assert len(few.inputFiles()) == 2 and all("eff70" in f or "eff80" in f for f in few.inputFiles())
    assert "regexp" not in few._jdf.queryExecution().executedPlan().toString()
    none = logs.read_config_logs(spark, path, log, "file_cost > 999")
    assert none.columns == found.columns and none.count() == 0


def test_kinds_of_lines_are_counted_while_the_clean_ones_are_written(spark, tmp_path):
    good = "none_0,none,1,0,0,2.0,1.0,0,0.0,100.0"
    text = "\n".join([HEADER, good, "none_0,none,1,0", HEADER, good])
    raw, seen = logs.observe_kinds(logs.read_dirty_log(spark, write(tmp_path, "a.csv", text + "\n"), GRID))
    out = new_folder(spark, "clean")
    logs.clean_log(raw).write.parquet(out)
    assert spark.read.parquet(out).count() == 2
    assert seen.get == {"good": 2, "repeated_header": 2, "malformed": 1}
    assert raw.filter("kind <> 'good'").filter("run_id IS NOT NULL OR grain_tha IS NOT NULL").count() == 0


def test_names_as_rows_and_sketches(spark):
    rows = spark.createDataFrame(
        [(f"r{i % 7}", 1 + i % 3, "ab"[i % 2] if i % 5 else None, f"n{i}") for i in range(600)],
        "run_id string, season int, strategy string, pesticide_choice string",
    )
    report = logs.source_report(rows, listed=2).first()
    assert (report.n_rows, report.n_runs, report.max_season) == (600, 7, 3)
    assert (report.strategy_values, report.pesticide_choice_values) == ("a,b", "n0,n1")
    names = {(r.column, r.value): r.n_rows for r in logs.distinct_names(rows, ["strategy", "run_id", "nothing"]).collect()}
    assert names["strategy", "a"] + names["strategy", "b"] == 480 and sum(n for (c, _), n in names.items() if c == "run_id") == 600
    sketches = logs.name_sketches(rows, ["run_id", "pesticide_choice"], ["season"])
    merged = logs.sketched_counts(sketches, ["run_id", "pesticide_choice"]).first()
    assert merged.n_run_id == 7 and abs(merged.n_pesticide_choice - 600) <= 30
    assert logs.sketched_counts(sketches, ["run_id"], ["season"]).count() == 3


def test_union_keeps_columns_of_either_log(spark):
    a = spark.createDataFrame([("r", 1)], "run_id string, x int")
    b = spark.createDataFrame([("s", 2.5)], "run_id string, y double")
    rows = logs.union_logs({"low": a, "high": b}).orderBy("run_id").collect()
    assert [(r.run_id, r.x, r.y, r.source) for r in rows] == [("r", 1, None, "low"), ("s", None, 2.5, "high")]


def test_first_rule_wins(spark):
    flags = spark.createDataFrame(
        [(1, True, True, True), (2, False, True, True), (3, False, False, True), (4, False, False, False)],
        "id int, interval_sweep_mode_rotation boolean, rotation_mode boolean, batch_mode boolean",
    )
    routed = {r.id: r.dataset for r in logs.route(flags).collect()}
    assert routed == {
        1: "sensitivity_output_interval_grid_rotation",
        2: "harvest_grid_output_rotation",
        3: "harvest_grid_output",
        4: None,
    }
    assert logs.route(flags.select("id")).filter("dataset IS NOT NULL").count() == 0


def test_routes_lead_to_contracts():
    targets = [name for _, name in logs.ROUTES]
    assert len(targets) == len(set(targets)) == 29
    assert set(targets) <= set(CONTRACTS)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_routed_rows_are_written_once(spark, fmt):
    path = new_folder(spark, "routes")
    flags = spark.range(10).selectExpr("id", "id < 3 AS rotation_mode", "id < 8 AS batch_mode")
    logs.write_routed(logs.route(flags), path, fmt)
    back = spark.read.option("header", True).format(fmt).load(path)
    assert {r.dataset: r["count"] for r in back.groupBy("dataset").count().collect()} == {
        "harvest_grid_output_rotation": 3,
        "harvest_grid_output": 5,
    }


def test_overwrite_and_append(spark):
    path = new_folder(spark, "out")
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    for mode, count in (("overwrite", 1), ("append", 2), ("overwrite", 1)):
        logs.write_summary(one, path, "csv", mode)
        assert spark.read.option("header", True).csv(path).count() == count


def test_source_report(spark, folder):
    report = logs.source_report(views.harvest(spark, folder)).first()
    assert report.strategy_values == "calendar,none,threshold"
    empty = logs.source_report(views.harvest(spark, folder).filter("season > 99")).first()
    assert (empty.n_rows, empty.n_runs, empty.max_season, empty.strategy_values) == (0, 0, None, "")


def test_contract_keys_leave_trajectories_out():
    swaps = contract("sensitivity_output_strategyswap_grid_profit")
    assert swaps.keys == (
        "adaptive_strategyswap_profit_mode", "adaptive_strategyswap_resistance_mode", "initial_strategy",
    )
    sequence = contract("sensitivity_output_compound_sequence_grid_calendar")
    assert sequence.keys == ("strategy", "rotation_pattern")
    assert contract("sensitivity_output_decay_grid").keys == ("strategy", "resistance_fitness_cost")
    longterm = contract("harvest_grid_output_longterm")
    assert longterm.keys == ("strategy", "pesticide_choice")
    assert longterm.columns[6:9] == ("grain_tha", "pest_load", "pest_loss_tha")


def test_every_swept_column_is_a_key():
    """Or, where a run logs it live, its first value is."""
    for log in CONTRACTS.values():
        missing = set(log.sweep) - set(log.keys)
        assert missing == ({"strategy"} if log.derived == ("initial_strategy",) else set()), log.name


def test_swap_logs_get_their_first_strategy(spark):
    log = contract("sensitivity_output_strategyswap_grid_profit")
    rows = spark.createDataFrame([("calendar_3", "none")], "run_id string, strategy string")
    assert with_derived(rows, log).first()["initial_strategy"] == "calendar"
    assert with_derived(rows, contract("harvest_grid_output_longterm")).columns == rows.columns


def test_unknown_contract_and_own_contract(spark):
    with pytest.raises(KeyError):
        contract("nothing")
    own = register(Contract("own_log", ("run_id", "season", "rate"), ("rate",)))
    rows = spark.createDataFrame([("r", 1, 0.5)], "run_id string, season int, rate double")
    assert present_keys(rows, own) == ["rate"]
    assert present_keys(rows.drop("rate"), own) == []
    with pytest.raises(ValueError, match="season"):
        require_columns(rows.drop("season"), ["run_id", "season"])


def test_conform_casts_and_orders(spark):
    rows = spark.createDataFrame(
        [("none_0", "1", "2.5", 1.0, 3.0, "0.5", 100)],
        "run_id string, season string, grain_tha string, pest_loss_tha double, spray_count double, "
        "resistant_fraction string, cost_per_spray int",
    )
    out = conform(rows, GRID)
    assert out.schema == GRID.schema
    assert out.first().strategy is None
    with pytest.raises(ValueError, match="grain_tha"):
        conform(rows.drop("grain_tha"), GRID)


def test_folders_come_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_large_sides_are_not_broadcast(spark):
    small, large = spark.range(5), spark.range(20)
    plan = broadcast_if_small(small, 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan
    plan = broadcast_if_small(large, 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in plan


def test_compound_lookup_keeps_defaults(spark):
    rows = spark.createDataFrame([("starfarm",), ("etofenprox",), ("copper",), (None,)], "pesticide_choice string")
    found = joins.with_compound(rows, views.compounds(spark)).collect()
    got = {r.pesticide_choice: (r.efficacy, r.selection_pressure, r.cost) for r in found}
    default = (0.8, 0.02, 100.0)
    assert got == {"starfarm": default, "etofenprox": (0.7, 0.015, 110.6), "copper": default, None: default}


def test_unmatched_names_its_side(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "k string, n int")
    b = spark.createDataFrame([("y", 1), ("z", 1), ("z", 1)], "k string, n int")
    found = {r.k: r.side for r in joins.unmatched(a, b, ["k", "n"]).collect()}
    assert found == {"x": "computed only", "z": "reported only"}


def test_profit_lead_of_a_missing_side_is_null(spark):
    rows = spark.createDataFrame(
        [("threshold_0", "threshold", 1, 2.0, 1, 100.0), ("calendar_0", "calendar", 1, 1.0, 0, 100.0),
         ("threshold_0", "threshold", 2, 2.0, 0, 100.0)],
        "run_id string, strategy string, season int, grain_tha double, spray_count int, cost_per_spray double",
    )
    lead = {r.season: r.lead for r in joins.profit_lead(rows).collect()}
    assert lead == {1: 2900.0, 2: None}


def test_stage_lookup_bounds(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 69.9, 70.0, 919.9, 920.0, 1349.9, 1350.0)], "heat double")
    found = joins.with_stage(rows).orderBy("heat").collect()
    assert [r.stage for r in found] == [1, 1, 2, 2, 3, 3, 4]
    assert [r.fapar for r in found] == [0.2, 0.2, 0.7, 0.7, 0.9, 0.9, 0.85]


def test_common_form_holds_every_grid_log(spark):
    columns = common_columns()
    assert len(columns) == len(set(columns))
    for log in CONTRACTS.values():
        if log.plots > 1:
            empty = to_common(spark.createDataFrame([], log.schema), log)
            assert empty.columns == ["dataset", *columns]
            assert all(empty.schema[c].dataType == log.schema[c].dataType for c in log.columns)
