"""Reading, checking, routing and writing logs.

The logs are written by Spark from the harvest view into a fresh folder below
the shared folder, then read back; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.operators.summaries import season_summary
from fieldtally.plans.base import HARVEST_LOG, IDS, plan, sql
from fieldtally.session import new_folder
from fieldtally.sources import logs, views
from fieldtally.sources.contracts import conform, contract, present_keys, to_common

_SEASON_SQL = """
SELECT strategy, pesticide_choice, season, grain_tha, pest_loss_tha, resistant_fraction, spray_count, cost_per_spray
FROM seasons"""


@plan("io1_read_log", sql(_SEASON_SQL, "seasons"))
def _read_log(spark, folder):
    path = new_folder(spark, "log")
    logs.write_summary(conform(views.harvest(spark, folder), HARVEST_LOG), path)
    log = logs.read_log(spark, path, HARVEST_LOG)
    return season_summary(log, present_keys(log, HARVEST_LOG))


@plan("io2_contract_projection", sql("""
SELECT run_id, strategy, CAST(NULL AS VARCHAR) AS rotation_pattern, pesticide_choice, season, plot_x, plot_y,
       grain_tha, pest_loss_tha, spray_count, resistant_fraction, cost_per_spray
FROM harvest""", "harvest"))
def _contract_projection(spark, folder):
    return conform(
        views.harvest(spark, folder), contract("sensitivity_output_compound_sequence_grid_calendar")
    )


@plan("io2_common_form", sql("""
SELECT 'harvest_grid_output' AS dataset, strategy, CAST(NULL AS VARCHAR) AS pesticide_choice,
       CAST(count(*) AS BIGINT) AS n_rows, sum(grain_tha) AS grain FROM harvest WHERE season <= 3 GROUP BY strategy
UNION ALL
SELECT 'harvest_grid_output_rotation', strategy, pesticide_choice, CAST(count(*) AS BIGINT), sum(grain_tha)
FROM harvest WHERE season > 3 GROUP BY strategy, pesticide_choice""", "harvest"))
def _common_form(spark, folder):
    log = views.harvest(spark, folder)
    short = to_common(log.filter("season <= 3").drop("pesticide_choice"), contract("harvest_grid_output"))
    rotated = to_common(log.filter("season > 3"), contract("harvest_grid_output_rotation"))
    return (
        short.unionByName(rotated)
        .groupBy("dataset", "strategy", "pesticide_choice")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("grain_tha").alias("grain"))
    )


@plan("io3_union_logs", sql("""
SELECT 'low' AS source, run_id, strategy, pesticide_choice, immigration_rate, season, plot_x, plot_y, grain_tha
FROM harvest WHERE immigration_rate <= 0.2
UNION ALL
SELECT 'high', run_id, strategy, NULL, immigration_rate, season, plot_x, plot_y, grain_tha
FROM harvest WHERE immigration_rate > 0.2""", "harvest"))
def _union_logs(spark, folder):
    log = views.harvest(spark, folder).select(
        "run_id", "strategy", "pesticide_choice", "immigration_rate", "season", "plot_x", "plot_y", "grain_tha"
    )
    low = log.filter(F.col("immigration_rate") <= 0.2)
    high = log.filter(F.col("immigration_rate") > 0.2).drop("pesticide_choice")
    return logs.union_logs({"low": low, "high": high})


_FILES = """
SELECT run_id, season, plot_x, plot_y, pesticide_choice AS file_compound,
       CAST(60 + season AS INT) AS file_efficacy_pct, CAST(2 + season % 3 AS INT) AS file_increment_pct,
       CAST(floor(cost_per_spray) AS INT) AS file_cost
FROM harvest"""


def _configured(spark, folder):
    """The harvest log, written as one CSV folder for each configuration it holds."""
    path = new_folder(spark, "configs")
    name = F.concat(
        F.lit("sensitivity_output_"), F.col("pesticide_choice"), F.lit("_eff"), F.lit(60) + F.col("season"),
        F.lit("_inc"), F.lit(2) + F.col("season") % 3, F.lit("_cost"), F.floor("cost_per_spray"), F.lit(".csv"),
    )
    log = conform(views.harvest(spark, folder), HARVEST_LOG)
    logs.write_routed(logs.route(log, []).withColumn("dataset", name), path, "csv", rebalance=True)
    return path


@plan("io4_config_from_path", sql(_FILES, "harvest"))
def _config(spark, folder):
    rows = logs.read_config_logs(spark, _configured(spark, folder), HARVEST_LOG)
    return rows.select("run_id", "season", "plot_x", "plot_y", *logs.FILE_COLUMNS)


@plan("io4_config_filtered", sql(f"""
SELECT file_compound, file_efficacy_pct, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT run_id) AS BIGINT) AS n_runs
FROM ({_FILES}) f WHERE file_efficacy_pct >= 64 AND file_compound = 'etofenprox' GROUP BY ALL""", "harvest"))
def _config_filtered(spark, folder):
    where = (F.col("file_efficacy_pct") >= 64) & (F.col("file_compound") == "etofenprox")
    rows = logs.read_config_logs(spark, _configured(spark, folder), HARVEST_LOG, where)
    return rows.groupBy("file_compound", "file_efficacy_pct").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("run_id").alias("n_runs")
    )


@plan("io5_clean_log", sql("""
SELECT 'good' AS kind, strategy, CAST(count(*) AS BIGINT) AS n_lines, sum(grain_tha) AS grain
FROM harvest GROUP BY strategy
UNION ALL SELECT 'malformed', NULL, CAST(count(*) AS BIGINT), NULL FROM harvest WHERE plot_x = 3 AND season = 2
UNION ALL SELECT 'repeated header', NULL, CAST(count(*) AS BIGINT), NULL FROM harvest
          WHERE plot_x = 5 AND plot_y = 5 AND season = 1""", "harvest"))
def _clean_log(spark, folder):
    path = new_folder(spark, "dirty")
    columns = HARVEST_LOG.columns
    log = conform(views.harvest(spark, folder), HARVEST_LOG)
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    header = F.lit(",".join(columns))
    # Some rows are followed by a cut-off copy, some by a header written again.
    extra = F.when(
        (F.col("plot_x") == 3) & (F.col("season") == 2), F.substring_index("line", ",", 7)
    ).when((F.col("plot_x") == 5) & (F.col("plot_y") == 5) & (F.col("season") == 1), header)
    lines = log.withColumn("line", line).select(
        F.explode(F.array_compact(F.array("line", extra))).alias("value")
    )
    lines.write.text(path)
    raw = logs.read_dirty_log(spark, path, HARVEST_LOG)
    return raw.groupBy("kind", "strategy").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("grain_tha").alias("grain"))


@plan("io6_source_report", sql("""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT run_id) AS BIGINT) AS n_runs,
       max(season) AS max_season,
       (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT strategy AS s FROM harvest) a) AS strategy_values,
       (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT pesticide_choice AS s FROM harvest) a)
           AS pesticide_choice_values
FROM harvest""", "harvest"))
def _source_report(spark, folder):
    return logs.source_report(views.harvest(spark, folder))


@plan("io6_distinct_names", sql("""
SELECT 'strategy' AS "column", strategy AS value, CAST(count(*) AS BIGINT) AS n_rows FROM harvest GROUP BY strategy
UNION ALL
SELECT 'pesticide_choice', pesticide_choice, CAST(count(*) AS BIGINT) FROM harvest GROUP BY pesticide_choice
UNION ALL
SELECT 'run_id', run_id, CAST(count(*) AS BIGINT) FROM harvest GROUP BY run_id""", "harvest"))
def _distinct_names(spark, folder):
    return logs.distinct_names(views.harvest(spark, folder), ["strategy", "pesticide_choice", "run_id"])


@plan("io6_sketched_counts", sql("""
SELECT strategy, CAST(count(DISTINCT run_id) AS BIGINT) AS n_run_id,
       CAST(count(DISTINCT pesticide_choice) AS BIGINT) AS n_pesticide_choice
FROM harvest GROUP BY strategy""", "harvest"))
def _sketched_counts(spark, folder):
    names = ["run_id", "pesticide_choice"]
    sketches = logs.name_sketches(views.harvest(spark, folder), names, ["strategy", "season"])
    return logs.sketched_counts(sketches, names, ["strategy"])


@plan("io7_route", sql("""
SELECT CASE WHEN plot_x = 0 THEN 'sensitivity_output_interval_grid'
            WHEN plot_y = 0 THEN 'sensitivity_output_interval_grid_rotation'
            WHEN season = 1 THEN 'sensitivity_output_strategyswap_grid_resistance'
            WHEN strategy = 'threshold' THEN 'harvest_grid_output_rotation'
            WHEN immigration_rate > 0.5 THEN 'sensitivity_output_immigration_grid_extended'
            WHEN plot_y < 9 THEN 'harvest_grid_output' END AS dataset,
       CAST(count(*) AS BIGINT) AS n_rows, sum(grain_tha) AS grain
FROM harvest GROUP BY 1""", "harvest"))
def _route(spark, folder):
    flags = {
        "interval_sweep_mode": F.col("plot_x") == 0,
        "interval_sweep_mode_rotation": F.col("plot_y") == 0,
        "strategyswap_resistance_sweep_mode": F.col("season") == 1,
        "strategyswap_profit_sweep_mode": F.col("season") == 1,
        "rotation_mode": (F.col("strategy") == "threshold") | (F.col("plot_y") == 0),
        "sweep_immigration_mode_extended": F.col("immigration_rate") > 0.5,
        "batch_mode": F.col("plot_y") < 9,
    }
    routed = logs.route(views.harvest(spark, folder).withColumns(flags))
    return routed.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("grain_tha").alias("grain"))


@plan("io7_route_written", sql("""
SELECT CASE WHEN strategy = 'none' THEN 'harvest_grid_output'
            WHEN strategy = 'calendar' THEN 'sensitivity_output_interval_grid' END AS dataset,
       CAST(count(*) AS BIGINT) AS n_rows, sum(grain_tha) AS grain
FROM harvest WHERE strategy <> 'threshold' GROUP BY 1""", "harvest"))
def _route_written(spark, folder):
    path = new_folder(spark, "routed")
    rules = [
        (F.col("strategy") == "calendar", "sensitivity_output_interval_grid"),
        (F.col("strategy") == "none", "harvest_grid_output"),
    ]
    logs.write_routed(logs.route(views.harvest(spark, folder), rules), path)
    return (
        spark.read.parquet(path)
        .groupBy("dataset")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("grain_tha").alias("grain"))
    )


@plan("io7_read_dataset", sql("""
SELECT run_id, strategy, pesticide_choice, season, plot_x, plot_y, grain_tha, pest_loss_tha, spray_count,
       resistant_fraction, cost_per_spray
FROM harvest WHERE strategy = 'threshold'""", "harvest"))
def _read_dataset(spark, folder):
    path = new_folder(spark, "store")
    target = contract("harvest_grid_output_rotation")
    rules = [(F.col("strategy") == "threshold", target.name), (F.lit(True), "harvest_grid_output")]
    logs.write_routed(logs.route(views.harvest(spark, folder), rules), path, rebalance=True)
    return logs.read_dataset(spark, path, target)


@plan("io8_write_summary", sql("""
SELECT * FROM (SELECT strategy, pesticide_choice, season, grain_tha, pest_loss_tha, resistant_fraction,
                      spray_count, cost_per_spray FROM seasons) a
UNION ALL
SELECT * FROM (SELECT strategy, pesticide_choice, season, grain_tha, pest_loss_tha, resistant_fraction,
                      spray_count, cost_per_spray FROM seasons) b""", "seasons"))
def _write_summary(spark, folder):
    path = new_folder(spark, "summary")
    summary = season_summary(views.harvest(spark, folder), IDS)
    logs.write_summary(summary, path, "parquet", "overwrite")
    logs.write_summary(spark.read.schema(summary.schema).parquet(path), path, "parquet", "append")
    return spark.read.parquet(path)
