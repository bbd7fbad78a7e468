"""Incremental summaries; each must equal its batch counterpart."""

from __future__ import annotations

from fieldtally.plans.base import IDS, plan, sql
from fieldtally.session import new_folder
from fieldtally.sources import views
from fieldtally.streaming import incremental


@plan("st1_incremental_season_summary", sql("""
SELECT strategy, pesticide_choice, season, grain_tha, pest_loss_tha, resistant_fraction, spray_count, cost_per_spray
FROM seasons""", "seasons"))
def _season_stream(spark, folder):
    schema = views.table(spark, folder, "lineitem").schema
    # A glob, since the table may be one file or a folder of files.
    arriving = incremental.stream_parquet(spark, f"{folder}/lineitem.parque[t]", schema)
    summary = incremental.season_summary_stream(views.harvest_of(arriving), IDS)
    return incremental.run_complete(summary, new_folder(spark, "seasons"))


@plan("st2_incremental_daily_monitors", sql("""
SELECT day, avg(pest_load) AS mean_load, max(pest_load) AS max_load,
       CAST(sum(sprayed) AS BIGINT) AS total_sprays, max(sprayed) AS any_spray
FROM daily GROUP BY day""", "daily"))
def _daily_stream(spark, folder):
    path = new_folder(spark, "daily")
    days = views.daily(spark, folder)
    days.write.parquet(path)
    arriving = incremental.stream_parquet(spark, path, days.schema, files_per_trigger=2)
    summary = incremental.daily_monitors_stream(arriving)
    return incremental.run_update(summary, ["day"], new_folder(spark, "monitors"))
