"""Incremental results equal the batch results, file by file."""

from pyspark.sql import functions as F

from fieldtally.operators.summaries import daily_monitors, season_summary
from fieldtally.session import new_folder
from fieldtally.sources import views
from fieldtally.sources.contracts import conform, contract
from fieldtally.streaming import incremental

LOG = contract("harvest_grid_output_rotation")
IDS = ["strategy", "pesticide_choice"]


def as_set(df):
    return {tuple(r) for r in df.select(*sorted(df.columns)).collect()}


def write_csv(df, path):
    df.repartition(3).write.mode("append").option("header", True).csv(path)


def test_season_summary_keeps_up(spark, folder):
    log = conform(views.harvest(spark, folder), LOG)
    path, out, state = (new_folder(spark, n) for n in ("arriving", "summary", "state"))
    early, late = log.filter("season <= 3"), log.filter("season > 3")
    for part, so_far in ((early, early), (late, log)):
        write_csv(part, path)
        rows = incremental.stream_log(spark, path, LOG, files_per_trigger=1)
        found = incremental.run_complete(incremental.season_summary_stream(rows, IDS), out, state)
        assert as_set(found) == as_set(season_summary(so_far, IDS))


def test_daily_monitors_keep_up(spark, folder):
    days = views.daily(spark, folder)
    path, out, state = (new_folder(spark, n) for n in ("arriving", "monitors", "state"))
    for part in (days.filter("plot_id % 2 = 0"), days.filter("plot_id % 2 = 1")):
        part.repartition(3).write.mode("append").parquet(path)
        rows = incremental.stream_parquet(spark, path, days.schema, files_per_trigger=1)
        found = incremental.run_update(incremental.daily_monitors_stream(rows), ["day"], out, state)
    assert as_set(found) == as_set(daily_monitors(days))
    # Six batches, but no more to read or to store than after two.
    assert len(incremental.versions(spark, out)) == incremental.KEPT
    assert found.count() == found.select("day").distinct().count()
    assert found.filter(F.col("any_spray").isNull()).count() == 0


def test_readers_see_whole_versions_only(spark):
    out = new_folder(spark, "published")
    assert incremental.current(spark, out) is None
    rows = spark.range(8).selectExpr("id AS k", "id * 2 AS v")
    assert incremental.publish(rows, out, "s-0")
    before = incremental.current(spark, out)
    # A version being written has files but no marker yet: readers stay with the old one.
    spark.range(3).selectExpr("id AS k", "id AS v").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/v000000000001-s-1")
    assert incremental.versions(spark, out) == ["v000000000000-s-0"] and incremental.current(spark, out).count() == 8
    # The batch is repeated after the failure, then once more: one version of it.
    more = rows.filter("k < 5")
    assert incremental.publish(more, out, "s-1") and not incremental.publish(more, out, "s-1")
    assert incremental.current(spark, out).count() == 5 and len(incremental.versions(spark, out)) == 2
    # Whoever began on the version before can still end.
    assert before.count() == 8


def test_what_is_stored_does_not_grow_with_the_batches(spark):
    out = new_folder(spark, "folded")
    for i in range(50):
        changed = spark.createDataFrame([(i % 7, i), (100 + i % 2, -i)], "k int, v int").coalesce(1)
        incremental.publish(incremental.fold(incremental.current(spark, out), changed, ["k"]).coalesce(1), out, f"s-{i}")
        if i in (9, 49):
            assert len(incremental.versions(spark, out)) == 2
            assert len(incremental.current(spark, out).inputFiles()) == 1
    found = {r.k: r.v for r in incremental.current(spark, out).collect()}
    assert found == {**{k: max(i for i in range(50) if i % 7 == k) for k in range(7)}, 100: -48, 101: -49}


def test_a_new_stream_on_an_old_table_goes_on_from_it(spark, folder):
    days = views.daily(spark, folder)
    path, out = new_folder(spark, "arriving"), new_folder(spark, "monitors")
    days.repartition(2).write.parquet(path)
    for _ in range(2):
        rows = incremental.stream_parquet(spark, path, days.schema, files_per_trigger=1)
        found = incremental.run_update(incremental.daily_monitors_stream(rows), ["day"], out)
        assert as_set(found) == as_set(daily_monitors(days))
