from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetlane.operators import reports, sequence

from .tracks import SCHEMA, T0, by_device, guarded, random_tracks, track


@pytest.mark.parametrize("rows, stops", [([(0, 40), (1, 0), (4, 40)], 1), ([(0, 40), (1, 0), (3.99, 40)], 0), ([(0, 40), (1, 0)], 1), ([(0, 0)], 1), ([(0, 40)], 0)])
def test_daily_stop_count(spark, rows, stops):
    assert reports.daily_points(track(spark, rows)).first()["stop_count"] == stops


@pytest.mark.parametrize(
    "rows, threshold, segments",
    [
        ([(0, 40), (5, 40), (6, 0), (12, 0)], 5, 1),
        ([(0, 40), (1, 0), (6, 0), (7, 40)], 5, 2),
        ([(0, 40), (1, 0), (6, 0), (7, 40)], 5.0001, 1),
        ([(0, 0), (1, 0)], 1, 0),
        ([(0, 40), (1, 40), (2, 40)], 1, 1),
    ],
)
def test_travel_segments(spark, rows, threshold, segments):
    stats = reports.travel_stats(track(spark, rows), (threshold,)).first()
    assert stats["total_segments"] == segments
    assert (stats["total_distance_km"] > 0) == (segments > 0)


def test_travel_and_daily_count_an_open_stop_differently(spark):
    t = track(spark, [(0, 40), (1, 0), (3, 0)])
    assert reports.travel_stats(t, (5,)).first()["total_stop_count"] == 0
    assert reports.daily_points(t).first()["stop_count"] == 1


@pytest.mark.parametrize(
    "rows, seconds",
    [
        ([(0, 0, None), (5, 0, None), (10, 0, None), (11, 40)], []),
        ([(0, 0), (5, 0), (10, 0), (11, 40)], [660.0]),
        ([(0, 0), (5, 0), (5, 40)], [300.0]),
        ([(0, 0), (4, 0), (4.0001, 40)], []),
        ([(0, 0), (6, 0)], [360.0]),
        ([(0, 0), (3, 0), (14.7, 0), (20.7, 0)], [360.0]),
    ],
)
def test_idle_intervals(spark, rows, seconds):
    assert [r["seconds"] for r in reports.idle_intervals(track(spark, rows)).orderBy("start_at").collect()] == seconds


def test_mileage_is_that_of_a_loop(spark):
    rows = random_tracks(1)
    got = {r["imei"]: r["km"] for r in reports.mileage(spark.createDataFrame(rows, SCHEMA)).collect()}
    for imei, own in by_device(rows).items():
        want = sum(guarded(a, b)[0] for a, b in zip(own, own[1:], strict=False) if a[4] > 0 or b[4] > 0)
        assert got[imei] == pytest.approx(want, abs=1e-9)


def test_incremental_mileage_twice_adds_nothing_and_needs_the_prior_point(spark):
    t = track(spark, [(0, 40), (5, 40), (10, 40)])
    none = spark.createDataFrame([], "imei string, last_mileage_at timestamp, km_total double, miles_total double")
    once = reports.incremental_mileage(t, none)
    again = reports.incremental_mileage(t, once).first()
    assert again["km_total"] == once.first()["km_total"] == pytest.approx(reports.mileage(t).first()["km"])
    later = reports.incremental_mileage(t, spark.createDataFrame([("A", T0 + timedelta(minutes=5), 100.0, 62.0)], none.schema)).first()
    assert 0 < later["km_total"] - 100 < again["km_total"] and later["last_mileage_at"] == T0 + timedelta(minutes=10)


def test_static_threshold_and_missing_rows(spark):
    t = track(spark, [(0, 40), (5, 40, True, 31.0, 31.0)]).unionByName(track(spark, [(0, 0)], "B"))
    daily = spark.createDataFrame([("C", T0.date(), 0.5), ("D", T0.date(), 0.51), ("E", T0.date(), None)], "imei string, day date, km double")
    got = {r["imei"]: r["is_static"] for r in reports.static_stats(t, daily).collect()}
    assert got == {"A": True, "B": True, "C": True, "D": False, "E": True}  # A's only pair is a jump


def test_partitioning_does_not_change_reports(spark):
    t = spark.createDataFrame(random_tracks(2), SCHEMA)
    few, many = (reports.travel_stats(t.repartition(n)).drop("segments") for n in (1, 8))
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()


def test_reports_of_no_points(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (reports.mileage, reports.daily_points, reports.travel_stats, reports.idle_stats, reports.travel_segments):
        assert f(none).count() == 0


def test_one_exchange_for_a_report(spark, capsys):
    t = spark.createDataFrame(random_tracks(3), SCHEMA)
    for df in (reports.daily_points(t), reports.idle_stats(t), reports.travel_segments(t), reports.travel_stats(t)):
        df.explain()
        assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_range_filter_is_half_open(spark):
    t = track(spark, [(0, 1), (1, 1), (2, 1)])
    at = [F.lit(T0 + timedelta(minutes=m)) for m in (0, 2)]
    assert sequence.in_range(t, *at).count() == 2


def test_a_distance_is_computed_once(spark):
    points = derived_points(spark)
    plan = reports.mileage(points)._jdf.queryExecution().executedPlan().toString()
    assert plan.upper().count("ATAN2") == 1 and plan.count("Exchange hash") == 1


def derived_points(spark):
    return spark.createDataFrame([], "imei string, packet_date timestamp, latitude double, longitude double, speed double, ignition boolean, position_id long")


def test_incremental_mileage_reads_new_points_alone(spark, tmp_path):
    t = track(spark, [(k, 50) for k in range(40)])
    t.write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    status = spark.createDataFrame([], "imei string, last_mileage_at timestamp, km_total double, miles_total double, last_point_at timestamp, last_latitude double, last_longitude double, last_speed double")
    half = T0 + timedelta(minutes=20)
    first = reports.incremental_mileage(points.filter(F.col("packet_date") <= F.lit(half)), status)
    again = spark.createDataFrame(first.collect(), status.schema)
    out = reports.incremental_mileage(points, again, F.lit(half))
    whole = reports.mileage(points).first()["km"]
    assert abs(out.first()["km_total"] - whole) < 1e-9 and again.first()["km_total"] < whole
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(packet_date" in plan


def test_travel_sorts_points_once(spark):
    """Points multiplied by thresholds, and windows by run and threshold, were sorted anew, each in a task's memory."""
    t = spark.createDataFrame(random_tracks(4), SCHEMA)
    plan = reports.travel_segments(t)._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert plan.count("Sort [") == 1 and "SortAggregate" not in plan
