"""Sliced track tables, copy on write, and the query SQL that no other test runs."""

import hashlib
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlane.operators import events, reports
from fleetlane.sources import buckets

from .tracks import SCHEMA, T0, km, random_tracks


def digests(path):
    return {str(p.relative_to(path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet") if "manifests" not in str(p)}


def test_an_upsert_writes_touched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select(F.col("id").alias("imei"), F.lit(0.0).alias("km"))
    buckets.create(rows, path, ["imei"], 50)
    before = digests(path)
    new = rows.filter("imei in (3, 500)").withColumn("km", F.lit(7.0)).unionByName(spark.createDataFrame([(5000, 1.0)], "imei long, km double"))
    written = buckets.upsert(new, path)
    after = digests(path)
    assert 0 < written <= 3 and before.items() <= after.items()
    folders = lambda v: {r["bucket"]: r["folder"] for r in buckets.manifest(spark, path, v).collect()}
    assert sum(folders(0)[b] != folders(1)[b] for b in folders(0)) <= written
    got = {r["imei"]: r["km"] for r in buckets.read(spark, path).collect()}
    assert len(got) == 1001 and (got[3], got[500], got[5000], got[4]) == (7.0, 7.0, 1.0, 0.0)
    assert buckets.read(spark, path, 0).count() == 1000
    assert buckets.upsert(new.limit(0), path) == 0


def test_readers_take_complete_manifests(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(spark.range(10).withColumnRenamed("id", "k"), path, ["k"], 4)
    (tmp_path / "t" / "manifests" / "v=00000001").mkdir()  # an upsert that didn't end
    assert buckets.read(spark, path).count() == 10
    with pytest.raises(Exception, match="(?i)already exists"):
        buckets.upsert(spark.range(3).withColumnRenamed("id", "k"), path)


def carried(points, keep, cursor):
    last = {"packet_date": "last_point_at", "latitude": "last_latitude", "longitude": "last_longitude", "speed": "last_speed"}
    cursors = points.select("imei").distinct().filter(keep).withColumn("last_at", cursor)
    prior = reports.prior_points(points, cursors).select("imei", *[F.col(c).alias(n) for c, n in last.items()])
    return cursors.join(prior, "imei", "left").select("imei", F.col("last_at").alias("last_mileage_at"), F.lit(0.0).alias("km_total"), F.lit(0.0).alias("miles_total"), *reports.LAST_POINT)


def totals(df):
    return sorted((r["imei"], str(r["last_mileage_at"]), round(r["km_total"], 6)) for r in df.collect())


def days(seed):
    """Tracks of which each device's point k is k days later."""
    rows, n = [], {}
    for r in sorted(random_tracks(seed), key=lambda r: (r[0], r[1], r[6])):
        n[r[0]] = n.get(r[0], 0) + 1
        rows.append((r[0], r[1] + timedelta(days=n[r[0]] // 4), *r[2:]))
    return rows


def test_cursors_prune_slices_as_the_query_runs(spark, tmp_path):
    points = spark.createDataFrame(days(11), SCHEMA)
    reports.sliced(points, 8).repartition("slice").write.partitionBy("slice").parquet(str(tmp_path / "track"))
    stored = spark.read.parquet(str(tmp_path / "track"))
    cursor = F.lit(T0 + timedelta(days=4))
    status = carried(points, F.col("imei") != "D3", cursor).cache()
    first, until = F.lit(T0), F.lit(T0 + timedelta(days=30))
    known = points.select("imei").distinct().filter("imei <> 'D3'")
    out = reports.incremental_mileage_sliced(stored, known, status, first, until, 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    mine = lambda df: [r for r in totals(df) if r[0] != "D3"]
    assert mine(out) == mine(reports.incremental_mileage(points, status))
    every = reports.incremental_mileage_sliced(stored, points.select("imei").distinct(), status, first, until, 8)
    assert totals(every) == totals(reports.incremental_mileage(points, status))
    some = {r["slice"] for r in reports.wanted_slices(known, status, first, until, 8).collect()}
    assert min(some) >= (T0 + timedelta(days=4)).strftime("%Y%m%d")


def test_devices_without_row_or_last_point_lose_nothing(spark):
    rows = [(d, T0 + timedelta(minutes=10 * k), 30.0 + k / 100, 31.0, 50.0, True, n, None) for n, (d, k) in enumerate((d, k) for d in "ABC" for k in range(4))]
    points = spark.createDataFrame(rows, SCHEMA)
    late = T0 + timedelta(minutes=25)
    status = carried(points, F.col("imei") == "A", F.lit(late)).unionByName(spark.createDataFrame([("B", T0 + timedelta(minutes=5), 0.0, 0.0, None, None, None, None)], "imei string, last_mileage_at timestamp, km_total double, miles_total double, last_point_at timestamp, last_latitude double, last_longitude double, last_speed double"))
    got = {r["imei"]: r["km_total"] for r in reports.incremental_mileage(points, status, F.lit(late)).collect()}
    step = [km(rows[k], rows[k + 1]) for k in range(3)]
    assert got["A"] == pytest.approx(step[2]) and got["B"] == pytest.approx(sum(step)) and got["C"] == pytest.approx(sum(step))


def test_overspeed_of_a_long_history(spark):
    """One device's sessions take time in proportion to its points."""
    n = 200_000
    t = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id") * 1000)
    points = spark.range(n).select(F.lit("A").alias("imei"), t.alias("packet_date"), F.lit(30.0).alias("latitude"), F.lit(31.0).alias("longitude"), F.when(F.col("id") % 3 == 0, 10.0).otherwise(90.0).alias("speed"), F.lit(True).alias("ignition"), F.col("id").alias("position_id"), F.lit(None).cast("string").alias("alarm"))
    out = events.overspeed_sessions(points, spark.createDataFrame([("A", 60.0)], "imei string, limit_kmh double"))
    assert out.count() == (n - 1) // 3


