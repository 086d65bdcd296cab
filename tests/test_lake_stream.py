"""Versioned tables and streaming against their batch forms."""

import time

import pytest
from pyspark.sql import functions as F

from priorline.operators import quality as Q, ratings as R
from priorline.operators.guards import ContractError
from priorline.session import cut_lineage, scratch_path, stage_table
from priorline.sources import lake
from priorline.streaming import ops as S


def test_digest_ignores_order_and_sees_changes(spark):
    df = spark.range(500).withColumn("x", F.col("id") * 3)
    one = lake.table_digest(df).first()
    assert lake.table_digest(df.orderBy(F.desc("id")).repartition(7)).first() == one
    assert lake.table_digest(df.withColumn("x", F.col("x") + (F.col("id") == 3).cast("int"))).first()["digest"] != one["digest"]


def test_pinned_version_is_checked(spark):
    df = spark.range(20).withColumn("x", F.lit("a"))
    path = lake.write_version(df, scratch_path(spark, "t"), "d")
    assert lake.write_version(df, path.rsplit("/", 2)[0], "d") == path
    assert lake.read_version(spark, path, lake.table_digest(df).first()["digest"]).count() == 20
    with pytest.raises(ContractError):
        lake.read_version(spark, path, "1")


def test_season_in_two_versions_is_refused(spark):
    a = spark.createDataFrame([(2020, 1)], "season INT, x INT")
    with pytest.raises(ContractError):
        lake.union_versions([a, a])


def test_append_only_refuses_changes(spark):
    old = spark.createDataFrame([(1, "a")], "k INT, v STRING")
    assert lake.append_only(old, spark.createDataFrame([(2, "b")], "k INT, v STRING"), ["k"], ["v"]).count() == 2
    with pytest.raises(Exception, match="existing row would change"):
        lake.append_only(old, spark.createDataFrame([(1, "z")], "k INT, v STRING"), ["k"], ["v"]).collect()


def test_cut_lineage_keeps_rows_and_schema(spark):
    df = spark.range(10).select("id", F.array(F.col("id")).alias("a"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("t"))
    for out in (cut_lineage(df), stage_table(df)):
        assert out.schema.simpleString() == df.schema.simpleString() and out.count() == 10


def test_contract_refuses_missing_column(spark):
    with pytest.raises(ValueError, match="lacks columns"):
        Q.Contract("t", ["id", "absent"]).check(spark.range(1))


@pytest.fixture(scope="module")
def folder(spark):
    """Events in three files, in time order, so a stream takes three micro-batches."""
    rows = [(k, k * 1000 + i, float(i * 43200), ((i * 7 + k) % 11) / 5.0 - 1, 1.0) for k in range(5) for i in range(30)]
    df = spark.createDataFrame(rows, "k BIGINT, id BIGINT, at DOUBLE, z DOUBLE, n DOUBLE")
    path = scratch_path(spark, "stream-in")
    for part in range(3):
        df.where((F.col("at") >= part * 432000) & (F.col("at") < (part + 1) * 432000)).coalesce(1).write.mode("append").parquet(path)
    return path, df


def test_stateful_filter_equals_batch(spark, folder):
    path, df = folder
    out = S.run_to_table(S.kalman_stream(S.stream_folder(spark, path, df.schema, 1), "k", ["id", "at", "z", "n"], 0.1, 0.5), "k")
    got = {r["id"]: (r["mean"], r["variance"]) for r in out.collect()}
    batch = R.kalman_filter(df, ["k"], ["at", "id"], F.floor(F.col("at") / 86400), F.col("z"), F.col("n"), F.col("at"), F.lit(0.1), F.lit(0.5), F.lit(0.0), F.lit(1.0))
    want = {r["id"]: (r["mean"], r["variance"]) for r in batch.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_upsert_replay_changes_nothing(spark, folder):
    path, df = folder
    target = scratch_path(spark, "target")
    day = lambda s: s.withColumn("day", F.floor(F.col("at") / 432000).cast("int"))
    for _ in range(2):
        S.upsert_batches(day(S.stream_folder(spark, path, df.schema, 1)), target, ["k", "day"], "day", ["at", "id"])
    got = sorted(map(tuple, spark.read.parquet(target).select("k", "day", "id").collect()))
    want = sorted(map(tuple, day(df).groupBy("k", "day").agg(F.max_by("id", F.struct("at", "id")).alias("id")).collect()))
    assert got == want


def test_half_written_version_is_written_anew(spark):
    df = spark.range(20).selectExpr("id", "id % 3 AS g")
    root = scratch_path(spark, "half")
    path = lake.write_version(df, root, "d")
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(marker, False)
    df.limit(5).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    assert not fs.exists(marker)
    assert lake.write_version(df, root, "d") == path and fs.exists(marker)
    assert spark.read.parquet(path).count() == 20


def test_score_alerts_place_late_rows_across_batches(spark):
    """Files in order of arrival: a late row within the delay is compared with its neighbours in time, one beyond it is left out."""
    path = scratch_path(spark, "late-in")
    batches = [[("a", 1, 0, 5), ("a", 2, 600, 9), ("b", 3, 0, None), ("b", 4, 100, 4)],
               [("a", 5, 1200, 9), ("a", 6, 300, 7), ("b", 7, 50, 6)],  # 6 and 7 come late
               [("a", 8, 1800, 8), ("a", 9, 900, 10)],  # 9 falls to 5 at 1200
               [("a", 10, 20000, 8), ("a", 11, 20000, 3)],
               [("a", 13, 40000, 3)],
               [("a", 12, 60, 99), ("a", 14, 50000, 2)]]  # 12 is beyond the delay, 14 is not passed yet
    schema = "stream STRING, id BIGINT, s BIGINT, score INT"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their times
    stream = S.stream_folder(spark, path, spark.read.parquet(path).schema, 1)
    out = S.run_to_table(S.score_alerts(stream, "stream", "ts", "1 hour"), "late-out").collect()
    assert sorted((r["stream"], r["id"], r["fell_by"]) for r in out) == [("a", 5, 1), ("a", 8, 1), ("a", 11, 5), ("b", 4, 2)]


def test_score_alerts_share_states(spark):
    """Many keys in one state alert as each alone would, across batches, null keys included."""
    path = scratch_path(spark, "shared-in")
    rows = [(None if k == 5 else f"k{k}", 100 * k + i, 60 * ((7 * i) % 20), (k * i * 5) % 13) for k in range(30) for i in range(20)]
    schema = "stream STRING, id BIGINT, s BIGINT, score INT"
    for part in (rows[::2], rows[1::2], [("end", 9999, 90000, 1)]):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    want = []
    for key in {r[0] for r in rows}:
        mine = sorted((s, i, score) for k, i, s, score in rows if k == key)
        want += [(str(key), b[1], a[2] - b[2]) for a, b in zip(mine, mine[1:]) if b[2] < a[2]]
    stream = S.stream_folder(spark, path, spark.read.parquet(path).schema, 1)
    out = S.run_to_table(S.score_alerts(stream, "stream", "ts", "1 hour", buckets=2), "shared-out").collect()
    assert want and sorted((str(r["stream"]), r["id"], r["fell_by"]) for r in out) == sorted(want)
