"""Scans, sources and sinks: tables are written to the shared folder and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import lake
from .registry import q6, query, r6


def _orders(d):
    return d.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                           F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("month"))


def _indexed(d):
    return d.spark.read.parquet(lake.write_partitions(_orders(d), scratch_path(d.spark, "orders"), ["season", "month"]))


@query("src1_parquet_scan", sql=f"""
    SELECT l_returnflag, l_linestatus, {q6('sum(l_quantity)')} AS qty, count(*) AS n FROM lineitem
    WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2""")
def _(d):
    df = lake.scan_parquet(d.spark, d.tables.path("lineitem"), ["l_returnflag", "l_linestatus", "l_quantity", "l_shipdate"])
    return df.where("l_shipdate < TIMESTAMP '1998-01-01'").groupBy("l_returnflag", "l_linestatus").agg(
        r6(F.sum("l_quantity")).alias("qty"), F.count("*").alias("n"))


@query("src2_csv_scan", sql=f"""
    SELECT o_orderstatus, count(*) AS n, {q6('sum(o_totalprice)', 2)} AS price FROM orders GROUP BY 1""")
def _(d):
    path = scratch_path(d.spark, "orders-csv")
    src = d.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    src.write.option("header", "true").csv(path)
    return lake.scan_csv(d.spark, path, src.schema).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), r6(F.sum("o_totalprice"), 2).alias("price"))


@query("src3_partition_filter_scan", sql="""
    SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate)=1998 AND month(o_orderdate)=3""")
def _(d):
    path = lake.write_partitions(_orders(d), scratch_path(d.spark, "orders"), ["season", "month"])
    return lake.read_index(d.spark, path, {"season": 1998, "month": 3}, ["o_orderkey", "o_custkey"])


@query("src4_partition_listing", sql="""
    SELECT CAST(year(o_orderdate) AS INT) AS season, CAST(month(o_orderdate) AS INT) AS month, count(*) AS rows FROM orders GROUP BY 1, 2""")
def _(d):
    return lake.list_partitions(_indexed(d), ["season", "month"])


@query("src5_natural_part_order", sql="""
    WITH p AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS rows FROM orders GROUP BY 1, 2)
    SELECT CAST(y AS INT) AS season, CAST(m AS INT) AS month, rows, CAST(row_number() OVER (ORDER BY y, m) AS INT) AS position FROM p""")
def _(d):
    parts = _indexed(d).groupBy("season", "month").agg(F.count("*").alias("rows"))
    ordered = lake.natural_order(parts, {"season": "int", "month": "int"})
    position = (F.col("season") - 1995) * 12 + F.col("month")  # the calendar is dense, so no global window is needed
    return ordered.select("season", "month", "rows", position.cast("int").alias("position"))


_HASH = "CAST(CAST('0x' || substr(sha256({0}), 1, 15) AS BIGINT) AS HUGEINT)"
_NATION = "'{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}'"
_ORDER = "'{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}'"


@query("src6_pinned_version", sql=f"""
    SELECT count(*) AS rows, CAST(sum({_HASH.format(_ORDER)}) AS VARCHAR) AS digest FROM orders""")
def _(d):
    df = d.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    path = lake.write_version(df, scratch_path(d.spark, "lake"), "orders")
    pinned = lake.table_digest(df).first()["digest"]
    return lake.table_digest(lake.read_version(d.spark, path, pinned))


@query("src7_version_as_of", sql="""
    SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate
    FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '1998-06-30' GROUP BY 1""")
def _(d):
    catalog = d.orders.withColumn("validated", F.col("o_orderstatus") != "P")
    return lake.resolve_as_of(catalog, F.lit("1998-06-30").cast("timestamp"), ["o_custkey"], "o_orderkey", "o_orderdate")


@query("src8_json_records", sql="""
    SELECT event_type, count(*) AS n, CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) AS BIGINT) AS k FROM events GROUP BY 1""")
def _(d):
    path = scratch_path(d.spark, "records")
    rec = F.struct("event_id", "event_type", F.from_json("props", "k INT").alias("props"))
    d.events.select(F.struct(rec.alias("rec")).alias("w")).select("w.rec").write.json(path)
    schema = "rec STRUCT<event_id BIGINT, event_type STRING, props STRUCT<k: INT>>"
    return lake.scan_records(d.spark, path, schema).groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("props.k").alias("k"))


@query("src9_union_versions", sql="""
    SELECT CAST(year(o_orderdate) AS INT) AS season, count(*) AS n, count(CASE WHEN year(o_orderdate)>=1998 THEN o_orderstatus END) AS with_status
    FROM orders GROUP BY 1""")
def _(d):
    o = _orders(d)
    whole = lake.union_versions([o.where("season < 1998").drop("o_orderstatus"), o.where("season >= 1998")])
    return whole.groupBy("season").agg(F.count("*").alias("n"), F.count("o_orderstatus").alias("with_status"))


@query("src10_inventory", sql="""
    SELECT CASE WHEN l_returnflag='R' THEN 'plays' WHEN l_returnflag='A' THEN 'games' ELSE 'unrecognized' END AS entity,
           CASE WHEN l_returnflag<>'N' THEN CAST(year(l_shipdate) AS DOUBLE) END AS year, count(*) AS objects FROM lineitem GROUP BY 1, 2""")
def _(d):
    path = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("tmp/x-"), "l_orderkey")).otherwise(F.concat(
        F.lit("raw/"), F.when(F.col("l_returnflag") == "R", "plays").otherwise("games"), F.lit("/season="),
        F.year("l_shipdate"), F.lit("/part-"), "l_orderkey", F.lit(".parquet")))
    out = lake.classify_listing(d.lineitem.select(path.alias("path")), "path",
                                {"plays": "/plays/season=", "games": "/games/season="})
    return out.withColumn("year", F.col("year").cast("double"))


@query("snk1_dynamic_overwrite", sql="""
    SELECT CAST(year(o_orderdate) AS INT) AS season, count(*) FILTER (year(o_orderdate)<>1997 OR o_orderstatus='F') AS n,
           CAST(sum(o_orderkey) FILTER (year(o_orderdate)<>1997 OR o_orderstatus='F') AS BIGINT) AS keys FROM orders GROUP BY 1""")
def _(d):
    o, path = _orders(d), scratch_path(d.spark, "orders")
    lake.write_partitions(o, path, ["season"])
    lake.write_partitions(o.where("season = 1997 AND o_orderstatus = 'F'"), path, ["season"])
    return d.spark.read.parquet(path).groupBy("season").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("snk2_create_once_version", sql="SELECT count(*) AS rows, 1 AS versions FROM orders")
def _(d):
    df, root = d.orders.select("o_orderkey", "o_orderstatus"), scratch_path(d.spark, "lake")
    first = lake.write_version(df, root, "orders", ["p1"], "c1")
    lake.write_version(df.repartition(3), root, "orders", ["p1"], "c1")
    whole = d.spark.read.option("basePath", f"{root}/orders").parquet(f"{root}/orders")
    assert first.startswith(root)
    return whole.agg(F.count("*").alias("rows"), F.count_distinct("version").cast("int").alias("versions"))


@query("snk3_part_manifest", sql=f"""
    SELECT o_orderstatus, count(*) AS rows, min(o_orderdate) AS first_event, max(o_orderdate) AS last_event,
           CAST(sum({_HASH.format("'{\"o_orderdate\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') || '\",\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}'")}) AS VARCHAR) AS digest
    FROM orders GROUP BY 1""")
def _(d):
    path = lake.write_partitions(d.orders.select("o_orderkey", "o_orderdate", "o_orderstatus"),
                                 scratch_path(d.spark, "parts"), ["o_orderstatus"])
    return lake.part_manifest(d.spark.read.parquet(path), ["o_orderstatus"], "o_orderdate")


@query("snk4_manifest_statistics", uses="games", sql=f"""
    SELECT count(*) AS rows, min(kickoff) AS first_event, max(kickoff) AS last_event,
           {q6('avg(CAST(home_points IS NULL AS INT))')} AS missing_home_points, {q6('avg(CAST(home IS NULL AS INT))')} AS missing_home FROM games""")
def _(d):
    out = lake.manifest_statistics(d.games, "kickoff", ["home_points", "home"])
    return out.withColumns({c: r6(c) for c in ("missing_home_points", "missing_home")})


@query("snk5_capture_rows", sql=f"""
    SELECT n_regionkey, count(*) AS records, CAST(sum({_HASH.format(_NATION)}) AS VARCHAR) AS content_hash,
           TIMESTAMP '2024-01-01' AS captured_at, 'nations' AS source FROM nation GROUP BY 1""")
def _(d):
    return lake.capture(d.nation, ["n_regionkey"], "nations", F.lit("2024-01-01").cast("timestamp"))


def _old_new(d):
    o = d.orders.select("o_orderkey", "o_orderstatus", r6("o_totalprice", 2).alias("price"))
    new = d.orders.where("o_orderpriority = '1-URGENT'").select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), r6("o_totalprice", 2).alias("price"))
    return o.where("o_orderstatus <> 'P'"), new


@query("snk6_upsert", sql=f"""
    SELECT o_orderkey, CASE WHEN o_orderpriority='1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, {q6('o_totalprice', 2)} AS price
    FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority='1-URGENT'""")
def _(d):
    old, new = _old_new(d)
    once = lake.upsert(old, new, ["o_orderkey"])
    return lake.upsert(once, new, ["o_orderkey"])


@query("snk6_upsert_conflicts", sql="""
    SELECT o_orderkey, o_orderstatus AS old_o_orderstatus, 'X' AS new_o_orderstatus FROM orders
    WHERE o_orderstatus <> 'P' AND o_orderpriority='1-URGENT'""")
def _(d):
    old, new = _old_new(d)
    return lake.conflicts(old, new, ["o_orderkey"], ["o_orderstatus"])


@query("snk7_stale_keys", sql="SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'")
def _(d):
    old, new = _old_new(d)
    return lake.stale_keys(old, new, ["o_orderkey"])


@query("snk8_serving_record", sql="""
    WITH e AS (SELECT *, CAST(round(l_extendedprice*100) AS BIGINT) * 15625 AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_suppkey,
           (n // 10000 + CASE WHEN n % 10000 > 5000 OR (n % 10000 = 5000 AND (n // 10000) % 2 = 1) THEN 1 ELSE 0 END) / 10000.0 AS price,
           strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS l_shipdate FROM e""")
def _(d):
    df = d.lineitem.withColumn("price", F.col("l_extendedprice") * 0.015625)
    return lake.serving_record(df, ["l_orderkey", "l_linenumber", "l_suppkey", "price", "l_shipdate"])
