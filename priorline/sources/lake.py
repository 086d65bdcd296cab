"""Versioned and partitioned tables on Spark's own file sources."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.guards import ContractError, require_empty, unless


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None,
                 schema: T.StructType | None = None) -> DataFrame:
    """SRC-1: parquet scan; the column list reaches the reader."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """SRC-2: CSV scan with a fixed schema; malformed rows stop the job."""
    return spark.read.schema(schema).options(**{"header": "true", "mode": "FAILFAST", **options}).csv(path)


def scan_records(spark: SparkSession, path: str, schema: str, record: str = "rec") -> DataFrame:
    """SRC-8: JSON wrapper rows with a known schema, the nested record lifted to columns."""
    return spark.read.schema(schema).json(path).select(f"{record}.*")


def write_partitions(df: DataFrame, path: str, keys: list[str]) -> str:
    """SNK-1: replace only the partitions present in ``df``.

    Rows are spread by key and a hash of the row, so one large partition is written by many tasks.
    """
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(16))
    (df.repartition(*keys, spread).write.partitionBy(*keys).mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").parquet(path))
    return path


def read_index(spark: SparkSession, root: str, filters: dict, columns: list[str] | None = None) -> DataFrame:
    """SRC-3: partitions matching equality filters; other partitions are never opened."""
    df = spark.read.parquet(root)
    for key, value in filters.items():
        df = df.where(F.col(key) == F.lit(value))
    return df.select(*columns) if columns else df


def list_partitions(df: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-4: partitions present, with row counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"))


def natural_order(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """SRC-5: typed key order, so week 2 comes before week 10."""
    return df.orderBy(*[F.col(k).cast(kind) for k, kind in keys.items()])


def row_text(columns: list[str]) -> Column:
    """Canonical text of a row: columns in name order, nulls written out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def row_number_hash(text: Column) -> Column:
    """60 bits of SHA-256 as an exact integer."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")


def table_digest(df: DataFrame, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """DQ-18: order-free digest (row count and sum of row hashes), in total or per part.

    One aggregation with map-side partials; nothing is sorted or collected.
    """
    text = row_text(columns or df.columns)
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"), F.sum(row_number_hash(text)).cast("string").alias("digest"))


def version_id(dataset: str, digest: str, rows: int, parents: list[str], code: str) -> str:
    body = json.dumps([dataset, digest, rows, sorted(parents), code], separators=(",", ":"))
    return hashlib.sha256(body.encode()).hexdigest()


def write_version(df: DataFrame, root: str, dataset: str, parents: list[str] = (), code: str = "") -> str:
    """SNK-2: content-addressed create-once write; the same content is written once only.

    A version counts as written when its success marker is there; what a lost job left without one is written anew.
    """
    digest = table_digest(df).first()
    version = version_id(dataset, digest["digest"] or "0", digest["rows"], list(parents), code)
    path = f"{root.rstrip('/')}/{dataset}/version={version}"
    spark = df.sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
    return path


def read_version(spark: SparkSession, path: str, digest: str | None = None) -> DataFrame:
    """SRC-6: a pinned version; a digest that differs from the pinned one is refused."""
    df = spark.read.parquet(path)
    if digest is not None and (table_digest(df).first()["digest"] or "0") != digest:
        raise ContractError(f"content of {path} differs from its pinned digest")
    return df


def resolve_as_of(catalog: DataFrame, cutoff: Column, by: list[str], value: str, as_of: str) -> DataFrame:
    """SRC-7: newest validated version at or before the cutoff, per dataset (and partition)."""
    return (catalog.where(F.col("validated") & (F.col(as_of) <= cutoff)).groupBy(*by)
            .agg(F.max_by(value, F.struct(as_of, value)).alias(value), F.max(as_of).alias(as_of)))


def union_versions(parts: list[DataFrame], season: str = "season") -> DataFrame:
    """SRC-9: season-scoped versions as one table; a season found in two versions is an error."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    require_empty(whole.groupBy(season).agg(F.count_distinct("_part").alias("n")).where("n > 1"),
                  "season in more than one version")
    return whole.drop("_part")


def classify_listing(paths: DataFrame, path: str, patterns: dict[str, str]) -> DataFrame:
    """SRC-10: entity and year of each listed object; unknown layouts are kept as such."""
    entity = F.lit("unrecognized")
    for name, pattern in reversed(patterns.items()):
        entity = F.when(F.col(path).rlike(pattern), F.lit(name)).otherwise(entity)
    year = F.regexp_extract(path, "(?:season|year)=([0-9]{4})", 1)
    return (paths.select(entity.alias("entity"), F.when(year != "", year.cast("int")).alias("year"))
            .groupBy("entity", "year").agg(F.count("*").alias("objects")))


def part_manifest(df: DataFrame, keys: list[str], event_time: str) -> DataFrame:
    """SNK-3: one metadata row per part: rows, time range, digest."""
    text = row_text(df.columns)
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.min(event_time).alias("first_event"), F.max(event_time).alias("last_event"),
        F.sum(row_number_hash(text)).cast("string").alias("digest"))


def manifest_statistics(df: DataFrame, event_time: str, columns: list[str]) -> DataFrame:
    """SNK-4: row count, event-time range and missing share per column in one pass."""
    return df.agg(
        F.count("*").alias("rows"), F.min(event_time).alias("first_event"), F.max(event_time).alias("last_event"),
        *[F.avg(F.col(c).isNull().cast("int")).alias(f"missing_{c}") for c in columns])


def capture(df: DataFrame, keys: list[str], source: str, captured_at: Column) -> DataFrame:
    """SNK-5: one capture row per response: key, content hash, record count, time."""
    text = row_text(df.columns)
    return df.groupBy(*keys).agg(
        F.count("*").alias("records"), F.sum(row_number_hash(text)).cast("string").alias("content_hash"),
        F.max(captured_at).alias("captured_at")).withColumn("source", F.lit(source))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-6: the new snapshot; new rows win. Applying it twice changes nothing."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def conflicts(existing: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """SNK-6: rows both sides have but with different values (null-safe)."""
    e, n = existing.alias("e"), new.alias("n")
    differs = reduce(lambda a, b: a | b, [~F.col(f"e.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns])
    on = reduce(lambda a, b: a & b, [F.col(f"e.{k}") == F.col(f"n.{k}") for k in keys])
    return e.join(n, on).where(differs).select(
        *[F.col(f"e.{k}") for k in keys],
        *[F.col(f"{side}.{c}").alias(f"{label}_{c}") for c in columns for side, label in (("e", "old"), ("n", "new"))])


def stale_keys(current: DataFrame, built: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-7: keys of the target scope that the new payload no longer has."""
    return current.select(*keys).distinct().join(built.select(*keys), keys, "left_anti")


def serving_record(df: DataFrame, columns: list[str]) -> DataFrame:
    """SNK-8: exact column list, NaN as null, doubles half-even at 4 places, times in ISO form."""
    kinds = dict(df.dtypes)

    def clean(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return F.bround(F.when(~F.isnan(c), F.col(c)), 4).alias(c)
        if kinds[c].startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
        return F.col(c)

    return df.select(*[clean(c) for c in columns])


def append_only(existing: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Insert-only merge: an existing key with other values fails the job."""
    e = existing.select(*keys, F.struct(*columns).alias("_e"))
    n = new.select(*keys, F.struct(*columns).alias("_n"))
    both = e.join(n, keys, "full_outer")
    row = unless(~F.col("_e").eqNullSafe(F.col("_n")) & F.col("_e").isNotNull() & F.col("_n").isNotNull(),
                 F.coalesce("_e", "_n"), "existing row would change")
    return both.select(*keys, row.alias("_row")).select(*keys, "_row.*")
