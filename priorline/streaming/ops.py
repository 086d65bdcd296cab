"""Structured Streaming forms of the ordering and availability rules.

Each function takes a streaming DataFrame; with ``availableNow`` the result equals the batch
operator on the rows that arrived inside the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_path


def stream_table(spark: SparkSession, root: str, file: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over one table of a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(root)


def stream_folder(spark: SparkSession, path: str, schema, files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).parquet(path)


def _local_partitions(spark: SparkSession) -> None:
    # stateful operators keep one store per shuffle partition and are not coalesced at run time
    if spark.sparkContext.master.startswith("local") and int(spark.conf.get("spark.sql.shuffle.partitions")) > spark.sparkContext.defaultParallelism:
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain what is available into a parquet table (files, with a checkpoint) and read it back."""
    spark = stream.sparkSession
    _local_partitions(spark)
    path = scratch_path(spark, label)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", path).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, label: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Drain what is available through ``foreachBatch``."""
    spark = stream.sparkSession
    _local_partitions(spark)
    path = scratch_path(spark, label)
    (stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination())


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """SS-1: the first arrival of each id; state is dropped once the watermark passes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def closed_windows(stream: DataFrame, time: str, delay: str, size: str, slide: str | None, keys: list[str], aggs: list[Column]) -> DataFrame:
    """SS-2/3: tumbling or sliding windows, emitted once no row of theirs can be admitted any more."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = stream.withWatermark(time, delay).groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[c for c in out.columns if c not in ("w", *keys)])


def late_rows(rows: DataFrame, time: str, arrival: str, delay_hours: int) -> DataFrame:
    """SS-2: rows that arrived after their time plus the delay, for the side table (batch comparison)."""
    return rows.where(F.col(arrival) > F.col(time) + F.expr(f"INTERVAL {delay_hours} HOURS"))


def sessions(stream: DataFrame, key: str, time: str, gap: str, delay: str, aggs: list[Column]) -> DataFrame:
    """SS-4: gap-based segments per key."""
    out = stream.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("s")).agg(*aggs)
    return out.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *[c for c in out.columns if c not in ("s", key)])


def kalman_stream(stream: DataFrame, key: str, columns: list[str], q: float, r: float) -> DataFrame:
    """SS-5: the filter of IT-10 with its state kept per key between micro-batches.

    Input columns: key, id, at (seconds), z, n.  A micro-batch's rows of a key are put in order;
    rows older than the state's time only widen nothing and are marked late.
    """
    out_schema = f"{key} BIGINT, id BIGINT, mean DOUBLE, variance DOUBLE, late BOOLEAN"

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, v, last = state.get if state.exists else (0.0, 1.0, None)
        pdf = pd.concat(list(frames)).sort_values(["at", "id"])
        rows = []
        for row in pdf.itertuples(index=False):
            if last is not None and row.at < last:
                rows.append((k[0], row.id, m, v, True))
                continue
            pv = v + q * ((row.at - last) if last is not None else 0.0) / 86400.0 / 7.0
            if row.z == row.z and row.z is not None and row.n > 0:
                gain = pv / (pv + r / row.n)
                m, v = m + gain * (row.z - m), (1 - gain) * pv
            else:
                v = pv
            last = row.at
            rows.append((k[0], row.id, m, v, False))
        state.update((float(m), float(v), float(last) if last is not None else None))
        yield pd.DataFrame(rows, columns=[key, "id", "mean", "variance", "late"])

    return stream.select(key, *columns).groupBy(key).applyInPandasWithState(
        update, out_schema, "m DOUBLE, v DOUBLE, last DOUBLE", "append", GroupStateTimeout.NoTimeout)


def score_alerts(stream: DataFrame, key: str, time: str, delay: str, buckets: int = 1024) -> DataFrame:
    """SS-6: an alert for each fall of a running score against the score before it in time.

    Input columns: key, id, ``time``, score.  Rows wait in the state until the watermark has passed them, so a row that
    comes late, but within ``delay``, takes its place by (time, id) across micro-batches; rows behind
    what was already passed are left out, as Spark does.  Keys share the states of ``buckets`` hash buckets, because a call per key
    costs far more than its rows; a state holds its keys' rows of the last ``delay`` and one score a key.  A null score neither alerts nor
    counts as the score before.
    """
    out_schema = f"{key} STRING, id BIGINT, fell_by INT"
    state_schema = "key ARRAY<STRING>, at ARRAY<BIGINT>, id ARRAY<BIGINT>, score ARRAY<INT>, known ARRAY<STRING>, last ARRAY<INT>"

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *waiting, known, last = state.get if state.exists else ([],) * 6
        parts = [[np.asarray(x, kind) for x, kind in zip(waiting, ("object", "int64", "int64", "int64"))]]
        for f in frames if not state.hasTimedOut else ():
            there = f["score"].notna().to_numpy()
            parts.append([f[c].to_numpy()[there].astype(kind) for c, kind in ((key, "object"), ("at", "int64"), ("id", "int64"), ("score", "int64"))])
        keys, at, ids, scores = (np.concatenate(x) for x in zip(*parts))
        code, names = pd.factorize(np.concatenate([np.asarray(known, "object"), keys]), use_na_sentinel=False)
        names = np.array([None if pd.isna(x) else x for x in names], "object")
        before, seen = np.zeros(len(names), "int64"), np.zeros(len(names), bool)
        before[code[:len(known)]], seen[code[:len(known)]] = last, True
        code = code[len(known):]
        passed = at <= state.getCurrentWatermarkMs() * 1000
        order = np.lexsort((ids, at, code))
        order = order[passed[order]]
        of, score = code[order], scores[order]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        was = np.roll(score, 1)
        was[first] = np.where(seen[of[first]], before[of[first]], score[first])
        falls = np.flatnonzero(score < was)
        before[of], seen[of] = score, True  # the last row of a key counts
        stay = ~passed
        state.update((keys[stay].tolist(), at[stay].tolist(), ids[stay].tolist(), scores[stay].tolist(), names[seen].tolist(), before[seen].tolist()))
        if stay.any():
            state.setTimeoutTimestamp(-(-int(at[stay].min()) // 1000))
        if len(falls):
            yield pd.DataFrame({key: names[of[falls]], "id": ids[order][falls], "fell_by": (was - score)[falls].astype("int32")})

    rows = stream.select(key, "id", F.col(time).alias("ts"), F.unix_micros(time).alias("at"), F.col("score").cast("int").alias("score"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    return rows.withWatermark("ts", delay).groupBy("_bucket").applyInPandasWithState(update, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def upsert_batches(stream: DataFrame, target: str, keys: list[str], partition: str, order: list[str]) -> None:
    """SS-7/8: merge micro-batches into a partitioned table, latest row per key.

    Only the partitions a batch touches are read and replaced (dynamic overwrite), and the merge is
    a maximum per key, so a batch that is replayed after a failure changes nothing.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.sparkSession
        columns = [c for c in batch.columns if c not in keys]
        newest = lambda df: df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
        hadoop = fresh._jvm.org.apache.hadoop.fs.Path(target)
        rows = batch
        if hadoop.getFileSystem(fresh._jsc.hadoopConfiguration()).exists(hadoop):
            touched = batch.select(partition).distinct()
            rows = fresh.read.schema(batch.schema).parquet(target).join(touched, partition, "left_semi").select(*batch.columns).unionByName(batch)
        # the table is read and replaced in one job otherwise, so the merged rows go through reliable storage
        merged = newest(rows).checkpoint(eager=True)
        merged.write.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)

    from ..session import shared_dir
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    run_batches(stream, "upsert", merge)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, bound: str, delay: str) -> DataFrame:
    """SS-9: pairs whose right time lies within the bound after the left time; state is bounded by watermarks."""
    l = left.withWatermark(left_time, delay).alias("l")
    r = right.withWatermark(right_time, delay).alias("r")
    return l.join(r, F.expr(f"l.{key} = r.{key} AND r.{right_time} >= l.{left_time} AND r.{right_time} <= l.{left_time} + INTERVAL {bound}"))
