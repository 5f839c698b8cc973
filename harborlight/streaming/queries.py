"""Streaming forms: windowed counts, latest rows, edge-triggered alerts, deduplication, snapshot sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import sequential, upsert

DAY_START = "16 hours"  # a Shanghai day begins at 16:00 UTC


def day_counts(events: DataFrame, time: str, key: str, late: str = "1 day") -> DataFrame:
    """Rows of each key by Shanghai day; a day is final when the watermark passes its end."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day", "1 day", DAY_START), key).agg(F.count("*").alias("n"))


def sliding_mood(rows: DataFrame, time: str, key: str, score: str, span: str = "7 days", step: str = "1 day", late: str = "1 day", least: int = 3) -> DataFrame:
    """Mean score of each key over sliding windows; null for windows with fewer than ``least`` rows."""
    return rows.withWatermark(time, late).groupBy(F.window(time, span, step), key).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.avg(score)).alias("mood"))


def latest_rows(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key so far (update mode)."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def exact_dedup(rows: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def edge_alerts(quotes: DataFrame, threshold: float, quiet_seconds: int = 0) -> DataFrame:
    """Alerts when a symbol's price goes over the threshold, at most one in ``quiet_seconds``; state: over, last alert.

    quotes: symbol, id, price, at (seconds).  State is two numbers for each symbol.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        over, last = state.get if state.exists else (False, -(1 << 62))
        out = []
        for row in pd.concat(list(frames)).sort_values(["at", "id"]).itertuples(index=False):
            now = row.price >= threshold
            if now and not over and row.at - last >= quiet_seconds:
                out.append((key[0], row.id, row.price, row.at))
                last = row.at
            over = now
        state.update((bool(over), int(last)))
        yield pd.DataFrame(out, columns=["symbol", "id", "price", "at"])

    return quotes.select("symbol", "id", "price", "at").groupBy("symbol").applyInPandasWithState(step, "symbol string, id long, price double, at long", "over boolean, last long", "append", GroupStateTimeout.NoTimeout)


def due_sources(results: DataFrame, most_backoff: int = 8, empty_threshold: int = 3, late: str = "0 seconds") -> DataFrame:
    """When each source is due again: a row (kind next) for each result, and one (kind due) when that time has come.

    ``results`` has source, cadence_seconds, status (success, empty, or anything else for a failure) and at.  A source is due
    after its cadence; after k failures in a row after 2^k times that, at most ``most_backoff`` times; and from ``empty_threshold``
    empty results in a row on after twice, four times that and so on.  The clock is the watermark: a timer for each source fires
    when it has passed the due time, once, also after a restart.  State is four numbers a source.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, empties, due, last = state.get if state.exists else (0, 0, 0, -1)
        out = []
        if state.hasTimedOut:
            out.append((key[0], "due", due, failures, empties))
            state.update((failures, empties, 0, last))
        else:
            for row in pd.concat(list(frames)).sort_values(["at", "status"]).itertuples(index=False):
                at = int(row.at.timestamp())
                if at < last:
                    continue  # a result from before the last one tells nothing new
                failures, empties, last = (0, 0, at) if row.status == "success" else (0, empties + 1, at) if row.status == "empty" else (failures + 1, 0, at)
                power = failures or max(0, empties - empty_threshold + 1)
                due = at + int(row.cadence_seconds) * min(2 ** min(power, 30), most_backoff)
                out.append((key[0], "next", due, failures, empties))
            state.update((failures, empties, due, last))
            if due:
                state.setTimeoutTimestamp(max(due * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["source", "kind", "due_at", "failures", "empties"])

    rows = results.select("source", "cadence_seconds", "status", "at").withWatermark("at", late)
    kept = "failures long, empties long, due long, last long"
    return rows.groupBy("source").applyInPandasWithState(step, "source string, kind string, due_at long, failures long, empties long", kept, "append", GroupStateTimeout.EventTimeTimeout)


def queue_drain_sink(path: str, cap: int, pending: Callable[[SparkSession], DataFrame] | None = None, scan_seconds: int = 60):
    """A foreachBatch sink that takes at most ``cap`` queued ids (id, at) for each batch, in the order in which they came.

    What is over stays queued before later ids; an id that is queued already is not queued again.  Rows without an id
    only move the clock.  When nothing is queued and ``scan_seconds`` have passed since the last scan, ``pending`` gives
    ids that wait elsewhere, and the first ``cap`` of them by id are taken.  ``path`` has, for each batch, what was taken
    (claimed: id, from_scan), what stays queued, and the time of the next scan; a repeated batch starts from the batch
    before it and writes the same again.
    """
    queue_schema, scan_schema = "id long, at timestamp, came long", "next_scan long"

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def version(name: str, schema: str) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{path}/{name}/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], schema)

        before = version("queue", queue_schema)
        fresh = batch.where("id is not null").groupBy("id").agg(F.min("at").alias("at")).join(before.select("id"), "id", "left_anti")
        queue = before.unionByName(fresh.withColumn("came", F.lit(batch_id).cast("long")))
        clock = batch.agg(F.unix_timestamp(F.max("at")).alias("now")).first()["now"]
        row = version("scan", scan_schema).first()
        next_scan = row["next_scan"] if row else 0
        head = queue.orderBy("came", "at", "id").limit(cap).select("id", F.lit(False).alias("from_scan"))
        if pending is not None and clock is not None and clock >= next_scan and queue.isEmpty():
            head = pending(spark).select(F.col("id").cast("long")).distinct().orderBy("id").limit(cap).select("id", F.lit(True).alias("from_scan"))
            next_scan = clock + scan_seconds
        claimed = f"{path}/claimed/batch={batch_id}"
        head.coalesce(1).write.mode("overwrite").parquet(claimed)
        taken = spark.read.schema("id long, from_scan boolean").parquet(claimed).select("id")
        queue.join(taken, "id", "left_anti").select("id", "at", "came").write.mode("overwrite").parquet(f"{path}/queue/batch={batch_id}")
        spark.createDataFrame([(next_scan,)], scan_schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/scan/batch={batch_id}")

    return sink


def near_title_sink(history_path: str, out_path: str, minutes: int = 60):
    """A foreachBatch sink: appends a batch's headlines (news_id, title, effective_at, url if there is one) that the near-duplicate gate keeps.

    A batch is held against the headlines kept before within ``minutes`` of it, of which only those hours are read,
    and its later items against its earlier ones that were kept.  A repeated batch id reads only what the batches
    before it kept, and writes the same folder again.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark, hour = batch.sparkSession, F.floor(F.unix_micros(F.col("effective_at").cast("timestamp")) / 3.6e9)
        span = batch.agg(F.min(hour).alias("a"), F.max(hour).alias("b")).first()
        url = F.col("url") if "url" in batch.columns else F.lit("http://any")
        sided = lambda df: df.select(F.col("news_id").alias("id"), "title", url.alias("url"), F.col("effective_at").alias("at"))
        stored = None
        if batch_id and span["a"] is not None:
            reach = -(-minutes // 60)
            try:
                past = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType()), T.StructField("hour", T.LongType())])).option("basePath", history_path).parquet(history_path)
                stored = sided(past.where((F.col("batch") < batch_id) & F.col("hour").between(span["a"] - reach, span["b"] + reach)))
            except Exception as error:  # no history yet
                if "PATH_NOT_FOUND" not in str(error):
                    raise
        kept = sequential.duplicate_gate(sided(batch), stored, minutes).where("kept").select(F.col("id").alias("news_id"))
        rows = batch.join(kept, "news_id", "left_semi").select(batch.columns)
        rows.withColumn("hour", hour).write.mode("overwrite").partitionBy("hour").parquet(f"{out_path}/batch={batch_id}")

    return sink


def bounded_stream_sink(path: str, most: int, *order: str):
    """A foreachBatch sink that publishes rows to a stream of bounded length: the last ``most`` rows by batch, then by ``order``.

    Each batch writes a new version, its length bounded, from that of the batch before; a repeated batch writes the same again.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, T.StructType([*batch.schema.fields, T.StructField("came", T.LongType())])
        rows = batch.withColumn("came", F.lit(batch_id).cast("long"))
        if batch_id:
            rows = spark.read.schema(schema).parquet(f"{path}/batch={batch_id - 1}").unionByName(rows)
        rows.orderBy(F.desc("came"), *map(F.desc, order)).limit(most).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def snapshot_sink(path: str, keys: list[str]):
    """A foreachBatch sink that keeps one row for each key: each batch writes a new whole version."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = upsert.latest_wins(batch.limit(0), batch, keys)
        if batch_id:
            new = upsert.latest_wins(upsert.read_snapshot(spark, path).select(batch.columns), new, keys)
        upsert.write_snapshot(new, path, batch_id)

    return sink
