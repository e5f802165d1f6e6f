"""Structured Streaming jobs: incremental ingest (T1-T3) and daily tables (T4).

``stream_ingest`` watches a drop folder of CSV exports. Each micro-batch goes
through the functions of the batch path (header per file, cleaning, typing,
quarantine, lineage). First-wins dedup over all batches is a second, keyed
stream over the rows that arrived: the state store holds the keys, so a batch
looks up its own keys and never reads the table. A micro-batch writes folders
named by its epoch and overwrites them, so a replayed epoch leaves nothing
twice. ``run_daily_stream`` keeps one state row per calendar day, without a
watermark: a bill that comes late, however late, still updates its day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.cleaning import export_date
from ..session import discard, released, saved
from ..sources import ingest
from ..sources.records import TEXT_CODEC, as_lines

#: Keys of the dedup stream live in a state store on disk, not on the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_arrivals(spark: SparkSession, arrivals: str, schema: StructType, keys: list[str], checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Pass on the rows of new files under ``arrivals`` whose key no earlier file had.

    Keys are never null, and unique within what arrives at one time. The state
    has one entry per key ever seen and is looked up by key.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    (own.readStream.schema(schema).parquet(f"{arrivals}/*").dropDuplicates(keys)
     .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def elsewhere(spark: SparkSession, table: DataFrame) -> DataFrame:
    """A table of :func:`saved` as another session reads it."""
    out = spark.read.schema(table.schema).parquet(table._saved_path)
    out._saved_path = table._saved_path
    return out


def stream_ingest(spark: SparkSession, folder: str, report_type: str, target: str, checkpoint: str,
                  keys: list[str] | None = None, after: Callable[[DataFrame, int], None] | None = None,
                  files_per_batch: int | None = None, day: Column | None = None):
    """New files -> typed, deduplicated rows under ``target`` (availableNow).

    ``target`` has a folder per kind (``keyed`` rows, ``free`` ones whose key
    has a null or that need none) and epoch; with ``day``, rows have their day
    and a folder per month, so that readers of some days open these alone.

    A report without a dedup key (a snapshot) keeps all its rows; see
    :func:`keep_latest` for its current state.

    ``after(fresh, epoch)`` runs once the rows of a batch are written.
    Quarantined rows go to ``target``_quarantine, files that do not match the
    report to ``target``_failed.
    """
    keys = keys or ingest.DEDUP_KEYS.get(report_type)
    reader = spark.readStream.option("pathGlobFilter", "[!.~]*")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    src = reader.text(folder).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))

    def save(rows: DataFrame, path: str) -> None:
        if day is not None:
            # rows of a month come together, those of a large month in several parts
            by_month(rows, day).hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)
        else:
            rows.write.mode("overwrite").parquet(path)

    @released()  # what an epoch stages goes with it
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # a micro-batch's own session plans without AQE: what follows its text runs in the caller's
        lines = elsewhere(spark, saved(as_lines(batch, F.col("_file"), F.col("_block")), "csv-lines", TEXT_CODEC))
        typed, quarantine, files = ingest.report_of_staged(lines, report_type, epoch_id, once=True)
        discard(lines)
        written = [f"{target}/kind=free/epoch={epoch_id}"]
        if keys:
            free = ingest.key_null(keys)
            save(typed.where(free).drop("_order"), written[0])
            # only keys and orders go through the dedup: rows are looked up by what it leaves out
            marks = typed.where(~free).select(*keys, "_order")
            one = ingest.load_dedup(typed.limit(0).select(*keys), marks, keys, "_order")
            one.write.mode("overwrite").parquet(f"{target}_arrivals/epoch={epoch_id}")

            @released()
            def keyed(rows: DataFrame, n: int) -> None:
                first = elsewhere(spark, saved(rows.select("_order"), "csv-first"))
                repeated = marks.select("_order").join(first, "_order", "left_anti")
                written.append(f"{target}/kind=keyed/epoch={n}")
                save(ingest.without(typed.where(~free), repeated, "_order").drop("_order"), written[-1])

            first_arrivals(spark, f"{target}_arrivals", one.schema, keys, f"{checkpoint}-keys", keyed)
        else:
            save(typed, written[0])
        quarantine.write.mode("overwrite").parquet(f"{target}_quarantine/epoch={epoch_id}")
        (files.where(F.col("error_message").isNotNull()).select("source_file_name", "error_message")
         .write.mode("overwrite").parquet(f"{target}_failed/epoch={epoch_id}"))
        if after is not None:
            rows = typed if not keys else typed.drop("_order")
            if day is not None:
                rows = by_month(rows, day)
            after(spark.read.schema(rows.schema).option("basePath", target).parquet(*written), epoch_id)

    return (src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def keep_latest(state: str, key: str, columns: list[str]) -> Callable[[DataFrame, int], None]:
    """T1 for snapshots: an ``after`` step that writes, for each key of the epoch, its newest row's ``columns``.

    A later file, and a later line of a file, is newer. Only the epoch's own
    rows are read; :func:`current` picks the newest epoch of each key.
    """
    def step(fresh: DataFrame, epoch_id: int) -> None:
        (fresh.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), "_order").alias("_v"))
         .select(key, *[F.col(f"_v.{c}").alias(c) for c in columns]).write.mode("overwrite").parquet(f"{state}/epoch={epoch_id}"))
    return step


def recompute_days(target: str, days: str, daily: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """An ``after`` step that recomputes, from the raw table, every day that the new rows touch.

    The raw table is stored by month, so only the touched months' folders are
    opened, and in them the row groups of the days (the driver gets at most a
    date per calendar day). The days' new values go to a folder of the epoch,
    and :func:`current_days` reads the newest.
    """
    def step(fresh: DataFrame, epoch_id: int) -> None:
        touched = [r["day"] for r in fresh.select("day").where(F.col("day").isNotNull()).distinct().collect()]
        rows = touched_rows(fresh.sparkSession, target, fresh.schema, touched)
        daily(rows).write.mode("overwrite").parquet(f"{days}/epoch={epoch_id}")
    return step


def by_month(rows: DataFrame, day: Column) -> DataFrame:
    return rows.withColumn("day", day).withColumn("month", F.date_format("day", "yyyy-MM"))


def touched_rows(spark: SparkSession, target: str, schema: StructType, days: list) -> DataFrame:
    """The raw rows of some days; other months' folders are pruned."""
    months = sorted({f"{d:%Y-%m}" for d in days})
    return (spark.read.schema(schema).option("basePath", target).parquet(target)
            .where(F.col("month").isin(months) & F.col("day").isin(days)))


def current(spark: SparkSession, table: str, key: str) -> DataFrame:
    """The newest value of each key of a table that epochs write."""
    t = spark.read.option("basePath", table).parquet(table)
    rest = [c for c in t.columns if c not in (key, "epoch")]
    return (t.groupBy(key).agg(F.max_by(F.struct(*rest), "epoch").alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in rest]))


def current_days(spark: SparkSession, days: str, day: str = "sale_date") -> DataFrame:
    """The newest value of each day."""
    return current(spark, days, day)


def daily_sales(bills: DataFrame) -> DataFrame:
    """Bills and revenue per day; the same on a stream and on a table."""
    return (bills.select(export_date("bill_datetime_raw").alias("sale_date"), F.col("net_total").cast("decimal(18,4)").alias("net_total"))
            .where(F.col("sale_date").isNotNull()).groupBy("sale_date")
            .agg(F.count(F.lit(1)).alias("total_bills"), F.sum("net_total").cast("double").alias("total_revenue")))


def run_daily_stream(spark: SparkSession, source_dir: str, schema: StructType, target: str, checkpoint: str,
                     daily: Callable[[DataFrame], DataFrame] = daily_sales, files_per_batch: int = 64) -> DataFrame:
    """T4: file stream -> update-mode aggregate by day -> the newest value of each day.

    ``daily`` is an aggregate by ``sale_date`` (sales or payments). Its state
    has one row per day, which days bound, so no day is ever closed. A replayed
    epoch overwrites its own folder.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)

    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch_id}")

    q = (daily(stream).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return current_days(spark, target)
