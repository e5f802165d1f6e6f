"""A report dealt into ordered parts once, so that any page of it reads only its own parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, saved, scratch

PART = "_part"


class PageIndex:
    """The rows of a report by ranges of their order, one folder a range, and the number of rows in each.

    The rows are exchanged once by range; ``order`` must name columns of the
    report and should end in a key, so that a value that many rows share can be
    cut between ranges. Ranges are as large as a shuffle partition, or ``parts``
    of them. Only the counts, one number a range, come to the driver: they give
    ``total`` and say where an offset lies, so no page counts the report, sorts
    it or reads what is before it. Nulls are where ``order`` puts them. An empty
    report has no pages.
    """

    def __init__(self, rows: DataFrame, order: list[Column], parts: int | None = None):
        spark = rows.sparkSession
        path = scratch(spark, "pages")
        staged = saved(rows, "page-rows")  # the bounds of the ranges are sampled, and the report is not to run twice
        dealt = staged.repartitionByRange(*([parts] if parts else []), *order).withColumn(PART, F.spark_partition_id())
        dealt.write.partitionBy(PART).parquet(path)
        discard(staged)
        self.order = order
        self.rows = spark.read.schema(dealt.schema).parquet(path)
        self.rows._saved_path = path
        counts = self.rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect()
        #: (range, rows before it, rows up to its end), in order
        self.ranges: list[tuple[int, int, int]] = []
        self.total = 0
        for part, n in sorted((r[PART], r["n"]) for r in counts):
            self.ranges.append((part, self.total, self.total + n))
            self.total += n

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the order, with ``total``; past the end, none."""
        hit = [r for r in self.ranges if r[1] < offset + limit and r[2] > offset]
        out = self.rows.withColumn("total", F.lit(self.total).cast("bigint"))
        if not hit:
            return out.where(F.lit(False)).drop(PART)
        return (out.where(F.col(PART).between(hit[0][0], hit[-1][0])).orderBy(*self.order)
                .offset(max(0, offset - hit[0][1])).limit(limit).drop(PART))

    def ranked(self, size: int) -> DataFrame:
        """All rows with ``rank`` (from 1), ``page`` of ``size`` rows (from 1) and ``total``.

        Ranks are numbered within each range and begin after the ranges before
        it, so no task sorts the report.
        """
        before = self.rows.sparkSession.createDataFrame([r[:2] for r in self.ranges], f"{PART} int, _before bigint")
        w = Window.partitionBy(PART).orderBy(*self.order)
        rank = F.row_number().over(w) + F.col("_before")
        # one row a range, which the number of shuffle partitions bounds
        return (self.rows.join(F.broadcast(before), PART).withColumn("rank", rank)
                .withColumn("page", F.floor((F.col("rank") - 1) / size) + 1)
                .withColumn("total", F.lit(self.total).cast("bigint")).drop(PART, "_before"))

    def release(self) -> None:
        """Delete the dealt rows; pages made from them can no longer be read."""
        discard(self.rows)
