"""CSV records of large files, read in parallel whatever their cells hold.

A file is read as lines, in byte ranges, by many tasks. A cell may hold line
breaks, so whether a line starts a record depends on the quotes before it. Each
line maps the state before it (inside a quoted cell or not) to the state after
it; a line without quotes changes nothing, and most lines have none. A task
reads a range from end to end, so it composes the maps as it stages the lines
and keeps with each line what a start outside or inside a cell would make of
it. A scan over the few ranges of a file then gives the state at each range's
start, and with it where records start; only the lines of records that span
lines are brought together.

Lines are staged once as Parquet; the text is scanned one time. Records are
not staged again, nor is the text dealt or sorted: they are read from the lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.sizing import broadcast_if_small
from ..session import saved

# A quote opens only at the start of a cell; a doubled quote inside is one quote; what follows a closing quote is plain.
_OPEN = r'"[^"]*+(?:""[^"]*+)*+'
_CELL = rf'(?:{_OPEN}"(?!")[^,]*+|[^",][^,]*+|)'
_TAIL = rf"(?:{_CELL},)*+{_OPEN}$"
#: A line that starts outside a quoted cell and ends inside one; one that starts inside and ends inside.
OPENS = rf"^{_TAIL}"
STAYS = rf'^[^"]*+(?:""[^"]*+)*+(?:$|"(?!")[^,]*+,{_TAIL})'
#: Maps of a line (state after for outside + 2 * state after for inside): always outside, swapped, unchanged, always inside.
CLOSED, SWAPPED, SAME, INSIDE = range(4)

FILE = "source_file_name"
#: Staged text is repetitive, so a stronger codec than the default is used for it (its gain was not measured).
TEXT_CODEC = "zstd"
RANGE = [FILE, "block"]


def line_map(line: Column) -> Column:
    return (F.when(~line.contains('"'), SAME).otherwise(line.rlike(OPENS).cast("int") + 2 * line.rlike(STAYS).cast("int"))).cast("int")


#: What a staged line is: ``state`` maps the state at its range's start to the one before the line, ``back0`` and ``back1`` count
#: the rows back to the start of its record if the range starts outside or inside a cell (-1: it starts before the range).
LINE = f"{FILE} string, block long, row long, line string, map int, state int, back0 long, back1 long"


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines as a task reads them, range by range, with their ``state`` and ``back``."""
    mine, seen = None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, block = (batch.column(i) for i in (0, 1))
        cut = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(cut) + 1).tolist()]
        row, maps = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        state, back = np.empty(n, np.int32), (np.empty(n, np.int64), np.empty(n, np.int64))
        for lo, hi in zip(starts, [*starts[1:], n]):
            here = (file[lo].as_py(), block[lo].as_py())
            if here != mine:
                mine, seen = here, ([0, None], [1, None])  # per start: the state, the row where its record starts
            m, r = maps[lo:hi], row[lo:hi]
            before = []
            for one, out in zip(seen, back):
                known = np.maximum.accumulate(np.where((m == CLOSED) | (m == INSIDE), np.arange(hi - lo), -1))
                swaps = np.cumsum(m == SWAPPED)
                after = np.where(known >= 0, (m[known] == INSIDE) + swaps - swaps[known], one[0] + swaps) & 1
                was = np.concatenate(([one[0]], after[:-1]))
                first = np.maximum.accumulate(np.where(was == 0, r, -1 if one[1] is None else one[1]))
                out[lo:hi] = np.where(first < 0, -1, r - first)
                one[0], one[1] = int(after[-1]), None if first[-1] < 0 else int(first[-1])
                before.append(was)
            state[lo:hi] = before[0] + 2 * before[1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(state), *map(pa.array, back)], [*batch.schema.names, "state", "back0", "back1"])


def as_lines(text: DataFrame, file: Column, block: Column) -> DataFrame:
    """Lines of a text source: file, block, row (growing within a block), line, map, and where they stand in their range (LINE)."""
    lines = text.select(file.alias(FILE), block.cast("long").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"),
                        line_map(F.col("value")).alias("map"))
    return lines.mapInArrow(_marked, LINE)


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return as_lines(spark.read.text(paths), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))


def _running(w: Window) -> tuple[Column, Column]:
    """Swaps so far, and the last line that fixes the state: (state, swaps up to it)."""
    swaps = F.sum((F.col("map") == SWAPPED).cast("long")).over(w)
    fixed = F.last(F.when(F.col("map").isin(CLOSED, INSIDE), F.struct((F.col("map") == INSIDE).cast("long").alias("state"), F.col("_swaps"))), ignorenulls=True).over(w)
    return swaps, fixed


def _after(start: Column) -> Column:
    return F.when(F.col("_fixed").isNotNull(), (F.col("_fixed.state") + F.col("_swaps") - F.col("_fixed._swaps")) % 2).otherwise((start + F.col("_swaps")) % 2)


def _next(state: Column) -> Column:
    """The state after a line from the one before it."""
    return F.when(state == 0, F.col("map") % 2).otherwise(F.floor(F.col("map") / 2)).cast("int")


def ranges(lines: DataFrame) -> DataFrame:
    """One row per (file, block): its first row, its lines, ``start`` (1: inside a quoted cell), ``plain`` (its lines are records), ``open`` (its file ends inside a cell)."""
    end = _next(F.col("state") % 2) + 2 * _next(F.floor(F.col("state") / 2))
    per = lines.groupBy(*RANGE).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("lines"), (F.count_if(F.col("map") != SAME) > 0).alias("_marked"),
                                    F.max_by(end, "row").alias("map"))
    # a range is to its file what a line is to a range
    along = Window.partitionBy(FILE).orderBy("block")
    swaps, fixed = _running(along)
    done = per.withColumn("_swaps", swaps).withColumn("_fixed", fixed).withColumn("_end", _after(F.lit(0)))
    start = F.coalesce(F.lag("_end").over(along), F.lit(0))
    done = done.withColumn("start", start).withColumn("open", F.last("_end").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 1)
    return done.select(*RANGE, "first", "lines", "start", (~F.col("_marked") & (F.col("start") == 0)).alias("plain"), "open")


def records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, files) of staged ``lines``: records are (file, _pos, record), _pos in file order; files tells which end inside a quoted cell.

    Empty lines outside cells are no records. A file whose last quote is never
    closed has no records: they cannot be told apart.
    """
    info = saved(ranges(lines), "csv-ranges")
    files = info.groupBy(FILE).agg(F.any_value("open").alias("open"), F.sum("lines").alias("lines"))
    pos = lambda block, row: F.struct(F.col(block).alias("block"), F.col(row).alias("row")).alias("_pos")
    outside = F.col("start") == 0

    def placed(some: DataFrame) -> DataFrame:
        """Lines of some ranges with the states before and after them and the row where their record starts (none: before the range)."""
        back = F.when(outside, F.col("back0")).otherwise(F.col("back1"))
        return (lines.join(broadcast_if_small(some.select(*RANGE, "start")), RANGE)
                .withColumn("_before", F.when(outside, F.col("state") % 2).otherwise(F.floor(F.col("state") / 2)).cast("int"))
                .withColumn("_after", _next(F.col("_before"))).withColumn("_from", F.when(back >= 0, F.col("row") - back)))

    closed = info.where(~F.col("open"))
    single = (F.col("_before") == 0) & (F.col("_after") == 0)
    one = placed(closed).where(single).select(FILE, pos("block", "row"), F.col("line").alias("record"))
    # lines that continue a record of an earlier range: the last record start before the range
    mixed = placed(closed.where(~F.col("plain")))
    last = mixed.groupBy(*RANGE).agg(F.max("_from").alias("_last"))
    before = Window.partitionBy(FILE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    owner = last.select(*RANGE, F.last(F.when(F.col("_last").isNotNull(), F.struct("block", "_last")), ignorenulls=True).over(before).alias("_owner"))
    parts = mixed.where(~single).join(owner, RANGE)
    own = F.col("_from").isNotNull()
    spanning = (parts.withColumn("_block", F.when(own, F.col("block")).otherwise(F.col("_owner.block")))
                .withColumn("_row", F.when(own, F.col("_from")).otherwise(F.col("_owner._last")))
                .groupBy(FILE, "_block", "_row")
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "line"))), lambda x: x["line"]), "\n").alias("record"))
                .select(FILE, pos("_block", "_row"), "record"))
    # few records span lines; the others are read from the staged lines as they are
    spanning = saved(spanning, "csv-spanning", TEXT_CODEC)
    return one.unionAll(spanning).where(F.trim("record") != ""), files


def places(rows: DataFrame) -> DataFrame:
    """One row per file: _first and _last _pos, _n records, and the first ``record``.

    Hash aggregates by range first, so the records are not sorted by file.
    """
    by_range = rows.groupBy(FILE, F.col("_pos.block").alias("block")).agg(F.min("_pos.row").alias("_lo"), F.max("_pos.row").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    at = lambda row: F.struct(F.col("block"), F.col(row).alias("row"))
    per = saved(by_range.groupBy(FILE).agg(F.min(at("_lo")).alias("_first"), F.max(at("_hi")).alias("_last"), F.sum("_n").alias("_n")), "csv-places")
    head = rows.join(per.select(FILE, F.col("_first").alias("_pos")), [FILE, "_pos"])
    return saved(per.join(head.select(FILE, "record"), FILE), "csv-heads")


def parsed(rows: DataFrame, head: DataFrame, least: int) -> DataFrame:
    """Records as (file, _pos, _cells): as many cells as the widest header (``record`` of ``head``) has, ``least`` at least."""
    commas = F.length("record") - F.length(F.replace("record", F.lit(","), F.lit("")))
    width = max(least, (head.agg(F.max(commas).alias("n")).first()["n"] or 0) + 1)
    schema = ", ".join(f"_c{i} string" for i in range(width))
    cells = F.from_csv("record", schema, {"escape": '"', "maxColumns": str(max(20480, width + 1)), "maxCharsPerColumn": "-1"})
    # parsed once, then taken apart
    return (rows.withColumn("_row", cells).drop("record")
            .withColumn("_cells", F.array(*[F.col(f"_row._c{i}") for i in range(width)])).drop("_row"))
