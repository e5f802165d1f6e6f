"""Product x day facts (reference steps 01-04) and the latest-day fast path.

:func:`grid_windows` makes the grid and its windows from the sparse facts in one
pass by product. :func:`dense_metrics` and :func:`windowed` are the same in
DataFrame terms, for rows that come from elsewhere.

Partitioning plan (one shuffle of grid-sized data is avoided entirely):

* sales and purchase lines are aggregated to (product, day) with partial
  aggregation, so a hot product costs at most one row per day per task;
* the sparse facts and the product list are hash-partitioned on
  ``product_id`` only; the day spine is generated *inside* each partition by
  ``explode(sequence(start, end))`` (no cross join, no shuffle of the grid);
* densify = aggregate over (product, day) of grid and sparse rows, and every
  window (lags, rolling means, cumulative stock) is partitioned by
  ``product_id`` -- all satisfied by the same hash partitioning, so the grid
  is sorted once per partition and never exchanged.

Quantities on the grid are fixed-point LONGs in units of 1e-4 (the unscaled
DECIMAL(18,4)), so sums are exact primitive additions inside codegen. Rolling
k-day sums are differences of one running sum (O(rows), not O(rows x k)).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import export_date, plain_date, z
from ..functions.numeric import round_half_up
from ..plans.sizing import broadcast_if_small
from ..session import saved
from . import spans

SCALE = 10000.0


def unscaled(c) -> Column:
    """DECIMAL(18,4) -> exact LONG in units of 1e-4."""
    c = F.col(c) if isinstance(c, str) else c
    return (c * F.lit(10000)).cast("bigint")


def to_double(c) -> Column:
    """Unscaled LONG -> the DOUBLE nearest to its decimal value."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double") / F.lit(SCALE)


def remap(df: DataFrame, col: str, aliases: DataFrame, out: str = "product_id") -> DataFrame:
    """Alias barcode -> canonical barcode (left join, coalesce)."""
    amap = broadcast_if_small(
        aliases.select(F.col("alias_barcode").alias("__alias"), F.col("canonical_barcode").alias("__canon")))
    return (df.join(amap, df[col] == amap["__alias"], "left")
            .withColumn(out, F.coalesce(F.col("__canon"), F.col(col)))
            .drop("__alias", "__canon"))


def sales_by_product_day(items: DataFrame, aliases: DataFrame, keep_undated: bool = False) -> DataFrame:
    """A4: (date, product_id) -> sold qty (sale + free) and revenue, unscaled LONG.

    ``keep_undated`` also keeps the groups without a date or a product, so
    that the product list and the first day can derive from this aggregate.
    """
    lines = items.select(export_date("sale_datetime_raw").alias("date"), "barcode",
                         unscaled(z("sale_qty") + z("free_qty")).alias("_q"),
                         unscaled(z("net_total")).alias("_r"))
    lines = remap(lines, "barcode", aliases)
    if not keep_undated:
        lines = lines.filter(F.col("product_id").isNotNull() & F.col("date").isNotNull())
    return lines.groupBy("date", "product_id").agg(F.sum("_q").alias("qty"), F.sum("_r").alias("rev"))


def purchases_by_product_day(pitems: DataFrame, aliases: DataFrame) -> DataFrame:
    """A5: (date, product_id) -> purchased qty, unscaled LONG."""
    lines = pitems.select(plain_date("purchase_date_raw").alias("date"), "barcode",
                          unscaled(z("total_qty")).alias("_p"))
    lines = remap(lines, "barcode", aliases).filter(
        F.col("date").isNotNull() & F.col("product_id").isNotNull())
    return lines.groupBy("date", "product_id").agg(F.sum("_p").alias("pqty"))


def sold_products(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct canonical products that appear in any sales line."""
    return remap(items.select("barcode"), "barcode", aliases).filter(
        F.col("product_id").isNotNull()).select("product_id").distinct()


def _avg_price(rev: Column, qty: Column) -> Column:
    return F.when(qty != 0, to_double(rev) / to_double(qty))


def product_daily_sparse(items: DataFrame, pitems: DataFrame, aliases: DataFrame) -> DataFrame:
    """Sold (product, day) rows with purchases joined on; no grid."""
    s = sales_by_product_day(items, aliases)
    p = purchases_by_product_day(pitems, aliases)
    return s.join(p, ["date", "product_id"], "left").select(
        "date", "product_id",
        to_double("qty").alias("quantity_sold"),
        to_double("rev").alias("revenue"),
        _avg_price(F.col("rev"), F.col("qty")).alias("avg_price"),
        to_double(F.coalesce(F.col("pqty"), F.lit(0))).alias("purchase_quantity"),
    )


def grid_partitions(spark, est_rows: int | None = None, rows_per_partition: int = 1_000_000) -> int:
    """Partition count for the product grid.

    The product list is small, so an AQE-coalesced shuffle would collapse the
    whole grid into one task; a fixed count keeps it spread. It is at least
    the session's shuffle partitions and four waves of the cluster's cores
    (measured: 4x cores cut the sf0.1 feature rebuild from 79 s to 57 s on
    8 cores), and grows with the estimated grid size when one is given.
    """
    base = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
               4 * spark.sparkContext.defaultParallelism)
    if est_rows:
        base = max(base, -(-est_rows // rows_per_partition))
    return base


def sale_days(bills: DataFrame, sales_facts: DataFrame) -> tuple[dt.date | None, dt.date | None]:
    """MIN and MAX(sale_date) of the daily summary, in one pass: bills and, from the built facts, lines."""
    b = bills.select(export_date("bill_datetime_raw").alias("d"))
    both = b.unionByName(sales_facts.select(F.col("date").alias("d")))
    return tuple(both.agg(F.min("d"), F.max("d")).first())


def spine_start_date(bills: DataFrame, sales_facts: DataFrame) -> dt.date | None:
    """The first sale day.

    The grid and the fast path name it in many expressions; a literal is
    planned once and lets the optimizer fold it.
    """
    return sale_days(bills, sales_facts)[0]


def product_facts(items: DataFrame, pitems: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sales, purchases) by product and day, built once: each raw table is scanned one time.

    The product list, the first day, the grid, the fast path and the windows
    all derive from these two tables.
    """
    return sales_facts(items, aliases), purchase_facts(pitems, aliases)


def sales_facts(items: DataFrame, aliases: DataFrame) -> DataFrame:
    return saved(sales_by_product_day(items, aliases, keep_undated=True), "sales-facts")


def purchase_facts(pitems: DataFrame, aliases: DataFrame) -> DataFrame:
    return saved(purchases_by_product_day(pitems, aliases), "purchase-facts")


def known_sales(sales: DataFrame) -> DataFrame:
    """:func:`sales_by_product_day` without undated groups, from the built facts."""
    return sales.where(F.col("product_id").isNotNull() & F.col("date").isNotNull())


def opening_balances(facts: tuple[DataFrame, DataFrame], start: Column, day: dt.date) -> DataFrame:
    """What the grid before ``day`` adds up to, one row per product: sold and purchased, last days of both.

    One conditional aggregate over the sparse facts; it replaces the grid's
    earlier rows for everything that is cumulative.
    """
    sales, purchases = facts
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("date")
    both = (sales.select("product_id", "date", "qty", zero.alias("pqty")).unionByName(purchases.select("product_id", "date", zero.alias("qty"), "pqty"))
            .where(F.col("product_id").isNotNull() & (F.col("date") >= start) & (F.col("date") < F.lit(day))))
    return both.groupBy("product_id").agg(
        F.sum("qty").alias("qty"), F.sum("pqty").alias("pqty"), F.coalesce(F.max(F.when(F.col("qty") > 0, F.col("date"))), none).alias("_sold"),
        F.coalesce(F.max(F.when(F.col("pqty") > 0, F.col("date"))), none).alias("_bought"))


#: Days of history that the windows of a day look back on.
LOOK_BACK = 60


def recent_windows(facts: tuple[DataFrame, DataFrame], start: Column, as_of: dt.date, since: dt.date) -> DataFrame:
    """:func:`windowed` of the days [since, as_of] alone, equal to those of the whole grid.

    The grid begins LOOK_BACK days earlier, after one opening row per product
    that carries all cumulative values; so the work grows with the days asked
    for, not with the history.
    """
    return days_of(recent_runs(facts, start, as_of, since))


def recent_runs(facts: tuple[DataFrame, DataFrame], start: Column, as_of: dt.date, since: dt.date) -> DataFrame:
    """:func:`recent_windows` as runs of days."""
    return grid_runs(facts, start, as_of, since - dt.timedelta(days=LOOK_BACK), opening=True, since=since)


def days_of(runs: DataFrame) -> DataFrame:
    """A row for each day of the runs of :func:`grid_runs`, or of what is made from them without their days.

    The rows are made where they are used, in generated code.
    """
    return runs.select(F.explode(F.sequence("_from", "_to")).alias("date"), *[c for c in runs.columns if c not in ("_from", "_to")])


def grid_windows(facts: tuple[DataFrame, DataFrame], start: Column, as_of: dt.date, grid_from: dt.date | None = None,
                 opening: bool = False, since: dt.date | None = None, columns: list[str] | None = None) -> DataFrame:
    """:func:`windowed` of :func:`dense_metrics` straight from the sparse facts: :func:`grid_runs` day by day."""
    return days_of(grid_runs(facts, start, as_of, grid_from, opening, since, columns))


#: Rows of the grid that a task makes, at least; it holds a few products at a time.
GRID_ROWS = 4_000_000


def grid_runs(facts: tuple[DataFrame, DataFrame], start: Column, as_of: dt.date, grid_from: dt.date | None = None,
              opening: bool = False, since: dt.date | None = None, columns: list[str] | None = None) -> DataFrame:
    """The grid's windows as runs of days [_from, _to] of a product on which no column changes; only the sparse facts are dealt and sorted by product.

    A task spreads the facts of its products over the days (:mod:`spans`), so
    no grid row is hashed, sorted or exchanged, and most days need no row of
    their own on the way. ``columns`` names the columns of ``spans.COLUMNS`` to
    make (all by default), ``since`` the first day to return.
    """
    s_all, purchases = facts
    spark = s_all.sparkSession
    first = start if grid_from is None else F.greatest(start, F.lit(grid_from))
    listed = s_all.filter(F.col("product_id").isNotNull())
    # two numbers of the grid: its first days and its products
    begin, day_one, n = listed.agg(F.any_value(start), F.any_value(first), F.count_distinct("product_id")).first()
    columns = list(spans.COLUMNS) if columns is None else columns
    kind = s_all.schema["product_id"].dataType.simpleString()
    schema = ", ".join(["_from date", "_to date", f"product_id {kind}", *[f"{c} {spans.COLUMNS[c]}" for c in columns]])
    if day_one is None:  # no product or no sale day: no grid
        return spark.createDataFrame([], schema)
    last = max(day_one, as_of)
    emit = day_one if since is None else max(day_one, since)
    if emit > last:
        return spark.createDataFrame([], schema)
    zero, none, no = F.lit(0).cast("bigint"), F.lit(None).cast("date"), F.lit(False)
    here = F.col("date").between(F.lit(day_one), F.lit(last))
    # a product that has sold on no day of the grid keeps one row without a day
    rows = (listed.where(here).select("product_id", "date", "qty", "rev", zero.alias("pqty"), F.lit(True).alias("_listed"), no.alias("_opens"), none.alias("_sold"), none.alias("_bought"))
            .unionByName(listed.where(~F.coalesce(here, no)).select("product_id").distinct()
                         .select("product_id", none.alias("date"), zero.alias("qty"), zero.alias("rev"), zero.alias("pqty"), F.lit(True).alias("_listed"), no.alias("_opens"),
                                 none.alias("_sold"), none.alias("_bought")))
            .unionByName(purchases.where(here & F.col("product_id").isNotNull()).select(
                "product_id", "date", zero.alias("qty"), zero.alias("rev"), "pqty", no.alias("_listed"), no.alias("_opens"), none.alias("_sold"), none.alias("_bought"))))
    if opening:
        rows = rows.unionByName(opening_balances(facts, start, grid_from).select(
            "product_id", none.alias("date"), "qty", zero.alias("rev"), "pqty", no.alias("_listed"), F.lit(True).alias("_opens"), "_sold", "_bought"))
    n_parts = grid_partitions(spark, n * ((last - emit).days + 1), GRID_ROWS)
    return (rows.repartition(n_parts, "product_id").sortWithinPartitions("product_id")
            .mapInArrow(spans.spread(begin, day_one, last, emit, columns), schema))


def dense_metrics(facts: tuple[DataFrame, DataFrame], start: Column, as_of: dt.date,
                  grid_from: dt.date | None = None, opening: bool = False) -> DataFrame:
    """Densified (product, day) grid of :func:`product_facts`: date, product_id, qty, rev, pqty (unscaled LONG).

    The result is hash partitioned by product_id; the grid rows are generated
    after the (small) product shuffle and never cross an exchange. The number
    of partitions grows with products x days. With ``grid_from`` the grid is
    truncated to [grid_from, as_of]: rolling windows stay exact for days at
    least 59 days after ``grid_from``; cumulative values need the ``opening``
    rows, which stand on the day before it, with the days of the last sale and
    purchase in _sold and _bought.
    """
    s_all, purchases = facts
    first = start if grid_from is None else F.greatest(start, F.lit(grid_from))
    zero = F.lit(0).cast("bigint")
    products = s_all.filter(F.col("product_id").isNotNull()).select("product_id").distinct()
    size = products.agg((F.count(F.lit(1)) * (F.datediff(F.lit(as_of), F.any_value(first)) + 1)).alias("n")).first()["n"]
    n_parts = grid_partitions(s_all.sparkSession, size)
    sales = s_all.filter(F.col("date").isNotNull() & F.col("product_id").isNotNull()).select(
        "product_id", "date", "qty", "rev", zero.alias("pqty"), F.lit(False).alias("_grid"))
    purch = purchases.select(
        "product_id", "date", zero.alias("qty"), zero.alias("rev"), "pqty", F.lit(False).alias("_grid"))
    sparse = sales.unionByName(purch)
    if opening:
        balances = opening_balances(facts, start, grid_from).join(products, "product_id", "left_semi")
        sparse = (sparse.where(F.col("date") >= first).select("*", F.lit(None).cast("date").alias("_sold"), F.lit(None).cast("date").alias("_bought"))
                  .unionByName(balances.select("product_id", F.lit(grid_from - dt.timedelta(days=1)).alias("date"), "qty", zero.alias("rev"), "pqty",
                                               F.lit(True).alias("_grid"), "_sold", "_bought")))
    sparse = sparse.repartition(n_parts, "product_id")
    grid = (
        products.repartition(n_parts, "product_id")
        .select("product_id", F.explode(F.sequence(first, F.lit(as_of))).alias("date"))
        .select("product_id", "date", zero.alias("qty"), zero.alias("rev"), zero.alias("pqty"),
                F.lit(True).alias("_grid"))
    )
    if opening:
        days = (F.max("_sold").alias("_sold"), F.max("_bought").alias("_bought"))
        return (grid.select("*", F.lit(None).cast("date").alias("_sold"), F.lit(None).cast("date").alias("_bought")).unionByName(sparse)
                .groupBy("product_id", "date")
                .agg(F.sum("qty").alias("qty"), F.sum("rev").alias("rev"), F.sum("pqty").alias("pqty"), F.max("_grid").alias("_grid"), *days)
                .filter("_grid").drop("_grid"))
    return (
        grid.unionByName(sparse)
        .groupBy("product_id", "date")
        .agg(F.sum("qty").alias("qty"), F.sum("rev").alias("rev"), F.sum("pqty").alias("pqty"),
             F.max("_grid").alias("_grid"))
        .filter(F.col("_grid") & (F.col("date") >= first))
        .drop("_grid")
    )


def _days(win: DataFrame) -> list[str]:
    """The columns that say which days a row stands for."""
    return ["date"] if "date" in win.columns else ["_from", "_to"]


def product_daily_metrics(dense: DataFrame) -> DataFrame:
    return dense.select(
        *_days(dense), "product_id",
        to_double("qty").alias("quantity_sold"),
        to_double("rev").alias("revenue"),
        _avg_price(F.col("rev"), F.col("qty")).alias("avg_price"),
        to_double("pqty").alias("purchase_quantity"),
    )


def rolling_mean(s_unscaled: Column, n: Column) -> Column:
    return to_double(s_unscaled) / n.cast("double")


def stddev_lags(lags: list[Column], s7: Column, n7: Column) -> Column:
    """Sample stddev of the (up to 7) values in the frame, two-pass form.

    ``lags[i]`` is the value i rows back (NULL before the partition start).
    One fixed sequence of IEEE operations, so any engine reproduces it.
    """
    mean = rolling_mean(s7, n7)
    acc = None
    for v in lags:
        dev = to_double(v) - mean
        term = F.coalesce(dev * dev, F.lit(0.0))
        acc = term if acc is None else acc + term
    return F.when(n7 > 1, F.sqrt(acc / (n7 - 1).cast("double")))


def windowed(dense: DataFrame, start: Column | None = None) -> DataFrame:
    """W1-W9 in one window pass per product (one sort, no exchange).

    ``start`` (the spine start) gives each day its position on the full
    spine, so a truncated grid keeps the right window sizes.
    """
    w = Window.partitionBy("product_id").orderBy("date")
    cum = w.rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("qty")
    rn = F.row_number().over(w) if start is None else F.datediff(F.col("date"), start) + 1
    sold, bought = F.when(q > 0, F.col("date")), F.when(F.col("pqty") > 0, F.col("date"))
    if "_sold" in dense.columns:  # an opening row's quantities are of earlier days
        opens = F.col("_sold").isNotNull() | F.col("_bought").isNotNull()
        sold, bought = F.when(opens, F.col("_sold")).otherwise(sold), F.when(opens, F.col("_bought")).otherwise(bought)
    base = dense.select(
        "date", "product_id", "qty", "rev", "pqty",
        rn.alias("_rn"),
        F.sum(q).over(cum).alias("_cq"),
        F.sum("pqty").over(cum).alias("_tp"),
        F.max(sold).over(cum).alias("last_sale_date"),
        F.max(bought).over(cum).alias("last_purchase_date"),
        *[F.lag(q, i).over(w).alias(f"_l{i}") for i in range(1, 8)],
    )
    cq, rn = F.col("_cq"), F.col("_rn")

    def ksum(k):
        return cq - F.coalesce(F.lag(cq, k).over(w), F.lit(0))

    sums = base.select("*", ksum(7).alias("_s7"), ksum(30).alias("_s30"), ksum(60).alias("_s60"))
    lags = [q] + [F.col(f"_l{i}") for i in range(1, 7)]
    n7 = F.least(rn, F.lit(7))
    s7 = F.col("_s7")
    return sums.select(
        "date", "product_id", "qty", "rev", "pqty", "last_sale_date", "last_purchase_date",
        to_double("_l1").alias("lag_1_qty"),
        to_double("_l7").alias("lag_7_qty"),
        rolling_mean(s7, n7).alias("last_7_day_avg"),
        rolling_mean(F.col("_s30"), F.least(rn, F.lit(30))).alias("last_30_day_avg"),
        rolling_mean(F.col("_s60"), F.least(rn, F.lit(60))).alias("last_60_day_avg"),
        stddev_lags(lags, s7, n7).alias("last_7_day_stddev"),
        F.col("_tp"), cq.alias("_ts"),
    )


def product_daily_features(win: DataFrame, calendar: DataFrame | None) -> DataFrame:
    """02: lags, rolling means, stddev, day of week, stock-out proxy, calendar; ``win`` has days or runs of days."""
    out = win.select(
        *_days(win), "product_id",
        to_double("qty").alias("quantity_sold"),
        to_double("rev").alias("revenue"),
        to_double("pqty").alias("purchase_quantity"),
        "lag_1_qty", "lag_7_qty", "last_7_day_avg", "last_30_day_avg", "last_60_day_avg",
        "last_7_day_stddev",
        ((F.col("qty") == 0) & (F.coalesce(F.col("last_7_day_avg"), F.lit(0.0)) > 0.5)
         & (F.col("pqty") == 0)).alias("stockout_proxy"),
    )
    out = out if "date" in out.columns else days_of(out)
    out = out.select(*out.columns[:-1], (F.dayofweek("date") - 1).cast("bigint").alias("day_of_week"), "stockout_proxy")
    if calendar is None:
        return out.select("*", F.lit(None).cast("boolean").alias("is_holiday"),
                          F.lit(None).cast("bigint").alias("days_to_next_festival"),
                          F.lit(None).cast("bigint").alias("days_since_last_festival"))
    # the calendar has one row per day of a bounded span: safe to broadcast
    cal = F.broadcast(calendar.select("date", "is_holiday", "days_to_next_festival",
                                      "days_since_last_festival"))
    return out.join(cal, "date", "left")


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def health_columns(a7: Column, a30: Column, a60: Column, sd: Column, lag1: Column) -> list[Column]:
    """P9 P10 on precomputed averages (shared by the dense and fast paths)."""
    pred = (F.lit(0.6) * F.coalesce(a7, F.lit(0.0)) + F.lit(0.3) * F.coalesce(a30, F.lit(0.0))
            + F.lit(0.1) * F.coalesce(a60, F.lit(0.0)))
    return [
        # at least 0.02; days without demand need no decimal rounding
        F.when(pred > F.lit(0.02), round_half_up(pred, 4)).otherwise(F.lit(0.02)).alias("predicted_daily_demand"),
        a7.alias("last_7_day_avg"), a30.alias("last_30_day_avg"), a60.alias("last_60_day_avg"),
        sd.alias("demand_volatility"),
        _flag(a7 > a30 * F.lit(1.2)).alias("fast_moving_flag"),
        _flag((a30 > 0) & (a7 < a30 * F.lit(0.5))).alias("slow_moving_flag"),
        _flag(a30 == 0).alias("dead_stock_flag"),
        _flag(lag1 > a7 * F.lit(2)).alias("demand_spike_flag"),
    ]


def product_health_signals(win: DataFrame) -> DataFrame:
    """03: baseline demand and health flags for every (product, day), or run of days."""
    c = F.col
    return win.select(*_days(win), "product_id",
                      *health_columns(c("last_7_day_avg"), c("last_30_day_avg"), c("last_60_day_avg"),
                                      c("last_7_day_stddev"), c("lag_1_qty")))


def product_stock_position(win: DataFrame) -> DataFrame:
    """04: cumulative purchased/sold, pseudo stock, last sale/purchase day, for every (product, day) or run of days."""
    return win.select(
        *_days(win), "product_id",
        to_double("_tp").alias("total_purchased"),
        to_double("_ts").alias("total_sold"),
        to_double(F.col("_tp") - F.col("_ts")).alias("pseudo_stock"),
        "last_sale_date", "last_purchase_date",
    )


# --------------------------------------------------------------------------
# Latest-day fast path: the same numbers as the dense windows on ``as_of``,
# from one conditional aggregation per product over the sparse facts.
# --------------------------------------------------------------------------

def latest_state(facts: tuple[DataFrame, DataFrame], start: Column, as_of: dt.date) -> DataFrame:
    """One row per sold product: the dense grid's windows evaluated on ``as_of``.

    On the last grid day a k-row window holds ``least(k, days since start + 1)``
    rows; missing days are zeros, so sums come from the sparse rows alone.
    The aggregation is partial+final on product_id (a hot product is
    pre-aggregated per task before the shuffle).
    """
    T = F.lit(as_of)
    span = F.datediff(T, start) + 1
    zero = F.lit(0).cast("bigint")
    s_all, purchases = facts
    s_all = s_all.filter(F.col("product_id").isNotNull())
    sales = s_all.filter(F.col("date").isNotNull()).select("product_id", "date", "qty", zero.alias("pqty"))
    purch = purchases.select("product_id", "date", zero.alias("qty"), "pqty")
    d, q, pq = F.col("date"), F.col("qty"), F.col("pqty")
    in_grid = (d >= start) & (d <= T)

    def last(k):
        return in_grid & (d > F.date_sub(T, k))

    def on_lag(i):
        return F.sum(F.when(in_grid & (d == F.date_sub(T, i)), q)).alias(f"_l{i}")

    agg = (
        sales.unionByName(purch)
        .groupBy("product_id")
        .agg(
            F.sum(F.when(last(7), q)).alias("_s7"),
            F.sum(F.when(last(30), q)).alias("_s30"),
            F.sum(F.when(last(60), q)).alias("_s60"),
            F.sum(F.when(last(180), q)).alias("_s180"),
            *[on_lag(i) for i in range(0, 7)],
            F.sum(F.when(in_grid, pq)).alias("_tp"),
            F.sum(F.when(in_grid, q)).alias("_ts"),
            F.max(F.when(in_grid & (q > 0), d)).alias("last_sale_date"),
            F.max(F.when(in_grid & (pq > 0), d)).alias("last_purchase_date"),
        )
    )
    s = s_all.select("product_id").distinct().join(agg, "product_id", "left")
    zc = lambda c: F.coalesce(F.col(c), F.lit(0))
    n7, n30, n60 = F.least(F.lit(7), span), F.least(F.lit(30), span), F.least(F.lit(60), span)
    a7, a30, a60 = rolling_mean(zc("_s7"), n7), rolling_mean(zc("_s30"), n30), rolling_mean(zc("_s60"), n60)
    # the i-th lag exists only if the grid has at least i+1 days
    lags = [F.when(span > i, zc(f"_l{i}")) for i in range(0, 7)]
    lag1 = to_double(lags[1])
    sd = stddev_lags(lags, zc("_s7"), n7)
    return s.select(
        T.alias("date"), "product_id",
        to_double(zc("_l0")).alias("quantity_sold"),
        lag1.alias("lag_1_qty"),
        *health_columns(a7, a30, a60, sd, lag1),
        to_double(zc("_tp")).alias("total_purchased"),
        to_double(zc("_ts")).alias("total_sold"),
        to_double(zc("_tp") - zc("_ts")).alias("pseudo_stock"),
        "last_sale_date", "last_purchase_date",
        round_half_up(to_double(zc("_s180")) / F.lit(6.0), 2).alias("avg_monthly_consumption"),
    )


SIGNAL_COLUMNS = ["date", "product_id", "predicted_daily_demand", "last_7_day_avg", "last_30_day_avg",
                  "last_60_day_avg", "demand_volatility", "fast_moving_flag", "slow_moving_flag",
                  "dead_stock_flag", "demand_spike_flag"]
STOCK_COLUMNS = ["date", "product_id", "total_purchased", "total_sold", "pseudo_stock",
                 "last_sale_date", "last_purchase_date"]

# Columns of ``spans.COLUMNS`` that each grid table is made from.
METRICS_NEED = ["qty", "rev", "pqty"]
FEATURES_NEED = ["qty", "rev", "pqty", "lag_1_qty", "lag_7_qty", "last_7_day_avg", "last_30_day_avg", "last_60_day_avg", "last_7_day_stddev"]
SIGNALS_NEED = ["lag_1_qty", "last_7_day_avg", "last_30_day_avg", "last_60_day_avg", "last_7_day_stddev"]
STOCK_NEED = ["_tp", "_ts", "last_sale_date", "last_purchase_date"]
