"""Grid invariants, window edge cases, fast path == dense path."""

import datetime as dt

from pyspark.sql import functions as F

from basketry.operators import product as P
from basketry.plans import registry as R


def test_fast_path_equals_dense_last_day(spark, small_tables):
    t = small_tables
    start = R._start(t)
    win = P.windowed(P.dense_metrics(R._facts(t), start, R.AS_OF))
    dense = (P.product_health_signals(win).join(P.product_stock_position(win), ["date", "product_id"])
             .filter(F.col("date") == F.lit(R.AS_OF)))
    fast = R._latest(t)
    cols = [c for c in P.SIGNAL_COLUMNS + P.STOCK_COLUMNS[2:] if c not in ("date",)]
    a = sorted(tuple(r) for r in dense.select(*cols).collect())
    b = sorted(tuple(r) for r in fast.select(*cols).collect())
    assert a == b and len(a) > 0


def test_grid_size_and_revenue_parity(spark, small_tables):
    t = small_tables
    start = R._start(t)
    dense = P.dense_metrics(R._facts(t), start, R.AS_OF)
    n_prod = P.sold_products(t.raw_sales_itemwise, t.product_aliases).count()
    first = P.spine_start_date(t.raw_sales_billwise, R._facts(t)[0])
    assert dense.count() == n_prod * ((R.AS_OF - first).days + 1)
    sparse = P.sales_by_product_day(t.raw_sales_itemwise, t.product_aliases)
    assert dense.agg(F.sum("rev")).first()[0] == sparse.agg(F.sum("rev")).first()[0]


def test_windows_on_literal_product(spark):
    """One product, 10 days: lag, rolling means, stddev NULL on day one, cumulative stock."""
    d0 = dt.date(2024, 1, 1)
    qty = [5, 0, 0, 2, 0, 0, 0, 0, 9, 1]
    rows = [("p", d0 + dt.timedelta(days=i), q * 10000, q * 20000, (3 if i == 2 else 0) * 10000)
            for i, q in enumerate(qty)]
    dense = spark.createDataFrame(rows, "product_id string, date date, qty long, rev long, pqty long")
    out = {r.date: r for r in P.windowed(dense).collect()}
    r0, r6, r9 = out[d0], out[d0 + dt.timedelta(days=6)], out[d0 + dt.timedelta(days=9)]
    assert r0.lag_1_qty is None and r0.last_7_day_stddev is None
    assert r6.last_7_day_avg == 7 / 7 and r6.lag_7_qty is None
    assert r9.last_7_day_avg == sum(qty[3:10]) / 7
    assert r9.last_60_day_avg == sum(qty) / 10
    assert r9.lag_7_qty == qty[2]
    import statistics
    assert abs(r9.last_7_day_stddev - statistics.stdev(qty[3:10])) < 1e-12
    assert r9._ts == sum(qty) * 10000 and r9._tp == 3 * 10000
    assert r9.last_sale_date == d0 + dt.timedelta(days=9)
    assert r9.last_purchase_date == d0 + dt.timedelta(days=2)


def test_truncated_grid_keeps_windows_exact(spark, small_tables):
    t = small_tables
    start = R._start(t)
    args = (R._facts(t), start, R.AS_OF)
    full = P.windowed(P.dense_metrics(*args), start)
    cut = P.windowed(P.dense_metrics(*args, grid_from=R.AS_OF - dt.timedelta(days=70)), start)
    keep = F.col("date") >= F.lit(R.AS_OF - dt.timedelta(days=10))
    cols = ["date", "product_id", "last_7_day_avg", "last_30_day_avg", "last_60_day_avg", "last_7_day_stddev",
            "lag_1_qty", "lag_7_qty"]
    a = sorted(tuple(r) for r in full.filter(keep).select(*cols).collect())
    b = sorted(tuple(r) for r in cut.filter(keep).select(*cols).collect())
    assert a == b


def test_grid_plan_scans_no_raw_lines(spark, small_tables):
    """The grid reads the built facts; its partitions grow with products x days."""
    t = small_tables
    plan = P.dense_metrics(R._facts(t), R._start(t), R.AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "l_orderkey" not in plan and "sale_datetime_raw" not in plan
    assert P.grid_partitions(spark, 10**9) == 1000


def test_grid_windows_equal_the_dense_ones_without_a_grid_sort(spark, tmp_path):
    """Odd facts: undated sales, a product sold on no day of the grid, one only bought, days outside, facts cut over batches."""
    d0, end = dt.date(2024, 1, 1), dt.date(2024, 4, 30)
    day = lambda i: d0 + dt.timedelta(days=i)
    sales = [("a", day(i), (i % 5 - 1) * 10000, i * 7) for i in range(0, 121, 3)] + [("b", None, 5, 5), (None, day(4), 1, 1), ("c", day(400), 9, 9), ("e", day(60), 3, None),
             ("a", None, 1, 1), ("z", day(0), 10001, 3)]
    bought = [("a", day(i), i * 11) for i in range(0, 121, 7)] + [("d", day(5), 7), ("b", day(9), 2), ("c", day(119), 3), ("a", day(-3), 100), ("a", day(500), 100)]
    facts = (spark.createDataFrame(sales, "product_id string, date date, qty long, rev long"), spark.createDataFrame(bought, "product_id string, date date, pqty long"))
    start = F.lit(d0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        want = P.windowed(P.dense_metrics(facts, start, end))
        got = P.grid_windows(facts, start, end)
        assert got.select("product_id").distinct().count() == 5 and got.count() == 5 * 121
        assert got.select(*want.columns).exceptAll(want).isEmpty() and want.exceptAll(got.select(*want.columns)).isEmpty()
        since = day(90)
        cut = P.windowed(P.dense_metrics(facts, start, end, since - dt.timedelta(days=60), opening=True), start).where(F.col("date") >= F.lit(since))
        got = P.recent_windows(facts, start, end, since).select(*cut.columns)
        assert got.count() == 5 * 31 and got.exceptAll(cut).isEmpty() and cut.exceptAll(got).isEmpty()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = P.product_health_signals(P.grid_windows(facts, start, end, columns=P.SIGNALS_NEED))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan
    assert P.grid_windows(facts, F.lit(None).cast("date"), end).isEmpty()


def test_every_grid_query_takes_the_windows_from_the_facts(spark):
    for key in ("product_daily_metrics", "product_daily_features", "product_health_signals", "product_stock_position"):
        plan = R.QUERIES[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "lag(" not in plan and "rowsBetween" not in plan and "RowFrame" not in plan.split("MapInArrow")[0]


def test_days_without_change_are_one_row_until_they_are_used(spark):
    """Runs of days: their days are those of the grid, and few rows leave the tasks; tables made from runs equal those made day by day."""
    d0 = dt.date(2024, 1, 1)
    day = lambda i: d0 + dt.timedelta(days=i)
    facts = (spark.createDataFrame([("a", day(3), 20000, 7), ("a", day(200), 50000, 9), ("b", day(0), 10000, 1)], "product_id string, date date, qty long, rev long"),
             spark.createDataFrame([("a", day(5), 30000)], "product_id string, date date, pqty long"))
    end, start = day(365), F.lit(d0)
    dense = P.windowed(P.dense_metrics(facts, start, end))
    for need, make in ((P.METRICS_NEED, P.product_daily_metrics), (P.SIGNALS_NEED, P.product_health_signals), (P.STOCK_NEED, P.product_stock_position),
                       (P.FEATURES_NEED, lambda df: P.product_daily_features(df, None))):
        runs = P.grid_runs(facts, start, end, columns=need)
        got, want = make(runs), make(dense)
        got = got if "date" in got.columns else P.days_of(got)
        assert got.columns == want.columns and got.count() == 2 * 366
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert P.grid_runs(facts, start, end, columns=P.STOCK_NEED).count() == 5  # b: one run; a: before, sold, bought, sold
    assert P.grid_runs(facts, start, end, columns=P.SIGNALS_NEED).count() < 2 * 366 // 3
