"""Ordered rebuild publishes a complete run; per-supplier sheets land one folder per supplier."""

import os

from pyspark.sql import functions as F

from basketry.plans import registry as R
from basketry.plans.rebuild import open_run, published_run, rebuild
from basketry.sources.sinks import write_supplier_sheets


def test_rebuild_publishes_all_tables(spark, small_tables, tmp_path):
    t = small_tables
    raw = {n: getattr(t, n) for n in ["raw_sales_billwise", "raw_sales_itemwise", "raw_purchase_billwise",
                                      "raw_purchase_itemwise", "product_aliases", "raw_item_combinations",
                                      "raw_supplier_master", "products"]}
    run = rebuild(spark, raw, str(tmp_path), R.AS_OF, run_id="r1")
    assert published_run(spark, str(tmp_path)) == run
    feats = spark.read.parquet(f"{run}/product_daily_features")
    assert feats.count() == spark.read.parquet(f"{run}/product_daily_metrics").count() > 0
    restock = open_run(spark, str(tmp_path), ["supplier_restock_recommendations"])["supplier_restock_recommendations"]
    assert restock.agg(F.countDistinct("product_id")).first()[0] == restock.count()


def test_a_rebuild_of_recent_days_equals_the_full_one(spark, small_tables, tmp_path):
    """All four grid tables: older months from an earlier run, the last 90 days made again; nothing but those months is written."""
    import datetime as dt
    from basketry.operators import product
    from basketry.plans import grid
    t = small_tables
    facts, start, calendar = R._facts(t), R._start(t), R._calendar(t)
    full = {n: df for n, df in grid.grid_tables(product.windowed(product.dense_metrics(facts, start, R.AS_OF)), calendar).items()}
    early = product.windowed(product.dense_metrics(facts, start, R.AS_OF - dt.timedelta(days=40)))
    grid.write_months(grid.grid_tables(early, calendar), str(tmp_path))
    old = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    since = grid.rebuild_recent(spark, facts, start, str(tmp_path), R.AS_OF, 90, calendar)
    assert since.day == 1 and 90 <= (R.AS_OF - since).days < 125
    for name, df in full.items():
        got = grid.read_grid(spark, str(tmp_path), name).select(*df.columns)
        assert got.count() == df.count() and got.exceptAll(df).isEmpty() and df.exceptAll(got).isEmpty()
    kept = [f for f in old if f.exists()]
    assert kept and all(f.stat().st_mtime_ns == old[f] for f in kept)
    assert all(f.parent.name < f"month={since:%Y-%m}" for f in kept)


def test_supplier_sheets(spark, small_tables, tmp_path):
    sheet = R.QUERIES["replenishment_sheet"](spark, "/root/testdata/sf0.001")
    write_supplier_sheets(sheet, str(tmp_path / "sheets"))
    dirs = [d for d in os.listdir(tmp_path / "sheets") if d.startswith("safe_supplier=")]
    n = sheet.select("supplier_name").distinct().count()
    assert len(dirs) == n


def test_suppliers_with_long_alike_names_get_sheets_of_their_own(spark, tmp_path):
    names = ["SRI LAKSHMI VENKATESWARA TRADING COMPANY BELLARY", "SRI LAKSHMI VENKATESWARA TRADING COMPANY HOSPET", "A/B", "A-B", "A:B", "Café Ünlü", None]
    sheet = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "supplier_name string, line int")
    write_supplier_sheets(sheet, str(tmp_path / "s"))
    assert len([d for d in os.listdir(tmp_path / "s") if d.startswith("safe_supplier=")]) == len(names)


def test_months_are_written_without_a_sort_and_more_months_than_open_files(spark, tmp_path):
    import datetime as dt
    from basketry.plans import grid
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    rows = spark.range(900).select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("date"), F.col("id").alias("v")).repartition(3, "v")
    grid.write_months({"t": rows}, str(tmp_path))
    assert grid.read_grid(spark, str(tmp_path), "t").select("date", "v").exceptAll(rows).isEmpty() and spark.conf.get(key) == before
    assert len(list((tmp_path / "t").glob("month=*"))) == 30 > grid.OPEN_MONTHS
    with grid.unsorted_months(spark):
        assert spark.conf.get(key) == str(grid.OPEN_MONTHS)
