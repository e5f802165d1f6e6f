"""Page filters and bulk categorisation."""

from pyspark.sql import functions as F

from basketry.operators import catalog, pages, reports
from basketry.plans import registry as R
from basketry.session import saved


def test_health_page_flag_and_search(spark, small_tables):
    t = small_tables
    latest, pdim, psm = R._latest(t), R._pdim(t), R._psm(t)
    fast = reports.health_signals_page(latest, pdim, psm, flag="fast", limit=500)
    rows = fast.collect()
    assert all(r.fast_moving_flag for r in rows)
    assert len(rows) == latest.filter("fast_moving_flag").count() == (rows[0].total if rows else 0)
    hit = reports.health_signals_page(latest, pdim, psm, search="ring", limit=500).collect()
    assert all("ring" in (r.product_name or "").lower() or "ring" in r.product_id for r in hit)
    page2 = reports.health_signals_page(latest, pdim, psm, limit=5, offset=5).collect()
    page1 = reports.health_signals_page(latest, pdim, psm, limit=10).collect()
    assert [r.product_id for r in page2] == [r.product_id for r in page1[5:10]]


def test_bulk_categorize(spark):
    products = spark.createDataFrame([("1", "A", "retail", False), ("2", "B", "retail", False)],
                                     "barcode string, category string, product_type string, is_reviewed boolean")
    edits = spark.createDataFrame([("2",), ("9",)], "barcode string")
    edits = edits.unionAll(edits)  # a barcode listed twice counts once
    out, counts = catalog.bulk_categorize(products, edits, category="Snacks")
    out = {r.barcode: r for r in out.collect()}
    assert out["2"].category == "Snacks" and out["2"].is_reviewed
    assert out["1"].category == "A" and not out["1"].is_reviewed
    assert tuple(counts.first()) == (1, 1)


def test_restock_pages_reach_every_row(spark, small_tables):
    t = small_tables
    rec = saved(R._restock(t), "restock")
    every = reports.supplier_restock_pages(rec).collect()
    pages = [reports.supplier_restock_pages(rec, limit=3, offset=o).collect() for o in range(0, max(r.total for r in every), 3)]
    key = lambda r: (r.supplier_name, r["rank"])
    assert sorted(map(key, (r for p in pages for r in p))) == sorted(map(key, every))


def test_page_index_equals_the_sorted_list(spark):
    """Every page over many ranges, with a hot value, nulls and a page size that does not fit the ranges; past the end none."""
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7.0D WHEN id % 50 = 1 THEN NULL ELSE CAST((id * 7919) % 1009 AS DOUBLE) END AS v")
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    want = [r.id for r in rows.orderBy(*order).collect()]
    index = pages.PageIndex(rows, order, parts=16)
    assert index.total == 5000 and len(index.ranges) == 16
    assert max(b - a for _, a, b in index.ranges) < 1000  # the hot value is in several ranges
    for limit, offset in ((37, 0), (37, 300), (700, 1234), (50, 4980), (5000, 0), (10, 5000), (0, 10)):
        got = index.page(limit, offset).collect()
        assert [r.id for r in got] == want[offset:offset + limit] and all(r.total == 5000 for r in got)
    assert {r.id: (r["rank"], r.page) for r in index.ranked(37).collect()} == {i: (k + 1, k // 37 + 1) for k, i in enumerate(want)}
    index.release()


def test_page_index_reads_only_the_ranges_of_a_page(spark):
    rows = spark.range(4000).withColumn("v", F.col("id") % 97)
    index = pages.PageIndex(rows, [F.col("v"), F.col("id")], parts=8)
    part, before, _ = index.ranges[5]
    df = index.page(10, before + 3)
    assert [r.v for r in df.collect()] == [r.v for r in rows.orderBy("v", "id").offset(before + 3).limit(10).collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan and f"(_part#" in plan
    assert {f.split("_part=")[1].split("/")[0] for f in index.rows.where(F.col("_part") == part).inputFiles()} >= {str(part)}
    assert "RangePartitioning" not in plan and "rangepartitioning" not in plan


def test_page_index_of_nothing_and_of_equal_rows(spark):
    none = pages.PageIndex(spark.createDataFrame([], "id long, v double"), [F.col("v"), F.col("id")])
    assert none.total == 0 and none.page(10).count() == 0 and none.ranked(10).count() == 0
    same = pages.PageIndex(spark.range(300).selectExpr("1 AS v"), [F.col("v")], parts=4)
    assert same.total == 300 and same.page(50, 280).count() == 20
    assert sorted(r["rank"] for r in same.ranked(50).collect()) == list(range(1, 301))


def test_sheets_build_the_dimension_once_and_count_names_by_hash(spark, monkeypatch):
    from basketry.operators import dims
    from basketry.plans import registry as R
    calls, make = [], dims.product_dimension
    monkeypatch.setattr(dims, "product_dimension", lambda *a: calls.append(1) or make(*a))
    for key in ("supplier_sheets", "supplier_sheet_lines", "csv_exports"):
        del calls[:]
        R.QUERIES[key](spark, "/root/testdata/sf0.001")
        assert len(calls) == 1, key
    rows = [("a", "x", 1, 5), ("a", "y", 1, 5), ("a", "z", 2, None), ("a", "x", 1, 3), (None, "n", 1, 1), ("b", "q", None, 1)]
    named = spark.createDataFrame(rows, "barcode string, item_name_raw string, import_batch_id long, imported_at int")
    names = dims.distinct_names(named)
    assert names.count() == 5
    assert "SortAggregate" not in names._jdf.queryExecution().executedPlan().toString()
    newest = lambda df: {tuple(r) for r in dims.latest_by(df, "barcode", ["imported_at", "import_batch_id", "item_name_raw"], ["item_name_raw"], "barcode").collect()}
    assert newest(names) == newest(named) == {("a", "y"), (None, "n"), ("b", "q")}
