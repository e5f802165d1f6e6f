"""The query registry: one entry per deliverable key.

Each entry is ``(spark, sf_dir) -> DataFrame`` over the raw-shaped fixture
views of that directory, with ``as_of`` fixed to the fixture's last day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import daily
from ..session import released, remove, saved, scratch
from ..sources import fixtures
from ..sources.fixtures import AS_OF, RetailTables
from . import grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str) -> RetailTables:
    return RetailTables(spark, sf_dir)


def _dss(t: RetailTables) -> DataFrame:
    return daily.daily_sales_summary(t.raw_sales_billwise, t.raw_sales_itemwise)


def _dps(t: RetailTables) -> DataFrame:
    return daily.daily_purchase_summary(t.raw_purchase_billwise, t.raw_purchase_itemwise)


@register("daily_sales_summary")
def q_daily_sales_summary(spark, sf_dir):
    return _dss(tables(spark, sf_dir))


@register("daily_purchase_summary")
def q_daily_purchase_summary(spark, sf_dir):
    return _dps(tables(spark, sf_dir))


@register("daily_payment_breakdown")
def q_daily_payment_breakdown(spark, sf_dir):
    return daily.daily_payment_breakdown(tables(spark, sf_dir).raw_sales_billwise)


@register("daily_payments_no_outliers")
def q_daily_payments_no_outliers(spark, sf_dir):
    pay = daily.daily_payment_breakdown(tables(spark, sf_dir).raw_sales_billwise)
    return daily.daily_payments_no_outliers(pay)


@register("daily_revenue_range")
def q_daily_revenue_range(spark, sf_dir):
    return daily.date_range(_dss(tables(spark, sf_dir)), "sale_date", as_of=AS_OF)


@register("daily_payments_range")
def q_daily_payments_range(spark, sf_dir):
    pay = daily.daily_payment_breakdown(tables(spark, sf_dir).raw_sales_billwise)
    return daily.date_range(pay, "sale_date", as_of=AS_OF)


@register("daily_purchases_range")
def q_daily_purchases_range(spark, sf_dir):
    return daily.date_range(_dps(tables(spark, sf_dir)), "purchase_date", as_of=AS_OF)


# ---------------------------------------------------------------- product x day
from ..operators import calendar as cal  # noqa: E402
from ..operators import product  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def _sold(t: RetailTables):
    """Product-day sales, undated ones too, built once per tables object."""
    if not hasattr(t, "_pd_sold"):
        t._pd_sold = product.sales_facts(t.raw_sales_itemwise, t.product_aliases)
    return t._pd_sold


def _facts(t: RetailTables):
    """Product-day sales and purchases, built once per tables object."""
    if not hasattr(t, "_pd_facts"):
        t._pd_facts = (_sold(t), product.purchase_facts(t.raw_purchase_itemwise, t.product_aliases))
    return t._pd_facts


def _sale_days(t: RetailTables):
    """First and last sale day, resolved once per tables object."""
    if not hasattr(t, "_first_last"):
        t._first_last = product.sale_days(t.raw_sales_billwise, _sold(t))
    return t._first_last


def _start(t: RetailTables):
    """Spine start bound as a literal."""
    return F.lit(_sale_days(t)[0])


def _runs(t: RetailTables, columns: list[str]):
    return product.grid_runs(_facts(t), _start(t), AS_OF, columns=columns)


def _calendar(t: RetailTables):
    return cal.calendar_dim(t.spark, _start(t), F.lit(AS_OF), t.festivals, t.holidays)


def _latest(t: RetailTables):
    return product.latest_state(_facts(t), _start(t), AS_OF)


@register("product_daily_sparse")
def q_product_daily_sparse(spark, sf_dir):
    t = tables(spark, sf_dir)
    return product.product_daily_sparse(t.raw_sales_itemwise, t.raw_purchase_itemwise, t.product_aliases)


@register("product_daily_metrics")
def q_product_daily_metrics(spark, sf_dir):
    return product.days_of(product.product_daily_metrics(_runs(tables(spark, sf_dir), product.METRICS_NEED)))


@register("product_daily_features")
def q_product_daily_features(spark, sf_dir):
    t = tables(spark, sf_dir)
    return product.product_daily_features(_runs(t, product.FEATURES_NEED), _calendar(t))


@register("product_health_signals")
def q_product_health_signals(spark, sf_dir):
    return product.days_of(product.product_health_signals(_runs(tables(spark, sf_dir), product.SIGNALS_NEED)))


@register("product_stock_position")
def q_product_stock_position(spark, sf_dir):
    return product.days_of(product.product_stock_position(_runs(tables(spark, sf_dir), product.STOCK_NEED)))


@register("rebuild_recent")
def q_rebuild_recent(spark, sf_dir):
    """The grid tables of some months before the last day as an earlier run left them, the last 90 days made again: all of them, side by side."""
    t = tables(spark, sf_dir)
    folder, earlier = scratch(spark, "grid"), AS_OF - dt.timedelta(days=25)
    since = grid.rebuild_recent(spark, _facts(t), _start(t), folder, earlier, 130, _calendar(t))
    grid.rebuild_recent(spark, _facts(t), _start(t), folder, AS_OF, 90, _calendar(t))
    metrics, features, signals, stock = (grid.read_grid(spark, folder, n, since) for n in (
        "product_daily_metrics", "product_daily_features", "product_health_signals", "product_stock_position"))
    key = ["date", "product_id"]
    return (metrics.join(features.drop("quantity_sold", "revenue", "purchase_quantity"), key)
            .join(signals.drop("last_7_day_avg", "last_30_day_avg", "last_60_day_avg"), key).join(stock, key))


@register("calendar_dim")
def q_calendar_dim(spark, sf_dir):
    return _calendar(tables(spark, sf_dir))


# ---------------------------------------------------------------- dims, restock, sheets
from ..operators import dims, restock  # noqa: E402


def _lic(t):
    return t.lic if hasattr(t, "lic") else dims.latest_item_combinations(t.raw_item_combinations)


def _loc(t):
    return dims.supplier_location(t.raw_supplier_master)


def _psm(t):
    return t.psm if hasattr(t, "psm") else dims.product_supplier_mapping(t.raw_purchase_itemwise)


def _pdim(t):
    return t.pdim if hasattr(t, "pdim") else dims.product_dimension(t.raw_item_combinations, t.raw_sales_itemwise, t.product_aliases, t.products)


def _restock(t, latest=None):
    return restock.restock_recommendations(latest if latest is not None else _latest(t), _psm(t), _loc(t), _pdim(t))


def _built(t: RetailTables, items: bool = True) -> RetailTables:
    """The derived tables that pages read several times, built once for this query (as ``rebuild`` does for all).

    ``items``: the newest item-master rows too, which some pages do not read.
    """
    t.latest, t.psm, t.pdim = saved(_latest(t), "latest"), saved(_psm(t), "psm"), saved(_pdim(t), "pdim")
    if items:
        t.lic = saved(_lic(t), "lic")
    return t


@register("latest_item_combinations")
def q_latest_item_combinations(spark, sf_dir):
    return _lic(tables(spark, sf_dir))


@register("supplier_location")
def q_supplier_location(spark, sf_dir):
    return _loc(tables(spark, sf_dir))


@register("product_supplier_mapping")
def q_product_supplier_mapping(spark, sf_dir):
    return _psm(tables(spark, sf_dir))


@register("product_dimension")
def q_product_dimension(spark, sf_dir):
    return _pdim(tables(spark, sf_dir))


@register("restock_recommendations")
def q_restock_recommendations(spark, sf_dir):
    return _restock(tables(spark, sf_dir))


@register("replenishment_sheet")
def q_replenishment_sheet(spark, sf_dir):
    t = tables(spark, sf_dir)
    return restock.replenishment_sheet(_latest(t), _pdim(t), _psm(t), _loc(t), _lic(t))


@register("conversion_attention_sheet")
def q_conversion_attention_sheet(spark, sf_dir):
    t = tables(spark, sf_dir)
    return restock.conversion_attention_sheet(_latest(t), _pdim(t), _psm(t), _lic(t))


@register("supplier_purchase_sheet")
def q_supplier_purchase_sheet(spark, sf_dir):
    t = _built(tables(spark, sf_dir))
    return restock.supplier_purchase_sheet(_restock(t, t.latest), t.latest, t.pdim, t.lic, t.psm, _loc(t))


# ---------------------------------------------------------------- customers, baskets, recon
from ..operators import baskets, customers, recon  # noqa: E402


@register("customer_dimension")
def q_customer_dimension(spark, sf_dir):
    return customers.customer_dimension(tables(spark, sf_dir).raw_sales_billwise)


@register("customer_metrics")
def q_customer_metrics(spark, sf_dir):
    return customers.customer_metrics(tables(spark, sf_dir).raw_sales_billwise, AS_OF)


@register("product_associations")
def q_product_associations(spark, sf_dir):
    """Brand-level baskets, min_co = 5 (part level is too sparse at small SF)."""
    t = tables(spark, sf_dir)
    return baskets.product_associations(t.raw_sales_itemwise, None, min_co=5, item_col="brand_raw")


def _assoc_part(t):
    return baskets.product_associations(t.raw_sales_itemwise, t.product_aliases, min_co=2, item_col="barcode")


@register("product_associations_part")
def q_product_associations_part(spark, sf_dir):
    return _assoc_part(tables(spark, sf_dir))


@register("bought_together")
def q_bought_together(spark, sf_dir):
    t = tables(spark, sf_dir)
    return baskets.bought_together(_assoc_part(t), _pdim(t), t.products, _lic(t), k=5)


@register("recon_sales_bill_vs_item")
def q_recon_sales(spark, sf_dir):
    t = tables(spark, sf_dir)
    return recon.recon_sales_bill_vs_item(t.raw_sales_billwise, t.raw_sales_itemwise)


@register("recon_sales_discrepancies")
def q_recon_sales_discrepancies(spark, sf_dir):
    t = tables(spark, sf_dir)
    return recon.recon_sales_bill_vs_item(t.raw_sales_billwise, t.raw_sales_itemwise, only_discrepancies=True)


@register("recon_purchase_bill_vs_item")
def q_recon_purchase(spark, sf_dir):
    t = tables(spark, sf_dir)
    return recon.recon_purchase_bill_vs_item(t.raw_purchase_billwise, t.raw_purchase_itemwise)


@register("recon_daily_quantity_flow")
def q_recon_flow(spark, sf_dir):
    t = tables(spark, sf_dir)
    return recon.recon_daily_quantity_flow(t.raw_purchase_itemwise, t.raw_sales_itemwise)


# ---------------------------------------------------------------- reports
import datetime as _dt  # noqa: E402

from ..operators import pages, reports  # noqa: E402


def _cdim(t):
    return customers.customer_dimension(t.raw_sales_billwise)


def _cmet(t):
    return customers.customer_metrics(t.raw_sales_billwise, AS_OF)


@register("kpi_summary")
def q_kpi_summary(spark, sf_dir):
    t = _built(tables(spark, sf_dir), items=False)
    dss, dps, cdim, cmet = (saved(df, "daily") for df in (_dss(t), _dps(t), _cdim(t), _cmet(t)))
    rec = saved(restock.restock_recommendations(t.latest, t.psm, _loc(t), t.pdim), "restock")
    return reports.kpi_summary(dss, dps, t.latest, rec, cdim, cmet, AS_OF)


@register("health_signals_page")
def q_health_signals_page(spark, sf_dir):
    t = _built(tables(spark, sf_dir), items=False)
    return reports.health_signals_page(t.latest, t.pdim, t.psm)


@register("health_signals_middle_page")
def q_health_signals_middle_page(spark, sf_dir):
    """50 rows from the middle of the list, by its page index."""
    t = _built(tables(spark, sf_dir), items=False)
    index = pages.PageIndex(reports.health_signals_page(t.latest, t.pdim, t.psm, limit=None), reports.health_order())
    return index.page(50, index.total // 2)


@register("health_report")
def q_health_report(spark, sf_dir):
    t = _built(tables(spark, sf_dir), items=False)
    return reports.health_report(t.latest, t.pdim, t.psm)


@register("supplier_report")
def q_supplier_report(spark, sf_dir):
    t = _built(tables(spark, sf_dir))
    return reports.supplier_report(t.latest, t.psm, t.pdim, t.lic)


@register("replenishment_page")
def q_replenishment_page(spark, sf_dir):
    return reports.replenishment_page(saved(_restock(tables(spark, sf_dir)), "restock"))


@register("replenishment_every_page")
def q_replenishment_every_page(spark, sf_dir):
    """The whole replenishment list with rank and page of 100 rows, by its page index."""
    rows = reports.replenishment_page(saved(_restock(tables(spark, sf_dir)), "restock"), limit=None)
    return pages.PageIndex(rows, reports.replenishment_order()).ranked(100)


@register("supplier_restock_pages")
def q_supplier_restock_pages(spark, sf_dir):
    """Every page of every supplier, without a limit; ``limit`` and ``offset`` ask for one page."""
    return reports.supplier_restock_pages(saved(_restock(tables(spark, sf_dir)), "restock"))


@register("supplier_restock_second_page")
def q_supplier_restock_second_page(spark, sf_dir):
    return reports.supplier_restock_pages(saved(_restock(tables(spark, sf_dir)), "restock"), limit=10, offset=10)


@register("top_products")
def q_top_products(spark, sf_dir):
    t = tables(spark, sf_dir)
    sales = product.known_sales(_sold(t))
    return reports.top_products(sales, _pdim(t), AS_OF, _start(t))


@register("top_products_by_qty")
def q_top_products_by_qty(spark, sf_dir):
    t = tables(spark, sf_dir)
    sales = product.known_sales(_sold(t))
    return reports.top_products(sales, _pdim(t), AS_OF, _start(t), sort_by="qty")


@register("demand_trend")
def q_demand_trend(spark, sf_dir):
    """Every product's last 60 days; the grid is truncated to 60 + 59 days of history."""
    t = tables(spark, sf_dir)
    start = _start(t)
    win = product.grid_windows(_facts(t), start, AS_OF, grid_from=AS_OF - _dt.timedelta(days=60 + 59))
    last_sale = F.lit(_sale_days(t)[1] or AS_OF - _dt.timedelta(days=1))
    return reports.demand_trend(win, AS_OF, last_sale)


@register("supplier_list")
def q_supplier_list(spark, sf_dir):
    t = tables(spark, sf_dir)
    return reports.supplier_list(_psm(t), _loc(t))


@register("product_search")
def q_product_search(spark, sf_dir):
    t = tables(spark, sf_dir)
    return reports.product_search(_pdim(t), t.products, _lic(t), q="ring")


@register("product_list")
def q_product_list(spark, sf_dir):
    t = tables(spark, sf_dir)
    return reports.product_list(_pdim(t), t.products)


@register("product_detail")
def q_product_detail(spark, sf_dir):
    t = tables(spark, sf_dir)
    _built(t)
    return reports.product_detail(t.pdim, t.products, t.lic, t.psm, t.latest)


@register("customer_list")
def q_customer_list(spark, sf_dir):
    t = tables(spark, sf_dir)
    return reports.customer_list(_cdim(t), _cmet(t))


@register("customer_every_page")
def q_customer_every_page(spark, sf_dir):
    """All identified customers by bills, with rank and page of 50 rows, by the page index."""
    t = tables(spark, sf_dir)
    rows = reports.customer_list(_cdim(t), _cmet(t), sort_by="total_bills", limit=None)
    return pages.PageIndex(rows, reports.customer_order("total_bills")).ranked(50).drop("m_total_bills")


@register("product_last_page")
def q_product_last_page(spark, sf_dir):
    """The last, short page of the catalog, by its page index."""
    t = tables(spark, sf_dir)
    index = pages.PageIndex(reports.product_list(_pdim(t), t.products, limit=None), reports.catalog_order())
    return index.page(50, max(0, index.total - 1) // 50 * 50)


@register("customer_summary")
def q_customer_summary(spark, sf_dir):
    t = tables(spark, sf_dir)
    return reports.customer_summary(_cdim(t), _cmet(t), AS_OF)


@register("customer_history")
def q_customer_history(spark, sf_dir):
    """All bills of each customer, ranked; ``limit`` asks for the newest ones."""
    return reports.customer_history(tables(spark, sf_dir).raw_sales_billwise)


@register("data_freshness")
def q_data_freshness(spark, sf_dir):
    return reports.data_freshness(_dss(tables(spark, sf_dir)), AS_OF)


# ---------------------------------------------------------------- entity resolution, catalog, misc
from ..operators import cash, catalog, entity, offers  # noqa: E402
from ..sources import ingest  # noqa: E402


def _clusters(t):
    c = entity.candidates(t.raw_item_combinations, t.raw_sales_itemwise, t.product_aliases)
    return entity.name_clusters(c, t.products, entity.CLI_MIN_SCORE)


@register("name_clusters")
def q_name_clusters(spark, sf_dir):
    return _clusters(tables(spark, sf_dir))[0]


@register("name_blocks")
def q_name_blocks(spark, sf_dir):
    """The candidates with their normalised names and blocks."""
    t = tables(spark, sf_dir)
    return entity.blocked(entity.candidates(t.raw_item_combinations, t.raw_sales_itemwise, t.product_aliases))


@register("merge_suggestions")
def q_merge_suggestions(spark, sf_dir):
    clusters, edges = _clusters(tables(spark, sf_dir))
    return entity.merge_suggestions(clusters, edges)


@register("suggestion_clusters")
def q_suggestion_clusters(spark, sf_dir):
    clusters, edges = _clusters(tables(spark, sf_dir))
    return entity.suggestion_clusters(saved(entity.merge_suggestions(clusters, edges), "suggestions"))


@register("suggestion_members")
def q_suggestion_members(spark, sf_dir):
    """The second page of five clusters, with its members."""
    clusters, edges = _clusters(tables(spark, sf_dir))
    s = saved(entity.merge_suggestions(clusters, edges), "suggestions")
    return entity.suggestion_members(s, entity.suggestion_clusters(s, limit=5, offset=5))


@register("alias_violations")
def q_alias_violations(spark, sf_dir):
    """The confirmed aliases with some chains among them."""
    return entity.alias_violations(tables(spark, sf_dir).chained_aliases)


@register("alias_list")
def q_alias_list(spark, sf_dir):
    t = tables(spark, sf_dir)
    return entity.alias_list(t.product_aliases, t.products)


@register("entity_product_facts")
def q_entity_product_facts(spark, sf_dir):
    t = tables(spark, sf_dir)
    return entity.entity_product_facts(t.raw_item_combinations, t.raw_sales_itemwise)


@register("canonical_products")
def q_canonical_products(spark, sf_dir):
    t = tables(spark, sf_dir)
    return catalog.canonical_products(t.raw_item_combinations, t.products)


@register("product_categories")
def q_product_categories(spark, sf_dir):
    """Canonical products but for the title, which SQL cannot case."""
    t = tables(spark, sf_dir)
    return catalog.canonical_products(t.raw_item_combinations, t.products).drop("canonical_name")


@register("cash_closure")
def q_cash_closure(spark, sf_dir):
    return cash.cash_closure_totals(fixtures.closures_from_events(tables(spark, sf_dir).base("events")))


@register("offer_pricing")
def q_offer_pricing(spark, sf_dir):
    return offers.offer_pricing(fixtures.offer_sheet(tables(spark, sf_dir)))


@register("filter_query")
def q_filter_query(spark, sf_dir):
    spec = {"filters": [{"field": "operator_name", "operator": "in", "value": ["1-URGENT", "2-HIGH"]},
                        {"field": "net_total", "operator": "gte", "value": 100000}],
            "condition": "and", "sort": {"net_total": -1}}
    out = offers.filter_query(tables(spark, sf_dir).raw_sales_billwise, spec)
    return out.select("bill_no", "bill_datetime_raw", "operator_name", F.col("net_total").cast("double"))


FILTER_SPECS = {
    "eq": [("operator_name", "eq", "3-MEDIUM")], "ne": [("operator_name", "ne", "3-MEDIUM")], "gt": [("net_total", "gt", 150000)],
    "gte": [("net_total", "gte", 150000)], "lt": [("net_total", "lt", 50000)], "lte": [("net_total", "lte", 50000)],
    "like": [("customer_name_raw", "like", "Customer#00000000%")], "ilike": [("customer_name_raw", "ilike", "%CUSTOMER#000000_1%")],
    "in": [("operator_name", "in", ["1-URGENT", "5-LOW"])], "or": [("net_total", "gt", 300000), ("operator_name", "eq", "2-HIGH")],
    "and": [("net_total", "gt", 300000), ("operator_name", "eq", "2-HIGH")],
}


@register("filter_operators")
def q_filter_operators(spark, sf_dir):
    """Every operator and both conditions."""
    bills = tables(spark, sf_dir).raw_sales_billwise
    out = None
    for name, filters in FILTER_SPECS.items():
        spec = {"filters": [{"field": f, "operator": o, "value": v} for f, o, v in filters], "condition": "or" if name == "or" else "and"}
        rows = offers.filter_query(bills, spec).select(F.lit(name).alias("operator"), "bill_no", "operator_name", F.col("net_total").cast("double"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("load_dedup")
def q_load_dedup(spark, sf_dir):
    """Re-delivered export: everything loaded before 1998 is already in the table."""
    items = tables(spark, sf_dir).raw_sales_itemwise
    existing = items.filter(F.col("imported_at") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    fresh = ingest.load_dedup(existing, items, ["bill_no", "barcode"], "line_no")
    return fresh.select("bill_no", "barcode", "line_no", F.col("sale_qty").cast("double"))


@register("upsert")
def q_upsert(spark, sf_dir):
    im = tables(spark, sf_dir).raw_item_combinations
    cols = ["barcode", "item_name_raw", "mrp", "import_batch_id", "imported_at"]
    out = ingest.upsert(im.filter("import_batch_id = 1").select(*cols), im.filter("import_batch_id = 2").select(*cols),
                        ["barcode"], "imported_at")
    return out.select("barcode", "item_name_raw", F.col("mrp").cast("double"), "import_batch_id")


# ---------------------------------------------------------------- files, ingest, streaming
from ..sources import sinks  # noqa: E402
from ..streaming import jobs as stream_jobs  # noqa: E402


def _bill_exports(t: RetailTables, broken: bool = False) -> str:
    return fixtures.export_bills(t, scratch(t.spark, "exports"), broken)


def _bill_columns() -> list:
    """Every column of the report, numbers as DOUBLE."""
    return [F.col(c).cast("double").alias(c) if c in ingest.NUMERIC["sales_billwise"] else F.col(c)
            for c in ingest.HEADER_MAP["sales_billwise"].values()]


@register("ingest_report")
def q_ingest_report(spark, sf_dir):
    """All 79 columns, from files with three header orders, an NBSP header and a missing optional column."""
    folder = _bill_exports(tables(spark, sf_dir))
    rows, _quarantine, _files = ingest.read_report(spark, f"{folder}/*/*/*.csv", "sales_billwise", batch_id=1)
    return rows.select(*_bill_columns(), "import_batch_id")


def _raw_columns(report: str) -> list:
    return [F.col(c).cast("double").alias(c) if c in ingest.NUMERIC[report] else F.col(c) for c in ingest.HEADER_MAP[report].values()]


def _exported(t: RetailTables, report: str) -> str:
    with released():
        return fixtures.write_export(fixtures.export_cells(t, report), report, scratch(t.spark, report))


def _register_ingest(report: str) -> None:
    @register(f"ingest_{report}")
    def q(spark, sf_dir):
        """All columns of the report, from several files with line breaks, quotes and broken numbers in their cells."""
        folder = _exported(tables(spark, sf_dir), report)
        rows = ingest.read_report(spark, f"{folder}/*", report)[0].select(*_raw_columns(report))
        remove(spark, folder)  # its lines are staged
        return rows


for _report in ("sales_itemwise", "purchase_itemwise", "purchase_billwise", "supplier_master", "item_combinations"):
    _register_ingest(_report)


@register("ingest_quarantine")
def q_ingest_quarantine(spark, sf_dir):
    """Rows kept aside with a number that is none, or that would have to be rounded, by report and reason."""
    t = tables(spark, sf_dir)
    out = None
    for report in ("sales_itemwise", "purchase_itemwise", "purchase_billwise"):
        path, folder = scratch(spark, "quarantine"), _exported(t, report)
        with released():  # one report's lines at a time
            bad = ingest.read_report(spark, f"{folder}/*", report)[1]
            remove(spark, folder)
            n = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(report).alias("report"), "reason", "rows")
            n.write.parquet(path)
        n = spark.read.schema(n.schema).parquet(path)
        out = n if out is None else out.unionByName(n)
    return out


def _slice(path: str = "file_name"):
    return F.regexp_extract(path, r"_slice=(\d+)", 1).cast("long").alias("slice")


@register("ingest_manifest")
def q_ingest_manifest(spark, sf_dir):
    """A ledger that has the files of the first header order: the other files are new."""
    folder = _bill_exports(tables(spark, sf_dir))
    done = ingest.file_manifest(spark, f"{folder}/order=0/*/*.csv", None, "sales_billwise").select("file_hash")
    m = ingest.file_manifest(spark, f"{folder}/*/*/*.csv", done, "sales_billwise")
    return m.select(_slice(), "report_type", "is_new")


@register("ingest_ledger")
def q_ingest_ledger(spark, sf_dir):
    """Three runs of the chain: some files, all files (one of them no such report), all files again."""
    folder = _bill_exports(tables(spark, sf_dir), broken=True)
    table, ledger = scratch(spark, "raw-bills"), scratch(spark, "ledger")
    runs = []
    for batch, paths in ((1, f"{folder}/order=0/*/*.csv"), (2, f"{folder}/*/*/*.csv"), (3, f"{folder}/*/*/*.csv")):
        entries = ingest.ingest_batch(spark, paths, "sales_billwise", table, ledger, batch)
        runs.append(entries.select(F.col("id").alias("batch"), _slice(), "report_type", "row_count", "status", "error_message"))
    loaded = (spark.read.option("basePath", table).parquet(table)
              .groupBy(F.col("import_batch_id").cast("long").alias("batch"), _slice("source_file_name")).agg(F.count(F.lit(1)).alias("loaded")))
    log = runs[0].unionByName(runs[1]).unionByName(runs[2])
    return log.join(loaded, ["batch", "slice"], "left").withColumn("loaded", F.coalesce("loaded", F.lit(0)))


@register("quarantine_counts")
def q_quarantine_counts(spark, sf_dir):
    return ingest.quarantine_counts(*fixtures.dirty_tables(tables(spark, sf_dir)))


@register("latest_file")
def q_latest_file(spark, sf_dir):
    """Routed exports, and how many of them are the newest of their report."""
    folder = _bill_exports(tables(spark, sf_dir))
    files = ingest.file_manifest(spark, f"{folder}/*/*/*.csv", None, "sales_billwise")
    named = files.withColumn("_name", F.concat(F.lit("/drop/Sales-Billwise "), _slice(), F.lit(".csv")))
    routed = ingest.route_files(named.drop("report_type"), "_name")
    newest = ingest.latest_file(routed).select("file_name", F.lit(1).alias("newest"))
    return (routed.join(newest, "file_name", "left").groupBy("report_type")
            .agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("newest", F.lit(0))).cast("long").alias("newest")))


@register("latest_exports")
def q_latest_exports(spark, sf_dir):
    """The newest dropped file of each report, ties to the later name."""
    files = ingest.route_files(fixtures.file_listing(tables(spark, sf_dir)))
    return ingest.latest_file(files.where(F.col("report_type").isNotNull()))


def _read_back(spark, path: str, schema, drop: tuple[str, ...] = ()) -> DataFrame:
    """A written CSV export with the types that its table had."""
    names = [f.name for f in schema]
    back = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in [*names, *drop])).csv(path)
    return back.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def _register_csv(key: str, build, write, blank: tuple[str, ...] = ()) -> None:
    @register(key)
    def q(spark, sf_dir):
        """The export as written, read back cell by cell."""
        df, path = build(_built(tables(spark, sf_dir))), scratch(spark, key)
        write(df, path)
        return _read_back(spark, path, df.schema, blank)


_register_csv("csv_health_report", lambda t: reports.health_report(t.latest, t.pdim, t.psm), sinks.export_csv)
_register_csv("csv_supplier_report", lambda t: reports.supplier_report(t.latest, t.psm, t.pdim, t.lic), sinks.export_csv)
_register_csv("csv_conversion_sheet", lambda t: restock.conversion_attention_sheet(t.latest, t.pdim, t.psm, t.lic), sinks.write_conversion_sheet,
              ("physical_stock", "order_qty"))


@register("supplier_sheet_lines")
def q_supplier_sheet_lines(spark, sf_dir):
    """The lines of all order sheets, read back from the suppliers' folders."""
    t = _built(tables(spark, sf_dir))
    sheet = restock.supplier_purchase_sheet(_restock(t, t.latest), t.latest, t.pdim, t.lic, t.psm, _loc(t))
    path = scratch(spark, "sheet-lines")
    sinks.write_supplier_sheets(sheet, path)
    return _read_back(spark, f"{path}/*", sheet.schema, ("physical_stock", "order_qty"))


@register("supplier_sheets")
def q_supplier_sheets(spark, sf_dir):
    """The order sheets as written, one folder per supplier, read back."""
    t = _built(tables(spark, sf_dir))
    sheet = restock.supplier_purchase_sheet(_restock(t, t.latest), t.latest, t.pdim, t.lic, t.psm, _loc(t))
    path = scratch(spark, "sheets")
    sinks.write_supplier_sheets(sheet, path)
    back = spark.read.option("header", True).option("basePath", path).csv(f"{path}/*")
    return back.groupBy("supplier_name").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("safe_supplier").alias("folders"),
        F.count_if(F.col("physical_stock").isNull() & F.col("order_qty").isNull()).alias("blank"))


@register("csv_exports")
def q_csv_exports(spark, sf_dir):
    """Three CSV reports, written and read back: rows of each."""
    t = _built(tables(spark, sf_dir))
    out = None
    for name, df, write in (
            ("health_report", reports.health_report(t.latest, t.pdim, t.psm), sinks.export_csv),
            ("supplier_report", reports.supplier_report(t.latest, t.psm, t.pdim, t.lic), sinks.export_csv),
            ("conversion_sheet", restock.conversion_attention_sheet(t.latest, t.pdim, t.psm, t.lic), sinks.write_conversion_sheet)):
        path = scratch(spark, name)
        write(df, path)
        n = (spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in df.columns)).option("enforceSchema", True)
             .csv(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("report"), "rows"))
        out = n if out is None else out.unionByName(n)
    return out


@register("bulk_categorize")
def q_bulk_categorize(spark, sf_dir):
    """Every fifth part is listed; parts that are no product are skipped."""
    t = tables(spark, sf_dir)
    listed = t.base("part").where("p_partkey % 5 = 0").select(F.col("p_partkey").cast("string").alias("barcode"))
    out, counts = catalog.bulk_categorize(t.products, listed, category="Spices")
    return (out.groupBy("category").agg(F.count(F.lit(1)).alias("products"), F.count_if("is_reviewed").alias("reviewed"))
            .crossJoin(F.broadcast(counts)))  # counts is one row


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """The exports dropped in a folder, ingested by a file stream, several micro-batches."""
    src, target = _bill_exports(tables(spark, sf_dir)), scratch(spark, "raw")
    stream_jobs.stream_ingest(spark, f"{src}/*/*", "sales_billwise", target, scratch(spark, "ck"), files_per_batch=9).awaitTermination()
    return spark.read.option("basePath", target).parquet(target).select(*_bill_columns())


@register("stream_recomputed_days")
def q_stream_recomputed_days(spark, sf_dir):
    """After each micro-batch the days that it touches are recomputed from the raw table."""
    src, target, days = _bill_exports(tables(spark, sf_dir)), scratch(spark, "raw"), scratch(spark, "days")
    step = stream_jobs.recompute_days(target, days, stream_jobs.daily_sales)
    stream_jobs.stream_ingest(spark, f"{src}/*/*", "sales_billwise", target, scratch(spark, "ck"), after=step, files_per_batch=9,
                              day=stream_jobs.export_date("bill_datetime_raw")).awaitTermination()
    return stream_jobs.current_days(spark, days)


def _snapshot_stream(t: RetailTables, report: str, key: str, columns: list[str]) -> DataFrame:
    """Both deliveries of a master report dropped one after the other, its newest rows kept by a stream."""
    spark = t.spark
    drop, state, target, ck = (scratch(spark, n) for n in ("drop", "state", "raw", "ck"))
    cells = fixtures.export_cells(t, report)
    for batch in (1, 2):
        fixtures.write_export(cells.where(F.col("import_batch_id") == batch), report, drop)
        stream_jobs.stream_ingest(spark, f"{drop}/*", report, target, ck, after=stream_jobs.keep_latest(state, key, columns)).awaitTermination()
    now = stream_jobs.current(spark, state, key)
    return now.withColumn("imported_at", F.current_timestamp()).withColumn("import_batch_id", F.lit(0).cast("long"))


@register("stream_supplier_location")
def q_stream_supplier_location(spark, sf_dir):
    """Equal to the batch table."""
    return dims.supplier_location(_snapshot_stream(tables(spark, sf_dir), "supplier_master", "supplier_name_raw", ["city_raw"]))


@register("stream_item_master")
def q_stream_item_master(spark, sf_dir):
    """Equal to the batch table."""
    columns = ["purchase_price", "rate", "mrp", "expiry_date_raw", "hsn_code", "system_stock_snapshot"]
    return dims.latest_item_combinations(_snapshot_stream(tables(spark, sf_dir), "item_combinations", "barcode", columns))


def _bill_stream(spark, sf_dir, daily):
    """Bills dealt over many files without any order in time, a few files a micro-batch."""
    t = tables(spark, sf_dir)
    src = scratch(spark, "bills")
    bills = t.raw_sales_billwise.drop("imported_at")
    n = max(12, bills.count() // 100_000)
    bills.repartition(n, "bill_no").write.parquet(src)
    return stream_jobs.run_daily_stream(spark, src, bills.schema, scratch(spark, "daily"), scratch(spark, "ck"), daily, files_per_batch=-(-n // 4))


@register("stream_daily_sales")
def q_stream_daily_sales(spark, sf_dir):
    """T4: daily bills and revenue maintained by a stream (equals the batch result)."""
    return _bill_stream(spark, sf_dir, stream_jobs.daily_sales)


@register("stream_daily_payments")
def q_stream_daily_payments(spark, sf_dir):
    """T4: daily payments maintained by a stream (equals the batch result)."""
    return _bill_stream(spark, sf_dir, daily.daily_payment_breakdown)
