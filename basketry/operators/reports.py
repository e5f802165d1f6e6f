"""Dashboard reports, pages and exports as DataFrame functions.

Every report is ``(tables, params) -> DataFrame``. Scalars (latest date,
totals) are scalar subqueries; pages order globally with a key tie-break and
apply ``offset``/``limit`` (a bounded top-k); per-entity endpoints are also
offered in batch form (one ranked list per entity via a partitioned window).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..functions.cleaning import cash_amount, clean_mobile, export_timestamp, upi_amount, z, WALK_IN_KEY


def redecimal(c) -> Column:
    """A DOUBLE that holds an exact 4-place decimal, back to DECIMAL for exact re-summing."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(38,4)")


def exact_sum(c) -> Column:
    return F.sum(redecimal(c)).cast("double")


def signal_label(prefix: str = "") -> Column:
    """One label, precedence fast > slow > dead > spike > Normal."""
    c = lambda n: F.col(prefix + n)
    return (F.when(c("fast_moving_flag"), "Fast Moving").when(c("slow_moving_flag"), "Slow Moving")
            .when(c("dead_stock_flag"), "Dead Stock").when(c("demand_spike_flag"), "Demand Spike")
            .otherwise("Normal"))


def urgency_label(cover: Column, lead: Column) -> Column:
    """No Data / Urgent / Low / OK."""
    return (F.when(cover.isNull(), "No Data")
            .when(lead.isNotNull() & (lead != 0) & (cover < lead), "Urgent")
            .when(lead.isNotNull() & (lead != 0) & (cover < lead * F.lit(1.5)), "Low")
            .otherwise("OK"))


def supplier_list_str(mapping: DataFrame, sep: str) -> DataFrame:
    """Distinct suppliers per product, sorted, joined by ``sep`` (NULL if none)."""
    arr = F.array_sort(F.collect_set("supplier_name"))
    return mapping.groupBy("product_id").agg(
        F.when(F.size(arr) > 0, F.array_join(arr, sep)).alias("suppliers"))


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """``total`` (scalar subquery) + one ordered page; all rows, for a ``pages.PageIndex``, without a limit."""
    if limit is None:
        return df
    total = df.agg(F.count(F.lit(1))).scalar()
    out = df.withColumn("total", total).orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def kpi_summary(dss: DataFrame, dps: DataFrame, latest: DataFrame, restock: DataFrame,
                cdim: DataFrame, cmetrics: DataFrame, as_of: dt.date) -> DataFrame:
    """One row of dashboard KPIs.

    Each source is reduced by a single aggregate returning a struct scalar,
    so the row costs one small job per source table.
    """
    d = dss.agg(F.max("sale_date")).scalar()
    rev = dss.filter(F.col("sale_date") >= F.date_sub(d, 6)).agg(F.struct(
        exact_sum("total_revenue").alias("rev"), F.sum("total_bills").alias("bills"))).scalar()
    pur = dps.filter(F.col("purchase_date") >= F.date_sub(d, 6)).agg(F.struct(
        exact_sum("total_taxable_value").alias("purch"), F.sum("total_purchase_bills").alias("bills"),
        exact_sum(F.coalesce("total_due_amount", F.lit(0.0))).alias("credit"))).scalar()
    sig = latest.filter(F.col("date") == d).agg(F.struct(
        F.count_if("fast_moving_flag").alias("fast"), F.count_if("slow_moving_flag").alias("slow"),
        F.count_if("dead_stock_flag").alias("dead"), F.count_if("demand_spike_flag").alias("spike"))).scalar()
    reorder = restock.filter((F.col("date") == d) & (F.col("required_quantity") > 0)).agg(F.count(F.lit(1))).scalar()
    ident = ~F.col("is_walk_in")
    cust = cdim.join(cmetrics.select("mobile_clean", "is_repeat"), "mobile_clean", "left").agg(F.struct(
        F.count_if(ident).alias("unique"),
        F.count_if(F.coalesce(F.col("is_repeat"), F.lit(False)) & ident).alias("repeat"),
        F.count_if((F.col("first_seen_date") >= F.date_sub(F.lit(as_of), 30)) & ident).alias("new30"))).scalar()
    walk = cmetrics.agg(
        (F.lit(100.0) * F.sum(F.when(F.col("mobile_clean") == WALK_IN_KEY, redecimal("total_revenue"))).cast("double")
         / F.nullif(F.sum(redecimal("total_revenue")).cast("double"), F.lit(0.0)))).scalar()
    n_unique, n_repeat = cust.getField("unique"), cust.getField("repeat")
    return dss.sparkSession.range(1).select(
        d.alias("latest_date"),
        rev.getField("rev").alias("total_revenue_last_7d"),
        rev.getField("bills").alias("total_bills_last_7d"),
        pur.getField("purch").alias("total_purchases_last_7d"),
        pur.getField("bills").alias("total_purchase_bills_last_7d"),
        pur.getField("credit").alias("total_credit_last_7d"),
        sig.getField("fast").alias("fast_moving_count"),
        sig.getField("slow").alias("slow_moving_count"),
        sig.getField("dead").alias("dead_stock_count"),
        sig.getField("spike").alias("demand_spike_count"),
        reorder.alias("products_needing_reorder"),
        n_unique.alias("total_unique_customers"),
        n_repeat.alias("repeat_customer_count"),
        F.when(n_unique > 0, round_half_up(n_repeat.cast("double") / n_unique.cast("double") * F.lit(100.0), 1))
        .alias("repeat_customer_percent"),
        cust.getField("new30").alias("new_customers_last_30d"),
        round_half_up(walk, 1).alias("walk_in_revenue_percent"),
    )


def health_rows(latest: DataFrame, dimension: DataFrame, mapping: DataFrame, sep: str) -> DataFrame:
    return (latest.join(dimension.select("product_id", "product_name"), "product_id", "left")
            .join(supplier_list_str(mapping, sep), "product_id", "left"))


def health_order() -> list[Column]:
    return [F.col("predicted_daily_demand").desc_nulls_last(), F.col("product_id")]


def replenishment_order() -> list[Column]:
    return [F.col("days_of_cover").asc_nulls_last(), F.col("barcode"), F.col("supplier_name")]


def catalog_order() -> list[Column]:
    return [F.col("canonical_name"), F.col("barcode")]


FLAG_FILTERS = {"fast": "fast_moving_flag", "slow": "slow_moving_flag", "dead": "dead_stock_flag",
                "spike": "demand_spike_flag"}


def health_signals_page(latest: DataFrame, dimension: DataFrame, mapping: DataFrame, flag: str = "all",
                        search: str | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Latest-day signals, filtered and paged by demand."""
    df = health_rows(latest, dimension, mapping, ", ")
    if flag in FLAG_FILTERS:
        df = df.filter(F.col(FLAG_FILTERS[flag]))
    if search:
        pat = f"%{search}%"
        df = df.filter(F.col("product_id").ilike(pat) | F.col("product_name").ilike(pat))
    df = df.select("product_id", "product_name", "fast_moving_flag", "slow_moving_flag", "dead_stock_flag",
                   "demand_spike_flag", "predicted_daily_demand", "last_7_day_avg", "last_30_day_avg",
                   "last_60_day_avg", "demand_volatility", "avg_monthly_consumption", "suppliers")
    return page(df, health_order(), limit, offset)


def health_report(latest: DataFrame, dimension: DataFrame, mapping: DataFrame) -> DataFrame:
    """The product-health export (all products on the last day)."""
    df = health_rows(latest, dimension, mapping, " | ")
    return df.select(
        "product_name", F.col("product_id").alias("barcode"), "suppliers",
        F.coalesce(F.col("avg_monthly_consumption"), F.lit(0.0)).alias("avg_monthly_consumption"),
        round_half_up("last_30_day_avg", 3).alias("avg_daily_demand"),
        round_half_up("predicted_daily_demand", 3).alias("predicted_daily_demand"),
        round_half_up("last_7_day_avg", 3).alias("last_7_day_avg"),
        round_half_up("last_60_day_avg", 3).alias("last_60_day_avg"),
        round_half_up(F.col("demand_volatility") * F.lit(100.0), 1).alias("volatility_pct"),
        signal_label().alias("signal"),
    ).orderBy(F.col("suppliers").asc_nulls_last(), F.col("avg_monthly_consumption").desc_nulls_last(),
              F.col("barcode"))


def supplier_report(latest: DataFrame, mapping: DataFrame, dimension: DataFrame, item_latest: DataFrame,
                    supplier: str | None = None) -> DataFrame:
    """One row per (product, supplier) on the last day."""
    m = mapping if supplier is None else mapping.filter(F.col("supplier_name") == supplier)
    return (
        latest.join(m, "product_id", "inner")
        .join(dimension.select("product_id", "product_name"), "product_id", "left")
        .join(item_latest.select("product_id", "mrp", "purchase_price", "current_stock"), "product_id", "left")
        .select(
            F.col("supplier_name").alias("supplier"), "product_name", F.col("product_id").alias("barcode"),
            "mrp", "purchase_price",
            F.coalesce(F.col("avg_monthly_consumption"), F.lit(0.0)).alias("avg_monthly_consumption"),
            round_half_up("predicted_daily_demand", 3).alias("predicted_daily_demand"),
            round_half_up("current_stock", 0).alias("current_stock"),
            signal_label().alias("signal"),
        )
        .orderBy("supplier", F.col("avg_monthly_consumption").desc_nulls_last(), "barcode")
    )


def _restock_items(restock: DataFrame) -> DataFrame:
    return restock.select(
        F.col("product_id").alias("barcode"), "product_name", "supplier_name",
        F.col("current_stock").alias("system_stock"), "predicted_daily_demand", "days_of_cover",
        "min_stock", "max_stock", "required_quantity", "lead_time_days",
        urgency_label(F.col("days_of_cover"), F.col("lead_time_days")).alias("urgency"),
    )


def replenishment_page(restock: DataFrame, supplier: str | None = None, urgent_only: bool = False,
                       limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Restock list by days of cover, optional partial supplier filter."""
    d = restock.agg(F.max("date")).scalar()
    df = restock.filter(F.col("date") == d)
    if supplier:
        df = df.filter(F.col("supplier_name").ilike(f"%{supplier}%"))
    if urgent_only:
        df = df.filter(F.col("days_of_cover") < F.col("lead_time_days"))
    return page(_restock_items(df), [F.col("days_of_cover").asc_nulls_last(), F.col("barcode")], limit, offset)


def supplier_restock_pages(restock: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """L3 (batch form): every supplier's restock rows, ranked by days of cover.

    Without ``limit`` all of them; with it the page of each supplier that
    starts after ``offset`` rows. ``total`` is the supplier's number of rows,
    a pre-aggregated count joined on.
    """
    d = restock.agg(F.max("date")).scalar()
    w = Window.partitionBy("supplier_name").orderBy(F.col("days_of_cover").asc_nulls_last(), F.col("barcode"))
    items = _restock_items(restock.filter((F.col("date") == d) & F.col("supplier_name").isNotNull()))
    totals = items.groupBy("supplier_name").agg(F.count(F.lit(1)).alias("total"))
    ranked = items.withColumn("rank", F.row_number().over(w).cast("bigint"))
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= offset + limit)  # pushed into the window as a per-group limit
    return ranked.filter(F.col("rank") > offset).join(totals, "supplier_name")


def top_products(sales_pd: DataFrame, dimension: DataFrame, as_of: dt.date, start: Column,
                 days: int = 30, limit: int = 10, sort_by: str = "revenue") -> DataFrame:
    """Top products over the last ``days`` days; rank is by revenue.

    The top-k is taken first (per-partition top-k, then a k-row merge); the
    revenue rank of those k rows is then counted against all products.
    """
    T = F.lit(as_of)
    sold = (sales_pd.filter((F.col("date") >= F.date_sub(T, days)) & (F.col("date") <= T)
                            & (F.col("date") >= start) & (F.col("qty") > 0))
            .groupBy("product_id").agg(F.sum("rev").alias("_rev"), F.sum("qty").alias("_qty")))
    key = "_rev" if sort_by == "revenue" else "_qty"
    top = sold.orderBy(F.col(key).desc(), F.col("product_id")).limit(limit)
    if sort_by == "revenue":
        ranked = top.withColumn("rank", F.row_number().over(
            Window.orderBy(F.col("_rev").desc(), F.col("product_id"))).cast("bigint"))  # k rows only
    else:
        others = sold.select(F.col("product_id").alias("_o"), F.col("_rev").alias("_orev"))
        ahead = (F.col("_orev") > F.col("_rev")) | ((F.col("_orev") == F.col("_rev")) & (F.col("_o") < F.col("product_id")))
        ranked = (F.broadcast(top).join(others, ahead, "left").groupBy("product_id", "_rev", "_qty")
                  .agg((F.count("_o") + 1).cast("bigint").alias("rank")))
    return (ranked.join(dimension.select("product_id", "product_name"), "product_id", "left")
            .select("rank", F.col("product_id").alias("barcode"), "product_name",
                    (F.col("_rev").cast("double") / F.lit(10000.0)).alias("total_revenue"),
                    (F.col("_qty").cast("double") / F.lit(10000.0)).alias("total_qty"))
            .orderBy(F.col("total_revenue" if sort_by == "revenue" else "total_qty").desc(), "barcode"))


def demand_trend(win: DataFrame, as_of: dt.date, last_sale: Column, days: int = 60) -> DataFrame:
    """J24 (batch form): each product's last ``days`` days of features and demand."""
    from .product import health_columns
    c = F.col
    h = health_columns(c("last_7_day_avg"), c("last_30_day_avg"), c("last_60_day_avg"),
                       c("last_7_day_stddev"), c("lag_1_qty"))
    return (win.filter((F.col("date") >= F.date_sub(F.lit(as_of), days)) & (F.col("date") <= last_sale))
            .select("product_id", "date",
                    (F.col("qty").cast("double") / F.lit(10000.0)).alias("quantity_sold"),
                    (F.col("rev").cast("double") / F.lit(10000.0)).alias("revenue"),
                    "last_7_day_avg", "last_30_day_avg", h[0]))


def supplier_list(mapping: DataFrame, location: DataFrame) -> DataFrame:
    """Suppliers with region, lead time and product count."""
    from .dims import lead_time
    return (mapping.join(location, "supplier_name", "left")
            .groupBy("supplier_name", "supplier_region")
            .agg(F.count("product_id").alias("product_count"))
            .select("supplier_name", "supplier_region", lead_time(F.col("supplier_region")).alias("lead_time_days"),
                    "product_count"))


def _catalog(dimension: DataFrame, products: DataFrame) -> DataFrame:
    p = products.select(F.col("barcode").alias("product_id"), F.col("canonical_name").alias("_cn"), "category",
                        "subcategory", F.col("brand").alias("_brand"), F.col("product_type").alias("_pt"), "size",
                        "colour", F.col("hsn_code").alias("_hsn"), "is_active",
                        F.col("is_reviewed").alias("_rev"))
    return (dimension.select("product_id", "product_name").join(p, "product_id", "left")
            .withColumn("canonical_name", F.coalesce("_cn", "product_name")))


def product_search(dimension: DataFrame, products: DataFrame, item_latest: DataFrame, q: str,
                   limit: int = 20) -> DataFrame:
    """Case-insensitive contains search on name or barcode."""
    pat = f"%{q}%"
    df = (_catalog(dimension, products)
          .filter(F.col("canonical_name").ilike(pat) | F.col("product_id").ilike(pat))
          .join(item_latest.select("product_id", "mrp"), "product_id", "left"))
    return (df.select(F.col("product_id").alias("barcode"), "canonical_name", "category", "mrp")
            .orderBy("canonical_name", "barcode").limit(limit))


def product_list(dimension: DataFrame, products: DataFrame, search: str | None = None,
                 category: str | None = None, is_reviewed: bool | None = None, active_only: bool = True,
                 limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Filtered, paged catalog."""
    df = _catalog(dimension, products)
    if search:
        pat = f"%{search}%"
        df = df.filter(F.col("canonical_name").ilike(pat) | F.col("product_id").ilike(pat))
    if category:
        df = df.filter(F.col("category") == category)
    if is_reviewed is not None:
        df = df.filter(F.col("_rev") == is_reviewed)
    if active_only:
        df = df.filter(F.col("is_active").isNull() | F.col("is_active"))
    df = df.select(F.col("product_id").alias("barcode"), "canonical_name", "category", "subcategory",
                   F.col("_brand").alias("brand"), F.col("_pt").alias("product_type"), "size", "colour",
                   "is_active", F.col("_rev").alias("is_reviewed"))
    return page(df, catalog_order(), limit, offset)


def product_detail(dimension: DataFrame, products: DataFrame, item_latest: DataFrame, mapping: DataFrame,
                   latest: DataFrame) -> DataFrame:
    """J14 (batch form): detail row for every product in the dimension."""
    return (
        _catalog(dimension, products)
        .join(item_latest.select("product_id", "mrp", "purchase_price",
                                 F.col("current_stock").alias("system_stock")), "product_id", "left")
        .join(supplier_list_str(mapping, ", "), "product_id", "left")
        .join(latest.select("product_id", "avg_monthly_consumption"), "product_id", "left")
        .select(F.col("product_id").alias("barcode"), "canonical_name", "category", "subcategory",
                F.col("_brand").alias("brand"), F.col("_pt").alias("product_type"), "size", "colour",
                F.col("_hsn").alias("hsn_code"), "is_active", F.col("_rev").alias("is_reviewed"),
                "mrp", "purchase_price", "system_stock", "suppliers", "avg_monthly_consumption")
    )


CUSTOMER_SORTS = {"total_revenue": "total_revenue", "total_bills": "m_total_bills",
                  "last_seen_date": "last_seen_date", "avg_bill_value": "avg_bill_value"}


def customer_order(sort_by: str = "total_revenue") -> list[Column]:
    return [F.col(CUSTOMER_SORTS[sort_by]).desc_nulls_last(), F.col("mobile_clean")]


def _customers(cdim: DataFrame, cmetrics: DataFrame) -> DataFrame:
    m = cmetrics.select("mobile_clean", "total_revenue", F.col("total_bills").alias("m_total_bills"),
                        "avg_bill_value", "total_discount_received", "days_since_last_visit",
                        "avg_days_between_visits", "is_repeat", "preferred_payment")
    return cdim.join(m, "mobile_clean", "left")


def customer_list(cdim: DataFrame, cmetrics: DataFrame, search: str | None = None,
                  is_repeat: bool | None = None, is_member: bool | None = None, include_walkin: bool = False,
                  sort_by: str = "total_revenue", limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Filtered, sorted, paged customers."""
    df = _customers(cdim, cmetrics)
    if not include_walkin:
        df = df.filter(~F.col("is_walk_in"))
    if search:
        pat = f"%{search}%"
        df = df.filter(F.col("display_name").ilike(pat) | F.col("mobile_clean").ilike(pat))
    if is_repeat is not None:
        df = df.filter(F.col("is_repeat") == is_repeat)
    if is_member is not None:
        df = df.filter(F.col("is_member") == is_member)
    df = df.select("mobile_clean", "display_name", "is_walk_in", "is_member", "first_seen_date", "last_seen_date",
                   "total_bills", "total_revenue", "avg_bill_value", "total_discount_received",
                   "days_since_last_visit", "avg_days_between_visits", "is_repeat", "preferred_payment",
                   "m_total_bills")
    out = page(df, customer_order(sort_by), limit, offset)
    if limit is None:  # the index orders by it
        return out
    return out.drop("m_total_bills")


def customer_summary(cdim: DataFrame, cmetrics: DataFrame, as_of: dt.date) -> DataFrame:
    """One KPI row over identified customers."""
    ident = _customers(cdim, cmetrics).filter(~F.col("is_walk_in"))
    n = F.count(F.lit(1))
    rep = F.count_if(F.col("is_repeat"))
    walk = cmetrics.filter(F.col("mobile_clean") == WALK_IN_KEY).agg(
        F.sum(redecimal(F.coalesce("total_revenue", F.lit(0.0)))).cast("double")).scalar()
    total = cmetrics.agg(F.sum(redecimal("total_revenue")).cast("double")).scalar()
    return ident.agg(
        n.alias("total_unique_customers"),
        rep.alias("repeat_customer_count"),
        round_half_up(rep.cast("double") * F.lit(100.0) / F.nullif(n, F.lit(0)).cast("double"), 1)
        .alias("repeat_customer_percent"),
        round_half_up(F.avg("avg_bill_value"), 4).alias("avg_bill_value"),
        F.count_if(F.col("is_member")).alias("members_count"),
        F.count_if(F.col("first_seen_date") >= F.date_sub(F.lit(as_of), 30)).alias("new_customers_last_30d"),
    ).select(
        "*", round_half_up(walk * F.lit(100.0) / F.nullif(total, F.lit(0.0)), 1).alias("walk_in_revenue_percent"))


def customer_history(bills: DataFrame, limit: int | None = None) -> DataFrame:
    """L7 P3 (batch form): each customer's bills, newest first; with ``limit`` only so many of each."""
    df = bills.select(
        clean_mobile("customer_mobile_raw").alias("mobile_clean"), "bill_no",
        export_timestamp("bill_datetime_raw").alias("bill_ts"),
        F.col("net_total").cast("double").alias("net_total"),
        F.col("total_discount").cast("double").alias("total_discount"),
        cash_amount().cast("double").alias("cash_total"), z("card_amount").cast("double").alias("card_total"),
        upi_amount().cast("double").alias("upi_total"), z("credit_amount").cast("double").alias("credit_total"),
    ).filter(F.col("mobile_clean").isNotNull())
    w = Window.partitionBy("mobile_clean").orderBy(F.col("bill_ts").desc_nulls_last(), F.col("bill_no").desc())
    ranked = df.withColumn("rank", F.row_number().over(w).cast("bigint"))
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= limit)
    return (ranked
            .withColumn("bill_date", F.to_date("bill_ts")).drop("bill_ts"))


def data_freshness(dss: DataFrame, as_of: dt.date) -> DataFrame:
    """Last data day and how far behind ``as_of`` it is."""
    return dss.agg(F.max("sale_date").alias("last_data_date")).select(
        "last_data_date", F.datediff(F.lit(as_of), F.col("last_data_date")).cast("bigint").alias("days_behind"))
