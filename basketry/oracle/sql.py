"""DuckDB SQL for every registered query: the independent correctness oracle.

Written from the reference semantics, not from the Spark code: plain SQL on
the fixture CTEs of ``basketry.oracle.views``. Numeric convention as in
``basketry.functions.numeric``: exact decimal sums, DOUBLE outputs, ratios as
one double division, rounding on DECIMAL(28,10).
"""

from __future__ import annotations

from .exports import ORACLE as EXPORTS
from .views import AS_OF, VIEWS, oracle

ORACLE: dict[str, str] = {}


def pdate(c: str) -> str:
    """Export datetime text -> DATE (guarded), DuckDB form of P1/P2."""
    return ("CASE WHEN " + c + " IS NOT NULL AND regexp_matches(" + c + ", '^\\d{2}-\\d{2}-\\d{4}') "
            "THEN CAST(try_strptime(substr(" + c + ", 1, 10), '%d-%m-%Y') AS DATE) END")


def ddate(c: str) -> str:
    """``dd-MM-yyyy`` text -> DATE."""
    return "CAST(try_strptime(" + c + ", '%d-%m-%Y') AS DATE)"


def rnd(expr: str, k: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(28,10)), {k}) AS DOUBLE)"


def dv(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / CAST(NULLIF({den}, 0) AS DOUBLE))"


Z = "CAST(0 AS DECIMAL(18,4))"


def zc(c: str) -> str:
    return f"COALESCE({c}, {Z})"


MOBILE = ("NULLIF(regexp_extract(regexp_replace(COALESCE({c}, ''), '[^0-9]', '', 'g'), "
          "'^(?:91|0)?([6-9][0-9]{{9}})$', 1), '')")
WALK_IN_LIST = ("'CASH', 'X', 'MR', 'PTF', 'SUNDRY', 'RETAIL', 'CUSTOMER', 'CASH CUSTOMER', 'GENERAL', "
                "'GENERAL CUSTOMER', 'WALK IN', 'WALK-IN', 'WALKIN', 'RETAIL CUSTOMER'")

# ---------------------------------------------------------------- step 00
_DSS_CTES = [
    f"""b AS (SELECT {pdate('bill_datetime_raw')} AS sale_date, count(*) AS total_bills,
                 sum(net_total) AS rev
          FROM raw_sales_billwise WHERE {pdate('bill_datetime_raw')} IS NOT NULL GROUP BY 1)""",
    f"""i AS (SELECT {pdate('sale_datetime_raw')} AS sale_date, sum(sale_qty) AS qty
          FROM raw_sales_itemwise WHERE {pdate('sale_datetime_raw')} IS NOT NULL GROUP BY 1)""",
    """daily_sales_summary AS (
        SELECT COALESCE(b.sale_date, i.sale_date) AS sale_date, b.total_bills,
               CAST(i.qty AS DOUBLE) AS total_items_sold, CAST(b.rev AS DOUBLE) AS total_revenue,
               CASE WHEN COALESCE(b.total_bills, 0) > 0
                    THEN CAST(b.rev AS DOUBLE) / CAST(b.total_bills AS DOUBLE) END AS avg_bill_value
        FROM b FULL OUTER JOIN i ON b.sale_date = i.sale_date)""",
]
DSS_VIEWS = ["raw_sales_billwise", "raw_sales_itemwise"]

ORACLE["daily_sales_summary"] = oracle("SELECT * FROM daily_sales_summary", DSS_VIEWS, _DSS_CTES)

_DPS_CTES = [
    f"""pb AS (SELECT {ddate('purchase_date_raw')} AS purchase_date, count(*) AS total_purchase_bills,
                  CAST(sum(taxable_value) AS DOUBLE) AS total_taxable_value,
                  CAST(sum(settled_amount) AS DOUBLE) AS total_settled_amount,
                  CAST(sum(due_amount) AS DOUBLE) AS total_due_amount
           FROM raw_purchase_billwise
           WHERE purchase_date_raw IS NOT NULL AND {ddate('purchase_date_raw')} IS NOT NULL GROUP BY 1)""",
    f"""pi AS (SELECT {ddate('purchase_date_raw')} AS purchase_date,
                  CAST(sum(total_qty) AS DOUBLE) AS total_quantity_purchased
           FROM raw_purchase_itemwise
           WHERE purchase_date_raw IS NOT NULL AND {ddate('purchase_date_raw')} IS NOT NULL GROUP BY 1)""",
    """daily_purchase_summary AS (
        SELECT COALESCE(pb.purchase_date, pi.purchase_date) AS purchase_date, pb.total_purchase_bills,
               pi.total_quantity_purchased, pb.total_taxable_value, pb.total_settled_amount,
               pb.total_due_amount
        FROM pb FULL OUTER JOIN pi ON pb.purchase_date = pi.purchase_date)""",
]
DPS_VIEWS = ["raw_purchase_billwise", "raw_purchase_itemwise"]
ORACLE["daily_purchase_summary"] = oracle("SELECT * FROM daily_purchase_summary", DPS_VIEWS, _DPS_CTES)

# ---------------------------------------------------------------- step 07
_PAY_CTES = [
    f"""daily_payment_breakdown AS (
        SELECT {pdate('bill_datetime_raw')} AS sale_date, count(*) AS total_bills,
          CAST(sum(COALESCE(actual_cash, cash_amount, {Z})) AS DOUBLE) AS cash_total,
          CAST(sum({zc('card_amount')}) AS DOUBLE) AS card_total,
          CAST(sum({zc('google_pay_amount')}) AS DOUBLE) AS google_pay_total,
          CAST(sum({zc('phonepe_amount')}) AS DOUBLE) AS phonepe_total,
          CAST(sum({zc('paytm_amount')}) AS DOUBLE) AS paytm_total,
          CAST(sum({zc('google_pay_amount')} + {zc('phonepe_amount')} + {zc('paytm_amount')}) AS DOUBLE) AS upi_total,
          CAST(sum({zc('credit_amount')}) AS DOUBLE) AS credit_total,
          CAST(sum({zc('cn_amount')}) AS DOUBLE) AS cn_redeemed_total,
          CAST(sum({zc('total_discount')}) AS DOUBLE) AS total_discount,
          CAST(sum({zc('membercard_discount')}) AS DOUBLE) AS membercard_discount_total
        FROM raw_sales_billwise
        WHERE COALESCE(actual_cash, cash_amount, 0) < 1000000 AND COALESCE(card_amount, 0) < 1000000
          AND COALESCE(net_total, 0) < 1000000 AND {pdate('bill_datetime_raw')} IS NOT NULL
        GROUP BY 1)""",
]
ORACLE["daily_payment_breakdown"] = oracle("SELECT * FROM daily_payment_breakdown",
                                           ["raw_sales_billwise"], _PAY_CTES)
ORACLE["daily_payments_no_outliers"] = oracle(
    """SELECT p.* FROM daily_payment_breakdown p,
         (SELECT CASE WHEN quantile_cont(cash_total, 0.5) > 0 THEN quantile_cont(cash_total, 0.5) * 100.0
                      ELSE 5000000.0 END AS lim, count(*) AS n FROM daily_payment_breakdown) s
       WHERE s.n < 2 OR (COALESCE(cash_total, 0) <= s.lim AND COALESCE(card_total, 0) <= s.lim
                         AND COALESCE(upi_total, 0) <= s.lim AND COALESCE(credit_total, 0) <= s.lim)""",
    ["raw_sales_billwise"], _PAY_CTES)

ORACLE["daily_revenue_range"] = oracle(
    """SELECT * FROM daily_sales_summary
       WHERE sale_date BETWEEN (SELECT COALESCE(max(sale_date), """ + AS_OF + """ - 1) FROM daily_sales_summary) - 89
                           AND (SELECT COALESCE(max(sale_date), """ + AS_OF + """ - 1) FROM daily_sales_summary)""",
    DSS_VIEWS, _DSS_CTES)
ORACLE["daily_payments_range"] = oracle(
    """SELECT * FROM daily_payment_breakdown
       WHERE sale_date BETWEEN (SELECT COALESCE(max(sale_date), """ + AS_OF + """ - 1) FROM daily_payment_breakdown) - 89
                           AND (SELECT COALESCE(max(sale_date), """ + AS_OF + """ - 1) FROM daily_payment_breakdown)""",
    ["raw_sales_billwise"], _PAY_CTES)
ORACLE["daily_purchases_range"] = oracle(
    """SELECT * FROM daily_purchase_summary
       WHERE purchase_date BETWEEN (SELECT COALESCE(max(purchase_date), """ + AS_OF + """ - 1) FROM daily_purchase_summary) - 89
                               AND (SELECT COALESCE(max(purchase_date), """ + AS_OF + """ - 1) FROM daily_purchase_summary)""",
    DPS_VIEWS, _DPS_CTES)

# ---------------------------------------------------------------- steps 01-04
AMAP = "amap AS (SELECT alias_barcode, canonical_barcode FROM product_aliases)"
_PD_CTES = [
    AMAP,
    f"""sales_pd AS (
        SELECT {pdate('s.sale_datetime_raw')} AS date, COALESCE(a.canonical_barcode, s.barcode) AS product_id,
               sum({zc('s.sale_qty')} + {zc('s.free_qty')}) AS qty, sum({zc('s.net_total')}) AS rev
        FROM raw_sales_itemwise s LEFT JOIN amap a ON s.barcode = a.alias_barcode
        WHERE {pdate('s.sale_datetime_raw')} IS NOT NULL AND COALESCE(a.canonical_barcode, s.barcode) IS NOT NULL
        GROUP BY 1, 2)""",
    f"""purch_pd AS (
        SELECT {ddate('p.purchase_date_raw')} AS date, COALESCE(a.canonical_barcode, p.barcode) AS product_id,
               sum({zc('p.total_qty')}) AS pqty
        FROM raw_purchase_itemwise p LEFT JOIN amap a ON p.barcode = a.alias_barcode
        WHERE {ddate('p.purchase_date_raw')} IS NOT NULL AND COALESCE(a.canonical_barcode, p.barcode) IS NOT NULL
        GROUP BY 1, 2)""",
    """prods AS (
        SELECT DISTINCT COALESCE(a.canonical_barcode, s.barcode) AS product_id
        FROM raw_sales_itemwise s LEFT JOIN amap a ON s.barcode = a.alias_barcode
        WHERE COALESCE(a.canonical_barcode, s.barcode) IS NOT NULL)""",
]
PD_VIEWS = ["raw_sales_billwise", "raw_sales_itemwise", "raw_purchase_itemwise", "product_aliases"]

_DENSE_CTES = _DSS_CTES + _PD_CTES + [
    f"""spine AS (SELECT CAST(unnest(generate_series(lo, {AS_OF}, INTERVAL 1 DAY)) AS DATE) AS date
                 FROM (SELECT min(sale_date) AS lo FROM daily_sales_summary))""",
    """dense AS (
        SELECT g.date, g.product_id, COALESCE(s.qty, 0) AS qty, COALESCE(s.rev, 0) AS rev,
               COALESCE(p.pqty, 0) AS pqty
        FROM (SELECT spine.date, prods.product_id FROM spine CROSS JOIN prods) g
        LEFT JOIN sales_pd s ON g.date = s.date AND g.product_id = s.product_id
        LEFT JOIN purch_pd p ON g.date = p.date AND g.product_id = p.product_id)""",
    """win AS (
        SELECT date, product_id, qty, rev, pqty,
          CAST(lag(qty, 1) OVER w AS DOUBLE) AS lag_1_qty,
          CAST(lag(qty, 7) OVER w AS DOUBLE) AS lag_7_qty,
          CAST(sum(qty) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE)
            / CAST(count(*) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_7_day_avg,
          CAST(sum(qty) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS DOUBLE)
            / CAST(count(*) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_30_day_avg,
          CAST(sum(qty) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS DOUBLE)
            / CAST(count(*) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_60_day_avg,
          count(*) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS n7,
          CAST(sum(qty) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) AS s7d,
          CAST(qty AS DOUBLE) AS l0,
          CAST(lag(qty, 1) OVER w AS DOUBLE) AS l1,
          CAST(lag(qty, 2) OVER w AS DOUBLE) AS l2,
          CAST(lag(qty, 3) OVER w AS DOUBLE) AS l3,
          CAST(lag(qty, 4) OVER w AS DOUBLE) AS l4,
          CAST(lag(qty, 5) OVER w AS DOUBLE) AS l5,
          CAST(lag(qty, 6) OVER w AS DOUBLE) AS l6,
          sum(pqty) OVER (w ROWS UNBOUNDED PRECEDING) AS tp,
          sum(qty) OVER (w ROWS UNBOUNDED PRECEDING) AS ts,
          max(CASE WHEN qty > 0 THEN date END) OVER (w ROWS UNBOUNDED PRECEDING) AS last_sale_date,
          max(CASE WHEN pqty > 0 THEN date END) OVER (w ROWS UNBOUNDED PRECEDING) AS last_purchase_date
        FROM dense WINDOW w AS (PARTITION BY product_id ORDER BY date))""",
    """win2 AS (
        SELECT *, CASE WHEN n7 > 1 THEN sqrt((COALESCE((l0 - s7d / CAST(n7 AS DOUBLE)) * (l0 - s7d / CAST(n7 AS DOUBLE)), 0.0) + COALESCE((l1 - s7d / CAST(n7 AS DOUBLE)) * (l1 - s7d / CAST(n7 AS DOUBLE)), 0.0) + COALESCE((l2 - s7d / CAST(n7 AS DOUBLE)) * (l2 - s7d / CAST(n7 AS DOUBLE)), 0.0) + COALESCE((l3 - s7d / CAST(n7 AS DOUBLE)) * (l3 - s7d / CAST(n7 AS DOUBLE)), 0.0) + COALESCE((l4 - s7d / CAST(n7 AS DOUBLE)) * (l4 - s7d / CAST(n7 AS DOUBLE)), 0.0) + COALESCE((l5 - s7d / CAST(n7 AS DOUBLE)) * (l5 - s7d / CAST(n7 AS DOUBLE)), 0.0) + COALESCE((l6 - s7d / CAST(n7 AS DOUBLE)) * (l6 - s7d / CAST(n7 AS DOUBLE)), 0.0))
                                             / CAST(n7 - 1 AS DOUBLE)) END AS last_7_day_stddev
        FROM win)""",
]
DENSE_VIEWS = PD_VIEWS


def _health(src: str, a7="last_7_day_avg", a30="last_30_day_avg", a60="last_60_day_avg",
            sd="last_7_day_stddev", lag1="lag_1_qty") -> str:
    return f"""
        {rnd(f"greatest(0.6 * COALESCE({a7}, 0.0) + 0.3 * COALESCE({a30}, 0.0) + 0.1 * COALESCE({a60}, 0.0), 0.02)", 4)}
            AS predicted_daily_demand,
        {a7} AS last_7_day_avg, {a30} AS last_30_day_avg, {a60} AS last_60_day_avg,
        {sd} AS demand_volatility,
        COALESCE({a7} > {a30} * 1.2, false) AS fast_moving_flag,
        COALESCE({a30} > 0 AND {a7} < {a30} * 0.5, false) AS slow_moving_flag,
        COALESCE({a30} = 0, false) AS dead_stock_flag,
        COALESCE({lag1} > {a7} * 2, false) AS demand_spike_flag"""


_FEST_ROWS = None


_FEST = """fest AS (
        SELECT n_name AS name, n_nationkey AS priority, make_date(y, n_nationkey % 12 + 1, n_nationkey % 27 + 1) AS peak,
               CAST(n_nationkey % 5 AS INTEGER) AS pre, CAST(n_nationkey % 4 AS INTEGER) AS post
        FROM nation, (SELECT unnest(range(1995, 2002)) AS y) years)"""
_HOLI = """holi AS (
        SELECT make_date(y, r_regionkey * 2 + 1, 26) AS date, 'Day of ' || r_name AS name
        FROM region, (SELECT unnest(range(1995, 2002)) AS y) years)"""


def calendar_ctes(lo: str, hi: str) -> list[str]:
    return [
        _FEST, _HOLI,
        f"""cdays AS (SELECT CAST(unnest(generate_series({lo}, {hi}, INTERVAL 1 DAY)) AS DATE) AS date)""",
        """fw AS (SELECT CAST(unnest(generate_series(peak - pre, peak + post, INTERVAL 1 DAY)) AS DATE) AS date,
                         name, priority FROM fest)""",
        "fwin AS (SELECT date, arg_min(name, priority) AS festival_name FROM fw GROUP BY date)",
        """calendar_dim AS (
            SELECT d.date, CAST(dayofweek(d.date) AS BIGINT) AS dow, dayofweek(d.date) IN (0, 6) AS is_weekend,
                   CAST(month(d.date) AS BIGINT) AS month, CAST(quarter(d.date) AS BIGINT) AS quarter,
                   CAST(weekofyear(d.date) AS BIGINT) AS week_of_year,
                   (fwin.festival_name IS NOT NULL OR holi.name IS NOT NULL) AS is_holiday,
                   COALESCE(holi.name, fwin.festival_name) AS holiday_name,
                   fwin.festival_name IS NOT NULL AS is_festival_window, fwin.festival_name,
                   CAST((SELECT min(peak) FROM fest WHERE peak >= d.date) - d.date AS BIGINT) AS days_to_next_festival,
                   CAST(d.date - (SELECT max(peak) FROM fest WHERE peak <= d.date) AS BIGINT) AS days_since_last_festival
            FROM cdays d LEFT JOIN fwin ON d.date = fwin.date LEFT JOIN holi ON d.date = holi.date)""",
    ]


_CAL_BOUNDS = ("(SELECT min(sale_date) FROM daily_sales_summary)", AS_OF)

ORACLE["product_daily_sparse"] = oracle(
    """SELECT s.date, s.product_id, CAST(s.qty AS DOUBLE) AS quantity_sold, CAST(s.rev AS DOUBLE) AS revenue,
              CASE WHEN s.qty <> 0 THEN CAST(s.rev AS DOUBLE) / CAST(s.qty AS DOUBLE) END AS avg_price,
              CAST(COALESCE(p.pqty, 0) AS DOUBLE) AS purchase_quantity
       FROM sales_pd s LEFT JOIN purch_pd p ON s.date = p.date AND s.product_id = p.product_id""",
    PD_VIEWS, _PD_CTES)
ORACLE["product_daily_metrics"] = oracle(
    """SELECT date, product_id, CAST(qty AS DOUBLE) AS quantity_sold, CAST(rev AS DOUBLE) AS revenue,
              CASE WHEN qty <> 0 THEN CAST(rev AS DOUBLE) / CAST(qty AS DOUBLE) END AS avg_price,
              CAST(pqty AS DOUBLE) AS purchase_quantity FROM dense""",
    DENSE_VIEWS, _DENSE_CTES)
ORACLE["product_daily_features"] = oracle(
    """SELECT w.date, w.product_id, CAST(qty AS DOUBLE) AS quantity_sold, CAST(rev AS DOUBLE) AS revenue,
              CAST(pqty AS DOUBLE) AS purchase_quantity, lag_1_qty, lag_7_qty, last_7_day_avg, last_30_day_avg,
              last_60_day_avg, last_7_day_stddev, CAST(dayofweek(w.date) AS BIGINT) AS day_of_week,
              (qty = 0 AND COALESCE(last_7_day_avg, 0) > 0.5 AND pqty = 0) AS stockout_proxy,
              c.is_holiday, c.days_to_next_festival, c.days_since_last_festival
       FROM win2 w LEFT JOIN calendar_dim c ON w.date = c.date""",
    DENSE_VIEWS, _DENSE_CTES + calendar_ctes(*_CAL_BOUNDS))
ORACLE["product_health_signals"] = oracle(
    "SELECT date, product_id, " + _health("win2") + " FROM win2", DENSE_VIEWS, _DENSE_CTES)
ORACLE["product_stock_position"] = oracle(
    """SELECT date, product_id, CAST(tp AS DOUBLE) AS total_purchased, CAST(ts AS DOUBLE) AS total_sold,
              CAST(tp - ts AS DOUBLE) AS pseudo_stock, last_sale_date, last_purchase_date FROM win2""",
    DENSE_VIEWS, _DENSE_CTES)
# 130 days before 25 days before the last day, from the first of that month on
_RECENT = f"date_trunc('month', {AS_OF} - 155)"
ORACLE["rebuild_recent"] = oracle(
    """SELECT w.date, w.product_id, CAST(qty AS DOUBLE) AS quantity_sold, CAST(rev AS DOUBLE) AS revenue,
              CASE WHEN qty <> 0 THEN CAST(rev AS DOUBLE) / CAST(qty AS DOUBLE) END AS avg_price, CAST(pqty AS DOUBLE) AS purchase_quantity,
              lag_1_qty, lag_7_qty, last_7_day_stddev, CAST(dayofweek(w.date) AS BIGINT) AS day_of_week,
              (qty = 0 AND COALESCE(last_7_day_avg, 0) > 0.5 AND pqty = 0) AS stockout_proxy,
              c.is_holiday, c.days_to_next_festival, c.days_since_last_festival, """ + _health("w") + f""",
              CAST(tp AS DOUBLE) AS total_purchased, CAST(ts AS DOUBLE) AS total_sold, CAST(tp - ts AS DOUBLE) AS pseudo_stock,
              last_sale_date, last_purchase_date
       FROM win2 w LEFT JOIN calendar_dim c ON w.date = c.date WHERE w.date >= {_RECENT}""",
    DENSE_VIEWS, _DENSE_CTES + calendar_ctes(*_CAL_BOUNDS))
ORACLE["calendar_dim"] = oracle("SELECT * FROM calendar_dim", DSS_VIEWS,
                                _DSS_CTES + calendar_ctes(*_CAL_BOUNDS))

# ---------------------------------------------------------------- step 05 dims
_DIM_CTES = [
    """lic AS (
        SELECT barcode AS product_id, CAST(purchase_price AS DOUBLE) AS purchase_price, CAST(rate AS DOUBLE) AS rate,
               CAST(mrp AS DOUBLE) AS mrp, expiry_date_raw, hsn_code, CAST(system_stock_snapshot AS DOUBLE) AS current_stock
        FROM (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY imported_at DESC, import_batch_id DESC) AS rn
              FROM raw_item_combinations) x WHERE rn = 1)""",
    """sloc AS (
        SELECT supplier_name_raw AS supplier_name,
               CASE WHEN city_raw = 'Bellary' THEN 'BELLARY' ELSE 'OUTSIDE' END AS supplier_region
        FROM (SELECT *, row_number() OVER (PARTITION BY supplier_name_raw
                                           ORDER BY imported_at DESC, import_batch_id DESC, city_raw DESC) AS rn
              FROM raw_supplier_master) x WHERE rn = 1)""",
    "psm AS (SELECT DISTINCT barcode AS product_id, supplier_name_raw AS supplier_name FROM raw_purchase_itemwise)",
    AMAP,
    """imn AS (
        SELECT barcode, item_name_raw FROM (
            SELECT COALESCE(a.canonical_barcode, r.barcode) AS barcode, r.item_name_raw,
                   row_number() OVER (PARTITION BY COALESCE(a.canonical_barcode, r.barcode)
                                      ORDER BY r.imported_at DESC, r.import_batch_id DESC, r.item_name_raw DESC) AS rn
            FROM raw_item_combinations r LEFT JOIN amap a ON r.barcode = a.alias_barcode
            WHERE r.item_name_raw IS NOT NULL AND r.item_name_raw <> '') x WHERE rn = 1)""",
    """snn AS (
        SELECT barcode, item_name_raw FROM (
            SELECT COALESCE(a.canonical_barcode, r.barcode) AS barcode, r.item_name_raw,
                   row_number() OVER (PARTITION BY COALESCE(a.canonical_barcode, r.barcode)
                                      ORDER BY r.imported_at DESC, r.item_name_raw DESC) AS rn
            FROM raw_sales_itemwise r LEFT JOIN amap a ON r.barcode = a.alias_barcode
            WHERE r.item_name_raw IS NOT NULL AND r.item_name_raw <> '') x WHERE rn = 1)""",
    """pdim AS (
        SELECT ab.barcode AS product_id,
               COALESCE(ap.canonical_name, im.item_name_raw, sn.item_name_raw, ab.barcode) AS product_name,
               ap.brand, ap.hsn_code, ap.category, ap.product_type, ap.is_reviewed
        FROM (SELECT barcode FROM imn UNION SELECT barcode FROM snn) ab
        LEFT JOIN products ap ON ab.barcode = ap.barcode
        LEFT JOIN imn im ON ab.barcode = im.barcode
        LEFT JOIN snn sn ON ab.barcode = sn.barcode)""",
]
DIM_VIEWS = ["raw_item_combinations", "raw_supplier_master", "raw_purchase_itemwise", "raw_sales_itemwise",
             "product_aliases", "products"]
ORACLE["latest_item_combinations"] = oracle("SELECT * FROM lic", DIM_VIEWS, _DIM_CTES)
ORACLE["supplier_location"] = oracle("SELECT * FROM sloc", DIM_VIEWS, _DIM_CTES)
ORACLE["product_supplier_mapping"] = oracle("SELECT * FROM psm", DIM_VIEWS, _DIM_CTES)
ORACLE["product_dimension"] = oracle("SELECT * FROM pdim", DIM_VIEWS, _DIM_CTES)

# ---------------------------------------------------------------- step 06 + sheets
# Latest-day signals come from the dense windows (the fast path must equal them).
_ALL_VIEWS = sorted(set(DENSE_VIEWS + DIM_VIEWS))
_LATEST_CTES = _DENSE_CTES + [c for c in _DIM_CTES if not c.startswith("amap")] + [
    "maxd AS (SELECT max(date) AS d FROM win2)",
    "hl AS (SELECT date, product_id, " + _health("win2") + " FROM win2 WHERE date = (SELECT d FROM maxd))",
    """stl AS (SELECT product_id, CAST(tp - ts AS DOUBLE) AS pseudo_stock FROM win2
              WHERE date = (SELECT d FROM maxd))""",
    "sup1 AS (SELECT product_id, min(supplier_name) AS supplier_name FROM psm GROUP BY product_id)",
    """restock AS (
        SELECT h.date, h.product_id, pd.product_name, sup1.supplier_name, s.pseudo_stock AS current_stock,
               h.predicted_daily_demand,
               CASE WHEN h.predicted_daily_demand = 0 THEN NULL
                    ELSE s.pseudo_stock / h.predicted_daily_demand END AS days_of_cover,
               CASE WHEN sup1.supplier_name IS NULL THEN 2.0 * h.predicted_daily_demand
                    ELSE 7.0 * h.predicted_daily_demand END AS min_stock,
               30.0 * h.predicted_daily_demand AS max_stock,
               greatest(30.0 * h.predicted_daily_demand - s.pseudo_stock, 0.0) AS required_quantity,
               CASE WHEN sl.supplier_region = 'BELLARY' THEN 7 ELSE 15 END AS lead_time_days
        FROM hl h JOIN stl s ON h.product_id = s.product_id
        LEFT JOIN sup1 ON h.product_id = sup1.product_id
        LEFT JOIN sloc sl ON sup1.supplier_name = sl.supplier_name
        LEFT JOIN pdim pd ON h.product_id = pd.product_id)""",
]
ORACLE["restock_recommendations"] = oracle("SELECT * FROM restock", _ALL_VIEWS, _LATEST_CTES)
ORACLE["replenishment_sheet"] = oracle(
    f"""SELECT h.product_id AS barcode, pd.product_name, sm.supplier_name, ic.current_stock AS system_stock,
              {rnd('h.predicted_daily_demand', 2)} AS predicted_daily_demand,
              {rnd("h.predicted_daily_demand * CASE WHEN sl.supplier_region = 'BELLARY' THEN 7.0 ELSE 15.0 END", 0)} AS min_stock,
              {rnd("h.predicted_daily_demand * CASE WHEN sl.supplier_region = 'BELLARY' THEN 15.0 ELSE 30.0 END", 0)} AS max_stock
       FROM hl h LEFT JOIN pdim pd ON h.product_id = pd.product_id
       LEFT JOIN psm sm ON h.product_id = sm.product_id
       LEFT JOIN sloc sl ON sm.supplier_name = sl.supplier_name
       LEFT JOIN lic ic ON h.product_id = ic.product_id""",
    _ALL_VIEWS, _LATEST_CTES)
ORACLE["conversion_attention_sheet"] = oracle(
    f"""SELECT h.product_id AS barcode, pd.product_name, ic.current_stock,
              {rnd('h.predicted_daily_demand', 2)} AS predicted_daily_demand,
              {rnd('greatest(h.predicted_daily_demand * 7.0, 5.0)', 0)} AS min_stock,
              {rnd('greatest(h.predicted_daily_demand * 15.0, 5.0)', 0)} AS max_stock
       FROM hl h LEFT JOIN pdim pd ON h.product_id = pd.product_id
       LEFT JOIN lic ic ON h.product_id = ic.product_id
       WHERE NOT EXISTS (SELECT 1 FROM psm WHERE psm.product_id = h.product_id)
         AND h.predicted_daily_demand > 0.02""",
    _ALL_VIEWS, _LATEST_CTES)
ORACLE["supplier_purchase_sheet"] = oracle(
    """SELECT r.product_id AS barcode, pd.product_name, r.supplier_name, ic.current_stock AS system_stock,
              s.pseudo_stock, greatest(ic.current_stock, s.pseudo_stock, 0.0) AS effective_stock,
              r.predicted_daily_demand, lt AS lead_time_days,
              greatest(ic.current_stock, s.pseudo_stock, 0.0) / NULLIF(r.predicted_daily_demand, 0) AS days_of_cover,
              r.predicted_daily_demand * CAST(lt + 7 AS DOUBLE) AS target_stock,
              greatest(r.predicted_daily_demand * CAST(lt + 7 AS DOUBLE) + r.predicted_daily_demand * 3.0
                       - greatest(ic.current_stock, s.pseudo_stock, 0.0), 0.0) AS required_quantity,
              CAST(lt AS DOUBLE) - greatest(ic.current_stock, s.pseudo_stock, 0.0) / NULLIF(r.predicted_daily_demand, 0)
                  AS urgency_score
       FROM (SELECT r.*, CASE WHEN sl.supplier_region = 'BELLARY' THEN 7 ELSE 15 END AS lt, sm.supplier_name AS msup
             FROM restock r LEFT JOIN psm sm ON r.product_id = sm.product_id
             LEFT JOIN sloc sl ON sm.supplier_name = sl.supplier_name) r
       LEFT JOIN pdim pd ON r.product_id = pd.product_id
       LEFT JOIN lic ic ON r.product_id = ic.product_id
       LEFT JOIN stl s ON r.product_id = s.product_id""",
    _ALL_VIEWS, _LATEST_CTES)

# ---------------------------------------------------------------- steps 08-09 customers
_CUST_CTES = [
    f"""cb AS (
        SELECT bill_no, {pdate('bill_datetime_raw')} AS bill_date, customer_name_raw,
               {MOBILE.format(c='customer_mobile_raw')} AS mobile_clean,
               {zc('membercard_discount')} AS mcd, {zc('net_total')} AS net, {zc('total_discount')} AS disc,
               COALESCE(actual_cash, cash_amount, {Z}) AS cash_amt, {zc('card_amount')} AS card_amt,
               {zc('google_pay_amount')} + {zc('phonepe_amount')} + {zc('paytm_amount')} AS upi_amt,
               {zc('credit_amount')} AS credit_amt
        FROM raw_sales_billwise WHERE {pdate('bill_datetime_raw')} IS NOT NULL)""",
    f"""cc AS (SELECT *, (mobile_clean IS NULL
                          OR upper(trim(COALESCE(customer_name_raw, ''))) IN ({WALK_IN_LIST})) AS is_walk_in,
                   CASE WHEN mobile_clean IS NULL
                          OR upper(trim(COALESCE(customer_name_raw, ''))) IN ({WALK_IN_LIST})
                        THEN 'WALK-IN' ELSE mobile_clean END AS customer_key
            FROM cb)""",
    """nmc AS (SELECT mobile_clean, trim(customer_name_raw) AS nm, count(*) AS c FROM cc
             WHERE NOT is_walk_in AND customer_name_raw IS NOT NULL GROUP BY 1, 2)""",
    """md AS (SELECT mobile_clean, nm FROM (
                SELECT *, row_number() OVER (PARTITION BY mobile_clean ORDER BY c DESC, nm ASC) AS rn FROM nmc) x
             WHERE rn = 1)""",
    """customer_dimension AS (
        SELECT cc.mobile_clean, md.nm AS display_name, false AS is_walk_in, bool_or(mcd > 0) AS is_member,
               min(bill_date) AS first_seen_date, max(bill_date) AS last_seen_date, count(*) AS total_bills
        FROM cc LEFT JOIN md ON cc.mobile_clean = md.mobile_clean WHERE NOT is_walk_in
        GROUP BY cc.mobile_clean, md.nm
        UNION ALL
        SELECT 'WALK-IN', 'Walk-in / Retail', true, bool_or(mcd > 0), min(bill_date), max(bill_date), count(*)
        FROM cc WHERE is_walk_in)""",
    f"""cagg AS (
        SELECT customer_key AS mobile_clean, sum(net) AS rev, count(*) AS total_bills, sum(disc) AS disc,
               min(bill_date) AS first_purchase_date, max(bill_date) AS last_purchase_date,
               sum(cash_amt) AS sc, sum(card_amt) AS sk, sum(upi_amt) AS su, sum(credit_amt) AS sr
        FROM cc GROUP BY customer_key)""",
    f"""customer_metrics AS (
        SELECT mobile_clean, CAST(rev AS DOUBLE) AS total_revenue, total_bills,
               CAST(rev AS DOUBLE) / CAST(total_bills AS DOUBLE) AS avg_bill_value,
               CAST(disc AS DOUBLE) AS total_discount_received, first_purchase_date, last_purchase_date,
               CAST({AS_OF} - last_purchase_date AS BIGINT) AS days_since_last_visit,
               CASE WHEN total_bills > 1 THEN CAST(last_purchase_date - first_purchase_date AS DOUBLE)
                                              / CAST(total_bills - 1 AS DOUBLE) END AS avg_days_between_visits,
               total_bills > 1 AS is_repeat,
               CASE WHEN greatest(sc, sk, su, sr) = sc THEN 'cash' WHEN greatest(sc, sk, su, sr) = sk THEN 'card'
                    WHEN greatest(sc, sk, su, sr) = su THEN 'upi' WHEN greatest(sc, sk, su, sr) = sr THEN 'credit'
                    ELSE 'cash' END AS preferred_payment
        FROM cagg)""",
]
ORACLE["customer_dimension"] = oracle("SELECT * FROM customer_dimension", ["raw_sales_billwise"], _CUST_CTES)
ORACLE["customer_metrics"] = oracle("SELECT * FROM customer_metrics", ["raw_sales_billwise"], _CUST_CTES)


# ---------------------------------------------------------------- step 10 baskets
def assoc_ctes(min_co: int, item: str) -> list[str]:
    if item == "barcode":
        bi = ("""bi AS (SELECT DISTINCT s.bill_no, COALESCE(a.canonical_barcode, s.barcode) AS item
                 FROM raw_sales_itemwise s LEFT JOIN amap a ON s.barcode = a.alias_barcode
                 WHERE s.bill_no IS NOT NULL AND COALESCE(a.canonical_barcode, s.barcode) IS NOT NULL)""")
    else:
        bi = f"""bi AS (SELECT DISTINCT bill_no, {item} AS item FROM raw_sales_itemwise
                 WHERE bill_no IS NOT NULL AND {item} IS NOT NULL)"""
    return [AMAP, bi,
            "ib AS (SELECT item, count(*) AS bill_count FROM bi GROUP BY item)",
            "nb AS (SELECT count(DISTINCT bill_no) AS n FROM raw_sales_itemwise WHERE bill_no IS NOT NULL)",
            f"""pairs AS (SELECT x.item AS barcode_a, y.item AS barcode_b, count(*) AS co
                 FROM bi x JOIN bi y ON x.bill_no = y.bill_no AND x.item < y.item
                 GROUP BY 1, 2 HAVING count(*) >= {min_co})""",
            f"""assoc AS (
                SELECT p.barcode_a, p.barcode_b, p.co AS co_occurrences,
                  {rnd('CAST(p.co AS DOUBLE) / CAST(nb.n AS DOUBLE)', 6)} AS support,
                  {rnd('CAST(p.co AS DOUBLE) / CAST(ca.bill_count AS DOUBLE)', 4)} AS confidence_a_to_b,
                  {rnd('CAST(p.co AS DOUBLE) / CAST(cb.bill_count AS DOUBLE)', 4)} AS confidence_b_to_a,
                  {rnd('(CAST(p.co AS DOUBLE) / CAST(nb.n AS DOUBLE)) / ((CAST(ca.bill_count AS DOUBLE) / CAST(nb.n AS DOUBLE)) * (CAST(cb.bill_count AS DOUBLE) / CAST(nb.n AS DOUBLE)))', 4)} AS lift
                FROM pairs p JOIN ib ca ON p.barcode_a = ca.item JOIN ib cb ON p.barcode_b = cb.item, nb)"""]


ORACLE["product_associations"] = oracle("SELECT * FROM assoc", ["raw_sales_itemwise", "product_aliases"],
                                        assoc_ctes(5, "brand_raw"))
ORACLE["product_associations_part"] = oracle("SELECT * FROM assoc", ["raw_sales_itemwise", "product_aliases"],
                                             assoc_ctes(2, "barcode"))
ORACLE["bought_together"] = oracle(
    """SELECT t.barcode, t.other_barcode, COALESCE(p.canonical_name, d.product_name) AS canonical_name, p.category,
              ic.mrp, t.co_occurrences, t.lift, t.confidence, t.rank
       FROM (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY co_occurrences DESC, lift DESC,
                                          other_barcode) AS rank
             FROM (SELECT barcode_a AS barcode, barcode_b AS other_barcode, co_occurrences, lift,
                          confidence_a_to_b AS confidence FROM assoc
                   UNION ALL
                   SELECT barcode_b, barcode_a, co_occurrences, lift, confidence_b_to_a FROM assoc) u) t
       JOIN pdim d ON d.product_id = t.other_barcode
       LEFT JOIN products p ON p.barcode = t.other_barcode
       LEFT JOIN lic ic ON ic.product_id = t.other_barcode
       WHERE t.rank <= 5""",
    DIM_VIEWS, assoc_ctes(2, "barcode") + [c for c in _DIM_CTES if not c.startswith("amap")])

# ---------------------------------------------------------------- reconciliation
_RECON_SALES = f"""
    WITH_ITEMS AS (SELECT bill_no, sale_datetime_raw AS bill_datetime_raw, operator_name,
                          sale_location AS location_name, count(*) AS item_line_count, sum(sale_qty) AS iq,
                          sum({zc('taxable_amount')}) AS it, sum({zc('net_total')}) AS inet
                   FROM raw_sales_itemwise GROUP BY 1, 2, 3, 4)"""
_RECON_CTES = [
    _RECON_SALES.strip().replace("WITH_ITEMS", "ia"),
    """recon_sales AS (
        SELECT b.bill_no, b.bill_datetime_raw, b.operator_name, b.location_name,
               CAST(b.total_qty AS DOUBLE) AS bill_total_qty, CAST(b.taxable_amount AS DOUBLE) AS bill_taxable_amount,
               CAST(b.net_total AS DOUBLE) AS bill_net_total, CAST(b.round_off AS DOUBLE) AS bill_round_off,
               i.item_line_count, CAST(i.iq AS DOUBLE) AS total_item_qty, CAST(i.it AS DOUBLE) AS item_taxable_amount,
               CAST(i.inet AS DOUBLE) AS item_net_total,
               CAST(b.taxable_amount - i.it AS DOUBLE) AS delta_taxable_amount,
               CAST(b.net_total - i.inet AS DOUBLE) AS delta_net_total
        FROM raw_sales_billwise b LEFT JOIN ia i ON b.bill_no = i.bill_no AND b.bill_datetime_raw = i.bill_datetime_raw
             AND b.operator_name = i.operator_name AND b.location_name = i.location_name)""",
]
ORACLE["recon_sales_bill_vs_item"] = oracle("SELECT * FROM recon_sales", ["raw_sales_billwise", "raw_sales_itemwise"],
                                            _RECON_CTES)
ORACLE["recon_sales_discrepancies"] = oracle(
    "SELECT * FROM recon_sales WHERE abs(delta_net_total) <> 0 ORDER BY abs(delta_net_total) DESC",
    ["raw_sales_billwise", "raw_sales_itemwise"], _RECON_CTES)
ORACLE["recon_purchase_bill_vs_item"] = oracle(
    f"""SELECT b.purchase_id, b.invoice_no, b.purchase_date_raw, b.supplier_name_raw,
              CAST(b.total_qty AS DOUBLE) AS bill_total_qty, CAST(b.taxable_value AS DOUBLE) AS bill_taxable_value,
              i.item_line_count, CAST(i.iq AS DOUBLE) AS item_total_qty, CAST(i.it AS DOUBLE) AS item_taxable_value,
              CAST(b.total_qty - i.iq AS DOUBLE) AS delta_qty, CAST(b.taxable_value - i.it AS DOUBLE) AS delta_taxable_value
       FROM raw_purchase_billwise b LEFT JOIN (
            SELECT purchase_id, invoice_no, count(*) AS item_line_count, sum({zc('total_qty')}) AS iq,
                   sum({zc('taxable_value')}) AS it FROM raw_purchase_itemwise GROUP BY 1, 2) i
         ON b.purchase_id = i.purchase_id AND b.invoice_no = i.invoice_no""",
    ["raw_purchase_billwise", "raw_purchase_itemwise"])
ORACLE["recon_daily_quantity_flow"] = oracle(
    f"""SELECT COALESCE(p.day, s.day) AS day, CAST(p.q AS DOUBLE) AS purchased_qty, CAST(s.q AS DOUBLE) AS sold_qty,
              CAST(p.q - s.q AS DOUBLE) AS net_flow
       FROM (SELECT {ddate('purchase_date_raw')} AS day, sum({zc('total_qty')}) AS q FROM raw_purchase_itemwise
             WHERE {ddate('purchase_date_raw')} IS NOT NULL GROUP BY 1) p
       FULL OUTER JOIN (SELECT {pdate('sale_datetime_raw')} AS day, sum({zc('sale_qty')}) AS q FROM raw_sales_itemwise
             WHERE {pdate('sale_datetime_raw')} IS NOT NULL GROUP BY 1) s ON p.day = s.day""",
    ["raw_purchase_itemwise", "raw_sales_itemwise"])

# ---------------------------------------------------------------- reports
_REP_CTES = _LATEST_CTES + [
    f"""amc AS (SELECT product_id, {rnd('CAST(sum(qty) AS DOUBLE) / 6.0', 2)} AS avg_monthly_consumption
               FROM dense WHERE date > {AS_OF} - 180 GROUP BY product_id)""",
    "sup_c AS (SELECT product_id, string_agg(DISTINCT supplier_name, ', ' ORDER BY supplier_name) AS suppliers FROM psm GROUP BY product_id)",
    "sup_p AS (SELECT product_id, string_agg(DISTINCT supplier_name, ' | ' ORDER BY supplier_name) AS suppliers FROM psm GROUP BY product_id)",
    """hrow AS (SELECT h.*, pd.product_name, amc.avg_monthly_consumption FROM hl h
               LEFT JOIN pdim pd ON h.product_id = pd.product_id LEFT JOIN amc ON h.product_id = amc.product_id)""",
]
_REP_VIEWS = _ALL_VIEWS
_SIGNAL = """CASE WHEN fast_moving_flag THEN 'Fast Moving' WHEN slow_moving_flag THEN 'Slow Moving'
                 WHEN dead_stock_flag THEN 'Dead Stock' WHEN demand_spike_flag THEN 'Demand Spike' ELSE 'Normal' END"""

ORACLE["health_signals_page"] = oracle(
    """SELECT h.product_id, h.product_name, fast_moving_flag, slow_moving_flag, dead_stock_flag, demand_spike_flag,
              predicted_daily_demand, last_7_day_avg, last_30_day_avg, last_60_day_avg, demand_volatility,
              avg_monthly_consumption, s.suppliers, (SELECT count(*) FROM hl) AS total
       FROM hrow h LEFT JOIN sup_c s ON h.product_id = s.product_id
       ORDER BY predicted_daily_demand DESC NULLS LAST, h.product_id LIMIT 50""",
    _REP_VIEWS, _REP_CTES)
ORACLE["health_signals_middle_page"] = oracle(
    """SELECT h.product_id, h.product_name, fast_moving_flag, slow_moving_flag, dead_stock_flag, demand_spike_flag,
              predicted_daily_demand, last_7_day_avg, last_30_day_avg, last_60_day_avg, demand_volatility,
              avg_monthly_consumption, s.suppliers, (SELECT count(*) FROM hl) AS total
       FROM hrow h LEFT JOIN sup_c s ON h.product_id = s.product_id
       ORDER BY predicted_daily_demand DESC NULLS LAST, h.product_id LIMIT 50 OFFSET (SELECT count(*) // 2 FROM hl)""",
    _REP_VIEWS, _REP_CTES)
ORACLE["health_report"] = oracle(
    f"""SELECT h.product_name, h.product_id AS barcode, s.suppliers,
              COALESCE(avg_monthly_consumption, 0.0) AS avg_monthly_consumption,
              {rnd('last_30_day_avg', 3)} AS avg_daily_demand, {rnd('predicted_daily_demand', 3)} AS predicted_daily_demand,
              {rnd('last_7_day_avg', 3)} AS last_7_day_avg, {rnd('last_60_day_avg', 3)} AS last_60_day_avg,
              {rnd('demand_volatility * 100.0', 1)} AS volatility_pct, {_SIGNAL} AS signal
       FROM hrow h LEFT JOIN sup_p s ON h.product_id = s.product_id""",
    _REP_VIEWS, _REP_CTES)
ORACLE["supplier_report"] = oracle(
    f"""SELECT sm.supplier_name AS supplier, h.product_name, h.product_id AS barcode, ic.mrp, ic.purchase_price,
              COALESCE(avg_monthly_consumption, 0.0) AS avg_monthly_consumption,
              {rnd('predicted_daily_demand', 3)} AS predicted_daily_demand, {rnd('ic.current_stock', 0)} AS current_stock,
              {_SIGNAL} AS signal
       FROM hrow h JOIN psm sm ON h.product_id = sm.product_id LEFT JOIN lic ic ON h.product_id = ic.product_id""",
    _REP_VIEWS, _REP_CTES)
_URG = """CASE WHEN days_of_cover IS NULL THEN 'No Data'
               WHEN lead_time_days IS NOT NULL AND lead_time_days <> 0 AND days_of_cover < lead_time_days THEN 'Urgent'
               WHEN lead_time_days IS NOT NULL AND lead_time_days <> 0 AND days_of_cover < lead_time_days * 1.5 THEN 'Low'
               ELSE 'OK' END"""
_RITEMS = f"""SELECT product_id AS barcode, product_name, supplier_name, current_stock AS system_stock,
                     predicted_daily_demand, days_of_cover, min_stock, max_stock, required_quantity, lead_time_days,
                     {_URG} AS urgency FROM restock WHERE date = (SELECT max(date) FROM restock)"""
ORACLE["replenishment_page"] = oracle(
    f"""SELECT *, (SELECT count(*) FROM ({_RITEMS}) c) AS total FROM ({_RITEMS}) r
       ORDER BY days_of_cover ASC NULLS LAST, barcode LIMIT 100""", _REP_VIEWS, _REP_CTES)
ORACLE["replenishment_every_page"] = oracle(
    f"""SELECT *, CAST((rank - 1) // 100 + 1 AS BIGINT) AS page FROM (
          SELECT *, row_number() OVER (ORDER BY days_of_cover ASC NULLS LAST, barcode, supplier_name NULLS FIRST) AS rank,
                 count(*) OVER () AS total FROM ({_RITEMS}) r) x""", _REP_VIEWS, _REP_CTES)
ORACLE["supplier_restock_pages"] = oracle(
    f"""SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY supplier_name ORDER BY days_of_cover ASC NULLS LAST, barcode) AS rank,
                 count(*) OVER (PARTITION BY supplier_name) AS total
          FROM ({_RITEMS}) r WHERE supplier_name IS NOT NULL) x""", _REP_VIEWS, _REP_CTES)
ORACLE["supplier_restock_second_page"] = oracle(
    f"""SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY supplier_name ORDER BY days_of_cover ASC NULLS LAST, barcode) AS rank,
                 count(*) OVER (PARTITION BY supplier_name) AS total
          FROM ({_RITEMS}) r WHERE supplier_name IS NOT NULL) x WHERE rank > 10 AND rank <= 20""", _REP_VIEWS, _REP_CTES)
ORACLE["top_products"] = oracle(
    f"""SELECT row_number() OVER (ORDER BY s.rev DESC, s.product_id) AS rank, s.product_id AS barcode, pd.product_name,
              CAST(s.rev AS DOUBLE) AS total_revenue, CAST(s.qty AS DOUBLE) AS total_qty
       FROM (SELECT product_id, sum(rev) AS rev, sum(qty) AS qty FROM dense
             WHERE date >= {AS_OF} - 30 AND qty > 0 GROUP BY product_id) s
       LEFT JOIN pdim pd ON s.product_id = pd.product_id
       ORDER BY s.rev DESC, s.product_id LIMIT 10""", _REP_VIEWS, _REP_CTES)
ORACLE["top_products_by_qty"] = oracle(
    f"""SELECT CAST(rank AS BIGINT) AS rank, barcode, product_name, total_revenue, total_qty FROM (
          SELECT row_number() OVER (ORDER BY s.rev DESC, s.product_id) AS rank, s.product_id AS barcode,
                 pd.product_name, CAST(s.rev AS DOUBLE) AS total_revenue, CAST(s.qty AS DOUBLE) AS total_qty, s.qty
          FROM (SELECT product_id, sum(rev) AS rev, sum(qty) AS qty FROM dense
                WHERE date >= {AS_OF} - 30 AND qty > 0 GROUP BY product_id) s
          LEFT JOIN pdim pd ON s.product_id = pd.product_id) x
       ORDER BY qty DESC, barcode LIMIT 10""", _REP_VIEWS, _REP_CTES)
ORACLE["demand_trend"] = oracle(
    f"""SELECT product_id, date, CAST(qty AS DOUBLE) AS quantity_sold, CAST(rev AS DOUBLE) AS revenue,
              last_7_day_avg, last_30_day_avg,
              {rnd('greatest(0.6 * COALESCE(last_7_day_avg, 0.0) + 0.3 * COALESCE(last_30_day_avg, 0.0) + 0.1 * COALESCE(last_60_day_avg, 0.0), 0.02)', 4)} AS predicted_daily_demand
       FROM win2 WHERE date >= {AS_OF} - 60
         AND date <= (SELECT COALESCE(max(sale_date), {AS_OF} - 1) FROM daily_sales_summary)""",
    DENSE_VIEWS, _DENSE_CTES)
ORACLE["supplier_list"] = oracle(
    """SELECT m.supplier_name, l.supplier_region, CASE WHEN l.supplier_region = 'BELLARY' THEN 7 ELSE 15 END AS lead_time_days,
              count(m.product_id) AS product_count
       FROM psm m LEFT JOIN sloc l ON m.supplier_name = l.supplier_name GROUP BY m.supplier_name, l.supplier_region""",
    DIM_VIEWS, _DIM_CTES)
_CAT = """SELECT d.product_id, COALESCE(p.canonical_name, d.product_name) AS canonical_name, p.category, p.subcategory,
                 p.brand, p.product_type, p.size, p.colour, p.hsn_code, p.is_active, p.is_reviewed
          FROM pdim d LEFT JOIN products p ON d.product_id = p.barcode"""
ORACLE["product_search"] = oracle(
    f"""SELECT c.product_id AS barcode, c.canonical_name, c.category, ic.mrp FROM ({_CAT}) c
       LEFT JOIN lic ic ON c.product_id = ic.product_id
       WHERE c.canonical_name ILIKE '%ring%' OR c.product_id ILIKE '%ring%'
       ORDER BY c.canonical_name, c.product_id LIMIT 20""", DIM_VIEWS, _DIM_CTES)
ORACLE["product_list"] = oracle(
    f"""SELECT product_id AS barcode, canonical_name, category, subcategory, brand, product_type, size, colour,
              is_active, is_reviewed,
              (SELECT count(*) FROM ({_CAT}) x WHERE x.is_active IS NULL OR x.is_active) AS total
       FROM ({_CAT}) c WHERE c.is_active IS NULL OR c.is_active
       ORDER BY canonical_name, barcode LIMIT 50""", DIM_VIEWS, _DIM_CTES)
_CATALOG_N = f"(SELECT count(*) FROM ({_CAT}) x WHERE x.is_active IS NULL OR x.is_active)"
ORACLE["product_last_page"] = oracle(
    f"""SELECT product_id AS barcode, canonical_name, category, subcategory, brand, product_type, size, colour,
              is_active, is_reviewed, {_CATALOG_N} AS total
       FROM ({_CAT}) c WHERE c.is_active IS NULL OR c.is_active
       ORDER BY canonical_name NULLS FIRST, barcode LIMIT 50 OFFSET (SELECT greatest(0, {_CATALOG_N} - 1) // 50 * 50)""", DIM_VIEWS, _DIM_CTES)
ORACLE["product_detail"] = oracle(
    f"""SELECT c.product_id AS barcode, c.canonical_name, c.category, c.subcategory, c.brand, c.product_type, c.size,
              c.colour, c.hsn_code, c.is_active, c.is_reviewed, ic.mrp, ic.purchase_price, ic.current_stock AS system_stock,
              s.suppliers, amc.avg_monthly_consumption
       FROM ({_CAT}) c LEFT JOIN lic ic ON c.product_id = ic.product_id
       LEFT JOIN sup_c s ON c.product_id = s.product_id LEFT JOIN amc ON c.product_id = amc.product_id""",
    _REP_VIEWS, _REP_CTES)
_CUSTJ = """SELECT d.*, m.total_revenue, m.total_bills AS m_total_bills, m.avg_bill_value, m.total_discount_received,
                   m.days_since_last_visit, m.avg_days_between_visits, m.is_repeat, m.preferred_payment
            FROM customer_dimension d LEFT JOIN customer_metrics m ON d.mobile_clean = m.mobile_clean"""
ORACLE["customer_list"] = oracle(
    f"""SELECT mobile_clean, display_name, is_walk_in, is_member, first_seen_date, last_seen_date, total_bills,
              total_revenue, avg_bill_value, total_discount_received, days_since_last_visit, avg_days_between_visits,
              is_repeat, preferred_payment, (SELECT count(*) FROM ({_CUSTJ}) x WHERE NOT x.is_walk_in) AS total
       FROM ({_CUSTJ}) c WHERE NOT is_walk_in ORDER BY total_revenue DESC NULLS LAST, mobile_clean LIMIT 50""",
    ["raw_sales_billwise"], _CUST_CTES)
ORACLE["customer_every_page"] = oracle(
    f"""SELECT *, CAST((rank - 1) // 50 + 1 AS BIGINT) AS page FROM (
          SELECT mobile_clean, display_name, is_walk_in, is_member, first_seen_date, last_seen_date, total_bills,
                 total_revenue, avg_bill_value, total_discount_received, days_since_last_visit, avg_days_between_visits,
                 is_repeat, preferred_payment, count(*) OVER () AS total,
                 row_number() OVER (ORDER BY m_total_bills DESC NULLS LAST, mobile_clean) AS rank
          FROM ({_CUSTJ}) c WHERE NOT is_walk_in) x""",
    ["raw_sales_billwise"], _CUST_CTES)
ORACLE["customer_summary"] = oracle(
    f"""SELECT count(*) AS total_unique_customers, count(*) FILTER (WHERE is_repeat) AS repeat_customer_count,
              {rnd("CAST(count(*) FILTER (WHERE is_repeat) AS DOUBLE) * 100.0 / CAST(NULLIF(count(*), 0) AS DOUBLE)", 1)} AS repeat_customer_percent,
              {rnd("avg(avg_bill_value)", 4)} AS avg_bill_value,
              count(*) FILTER (WHERE is_member) AS members_count,
              count(*) FILTER (WHERE first_seen_date >= {AS_OF} - 30) AS new_customers_last_30d,
              {rnd("(SELECT CAST(sum(CAST(COALESCE(total_revenue, 0.0) AS DECIMAL(38,4))) AS DOUBLE) FROM customer_metrics WHERE mobile_clean = 'WALK-IN') * 100.0 / NULLIF((SELECT CAST(sum(CAST(total_revenue AS DECIMAL(38,4))) AS DOUBLE) FROM customer_metrics), 0.0)", 1)} AS walk_in_revenue_percent
       FROM ({_CUSTJ}) c WHERE NOT is_walk_in""",
    ["raw_sales_billwise"], _CUST_CTES)
_TS = ("COALESCE(try_strptime(sp, '%d-%m-%Y %I:%M %p'), try_strptime(sp, '%d-%m-%Y %H:%M'))")
ORACLE["customer_history"] = oracle(
    f"""SELECT mobile_clean, bill_no, net_total, total_discount, cash_total, card_total, upi_total, credit_total,
              rank, CAST(bill_ts AS DATE) AS bill_date FROM (
          SELECT *, row_number() OVER (PARTITION BY mobile_clean ORDER BY bill_ts DESC NULLS LAST, bill_no DESC) AS rank
          FROM (SELECT {MOBILE.format(c='customer_mobile_raw')} AS mobile_clean, bill_no,
                       CASE WHEN bill_datetime_raw IS NOT NULL AND regexp_matches(bill_datetime_raw, '^\\d{{2}}-\\d{{2}}-\\d{{4}}')
                            THEN {_TS} END AS bill_ts,
                       CAST(net_total AS DOUBLE) AS net_total, CAST(total_discount AS DOUBLE) AS total_discount,
                       CAST(COALESCE(actual_cash, cash_amount, 0) AS DOUBLE) AS cash_total,
                       CAST(COALESCE(card_amount, 0) AS DOUBLE) AS card_total,
                       CAST(COALESCE(google_pay_amount, 0) + COALESCE(phonepe_amount, 0) + COALESCE(paytm_amount, 0) AS DOUBLE) AS upi_total,
                       CAST(COALESCE(credit_amount, 0) AS DOUBLE) AS credit_total
                FROM (SELECT *, trim(CASE WHEN substr(bill_datetime_raw, 11, 1) = ' ' THEN bill_datetime_raw
                                          ELSE substr(bill_datetime_raw, 1, 10) || ' ' || substr(bill_datetime_raw, 11) END) AS sp
                      FROM raw_sales_billwise) b) y
          WHERE mobile_clean IS NOT NULL) z""",
    ["raw_sales_billwise"])
ORACLE["data_freshness"] = oracle(
    f"SELECT max(sale_date) AS last_data_date, CAST({AS_OF} - max(sale_date) AS BIGINT) AS days_behind FROM daily_sales_summary",
    DSS_VIEWS, _DSS_CTES)
ORACLE["kpi_summary"] = oracle(
    f"""SELECT (SELECT max(sale_date) FROM daily_sales_summary) AS latest_date,
          (SELECT CAST(sum(CAST(total_revenue AS DECIMAL(38,4))) AS DOUBLE) FROM daily_sales_summary WHERE sale_date >= (SELECT max(sale_date) FROM daily_sales_summary) - 6) AS total_revenue_last_7d,
          (SELECT sum(total_bills) FROM daily_sales_summary WHERE sale_date >= (SELECT max(sale_date) FROM daily_sales_summary) - 6) AS total_bills_last_7d,
          (SELECT CAST(sum(CAST(total_taxable_value AS DECIMAL(38,4))) AS DOUBLE) FROM daily_purchase_summary WHERE purchase_date >= (SELECT max(sale_date) FROM daily_sales_summary) - 6) AS total_purchases_last_7d,
          (SELECT sum(total_purchase_bills) FROM daily_purchase_summary WHERE purchase_date >= (SELECT max(sale_date) FROM daily_sales_summary) - 6) AS total_purchase_bills_last_7d,
          (SELECT CAST(sum(CAST(COALESCE(total_due_amount, 0.0) AS DECIMAL(38,4))) AS DOUBLE) FROM daily_purchase_summary WHERE purchase_date >= (SELECT max(sale_date) FROM daily_sales_summary) - 6) AS total_credit_last_7d,
          (SELECT count(*) FILTER (WHERE fast_moving_flag) FROM hl WHERE date = (SELECT max(sale_date) FROM daily_sales_summary)) AS fast_moving_count,
          (SELECT count(*) FILTER (WHERE slow_moving_flag) FROM hl WHERE date = (SELECT max(sale_date) FROM daily_sales_summary)) AS slow_moving_count,
          (SELECT count(*) FILTER (WHERE dead_stock_flag) FROM hl WHERE date = (SELECT max(sale_date) FROM daily_sales_summary)) AS dead_stock_count,
          (SELECT count(*) FILTER (WHERE demand_spike_flag) FROM hl WHERE date = (SELECT max(sale_date) FROM daily_sales_summary)) AS demand_spike_count,
          (SELECT count(*) FROM restock WHERE date = (SELECT max(sale_date) FROM daily_sales_summary) AND required_quantity > 0) AS products_needing_reorder,
          (SELECT count(*) FILTER (WHERE NOT is_walk_in) FROM ({_CUSTJ}) c) AS total_unique_customers,
          (SELECT count(*) FILTER (WHERE COALESCE(is_repeat, false) AND NOT is_walk_in) FROM ({_CUSTJ}) c) AS repeat_customer_count,
          (SELECT CASE WHEN count(*) FILTER (WHERE NOT is_walk_in) > 0 THEN
                  {rnd("CAST(count(*) FILTER (WHERE COALESCE(is_repeat, false) AND NOT is_walk_in) AS DOUBLE) / CAST(count(*) FILTER (WHERE NOT is_walk_in) AS DOUBLE) * 100.0", 1)} END
           FROM ({_CUSTJ}) c) AS repeat_customer_percent,
          (SELECT count(*) FILTER (WHERE first_seen_date >= {AS_OF} - 30 AND NOT is_walk_in) FROM ({_CUSTJ}) c) AS new_customers_last_30d,
          (SELECT {rnd("100.0 * CAST(sum(CAST(total_revenue AS DECIMAL(38,4))) FILTER (WHERE mobile_clean = 'WALK-IN') AS DOUBLE) / NULLIF(CAST(sum(CAST(total_revenue AS DECIMAL(38,4))) AS DOUBLE), 0.0)", 1)} FROM customer_metrics) AS walk_in_revenue_percent""",
    sorted(set(_REP_VIEWS + ["raw_purchase_billwise", "raw_sales_billwise"])),
    _REP_CTES + _DPS_CTES + [c for c in _CUST_CTES])

# ---------------------------------------------------------------- entity, ingest, misc
ORACLE["alias_violations"] = """
WITH al AS (
  SELECT CAST(p_partkey AS VARCHAR) AS alias_barcode, CAST(p_partkey - 1 AS VARCHAR) AS canonical_barcode FROM part WHERE p_partkey % 50 = 49
  UNION ALL
  SELECT CAST(p_partkey - 1 AS VARCHAR), CAST(p_partkey - 2 AS VARCHAR) FROM part WHERE p_partkey % 100 = 99)
SELECT *, 'canonical_is_alias' AS reason FROM al WHERE canonical_barcode IN (SELECT alias_barcode FROM al)
UNION ALL
SELECT *, 'alias_is_canonical' FROM al WHERE alias_barcode IN (SELECT canonical_barcode FROM al)
"""
ORACLE["alias_list"] = oracle(
    """SELECT a.alias_barcode, a.canonical_barcode, p.canonical_name, CAST(a.similarity_score AS DOUBLE) AS similarity_score,
              a.confirmed_at, a.notes
       FROM product_aliases a LEFT JOIN products p ON a.canonical_barcode = p.barcode""",
    ["product_aliases", "products"])
ORACLE["entity_product_facts"] = oracle(
    f"""SELECT m.barcode, m.item_name_raw AS item_name, m.brand_raw AS brand, CAST(m.mrp AS DOUBLE) AS mrp,
              CAST(m.purchase_price AS DOUBLE) AS purchase_price, CAST(m.rate AS DOUBLE) AS rate, m.size_raw AS size,
              m.expiry_date_raw AS expiry_date, m.hsn_code, CAST(m.system_stock_snapshot AS DOUBLE) AS system_stock,
              COALESCE(s.q, 0.0) AS total_sales_qty, s.last_sold
       FROM (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY imported_at DESC, import_batch_id DESC) AS rn
             FROM raw_item_combinations) m
       LEFT JOIN (SELECT barcode, CAST(sum(COALESCE(sale_qty, 0)) AS DOUBLE) AS q,
                         max(CASE WHEN sale_datetime_raw IS NOT NULL AND regexp_matches(sale_datetime_raw, '^\\d{{2}}-\\d{{2}}-\\d{{4}}')
                                  THEN {_TS} END) AS last_sold
                  FROM (SELECT *, trim(CASE WHEN substr(sale_datetime_raw, 11, 1) = ' ' THEN sale_datetime_raw
                                            ELSE substr(sale_datetime_raw, 1, 10) || ' ' || substr(sale_datetime_raw, 11) END) AS sp
                        FROM raw_sales_itemwise) x GROUP BY barcode) s ON m.barcode = s.barcode
       WHERE m.rn = 1""",
    ["raw_item_combinations", "raw_sales_itemwise"])
ORACLE["filter_query"] = oracle(
    """SELECT bill_no, bill_datetime_raw, operator_name, CAST(net_total AS DOUBLE) AS net_total FROM raw_sales_billwise
       WHERE operator_name IN ('1-URGENT', '2-HIGH') AND net_total >= 100000""", ["raw_sales_billwise"])
ORACLE["load_dedup"] = oracle(
    """SELECT bill_no, barcode, line_no, CAST(sale_qty AS DOUBLE) AS sale_qty FROM (
          SELECT *, row_number() OVER (PARTITION BY bill_no, barcode ORDER BY line_no) AS rn FROM raw_sales_itemwise
          WHERE bill_no IS NOT NULL AND barcode IS NOT NULL) f
       WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM raw_sales_itemwise e WHERE e.imported_at < TIMESTAMP '1998-01-01'
                                    AND e.bill_no = f.bill_no AND e.barcode = f.barcode)
       UNION ALL
       SELECT bill_no, barcode, line_no, CAST(sale_qty AS DOUBLE) FROM raw_sales_itemwise
       WHERE bill_no IS NULL OR barcode IS NULL""", ["raw_sales_itemwise"])
ORACLE["upsert"] = oracle(
    """SELECT barcode, item_name_raw, CAST(mrp AS DOUBLE) AS mrp, import_batch_id FROM raw_item_combinations
       WHERE import_batch_id = 1 AND barcode NOT IN (SELECT barcode FROM raw_item_combinations WHERE import_batch_id = 2)
       UNION ALL
       SELECT barcode, item_name_raw, CAST(mrp AS DOUBLE), import_batch_id FROM raw_item_combinations
       WHERE import_batch_id = 2""", ["raw_item_combinations"])
def _exported_bills() -> tuple[list[str], list[str]]:
    """(CTEs, select list) of the exported bills: bill columns, and the fixture's values for the others."""
    from ..sources.ingest import HEADER_MAP, NUMERIC
    import re
    known = set(re.findall(r" AS (\w+),?\n", VIEWS["raw_sales_billwise"])) | {"imported_at"}
    out = []
    for i, c in enumerate(HEADER_MAP["sales_billwise"].values()):
        num = c in NUMERIC["sales_billwise"]
        value = c if c in known else f"CAST(bill_no AS BIGINT) % {i + 2}" if num else f"'{c} ' || CAST(CAST(bill_no AS BIGINT) % {i + 2} AS VARCHAR)"
        if c == "paytm_amount":  # the files of every third slice lack it
            value = f"CASE WHEN slice % 3 <> 2 THEN {value} END"
        out.append(f"CAST({value} AS DOUBLE) AS {c}" if num else f"{value} AS {c}")
    ctes = ["n AS (SELECT greatest(24, CAST(ceil(count(*) / 100000) AS BIGINT)) AS slices FROM orders)",
            "bills AS (SELECT b.*, CAST(bill_no AS BIGINT) % n.slices AS slice FROM raw_sales_billwise b, n)"]
    return ctes, out


_EXP_CTES, _EXP_COLUMNS = _exported_bills()
ORACLE["ingest_report"] = oracle(f"SELECT {', '.join(_EXP_COLUMNS)}, CAST(1 AS BIGINT) AS import_batch_id FROM bills", ["raw_sales_billwise"], _EXP_CTES)
ORACLE["stream_ingest"] = oracle(f"SELECT {', '.join(_EXP_COLUMNS)} FROM bills", ["raw_sales_billwise"], _EXP_CTES)
ORACLE["ingest_manifest"] = oracle(
    "SELECT DISTINCT slice, 'sales_billwise' AS report_type, slice % 3 <> 0 AS is_new FROM bills", ["raw_sales_billwise"], _EXP_CTES)
ORACLE["ingest_ledger"] = oracle(
    """SELECT CASE WHEN slice % 3 = 0 THEN 1 ELSE 2 END AS batch, slice, 'sales_billwise' AS report_type,
              CASE WHEN slice % 3 <> 2 THEN count(*) END AS row_count,
              CASE WHEN slice % 3 <> 2 THEN 'SUCCESS' ELSE 'FAILED' END AS status,
              CASE WHEN slice % 3 = 2 THEN 'missing required columns: Net Total' END AS error_message,
              CASE WHEN slice % 3 <> 2 THEN count(*) ELSE 0 END AS loaded
       FROM bills GROUP BY slice""", ["raw_sales_billwise"], _EXP_CTES)
ORACLE["latest_file"] = oracle(
    "SELECT 'sales_billwise' AS report_type, count(DISTINCT slice) AS files, CAST(1 AS BIGINT) AS newest FROM bills", ["raw_sales_billwise"], _EXP_CTES)
_DIRTY = """SELECT '{t}' AS "table", 'null_date' AS reason, count(*) FILTER (k % {n} = 0) AS rows FROM ({v})
UNION ALL SELECT '{t}', 'bad_date', count(*) FILTER (k % {n} IN (1, 2) OR (k % {n} > 2 AND {bad})) FROM ({v})"""
_CODE = """UNION ALL SELECT '{t}', 'null_barcode', count(*) FILTER (k % {n} = 0 OR barcode IS NULL) FROM ({v})"""
_BK = "SELECT *, CAST(bill_no AS BIGINT) AS k FROM {}"
_IK = "SELECT *, CAST(regexp_extract(invoice_no, '([0-9]+)', 1) AS BIGINT) AS k FROM {}"
_ISO = "NOT regexp_matches({}, '^[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}')"
ORACLE["quarantine_counts"] = oracle("\nUNION ALL ".join([
    _DIRTY.format(t="raw_sales_billwise", n=101, v=_BK.format("raw_sales_billwise"), bad=_ISO.format("bill_datetime_raw")),
    _DIRTY.format(t="raw_sales_itemwise", n=103, v=_BK.format("raw_sales_itemwise"), bad=_ISO.format("sale_datetime_raw")),
    _CODE.format(t="raw_sales_itemwise", n=107, v=_BK.format("raw_sales_itemwise")).removeprefix("UNION ALL "),
    _DIRTY.format(t="raw_purchase_billwise", n=109, v=_IK.format("raw_purchase_billwise"), bad="false"),
    _DIRTY.format(t="raw_purchase_itemwise", n=113, v=_IK.format("raw_purchase_itemwise"), bad="false"),
    _CODE.format(t="raw_purchase_itemwise", n=127, v=_IK.format("raw_purchase_itemwise")).removeprefix("UNION ALL "),
]), ["raw_sales_billwise", "raw_sales_itemwise", "raw_purchase_billwise", "raw_purchase_itemwise"])
_DAY_SQL = """SELECT sale_date, total_bills, CAST(rev AS DOUBLE) AS total_revenue FROM b"""
ORACLE["stream_daily_sales"] = oracle(_DAY_SQL, DSS_VIEWS, _DSS_CTES)
ORACLE["stream_recomputed_days"] = oracle(_DAY_SQL, DSS_VIEWS, _DSS_CTES)
ORACLE["stream_daily_payments"] = ORACLE["daily_payment_breakdown"]
ORACLE["bulk_categorize"] = oracle(
    """SELECT * FROM (
         SELECT CASE WHEN CAST(barcode AS BIGINT) % 5 = 0 THEN 'Spices' ELSE category END AS category, count(*) AS products,
                count(*) FILTER (CAST(barcode AS BIGINT) % 5 = 0 OR is_reviewed) AS reviewed
         FROM products GROUP BY 1) p,
       (SELECT count(*) FILTER (p_partkey % 3 = 0) AS updated, count(*) FILTER (p_partkey % 3 <> 0) AS skipped
        FROM part WHERE p_partkey % 5 = 0) c""", ["products"])

# ---------------------------------------------------------------- cash closure, offers
ORACLE["cash_closure"] = """
WITH per AS (SELECT CAST(ts AS DATE) AS closure_date, event_type,
                    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM events GROUP BY 1, 2),
scal AS (SELECT closure_date,
                max(CASE WHEN event_type = 'signup' THEN amount END) AS opening_cash,
                max(CASE WHEN event_type = 'purchase' THEN amount END) AS net_sales,
                max(CASE WHEN event_type = 'view' THEN amount END) AS card_amount,
                max(CASE WHEN event_type = 'click' THEN amount END) AS click_amt,
                max(CASE WHEN event_type = 'error' THEN amount END) AS error_amt
         FROM per GROUP BY 1),
notes AS (SELECT CAST(ts AS DATE) AS closure_date,
                 CAST(sum(list_extract([500, 200, 100, 50, 20, 10, 5, 2, 1], CAST(user_id % 9 + 1 AS INTEGER))) AS DOUBLE) AS cash
          FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1),
tot AS (SELECT s.closure_date,
               COALESCE(opening_cash, 0.0) + COALESCE(net_sales, 0.0) + COALESCE(click_amt, 0.0) AS inside,
               COALESCE(card_amount, 0.0) + COALESCE(error_amt, 0.0) AS outside,
               CASE WHEN dayofmonth(s.closure_date) % 5 <> 0 THEN net_sales END AS physical,
               COALESCE(n.cash, 0.0) AS denomination_cash
        FROM scal s LEFT JOIN notes n ON s.closure_date = n.closure_date)
SELECT closure_date,
       CAST(round(CAST(inside AS DECIMAL(28,10)), 2) AS DOUBLE) AS total_inside_counter,
       CAST(round(CAST(outside AS DECIMAL(28,10)), 2) AS DOUBLE) AS total_outside_counter,
       CAST(round(CAST(inside - outside AS DECIMAL(28,10)), 2) AS DOUBLE) AS expected_cash,
       physical AS physical_cash_counted,
       CASE WHEN physical IS NOT NULL THEN CAST(round(CAST(physical - (inside - outside) AS DECIMAL(28,10)), 2) AS DOUBLE) END
           AS difference_amount,
       denomination_cash
FROM tot"""

ORACLE["offer_pricing"] = """
WITH sheet AS (
    SELECT p_partkey AS sort_order,
           NULLIF(trim(CASE WHEN p_partkey % 97 = 0 THEN ' ' ELSE p_name END), '') AS name,
           NULLIF(TRY_CAST(NULLIF(trim(CASE WHEN p_partkey % 89 = 0 THEN 'NA' ELSE CAST(p_retailprice AS VARCHAR) END), '')
                           AS DOUBLE), 0.0) AS mrp,
           lower(trim(CASE p_partkey % 4 WHEN 0 THEN 'Percent' WHEN 1 THEN 'amount' WHEN 2 THEN 'combo' ELSE 'unknown' END)) AS dtype,
           NULLIF(trim(CASE p_partkey % 4 WHEN 0 THEN CAST(p_size % 30 + 5 AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR)
                            WHEN 2 THEN 'Buy 1 Get 1' ELSE '' END), '') AS draw,
           'img/' || CAST(p_partkey AS VARCHAR) || '.png' AS image_url
    FROM part),
v AS (SELECT *, TRY_CAST(draw AS DOUBLE) AS dval FROM sheet WHERE name IS NOT NULL),
w AS (SELECT *, (mrp IS NOT NULL AND dval IS NOT NULL AND dval <> 0) AS ok FROM v)
SELECT name AS display_name, mrp AS original_price,
       CASE WHEN dtype = 'percent' AND ok THEN CAST(round(CAST(mrp * (1.0 - dval / 100.0) AS DECIMAL(28,10)), 2) AS DOUBLE)
            WHEN dtype = 'amount' AND ok THEN CAST(round(CAST(mrp - dval AS DECIMAL(28,10)), 2) AS DOUBLE) END AS offer_price,
       CASE WHEN dtype = 'percent' AND ok THEN CAST(CAST(trunc(dval) AS INTEGER) AS VARCHAR) || '% OFF'
            WHEN dtype = 'amount' AND ok THEN 'Save ₹' || CAST(CAST(trunc(dval) AS INTEGER) AS VARCHAR)
            WHEN dtype IN ('combo', 'text') AND draw IS NOT NULL THEN draw END AS highlight_text,
       image_url, sort_order
FROM w"""

# ---------------------------------------------------------------- exports read back
ORACLE["supplier_sheets"] = f"""
SELECT COALESCE(supplier_name, NULL) AS supplier_name, count(*) AS lines, CAST(1 AS BIGINT) AS folders, count(*) AS blank
FROM ({ORACLE["supplier_purchase_sheet"]}) s GROUP BY supplier_name"""
ORACLE["csv_exports"] = f"""
SELECT 'health_report' AS report, count(*) AS rows FROM ({ORACLE["health_report"]}) a
UNION ALL SELECT 'supplier_report', count(*) FROM ({ORACLE["supplier_report"]}) b
UNION ALL SELECT 'conversion_sheet', count(*) FROM ({ORACLE["conversion_attention_sheet"]}) c"""

# the written files read back cell by cell
for _key, _of in (("csv_health_report", "health_report"), ("csv_supplier_report", "supplier_report"), ("csv_conversion_sheet", "conversion_attention_sheet"),
                  ("supplier_sheet_lines", "supplier_purchase_sheet"), ("stream_item_master", "latest_item_combinations"), ("stream_supplier_location", "supplier_location")):
    ORACLE[_key] = ORACLE[_of]
ORACLE |= EXPORTS
