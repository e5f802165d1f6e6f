"""DuckDB twin of ``basketry.sources.fixtures`` for the correctness oracle.

Each raw table is a CTE over the pre-registered base views (orders, lineitem,
...). ``oracle(body, views)`` prefixes a query with the CTEs it names.
"""

from __future__ import annotations

AS_OF = "DATE '2001-08-01'"

_BILL_DT = """CASE
        WHEN {k} % 97 = 0 THEN strftime({d}, '%Y-%m-%d') || ' 10:15'
        WHEN {k} % 4 = 0 THEN strftime({d}, '%d-%m-%Y') || '07:29 AM'
        WHEN {k} % 4 = 1 THEN strftime({d}, '%d-%m-%Y') || ' 07:29 AM'
        WHEN {k} % 4 = 2 THEN strftime({d}, '%d-%m-%Y') || ' 18:30'
        ELSE strftime({d}, '%d-%m-%Y') || '11:45 PM' END"""

VIEWS: dict[str, str] = {}

VIEWS["raw_sales_billwise"] = f"""
SELECT
    CAST(o_orderkey AS VARCHAR) AS bill_no,
    {_BILL_DT.format(k='o_orderkey', d='o_orderdate')} AS bill_datetime_raw,
    o_orderpriority AS operator_name,
    'Main' AS location_name,
    CASE WHEN o_custkey % 25 = 0 THEN 'CASH' ELSE c_name END AS customer_name_raw,
    CASE WHEN o_custkey % 10 = 9 THEN '12345'
         ELSE (CASE o_custkey % 4 WHEN 0 THEN '+91 ' WHEN 1 THEN '0' WHEN 2 THEN '91' ELSE '' END)
              || '9' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS customer_mobile_raw,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS net_total,
    CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.95 AS DECIMAL(3,2)), 2) AS DECIMAL(18,4)) AS taxable_amount,
    CAST(0 AS DECIMAL(18,4)) AS round_off,
    CAST(o_orderkey % 7 + 1 AS DECIMAL(18,4)) AS total_qty,
    CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,4)) AS total_discount,
    CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS membercard_discount,
    CAST(CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS DECIMAL(18,4)) AS cash_amount,
    CAST(CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,4)) AS actual_cash,
    CAST(CASE WHEN o_orderkey % 5 = 1 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS DECIMAL(18,4)) AS card_amount,
    CAST(CASE WHEN o_orderkey % 5 = 2 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS DECIMAL(18,4)) AS google_pay_amount,
    CAST(CASE WHEN o_orderkey % 5 = 3 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS DECIMAL(18,4)) AS phonepe_amount,
    CAST(0 AS DECIMAL(18,4)) AS paytm_amount,
    CAST(CASE WHEN o_orderkey % 5 = 4 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS DECIMAL(18,4)) AS credit_amount,
    CAST(0 AS DECIMAL(18,4)) AS cn_amount,
    o_orderdate AS imported_at
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""

VIEWS["raw_sales_itemwise"] = f"""
SELECT
    CAST(l_orderkey AS VARCHAR) AS bill_no,
    {_BILL_DT.format(k='l_orderkey', d='o_orderdate')} AS sale_datetime_raw,
    o_orderpriority AS operator_name,
    'Main' AS sale_location,
    CAST(l_partkey AS VARCHAR) AS barcode,
    CAST(l_linenumber AS BIGINT) AS line_no,
    p_name || ' ' || CAST(p_size AS VARCHAR) || 'KG' AS item_name_raw,
    p_brand AS brand_raw,
    lpad(CAST(p_size AS VARCHAR), 2, '0') || '01' AS hsn_code,
    CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS sale_qty,
    CAST(0 AS DECIMAL(18,4)) AS free_qty,
    CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS mrp,
    CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(18,2))), 2) AS DECIMAL(18,4)) AS taxable_amount,
    CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(18,2)))
               * (CAST(1 AS DECIMAL(3,2)) + CAST(l_tax AS DECIMAL(18,2))), 2) AS DECIMAL(18,4)) AS net_total,
    o_orderdate AS imported_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey"""

_PURCHASE_LINES = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, s_name
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
    WHERE l_returnflag = 'R' AND l_partkey % 20 <> 7"""

VIEWS["raw_purchase_itemwise"] = f"""
SELECT
    CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS purchase_id,
    'INV-' || CAST(l_orderkey AS VARCHAR) AS invoice_no,
    strftime(l_shipdate, '%d-%m-%Y') AS purchase_date_raw,
    s_name AS supplier_name_raw,
    CAST(l_partkey AS VARCHAR) AS barcode,
    CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS total_qty,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS taxable_value,
    l_shipdate AS imported_at
FROM ({_PURCHASE_LINES}) pl"""

VIEWS["raw_purchase_billwise"] = f"""
SELECT
    CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS purchase_id,
    'INV-' || CAST(l_orderkey AS VARCHAR) AS invoice_no,
    strftime(ship, '%d-%m-%Y') AS purchase_date_raw,
    s_name AS supplier_name_raw,
    CAST(qty AS DECIMAL(18,4)) AS total_qty,
    CAST(taxable AS DECIMAL(18,4)) AS taxable_value,
    CAST(round(taxable * CAST(0.8 AS DECIMAL(2,1)), 2) AS DECIMAL(18,4)) AS settled_amount,
    CAST(taxable - round(taxable * CAST(0.8 AS DECIMAL(2,1)), 2) AS DECIMAL(18,4)) AS due_amount,
    ship AS imported_at
FROM (
    SELECT l_orderkey, l_suppkey, s_name, min(l_shipdate) AS ship,
           sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty,
           sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS taxable
    FROM ({_PURCHASE_LINES}) pl
    WHERE l_orderkey % 50 <> 0
    GROUP BY l_orderkey, l_suppkey, s_name) g"""

VIEWS["raw_supplier_master"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS supplier_code, s_name AS supplier_name_raw, n_name AS city_raw,
       1 AS import_batch_id, TIMESTAMP '2001-01-01 00:00:00' AS imported_at
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT CAST(s_suppkey AS VARCHAR), s_name,
       CASE WHEN n_regionkey = 0 THEN 'Bellary' ELSE n_name END,
       2, TIMESTAMP '2001-06-01 00:00:00'
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"""

_ITEM_BATCH = """
SELECT CAST(p_partkey AS VARCHAR) AS barcode, {name} AS item_name_raw,
       lpad(CAST(p_size AS VARCHAR), 2, '0') || '01' AS hsn_code, p_brand AS brand_raw,
       CAST(p_size AS VARCHAR) || 'KG' AS size_raw, CAST(NULL AS VARCHAR) AS colour_raw,
       CAST({mrp} AS DECIMAL(18,4)) AS mrp,
       CAST(round({mrp} * CAST(0.75 AS DECIMAL(3,2)), 2) AS DECIMAL(18,4)) AS purchase_price,
       CAST(round({mrp} * CAST(0.9 AS DECIMAL(2,1)), 2) AS DECIMAL(18,4)) AS rate,
       CAST({stock} AS DECIMAL(18,4)) AS system_stock_snapshot,
       CAST(NULL AS VARCHAR) AS expiry_date_raw,
       {bid} AS import_batch_id, TIMESTAMP '{ts}' AS imported_at
FROM part {where}"""

VIEWS["raw_item_combinations"] = (
    _ITEM_BATCH.format(name="upper(p_name)", mrp="(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(1.1 AS DECIMAL(2,1)))",
                       stock="p_partkey % 40 + 5", bid=1, ts="2001-01-01 00:00:00", where="")
    + "\nUNION ALL\n"
    + _ITEM_BATCH.format(name="p_name || ' ' || CAST(p_size AS VARCHAR) || 'KG'",
                         mrp="CAST(p_retailprice AS DECIMAL(18,2))", stock="p_partkey % 40", bid=2,
                         ts="2001-06-01 00:00:00", where="WHERE p_partkey % 4 <> 0")
)

VIEWS["product_aliases"] = """
SELECT CAST(p_partkey AS VARCHAR) AS alias_barcode, CAST(p_partkey - 1 AS VARCHAR) AS canonical_barcode,
       CAST(90 AS DECIMAL(5,2)) AS similarity_score, TIMESTAMP '2001-07-01 00:00:00' AS confirmed_at, 'fixture' AS notes
FROM part WHERE p_partkey % 50 = 49"""

VIEWS["products"] = """
SELECT CAST(p_partkey AS VARCHAR) AS barcode, upper(p_name) AS canonical_name, p_type AS category,
       CAST(NULL AS VARCHAR) AS subcategory,
       p_brand AS brand, lpad(CAST(p_size AS VARCHAR), 2, '0') || '01' AS hsn_code,
       CAST(p_size AS VARCHAR) || 'KG' AS size, CAST(NULL AS VARCHAR) AS colour,
       'retail' AS product_type, p_partkey % 2 = 0 AS is_reviewed,
       CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS is_active
FROM part WHERE p_partkey % 3 = 0"""


def oracle(body: str, views: list[str], ctes: list[str] | None = None) -> str:
    """``WITH <raw views>, <extra ctes> <body>``."""
    parts = [f"{v} AS ({VIEWS[v]}\n)" for v in views]
    parts += list(ctes or [])
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
