"""DuckDB SQL of the ingested exports, files, names, products and filters.

Column names stand here as plain lists of their own, in the order of the exports.
"""

from __future__ import annotations

import re

from .views import VIEWS, oracle

# Raw columns of each report; numbers are marked with a star.
COLUMNS = {
    "sales_itemwise": """
        store_name sale_location operator_name bill_no sale_datetime_raw sale_to customer_name mobile gstin item_name_raw barcode hsn_code brand_raw size_raw
        colour_raw style_raw expiry_date_raw *sale_qty *free_qty *current_stock_snapshot *mrp *total_mrp *rate *total_rate *discount_percent *discount_amount
        *other_discount_amount *total_discount_amount *taxable_amount *igst_percent *igst_amount *cgst_percent *cgst_amount *sgst_percent *sgst_amount
        *cess_percent *cess_amount *gross_amount *round_off *net_total""",
    "purchase_itemwise": """
        purchase_id purchase_reference_id invoice_no purchase_date_raw supplier_name_raw barcode item_name_raw hsn_code tax_type gst_percent *min_stock
        *max_stock expiry_date_raw brand_raw *qty_phm *free_qty_phm *qty_wh *free_qty_wh *total_qty *profit_percent *taxable_value *mrp *rate""",
    "purchase_billwise": """
        location_name *age purchase_id ref_id invoice_no purchase_date_raw purchase_time_raw supplier_name_raw supplier_type status *total_qty
        *total_disc1_amount *extra_disc_amount *taxable_value *gst_0 *gst_3 *gst_5 *gst_12 *gst_18 *gst_28 *gst_40 *tax_amount *round_off *settled_amount
        *due_amount""",
    "supplier_master": """
        supplier_id_raw status_raw supplier_code_raw supplier_name_raw location_raw address_raw mobile_raw email_raw supplier_date_raw city_raw country_raw
        state_raw register_type_raw gstin_raw tin_no_raw pan_no_raw registered_invoice_start_duration_raw supplier_category_raw create_ledger_raw
        closing_balance_raw""",
    "item_combinations": """
        item_id_raw barcode item_name_raw hsn_code tax_category_raw brand_raw size_raw colour_raw style_raw expiry_date_raw *purchase_price *mrp *rate
        *system_stock_snapshot""",
}

#: A row's number, as the fixture takes it, and the raw view of each report.
ROW = {
    "sales_itemwise": ("raw_sales_itemwise", "CAST(bill_no AS BIGINT) * 8 + line_no"),
    "purchase_itemwise": ("raw_purchase_itemwise", "CAST(regexp_extract(invoice_no, '([0-9]+)', 1) AS BIGINT) + CAST(barcode AS BIGINT)"),
    "purchase_billwise": ("raw_purchase_billwise", "CAST(regexp_extract(invoice_no, '([0-9]+)', 1) AS BIGINT)"),
    "supplier_master": ("raw_supplier_master", "CAST(supplier_code AS BIGINT) * 2 + import_batch_id"),
    "item_combinations": ("raw_item_combinations", "CAST(barcode AS BIGINT) * 2 + import_batch_id"),
}
ORACLE: dict[str, str] = {}


def _known(view: str) -> set[str]:
    return set(re.findall(r" AS (\w+)(?:,|\n|\s*$|\s+FROM)", VIEWS[view]))


def _report(report: str) -> tuple[list[str], str, bool]:
    """(select list, rows with their number n, whether a numeric cell of some rows is broken)."""
    view, n = ROW[report]
    known, out = _known(view), []
    names = [(c.lstrip("*"), c.startswith("*")) for c in COLUMNS[report].split()]
    text = next(c for c, num in names if c not in known and not num)
    number = next((c for c, num in names if c not in known and num), None)
    for i, (c, num) in enumerate(names):
        if c in known:
            out.append(f"CAST({c} AS DOUBLE) AS {c}" if num else f"{c} AS {c}")
        elif num:
            value = f"CAST(n % {i + 2} AS DOUBLE)"
            out.append(f"{f'CASE WHEN n % 13 <> 6 THEN {value} END' if c == number else value} AS {c}")
        else:
            value = f"'{c} ' || CAST(n % {i + 2} AS VARCHAR)"
            if c == text:
                value = (f"""CASE n % 11 WHEN 3 THEN 'Oil "A"' || chr(10) || '5, tin' WHEN 5 THEN 'padded' WHEN 6 THEN NULL """
                         f"""WHEN 7 THEN '2796' WHEN 8 THEN '"' ELSE {value} END""")
            out.append(f"{value} AS {c}")
    return out, f"r AS (SELECT *, {n} AS n FROM {view})", number is not None


for _name in COLUMNS:
    _select, _rows, _broken = _report(_name)
    ORACLE[f"ingest_{_name}"] = oracle(
        f"SELECT {', '.join(_select)} FROM r" + (" WHERE n % 13 NOT IN (4, 5)" if _broken else ""), [ROW[_name][0]], [_rows])
_REASON = {"sales_itemwise": "current_stock_snapshot", "purchase_itemwise": "min_stock", "purchase_billwise": "age"}
ORACLE["ingest_quarantine"] = oracle("\nUNION ALL ".join(
    f"SELECT '{r}' AS report, 'bad_numeric: {c}' AS reason, count(*) AS rows FROM (SELECT *, {ROW[r][1]} AS n FROM {ROW[r][0]}) WHERE n % 13 IN (4, 5)"
    for r, c in _REASON.items()), [ROW[r][0] for r in _REASON])

# ---------------------------------------------------------------- files by name and time
ORACLE["latest_exports"] = """
WITH f AS (
  SELECT '/drop/' || ['Sales Itemwise ', 'sales-billwise_', 'PURCHASE_ITEMWISE-', 'Purchase-Billwise', 'supplier master ', 'Item-Combinations', 'item_master ', 'notes '][o_orderkey % 8 + 1]
         || CAST(o_orderkey AS VARCHAR) || '.csv' AS file_name,
         ['sales_itemwise', 'sales_billwise', 'purchase_itemwise', 'purchase_billwise', 'supplier_master', 'item_combinations', 'item_combinations', NULL][o_orderkey % 8 + 1] AS report_type,
         o_orderdate AS ts
  FROM orders)
SELECT report_type, max_by(file_name, (ts, file_name)) AS file_name FROM f WHERE report_type IS NOT NULL GROUP BY report_type
"""

# ---------------------------------------------------------------- names and products
_UNITS = [("KG|KGS", "KG"), ("GM|GMS|GR", "G"), ("LTR|LT|LTS|L", "L"), ("ML|MLS", "ML"), ("PCS|PC", "PCS")]


def _normal(c: str) -> str:
    c = f"upper({c})"
    for units, to in _UNITS:
        c = f"regexp_replace({c}, '([0-9])({units})\\b', '\\1 {to}', 'g')"
    c = f"regexp_replace({c}, '[^\\w\\s\\-]', ' ', 'g')"
    return f"array_to_string(list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> '' AND t NOT IN ('CO', 'LTD', 'PVT', 'MFG', 'INDIA')), ' ')"


ORACLE["name_blocks"] = oracle(
    f"""SELECT barcode, name, norm,
              (CASE WHEN length(norm) >= 3 THEN substr(norm, 1, 3) ELSE rpad(norm, 3, '_') END) || '|' || regexp_extract(norm, '[0-9]+') AS block_key
       FROM (SELECT barcode, name, {_normal("name")} AS norm FROM c)""",
    ["raw_item_combinations", "raw_sales_itemwise", "product_aliases"],
    ["""im AS (SELECT barcode, max_by(item_name_raw, (imported_at, import_batch_id, item_name_raw)) AS name FROM raw_item_combinations
              WHERE item_name_raw <> '' GROUP BY barcode)""",
     """sl AS (SELECT barcode, max_by(item_name_raw, (imported_at, item_name_raw)) AS name FROM raw_sales_itemwise
              WHERE item_name_raw <> '' GROUP BY barcode)""",
     """c AS (SELECT barcode, coalesce(im.name, sl.name) AS name FROM im FULL JOIN sl USING (barcode)
              WHERE coalesce(im.name, sl.name) IS NOT NULL AND barcode NOT IN (SELECT alias_barcode FROM product_aliases))"""])
# HSN prefix and category.
_HSN = """
('2009', 'Juices'), ('1902', 'Processed Grains'), ('1905', 'Bakery'), ('3004', 'Pharmaceuticals'),
('3401', 'Soap & Detergent'), ('3402', 'Soap & Detergent'), ('07', 'Vegetables'), ('08', 'Fruits & Nuts'),
('09', 'Spices'), ('10', 'Grains & Pulses'), ('15', 'Oils & Fats'), ('16', 'Preserved Foods'),
('17', 'Sugar & Confectionery'), ('18', 'Cocoa & Chocolate'), ('19', 'Processed Grains'), ('20', 'Canned & Preserved'),
('21', 'Condiments & Sauces'), ('22', 'Beverages'), ('24', 'Tobacco'), ('30', 'Pharmaceuticals'),
('33', 'Personal Care'), ('34', 'Soap & Detergent'), ('39', 'Plastics & Packaging'), ('48', 'Paper & Stationery'),
('61', 'Clothing'), ('62', 'Clothing'), ('63', 'Textiles'), ('64', 'Footwear'),
('85', 'Electronics'), ('94', 'Furniture & Fixtures')"""
ORACLE["product_categories"] = oracle(
    f"""SELECT barcode, brand, hsn_code, size, colour, category, product_type, is_reviewed, is_active FROM products
       UNION ALL
       SELECT barcode, nullif(trim(brand_raw), '') AS brand, nullif(trim(m.hsn_code), '') AS hsn_code, nullif(trim(size_raw), '') AS size,
              nullif(trim(colour_raw), '') AS colour,
              (SELECT arg_max(h.category, length(h.prefix)) FROM (VALUES {_HSN}) h(prefix, category) WHERE trim(m.hsn_code) <> ''
               AND h.prefix IN (substr(trim(m.hsn_code), 1, 4), substr(trim(m.hsn_code), 1, 2))) AS category,
              CASE WHEN regexp_matches(lower(coalesce(item_name_raw, '')), 'labour|labor|service|charge|fee|delivery|installation') THEN 'service'
                   WHEN coalesce(m.hsn_code, '') = '' THEN 'misc' ELSE 'retail' END AS product_type,
              false AS is_reviewed, true AS is_active
       FROM (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY imported_at DESC, import_batch_id DESC) AS rn FROM raw_item_combinations) m
       WHERE rn = 1 AND barcode <> '' AND barcode NOT IN (SELECT barcode FROM products)""",
    ["raw_item_combinations", "products"])

# ---------------------------------------------------------------- filter operators
_FILTERS = [
    ("eq", "operator_name = '3-MEDIUM'"), ("ne", "operator_name <> '3-MEDIUM'"), ("gt", "net_total > 150000"), ("gte", "net_total >= 150000"),
    ("lt", "net_total < 50000"), ("lte", "net_total <= 50000"), ("like", "customer_name_raw LIKE 'Customer#00000000%'"),
    ("ilike", "customer_name_raw ILIKE '%CUSTOMER#000000_1%'"), ("in", "operator_name IN ('1-URGENT', '5-LOW')"),
    ("or", "(net_total > 300000 OR operator_name = '2-HIGH')"), ("and", "net_total > 300000 AND operator_name = '2-HIGH'")]
ORACLE["filter_operators"] = oracle("\nUNION ALL ".join(
    f"SELECT '{n}' AS operator, bill_no, operator_name, CAST(net_total AS DOUBLE) AS net_total FROM raw_sales_billwise WHERE {w}" for n, w in _FILTERS),
    ["raw_sales_billwise"])
