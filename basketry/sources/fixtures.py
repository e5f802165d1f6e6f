"""Raw-shaped views over the driver's TPC-H-ish tables.

The warehouse reads billing-export tables (``raw_sales_billwise`` ...). The
test data is a TPC-H-like star schema, so each raw table is *derived* from it
with plain projections and joins; the mapping is documented in FIXTURES.md §B
and mirrored for DuckDB in ``basketry.oracle.views`` (the correctness oracle).

All views are lazy DataFrames: Catalyst prunes the columns and pushes the
filters of whatever operator consumes them down to the parquet scan.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import MONEY
from ..operators.cash import DENOMINATIONS, LINE_ITEM
from ..session import saved

# Fixed parameters of the fixture mapping (see FIXTURES.md §B).
AS_OF = dt.date(2001, 8, 1)
MASTER_BATCH_1 = "2001-01-01 00:00:00"
MASTER_BATCH_2 = "2001-06-01 00:00:00"
LOCAL_CITY = "Bellary"


def _dmy(c):
    return F.date_format(c, "dd-MM-yyyy")


def _m2(c):
    """Source double with two decimals -> DECIMAL(18,2)."""
    return F.col(c).cast("decimal(18,2)")


def _key(c):
    return F.col(c).cast("string")


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


class RetailTables:
    """Lazily built raw tables for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- datetime text of a bill, four export variants plus ISO garbage ----
    @staticmethod
    def _bill_datetime(orderkey, orderdate):
        d = _dmy(orderdate)
        return (
            F.when(orderkey % 97 == 0, F.concat(F.date_format(orderdate, "yyyy-MM-dd"), F.lit(" 10:15")))
            .when(orderkey % 4 == 0, F.concat(d, F.lit("07:29 AM")))
            .when(orderkey % 4 == 1, F.concat(d, F.lit(" 07:29 AM")))
            .when(orderkey % 4 == 2, F.concat(d, F.lit(" 18:30")))
            .otherwise(F.concat(d, F.lit("11:45 PM")))
        )

    @cached_property
    def raw_sales_billwise(self) -> DataFrame:
        o = self.base("orders")
        c = self.base("customer").select("c_custkey", "c_name")
        ok, ck = F.col("o_orderkey"), F.col("o_custkey")
        net = _m2("o_totalprice")
        zero = F.lit(0).cast(MONEY)
        pay = lambda r: F.when(ok % 5 == r, net.cast(MONEY)).otherwise(zero)
        prefix = (F.when(ck % 4 == 0, F.lit("+91 ")).when(ck % 4 == 1, F.lit("0"))
                  .when(ck % 4 == 2, F.lit("91")).otherwise(F.lit("")))
        mobile = F.when(ck % 10 == 9, F.lit("12345")).otherwise(
            F.concat(prefix, F.lit("9"), F.lpad(ck.cast("string"), 9, "0")))
        return (
            o.join(c, o.o_custkey == c.c_custkey, "left")
            .select(
                _key("o_orderkey").alias("bill_no"),
                self._bill_datetime(ok, F.col("o_orderdate")).alias("bill_datetime_raw"),
                F.col("o_orderpriority").alias("operator_name"),
                F.lit("Main").alias("location_name"),
                F.when(ck % 25 == 0, F.lit("CASH")).otherwise(F.col("c_name")).alias("customer_name_raw"),
                mobile.alias("customer_mobile_raw"),
                net.cast(MONEY).alias("net_total"),
                F.round(net * F.lit(0.95).cast("decimal(3,2)"), 2).cast(MONEY).alias("taxable_amount"),
                zero.alias("round_off"),
                (ok % 7 + 1).cast(MONEY).alias("total_qty"),
                F.round(net * F.lit(0.01).cast("decimal(3,2)"), 2).cast(MONEY).alias("total_discount"),
                F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(1)).otherwise(F.lit(0))
                .cast(MONEY).alias("membercard_discount"),
                pay(0).alias("cash_amount"),
                F.when(ok % 10 == 0, net.cast(MONEY)).alias("actual_cash"),
                pay(1).alias("card_amount"),
                pay(2).alias("google_pay_amount"),
                pay(3).alias("phonepe_amount"),
                zero.alias("paytm_amount"),
                pay(4).alias("credit_amount"),
                zero.alias("cn_amount"),
                F.lit(1).cast("long").alias("import_batch_id"),
                F.lit("sales_billwise.csv").alias("source_file_name"),
                F.col("o_orderdate").alias("imported_at"),
            )
        )

    @cached_property
    def raw_sales_itemwise(self) -> DataFrame:
        li = self.base("lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
        o = self.base("orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
        p = self.base("part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
        one = F.lit(1).cast("decimal(3,2)")
        net_tax = _m2("l_extendedprice") * (one - _m2("l_discount"))
        return (
            li.join(o, li.l_orderkey == o.o_orderkey, "inner")
            .join(p, li.l_partkey == p.p_partkey, "left")
            .select(
                _key("l_orderkey").alias("bill_no"),
                self._bill_datetime(F.col("l_orderkey"), F.col("o_orderdate")).alias("sale_datetime_raw"),
                F.col("o_orderpriority").alias("operator_name"),
                F.lit("Main").alias("sale_location"),
                _key("l_partkey").alias("barcode"),
                F.col("l_linenumber").cast("long").alias("line_no"),
                F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("KG"))
                .alias("item_name_raw"),
                F.col("p_brand").alias("brand_raw"),
                F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("01")).alias("hsn_code"),
                _m2("l_quantity").cast(MONEY).alias("sale_qty"),
                F.lit(0).cast(MONEY).alias("free_qty"),
                _m2("p_retailprice").cast(MONEY).alias("mrp"),
                F.round(net_tax, 2).cast(MONEY).alias("taxable_amount"),
                F.round(net_tax * (one + _m2("l_tax")), 2).cast(MONEY).alias("net_total"),
                F.lit(1).cast("long").alias("import_batch_id"),
                F.lit("sales_itemwise.csv").alias("source_file_name"),
                F.col("o_orderdate").alias("imported_at"),
            )
        )

    def _purchase_lines(self) -> DataFrame:
        li = self.base("lineitem").filter(
            (F.col("l_returnflag") == "R") & (F.col("l_partkey") % 20 != 7)
        ).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        s = self.base("supplier").select("s_suppkey", "s_name")
        return li.join(s, li.l_suppkey == s.s_suppkey, "left")

    @cached_property
    def raw_purchase_itemwise(self) -> DataFrame:
        return self._purchase_lines().select(
            F.concat(_key("l_orderkey"), F.lit("-"), _key("l_suppkey")).alias("purchase_id"),
            F.concat(F.lit("INV-"), _key("l_orderkey")).alias("invoice_no"),
            _dmy(F.col("l_shipdate")).alias("purchase_date_raw"),
            F.col("s_name").alias("supplier_name_raw"),
            _key("l_partkey").alias("barcode"),
            _m2("l_quantity").cast(MONEY).alias("total_qty"),
            _m2("l_extendedprice").cast(MONEY).alias("taxable_value"),
            F.lit(1).cast("long").alias("import_batch_id"),
            F.lit("purchase_itemwise.csv").alias("source_file_name"),
            F.col("l_shipdate").alias("imported_at"),
        )

    @cached_property
    def raw_purchase_billwise(self) -> DataFrame:
        g = (
            self._purchase_lines().filter(F.col("l_orderkey") % 50 != 0)
            .groupBy("l_orderkey", "l_suppkey", "s_name")
            .agg(
                F.min("l_shipdate").alias("ship"),
                F.sum(_m2("l_quantity")).alias("qty"),
                F.sum(_m2("l_extendedprice")).alias("taxable"),
            )
        )
        settled = F.round(F.col("taxable") * F.lit(0.8).cast("decimal(2,1)"), 2)
        return g.select(
            F.concat(_key("l_orderkey"), F.lit("-"), _key("l_suppkey")).alias("purchase_id"),
            F.concat(F.lit("INV-"), _key("l_orderkey")).alias("invoice_no"),
            _dmy(F.col("ship")).alias("purchase_date_raw"),
            F.col("s_name").alias("supplier_name_raw"),
            F.col("qty").cast(MONEY).alias("total_qty"),
            F.col("taxable").cast(MONEY).alias("taxable_value"),
            settled.cast(MONEY).alias("settled_amount"),
            (F.col("taxable") - settled).cast(MONEY).alias("due_amount"),
            F.lit(1).cast("long").alias("import_batch_id"),
            F.lit("purchase_billwise.csv").alias("source_file_name"),
            F.col("ship").alias("imported_at"),
        )

    @cached_property
    def raw_supplier_master(self) -> DataFrame:
        s = self.base("supplier").select("s_suppkey", "s_name", "s_nationkey")
        n = self.base("nation").select("n_nationkey", "n_name", "n_regionkey")
        sn = s.join(n, s.s_nationkey == n.n_nationkey, "left")

        def batch(bid: int, ts: str, city):
            return sn.select(
                _key("s_suppkey").alias("supplier_code"),
                F.col("s_name").alias("supplier_name_raw"),
                city.alias("city_raw"),
                F.lit(bid).cast("long").alias("import_batch_id"),
                F.lit("supplier_master.csv").alias("source_file_name"),
                _ts(ts).alias("imported_at"),
            )

        later_city = F.when(F.col("n_regionkey") == 0, F.lit(LOCAL_CITY)).otherwise(F.col("n_name"))
        return batch(1, MASTER_BATCH_1, F.col("n_name")).unionByName(batch(2, MASTER_BATCH_2, later_city))

    @cached_property
    def raw_item_combinations(self) -> DataFrame:
        p = self.base("part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
        size = F.concat(F.col("p_size").cast("string"), F.lit("KG"))
        hsn = F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("01"))

        def batch(df, bid, ts, name, mrp, stock):
            return df.select(
                _key("p_partkey").alias("barcode"),
                name.alias("item_name_raw"),
                hsn.alias("hsn_code"),
                F.col("p_brand").alias("brand_raw"),
                size.alias("size_raw"),
                F.lit(None).cast("string").alias("colour_raw"),
                mrp.cast(MONEY).alias("mrp"),
                F.round(mrp * F.lit(0.75).cast("decimal(3,2)"), 2).cast(MONEY).alias("purchase_price"),
                F.round(mrp * F.lit(0.9).cast("decimal(2,1)"), 2).cast(MONEY).alias("rate"),
                stock.cast(MONEY).alias("system_stock_snapshot"),
                F.lit(None).cast("string").alias("expiry_date_raw"),
                F.lit(bid).cast("long").alias("import_batch_id"),
                F.lit("item_combinations.csv").alias("source_file_name"),
                _ts(ts).alias("imported_at"),
            )

        first = batch(p, 1, MASTER_BATCH_1, F.upper(F.col("p_name")),
                      _m2("p_retailprice") * F.lit(1.1).cast("decimal(2,1)"), F.col("p_partkey") % 40 + 5)
        second = batch(p.filter(F.col("p_partkey") % 4 != 0), 2, MASTER_BATCH_2,
                       F.concat(F.col("p_name"), F.lit(" "), size),
                       _m2("p_retailprice"), F.col("p_partkey") % 40)
        return first.unionByName(second)

    @cached_property
    def product_aliases(self) -> DataFrame:
        return self.base("part").filter(F.col("p_partkey") % 50 == 49).select(
            _key("p_partkey").alias("alias_barcode"),
            (F.col("p_partkey") - 1).cast("string").alias("canonical_barcode"),
            F.lit(90).cast("decimal(5,2)").alias("similarity_score"),
            _ts("2001-07-01 00:00:00").alias("confirmed_at"),
            F.lit("fixture").alias("notes"),
        )

    @cached_property
    def products(self) -> DataFrame:
        pk = F.col("p_partkey")
        return self.base("part").filter(pk % 3 == 0).select(
            _key("p_partkey").alias("barcode"),
            F.upper(F.col("p_name")).alias("canonical_name"),
            F.col("p_type").alias("category"),
            F.lit(None).cast("string").alias("subcategory"),
            F.col("p_brand").alias("brand"),
            F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("01")).alias("hsn_code"),
            F.concat(F.col("p_size").cast("string"), F.lit("KG")).alias("size"),
            F.lit(None).cast("string").alias("colour"),
            F.lit("retail").alias("product_type"),
            (pk % 2 == 0).alias("is_reviewed"),
            F.when(pk % 7 == 0, F.lit(None).cast("boolean")).when(pk % 7 == 1, F.lit(False))
            .otherwise(F.lit(True)).alias("is_active"),
        )

    @cached_property
    def chained_aliases(self) -> DataFrame:
        """Aliases with chains: every second canonical product is itself an alias."""
        a = self.product_aliases.select("alias_barcode", "canonical_barcode")
        chain = self.base("part").filter(F.col("p_partkey") % 100 == 99).select(
            (F.col("p_partkey") - 1).cast("string").alias("alias_barcode"), (F.col("p_partkey") - 2).cast("string").alias("canonical_barcode"))
        return a.unionByName(chain)

    def _years(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_year", F.explode(F.sequence(F.lit(1995), F.lit(AS_OF.year))))

    @cached_property
    def festivals(self) -> DataFrame:
        """One festival per nation and year, with windows that overlap."""
        k = F.col("n_nationkey").cast("int")
        return self._years(self.base("nation")).select(
            F.col("n_name").alias("name"), k.alias("priority"), F.make_date(F.col("_year").cast("int"), k % 12 + 1, k % 27 + 1).alias("peak"),
            (k % 5).alias("pre"), (k % 4).alias("post"))

    @cached_property
    def holidays(self) -> DataFrame:
        """One public holiday per region and year."""
        k = F.col("r_regionkey").cast("int")
        return self._years(self.base("region")).select(
            F.make_date(F.col("_year").cast("int"), k * 2 + 1, F.lit(26)).alias("date"), F.concat(F.lit("Day of "), F.col("r_name")).alias("name"))


# ---------------------------------------------------------------- promotion sheet, cash closures
def offer_sheet(t: RetailTables) -> DataFrame:
    """A promotion sheet derived from the part table (text cells, as a CSV would give)."""
    pk = F.col("p_partkey")
    dtype = (F.when(pk % 4 == 0, "Percent").when(pk % 4 == 1, "amount").when(pk % 4 == 2, "combo")
             .otherwise("unknown"))
    dval = (F.when(pk % 4 == 0, (F.col("p_size") % 30 + 5).cast("string"))
            .when(pk % 4 == 1, F.col("p_size").cast("string")).when(pk % 4 == 2, F.lit("Buy 1 Get 1"))
            .otherwise(F.lit("")))
    return t.base("part").select(
        pk.alias("_row"),
        F.when(pk % 97 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("Name"),
        F.when(pk % 89 == 0, F.lit("NA")).otherwise(F.col("p_retailprice").cast("string")).alias("MRP"),
        dtype.alias("Discount Type"), dval.alias("Discount Value"),
        F.concat(F.lit("img/"), pk.cast("string"), F.lit(".png")).alias("Image"))


def closures_from_events(events: DataFrame) -> DataFrame:
    """Fixture: one closure per event day (FIXTURES.md §B).

    Per-type day sums become the scalar and line-item columns (arrays hold
    one entry per event type, so they are bounded); denomination maps count
    purchase / signup events by ``user_id`` modulo the note list.
    """
    day = F.to_date("ts")
    amt = F.col("value").cast("decimal(18,2)")
    per = events.groupBy(day.alias("closure_date"), "event_type").agg(F.sum(amt).cast("double").alias("amount"))
    item = F.struct(F.col("event_type").alias("description"), F.col("amount").alias("amount"))
    t = lambda name: F.max(F.when(F.col("event_type") == name, F.col("amount")))
    arr = lambda name: F.filter(F.collect_list(F.when(F.col("event_type") == name, item)),
                                lambda x: x.isNotNull())
    scal = per.groupBy("closure_date").agg(
        t("signup").alias("opening_cash"), t("purchase").alias("net_sales"), t("view").alias("card_amount"),
        arr("click").alias("manual_billings"), arr("error").alias("expenses"))
    notes = F.array(*[F.lit(str(d)) for d in DENOMINATIONS])
    note = F.element_at(notes, (F.col("user_id") % len(DENOMINATIONS) + 1).cast("int"))
    cnt = (events.filter(F.col("event_type").isin("purchase", "signup"))
           .groupBy(day.alias("closure_date"), "event_type", note.alias("note"))
           .agg(F.count(F.lit(1)).cast("int").alias("n")))
    maps = cnt.groupBy("closure_date").agg(
        F.map_from_entries(F.filter(F.collect_list(F.when(F.col("event_type") == "purchase",
                                                          F.struct("note", "n"))), lambda x: x.isNotNull()))
        .alias("denominations_opening"),
        F.map_from_entries(F.filter(F.collect_list(F.when(F.col("event_type") == "signup",
                                                          F.struct("note", "n"))), lambda x: x.isNotNull()))
        .alias("denominations_sales"))
    return (scal.join(maps, "closure_date", "left")
            .withColumn("physical_cash_counted",
                        F.when(F.dayofmonth("closure_date") % 5 != 0, F.col("net_sales")))
            .select("closure_date", "opening_cash", "net_sales",
                    *[F.lit(None).cast("double").alias(c) for c in
                      ["sodexo_collection", "distributor_expiry", "oil_crush", "other_income",
                       "pluxee_amount", "paytm_amount", "phonepe_amount", "returns_amount"]],
                    "card_amount", "manual_billings", F.array().cast(LINE_ITEM).alias("old_balance_collections"),
                    F.array().cast(LINE_ITEM).alias("credits_given"), "expenses",
                    "physical_cash_counted", "denominations_opening", "denominations_sales"))


# ---------------------------------------------------------------- dirty rows and export files
def dirty_tables(t: RetailTables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four raw tables with broken dates and missing barcodes among their rows."""
    n = F.col("bill_no").cast("long")
    i = F.regexp_extract("invoice_no", r"(\d+)", 1).cast("long")
    broken = lambda c, k, parts: (F.when(k % parts == 0, F.lit(None).cast("string")).when(k % parts == 1, F.lit("31-02-1996 oops"))
                                  .when(k % parts == 2, F.lit("n/a")).otherwise(F.col(c)))
    return (t.raw_sales_billwise.withColumn("bill_datetime_raw", broken("bill_datetime_raw", n, 101)),
            t.raw_sales_itemwise.withColumn("sale_datetime_raw", broken("sale_datetime_raw", n, 103))
            .withColumn("barcode", F.when(n % 107 == 0, F.lit(None).cast("string")).otherwise(F.col("barcode"))),
            t.raw_purchase_billwise.withColumn("purchase_date_raw", broken("purchase_date_raw", i, 109)),
            t.raw_purchase_itemwise.withColumn("purchase_date_raw", broken("purchase_date_raw", i, 113))
            .withColumn("barcode", F.when(i % 127 == 0, F.lit(None).cast("string")).otherwise(F.col("barcode"))))


#: Rows of one export file at most (about), and files at least.
EXPORT_ROWS, EXPORT_FILES = 100_000, 24


def export_bills(t: RetailTables, folder: str, broken: bool = False) -> str:
    """Bill-wise export files with all columns of the report and a trailing totals row.

    Bills are dealt by number over ``slices`` files. The files differ in their
    headers: ``order=0`` has the usual order, ``order=1`` the reverse one with
    a no-break space in ``Net Total``, ``order=2`` lacks the optional Paytm
    column. With ``broken``, the files of ``order=2`` lack ``Net Total`` too.
    """
    from .ingest import HEADER_MAP, NUMERIC
    hmap = HEADER_MAP["sales_billwise"]
    # the narrow rows are dealt and sorted; cells are made as they are written
    n = F.col("bill_no").cast("long")
    slices = max(EXPORT_FILES, -(-t.base("orders").count() // EXPORT_ROWS))
    sums = {hmap[h]: F.sum(F.col(hmap[h]).cast("decimal(18,4)")).cast("string").alias(f"_sum_{hmap[h]}") for h in ("Qty", "Net Total")}
    body = t.raw_sales_billwise
    known = set(body.columns)
    body = saved(body.select((n % slices).alias("_slice"), F.lit(0).alias("_total"), *[c for c in body.columns if c == "bill_no" or c in hmap.values()]), "bills")
    totals = body.groupBy("_slice").agg(*sums.values()).withColumn("_total", F.lit(1))
    rows = body.unionByName(totals, allowMissingColumns=True)
    cells = {}
    for i, (h, c) in enumerate(hmap.items()):
        if c in known:
            cell = F.col(c).cast("string")
        elif c in NUMERIC["sales_billwise"]:
            cell = (n % (i + 2)).cast("string")
        else:
            cell = F.concat(F.lit(f"{c} "), (n % (i + 2)).cast("string"))
        cells[h] = F.when(F.col("_total") == 0, cell).otherwise(F.col(f"_sum_{c}") if c in sums else F.lit(None).cast("string"))
    headers = list(hmap)
    for order in range(3):
        cols = {0: headers, 1: headers[::-1], 2: [h for h in headers if h != "Paytm" and not (broken and h == "Net Total")]}[order]
        named = [cells[h].alias("Net\u00a0Total" if order == 1 and h == "Net Total" else h) for h in cols]
        (rows.where(F.col("_slice") % 3 == order).repartition("_slice").sortWithinPartitions("_slice", "_total", F.col("bill_no").cast("string"))
         .select("_slice", *named).write.partitionBy("_slice").option("header", True).csv(f"{folder}/order={order}"))
    return folder


# ---------------------------------------------------------------- the other export files
def _export_rows(t: RetailTables, report: str) -> DataFrame:
    """The raw view of a report with a number for each row."""
    digits = F.regexp_extract("invoice_no", r"(\d+)", 1).cast("long") if report.startswith("purchase") else None
    if report == "sales_itemwise":
        return t.raw_sales_itemwise.withColumn("_n", F.col("bill_no").cast("long") * 8 + F.col("line_no"))
    if report == "purchase_itemwise":
        return t.raw_purchase_itemwise.withColumn("_n", digits + F.col("barcode").cast("long"))
    if report == "purchase_billwise":
        return t.raw_purchase_billwise.withColumn("_n", digits)
    if report == "supplier_master":
        return t.raw_supplier_master.withColumn("_n", F.col("supplier_code").cast("long") * 2 + F.col("import_batch_id"))
    return t.raw_item_combinations.withColumn("_n", F.col("barcode").cast("long") * 2 + F.col("import_batch_id"))


def export_cells(t: RetailTables, report: str) -> DataFrame:
    """The rows of a report's export, staged: the view's columns of the report, beside _n, import_batch_id (0 where the view has none), _slice and _total.

    Each slice (:func:`slices_of`) is a file of its own; a report with totals
    rows has one in each.
    """
    from .ingest import HAS_TOTALS_ROW, HEADER_MAP
    view = _export_rows(t, report)
    batch = F.col("import_batch_id") if "import_batch_id" in view.columns else F.lit(0)
    named = [c for c in view.columns if c in HEADER_MAP[report].values()]
    rows = saved(view.select("_n", batch.cast("long").alias("import_batch_id"), F.lit(0).alias("_total"), *named), "export-rows")
    rows = rows.withColumn("_slice", F.col("_n") % slices_of(rows.count()))
    if report in HAS_TOTALS_ROW:
        totals = rows.select(F.col("_slice").alias("_n"), "import_batch_id", "_slice").distinct().withColumn("_total", F.lit(1))
        rows = rows.unionByName(totals, allowMissingColumns=True)
    return rows


def cells_of(report: str, columns: list[str]) -> list:
    """All cells of :func:`export_cells` rows as text.

    Columns that the view lacks count up from the row's number. In the first
    such text column some cells hold line breaks, quotes, blanks around them,
    ``nan`` or a number with ``.00``; in the first such numeric column some
    hold no number, too many decimals, or nothing.
    """
    from .ingest import HEADER_MAP, NUMERIC
    hmap, numbers, n, known = HEADER_MAP[report], set(NUMERIC[report]), F.col("_n"), set(columns)
    text = next(c for c in hmap.values() if c not in known and c not in numbers)
    number = next((c for c in hmap.values() if c not in known and c in numbers), None)
    cells = []
    for i, (h, c) in enumerate(hmap.items()):
        if c in known:
            cell = F.col(c).cast("string")
        elif c in numbers:
            cell = (n % (i + 2)).cast("string")
            if c == number:
                cell = F.when(n % 13 == 4, "x12").when(n % 13 == 5, "1.23456").when(n % 13 == 6, "").otherwise(cell)
        else:
            cell = F.concat(F.lit(f"{c} "), (n % (i + 2)).cast("string"))
            if c == text:
                cell = (F.when(n % 11 == 3, 'Oil "A"\n5, tin').when(n % 11 == 5, "  padded ").when(n % 11 == 6, "nan").when(n % 11 == 7, "2796.00")
                        .when(n % 11 == 8, '"').otherwise(cell))
        cells.append(F.when(F.col("_total") == 0, cell).otherwise(F.lit("TOTAL" if i == 0 else None).cast("string")).alias(h))
    return cells


#: Files of one export at least, per batch of the master reports.
EXPORT_SLICES = 7


def slices_of(rows: int) -> int:
    """Files of an export of so many rows: EXPORT_ROWS each, so that no task sorts or writes more as the report grows."""
    return max(EXPORT_SLICES, -(-rows // EXPORT_ROWS))


def write_export(rows: DataFrame, report: str, folder: str) -> str:
    """Append a file for each slice of the rows to ``folder``, totals rows last; cells are made as they are written."""
    (rows.repartition("_slice").sortWithinPartitions("_slice", "_total", "_n").select("_slice", *cells_of(report, rows.columns))
     .write.mode("append").partitionBy("_slice").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").csv(folder))
    return folder


def file_listing(t: RetailTables) -> DataFrame:
    """Names and times of dropped files, one per order, in the spellings that the router knows and one that it does not."""
    k = F.col("o_orderkey")
    spelled = F.array(*[F.lit(x) for x in ("Sales Itemwise ", "sales-billwise_", "PURCHASE_ITEMWISE-", "Purchase-Billwise", "supplier master ",
                                           "Item-Combinations", "item_master ", "notes ")])
    return t.base("orders").select(
        F.concat(F.lit("/drop/"), F.element_at(spelled, (k % 8 + 1).cast("int")), k.cast("string"), F.lit(".csv")).alias("file_name"),
        F.col("o_orderdate").alias("modificationTime"))
