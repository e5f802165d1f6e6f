"""Report ingestion: CSV exports -> typed raw rows with lineage.

Records come from :mod:`records`, which splits large files whatever their
cells hold; all that follows reads the staged lines and parses their cells. Columns are matched by name in every file on its own: the first record
of each file is that file's header, and a small per-file table says at which
position each known header stands. Files of
one report may order their columns differently or leave optional ones out; a
file that lacks a required one fails alone. The trailing totals row of a file
is its last record. File-level dedup compares content hashes with the ledger;
row-level dedup is a window over the key within the batch plus a left-anti
join against what is loaded. Batch and stream use the same functions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cleaning import clean_cell
from ..functions.numeric import MONEY
from ..plans.sizing import broadcast_if_small
from ..session import released, saved
from .records import FILE, TEXT_CODEC, parsed, places, read_lines, records

# ---------------------------------------------------------------------------
# The exports' headers in their order, the headers whose raw
# column has a name of its own, required headers, numeric columns, reports
# with a totals row, and the row-level dedup keys.
_GST = (0, 3, 5, 12, 18, 28, 40)


def _half(rate: int) -> str:
    return f"{rate / 2:g}"


HEADERS = {
    "sales_itemwise": [
        "Store Name", "Sale Location", "Operator", "Bill No.", "Date", "Sale To", "Customer", "Mobile No", "GSTIN No",
        "Item Name", "Barcode", "HSN Code", "Brand", "Size", "Colour", "Style", "Expiry Date", "Qty", "Free Qty",
        "Cur Stk", "MRP", "Total MRP", "Rate", "Total Rate", "Disc1(%)", "Disc1(Rs)", "Other Discount(Rs)",
        "Total Discount(Rs)", "Taxable Amt.",
        *[f"{tax}({u})" for tax in ("IGST", "CGST", "SGST", "CESS") for u in ("%", "Rs")],
        "Gross Amount", "Round Off", "Net Total"],
    "sales_billwise": [
        "Location", "Sale Type", "Bill Type", "Sale ID", "Bill No.", "Operator", "Date", "Dispatch Mode", "GST Type",
        "Sale To", "Cust. Name", "Cust. Mobile", "Cust. Address", "Cust. City", "Cust. State", "Company Name",
        "GSTIN No.", "Qty", "Total MRP", "Total Rate", "Gross Sale", "Cust Disc %", "Cust Discount",
        "Bill Discount %", "Bill Discount", "Extra Discount %", "Extra Discount", "Membercard Disc.",
        "Total Discount", "Taxable Amt.",
        *[f"GST-{r}" for r in _GST], *[f"taxable Amt{r}  %" for r in _GST], *[f"IGST {r} %" for r in _GST[1:]],
        *[f"CGST {_half(r)} %" for r in _GST[1:]], *[f"SGST {_half(r)} %" for r in _GST[1:]],
        "Total IGST", "Total CGST", "Total SGST", "Net Tax", "Other Charges", "Credit Amt", "CN Adjust", "CN Amount",
        "Cash", "Card", "Google Pay", "Phone Pe", "Paytm", "Actual Cash", "Cash Return", "Round Off", "Net Total"],
    "purchase_itemwise": [
        "Purchase Id", "Purchase Reference Id", "Invoice No", "Pur.Date", "Supplier", "Barcode", "Item Name",
        "HSN Code", "Tax Type", "GST (%)", "Min Stock", "Max Stock", "Expiry Date", "Brand", "QTY - PHM",
        "Free Qty- PHM", "QTY - WH", "Free Qty- WH", "Total Qty", "Profit(%)", "Taxable Value", "MRP", "Rate"],
    "purchase_billwise": [
        "Location", "Age", "ID", "Ref. ID", "Invoice", "Date", "Time", "Supplier", "Supplier Type", "Status",
        "Total Qty", "Total Disc1(Rs)", "Extra Disc", "Taxable Value", *[f"GST-{r}" for r in _GST],
        "Total Tax", "Round Off", "Settled Amount", "Due Amount"],
    "supplier_master": [
        "Id", "Status", "Supplier Code", "Supplier Name", "Location", "Address", "Mobile", "Email", "Supplier Date",
        "city", "Country", "State", "Register Type", "GSTIN / UID", "Tin No", "Pan No",
        "Registered Invoice Start Duration", "Supplier Category", "Create Ledger", "Closing Balance"],
    "item_combinations": [
        "Item_Id", "Barcode", "Item Name", "HsnCode", "Tax Category", "Brand", "Size", "Colour", "Style",
        "Expiry Date", "Purchase Price", "MRP", "Rate", "System Stock"],
}
_ITEM_TEXT = {"Item Name": "item_name_raw", "Brand": "brand_raw", "Size": "size_raw", "Colour": "colour_raw",
              "Style": "style_raw", "Expiry Date": "expiry_date_raw"}
#: Raw columns whose name does not follow from the header by ``column_of``'s rule.
NAMED = {
    "sales_itemwise": {
        **_ITEM_TEXT, "Operator": "operator_name", "Date": "sale_datetime_raw", "Customer": "customer_name",
        "Mobile No": "mobile", "GSTIN No": "gstin", "Qty": "sale_qty", "Cur Stk": "current_stock_snapshot",
        "Disc1(%)": "discount_percent", "Disc1(Rs)": "discount_amount", "Taxable Amt.": "taxable_amount"},
    "sales_billwise": {
        "Location": "location_name", "Operator": "operator_name", "Date": "bill_datetime_raw",
        "Cust. Name": "customer_name_raw", "Cust. Mobile": "customer_mobile_raw",
        "Cust. Address": "customer_address_raw", "Cust. City": "customer_city_raw",
        "Cust. State": "customer_state_raw", "GSTIN No.": "customer_gstin_raw", "Qty": "total_qty",
        "Cust Disc %": "cust_discount_percent", "Bill Discount": "bill_discount_amount",
        "Extra Discount": "extra_discount_amount", "Membercard Disc.": "membercard_discount",
        "Taxable Amt.": "taxable_amount", **{f"GST-{r}": f"taxable_amt_{r}" for r in _GST},
        **{f"taxable Amt{r}  %": f"taxable_amt_{r}_percent" for r in _GST},
        **{f"IGST {r} %": f"igst_{r}" for r in _GST[1:]},
        **{f"{t} {_half(r)} %": f"{t.lower()}_{_half(r).replace('.', '_')}" for t in ("CGST", "SGST") for r in _GST[1:]},
        "Credit Amt": "credit_amount", "Cash": "cash_amount", "Card": "card_amount",
        "Google Pay": "google_pay_amount", "Phone Pe": "phonepe_amount", "Paytm": "paytm_amount"},
    "purchase_itemwise": {
        "Pur.Date": "purchase_date_raw", "Supplier": "supplier_name_raw", "Item Name": "item_name_raw",
        "Expiry Date": "expiry_date_raw", "Brand": "brand_raw"},
    "purchase_billwise": {
        "Location": "location_name", "ID": "purchase_id", "Invoice": "invoice_no", "Date": "purchase_date_raw",
        "Time": "purchase_time_raw", "Supplier": "supplier_name_raw", "Extra Disc": "extra_disc_amount",
        "Total Tax": "tax_amount"},
    "supplier_master": {"Id": "supplier_id_raw", "GSTIN / UID": "gstin_raw"},
    "item_combinations": {**_ITEM_TEXT, "Item_Id": "item_id_raw", "HsnCode": "hsn_code",
                          "Tax Category": "tax_category_raw", "System Stock": "system_stock_snapshot"},
}
REQUIRED = {
    "sales_itemwise": ["Item Name", "Barcode", "Qty", "Net Total"],
    "sales_billwise": ["Bill No.", "Date", "Qty", "Net Total"],
    "purchase_itemwise": ["Purchase Id", "Item Name", "Barcode", "Total Qty"],
    "purchase_billwise": ["ID", "Date", "Supplier", "Total Qty"],
    "supplier_master": ["Supplier Code", "Supplier Name", "Mobile"],
    "item_combinations": ["Item_Id", "Barcode", "Item Name", "MRP"],
}
#: Numeric headers: a slice of the header list, or a list.
_NUMBERS = {
    "sales_itemwise": HEADERS["sales_itemwise"][17:],
    "sales_billwise": HEADERS["sales_billwise"][17:],
    "purchase_itemwise": ["Min Stock", "Max Stock", *HEADERS["purchase_itemwise"][14:]],
    "purchase_billwise": ["Age", *HEADERS["purchase_billwise"][10:]],
    "supplier_master": [],
    "item_combinations": ["Purchase Price", "MRP", "Rate", "System Stock"],
}
HAS_TOTALS_ROW = {"sales_billwise", "purchase_itemwise", "purchase_billwise"}
DEDUP_KEYS = {
    "sales_billwise": ["bill_no"],
    "sales_itemwise": ["bill_no", "barcode"],
    "purchase_billwise": ["invoice_no", "supplier_name_raw"],
    "purchase_itemwise": ["invoice_no", "barcode", "supplier_name_raw"],
}
# ---------------------------------------------------------------------------


def column_of(report_type: str, header: str) -> str:
    """Raw column of a header: its words in lower case, ``%`` as percent, ``(Rs)`` as amount, unless named."""
    named = NAMED[report_type].get(header)
    if named:
        return named
    words = header.replace("(Rs)", " amount").replace("%", " percent").lower()
    name = "_".join(re.findall(r"[a-z0-9]+", words))
    return name + "_raw" if report_type == "supplier_master" else name


HEADER_MAP = {r: {h: column_of(r, h) for h in hs} for r, hs in HEADERS.items()}
NUMERIC = {r: [HEADER_MAP[r][h] for h in hs] for r, hs in _NUMBERS.items()}
#: Rows are written with these beside the report's columns.
LINEAGE = ["source_file_name", "import_batch_id", "imported_at"]


def normalize_header(h: str) -> str:
    """NBSP and line breaks -> space, trimmed; inner spaces stay (column names only)."""
    return h.replace(" ", " ").replace("\r\n", " ").replace("\n", " ").replace("\r", " ").strip()


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " |\r\n|\n|\r", " "))


def stage_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, files) of staged lines: records are (file, _pos, record); files has _first, _last, _n, the first ``record`` and which end inside a quoted cell."""
    rows, files = records(lines)
    return rows, saved(files.select(FILE, "open").join(places(rows), FILE, "left"), "csv-files")


def file_headers(cells: DataFrame, report_type: str, drop_totals: bool | None = None) -> DataFrame:
    """S7 S8 S16, one row per file: _first, _last, _index (place of each known header), row_count, error_message.

    ``cells`` are the parsed files of :func:`stage_records`: _cells are a file's
    first record. ``row_count`` is the number of records before loading, without
    the header and the totals row. A file that lacks a required header, whose
    last quoted cell never ends, or that has no record has an ``error_message``
    and a null count. Columns of a file that the report does not know are not read.
    """
    totals = report_type in HAS_TOTALS_ROW if drop_totals is None else drop_totals
    known = [normalize_header(h) for h in HEADERS[report_type]]
    first = F.when(F.col("_n").isNotNull(), F.col("_cells"))
    head = F.transform(first, lambda h: F.coalesce(_normal(h), F.lit("")))
    missing = F.array(*[F.when(~F.array_contains("_head", normalize_header(h)), F.lit(h)) for h in REQUIRED[report_type]])
    per = cells.withColumn("_head", head).withColumn("_missing", F.array_compact(missing))
    error = (F.when(F.col("open"), F.lit("a quoted cell never ends")).when(F.col("_head").isNull(), F.lit("empty file"))
             .when(F.size("_missing") > 0, F.concat(F.lit("missing required columns: "), F.array_join("_missing", ", "))))
    index = F.array(*[F.array_position("_head", h) for h in known])
    count = F.greatest(F.col("_n") - (2 if totals else 1), F.lit(0))
    return per.select(FILE, "_first", "_last", index.alias("_index"), F.lit(totals).alias("_totals"),
                      F.when(error.isNull(), count).alias("row_count"), error.alias("error_message"))


#: Text that the money type holds as it is: most cells need no decimal to tell.
PLAIN_NUMBER = r"^-?[0-9]{1,14}(?:\.[0-9]{1,4})?\z"


def inexact(c: Column) -> Column:
    """True where text is no number, or a number that the money type cannot hold without rounding."""
    wide = c.try_cast("decimal(38,18)")
    return ~F.coalesce(c.rlike(PLAIN_NUMBER), F.lit(False)) & c.isNotNull() & (
        wide.isNull() | c.try_cast(MONEY).isNull() | (wide != c.try_cast(MONEY).cast("decimal(38,18)")))


def typed_rows(rows: DataFrame, files: DataFrame, report_type: str, batch_id: int = 0, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(typed rows, quarantine) of the files without an error.

    Rows keep ``_order`` (file name, position), by which the first of equal
    keys wins. Quarantined rows keep their text and the reason. With ``once``
    both are read from one staged table, so records are parsed one time however
    often they are read; only quarantined rows have their text there.
    """
    good = files.where(F.col("error_message").isNull()).select("source_file_name", "_first", "_last", "_index", "_totals")
    body = rows.join(good, "source_file_name").where(
        (F.col("_pos") > F.col("_first")) & ~(F.col("_totals") & (F.col("_pos") == F.col("_last"))))
    columns = list(HEADER_MAP[report_type].values())
    places = [i for i, c in enumerate(columns) if c in NUMERIC[report_type]]
    # one array per row, not one expression per column, keeps the plan small at 79 columns
    picked = F.transform("_index", lambda i: clean_cell(F.get("_cells", (i - 1).cast("int"))))
    # a generator: a filter on what it makes stays above it, so that cells are cleaned once
    text = body.select("source_file_name", F.struct("source_file_name", "_pos").alias("_order"), F.inline(F.array(F.struct(picked.alias("_text")))))
    # over the cells themselves: a filter may be pushed below and must stay linear in them
    is_number = F.array(*[F.lit(i in places) for i in range(len(columns))])
    bad = F.array_compact(F.transform("_text", lambda x, i: F.when(F.get(is_number, i) & inexact(x), i)))
    flagged = text.withColumn("_bad", bad)
    cell = [F.get("_text", F.lit(i)) for i in range(len(columns))]
    typed = [(cell[i].try_cast(MONEY) if i in places else cell[i]).alias(c) for i, c in enumerate(columns)]
    if once:
        fine = F.size("_bad") == 0
        flagged = saved(flagged.select("source_file_name", "_order", "_bad", F.when(~fine, F.col("_text")).alias("_text"), *typed), "csv-rows", TEXT_CODEC)
        typed = columns
    good_rows = (flagged.where(F.size("_bad") == 0)
                 .select(*typed, "source_file_name", "_order")
                 .withColumn("import_batch_id", F.lit(batch_id).cast("long")).withColumn("imported_at", F.current_timestamp()))
    names = F.array(*[F.lit(c) for c in columns])
    quarantine = flagged.where(F.size("_bad") > 0).select(
        *[cell[i].alias(c) for i, c in enumerate(columns)], "source_file_name",
        F.concat(F.lit("bad_numeric: "), F.array_join(F.transform("_bad", lambda i: F.get(names, i)), ", ")).alias("reason"))
    return good_rows, quarantine


def report_of(lines: DataFrame, report_type: str, batch_id: int = 0, drop_totals: bool | None = None, once: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(typed rows, quarantine, files) of the lines of one report's files; batch and stream alike."""
    return report_of_staged(saved(lines, "csv-lines", TEXT_CODEC), report_type, batch_id, drop_totals, once)


def report_of_staged(lines: DataFrame, report_type: str, batch_id: int = 0, drop_totals: bool | None = None,
                     once: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`report_of` of lines that are staged; with ``once`` (see :func:`typed_rows`) nothing reads them afterwards."""
    rows, read = stage_records(lines)
    width = len(HEADERS[report_type])
    files = saved(file_headers(parsed(read, read, width), report_type, drop_totals), "csv-headers")
    good, quarantine = typed_rows(parsed(rows, read, width), files, report_type, batch_id, once)
    return good, quarantine, files


def read_report(spark: SparkSession, paths: list[str] | str, report_type: str, batch_id: int = 0,
                drop_totals: bool | None = None, once: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(typed rows, quarantine, files) of one report type over many files."""
    return report_of(read_lines(spark, paths), report_type, batch_id, drop_totals, once)


def require_columns(files: DataFrame, report_type: str) -> None:
    """S8 as an error: raise with the files that do not match the report (at most 20 are named)."""
    bad = files.where(F.col("error_message").isNotNull()).select("source_file_name", "error_message").limit(20).collect()
    if bad:
        raise ValueError(f"{report_type}: " + "; ".join(f"{r[0]}: {r[1]}" for r in bad))


#: Files up to this size are hashed from one row; longer ones line by line, with the same result.
WHOLE_FILE_BYTES = 64 << 20
_WHOLE_SPLIT = str(1 << 50)


def streamed_sha256(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_name, length, sha of files of any size: SHA-256 of their bytes, which no row could hold.

    SHA-256 goes through a file from end to end, so a file is one task; its
    lines pass through it in batches. A session of its own keeps the reader
    from splitting files or packing several into a task. The line reader takes
    off line feeds, and a byte order mark at the start; the file's length
    tells whether the last line had one and whether a mark was there.
    """
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.unset("spark.sql.files.maxPartitionNum")
    own.conf.set("spark.sql.files.maxPartitionBytes", _WHOLE_SPLIT)
    own.conf.set("spark.sql.files.openCostInBytes", _WHOLE_SPLIT)
    lines = own.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_size").alias("length"), F.col("value").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = size = None
        tries: list = []  # with and without a byte order mark
        seen, held = 0, b""
        for b in batches:
            for n, s, line in zip(*(b.column(i).to_pylist() for i in range(3))):
                if n != name:
                    if name is not None:
                        yield digest(name, size, tries, seen, held)
                    name, size, seen, held = n, s, 0, b""
                    tries = [hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")]
                else:
                    held += b"\n"
                for t in tries:
                    t.update(held)
                seen += len(held)
                held = line
        if name is not None:
            yield digest(name, size, tries, seen, held)

    def digest(name: str, size: int, tries: list, seen: int, held: bytes) -> pa.RecordBatch:
        seen += len(held)
        plain, marked = tries
        for t in tries:
            t.update(held)
        mark = size - seen >= 3
        one = marked if mark else plain
        if size - seen - 3 * mark == 1:
            one.update(b"\n")
        return pa.RecordBatch.from_pylist([{"file_name": name, "length": size, "sha": one.hexdigest()}])

    return lines.mapInArrow(run, "file_name string, length long, sha string")


def file_manifest(spark: SparkSession, paths: list[str] | str, ledger: DataFrame | None,
                  report_type: str) -> DataFrame:
    """SHA-256 per file and whether it is new (a dry run is this frame).

    A file is new if the ledger does not have its hash, whatever the status
    was, and no file with a smaller name has the same content. The hash is that
    of the file's bytes at every size.
    """
    listed = spark.read.format("binaryFile").load(paths)
    small = listed.where(F.col("length") <= WHOLE_FILE_BYTES).select(
        F.col("path").alias("file_name"), F.sha2(F.col("content"), 256).alias("file_hash"), "modificationTime")
    large = listed.where(F.col("length") > WHOLE_FILE_BYTES).select(F.col("path").alias("file_name"), "modificationTime")
    files = small
    names = [r["file_name"] for r in large.select("file_name").collect()]  # the driver lists these files anyway
    if names:
        found = [(r["file_name"] if r["file_name"] in names else unquote(r["file_name"]), r["sha"]) for r in streamed_sha256(spark, names).collect()]
        hashes = spark.createDataFrame(found, "file_name string, file_hash string")  # odd characters are escaped in file_path only
        files = small.unionByName(large.join(hashes, "file_name", "left").select("file_name", "file_hash", "modificationTime"))
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("file_name")) == 1
    files = files.withColumn("report_type", F.lit(report_type)).withColumn("_first", first)
    if ledger is None:
        return files.withColumnRenamed("_first", "is_new")
    done = ledger.select("file_hash").distinct().withColumn("_seen", F.lit(True))
    return files.join(done, "file_hash", "left").select(
        "file_name", "file_hash", "report_type", "modificationTime", (F.col("_first") & F.col("_seen").isNull()).alias("is_new"))


def latest_file(manifest: DataFrame) -> DataFrame:
    """Newest file per report type by modification time, then name."""
    return manifest.groupBy("report_type").agg(
        F.max_by("file_name", F.struct("modificationTime", "file_name")).alias("file_name"))


LEDGER = ("id long, file_name string, file_hash string, report_type string, row_count long, status string, "
          "error_message string, imported_at timestamp")


def ledger_rows(files: DataFrame, manifest: DataFrame, batch_id: int) -> DataFrame:
    """One ledger row per new file: its hash, its records before loading, SUCCESS or FAILED with the error."""
    new = manifest.where("is_new").select("file_name", "file_hash", "report_type")
    seen = files.select(F.col("source_file_name").alias("file_name"), "row_count", "error_message")
    empty = F.col("row_count").isNull() & F.col("error_message").isNull()  # no record at all
    error = F.when(empty, F.lit("empty file")).otherwise(F.col("error_message"))
    return new.join(seen, "file_name", "left").select(
        F.lit(batch_id).cast("long").alias("id"), "file_name", "file_hash", "report_type", "row_count",
        F.when(error.isNull(), F.lit("SUCCESS")).otherwise(F.lit("FAILED")).alias("status"),
        error.alias("error_message"), F.current_timestamp().alias("imported_at"))


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@released()
def ingest_batch(spark: SparkSession, paths: list[str] | str, report_type: str, table: str, ledger: str,
                 batch_id: int) -> DataFrame:
    """S10-S20 in one chain: manifest -> read the new files -> dedup -> append -> ledger; returns the new ledger rows.

    The files' text is scanned once. A batch writes its own folders
    (``import_batch_id=``) of the raw table, its quarantine, its counts and the
    ledger, and overwrites them, so a batch that runs again after a failure
    leaves nothing twice. The counts (``ledger``_counts: rows loaded and rows
    quarantined) are observed while those rows are written. The ledger is
    written last: until then the files count as new.
    """
    mine = f"import_batch_id={batch_id}"

    def earlier(path: str) -> DataFrame | None:
        if not path_exists(spark, path):
            return None
        return spark.read.option("basePath", path).parquet(path).where(F.col("import_batch_id") != batch_id)

    manifest = file_manifest(spark, paths, earlier(ledger), report_type)
    manifest.write.mode("overwrite").parquet(f"{ledger}_manifest/{mine}")
    manifest = spark.read.parquet(f"{ledger}_manifest/{mine}")
    names = [r["file_name"] for r in manifest.where("is_new").select("file_name").collect()]  # the driver lists these files anyway
    if names:
        rows, quarantine, files = read_report(spark, names, report_type, batch_id, once=True)
        keys = DEDUP_KEYS.get(report_type)
        if keys:
            before = earlier(table)
            loaded = before if before is not None else rows.limit(0)
            rows = without(rows, repeated(loaded.select(*keys), rows, keys, "_order"), "_order")
        loads, bad = Observation(), Observation()
        count = F.count(F.lit(1)).alias("rows")
        rows.drop("_order", "import_batch_id").observe(loads, count).write.mode("overwrite").parquet(f"{table}/{mine}")
        quarantine.observe(bad, count).write.mode("overwrite").parquet(f"{table}_quarantine/{mine}")
        (spark.createDataFrame([(loads.get["rows"], bad.get["rows"])], "loaded long, quarantined long")
         .write.mode("overwrite").parquet(f"{ledger}_counts/{mine}"))
        entries = ledger_rows(files, manifest, batch_id)
    else:
        entries = spark.createDataFrame([], LEDGER)
    entries.write.mode("overwrite").parquet(f"{ledger}/{mine}")
    return spark.read.parquet(f"{ledger}/{mine}")


def key_null(keys: list[str]) -> Column:
    c = F.lit(False)
    for k in keys:
        c = c | F.col(k).isNull()
    return c


def load_dedup(existing: DataFrame, batch: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Rows of ``batch`` to append -- first per key in the batch, key not yet loaded.

    Rows with a NULL key part always pass (SQL equality never matches them).
    """
    nulls = batch.filter(key_null(keys))
    keyed = batch.filter(~key_null(keys))
    w = Window.partitionBy(*keys).orderBy(F.col(order_col))
    first = keyed.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    loaded = existing.select(*keys).filter(~key_null(keys)).distinct()
    fresh = first.join(loaded, keys, "left_anti")
    return fresh.unionByName(nulls)


def repeated(existing: DataFrame, batch: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """``order_col`` of the rows that :func:`load_dedup` leaves out; only keys and order are dealt."""
    keyed = batch.filter(~key_null(keys)).select(*keys, order_col)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order_col)))
    loaded = existing.select(*keys).filter(~key_null(keys)).distinct().withColumn("_seen", F.lit(True))
    return (keyed.withColumn("_rn", rn).join(loaded, keys, "left")
            .filter((F.col("_rn") > 1) | F.col("_seen").isNotNull()).select(order_col))


def without(rows: DataFrame, left_out: DataFrame, order_col: str) -> DataFrame:
    """``rows`` but for those of ``left_out`` (values of ``order_col``, each the mark of one row): few are broadcast, and wide rows stay where they are."""
    return rows.join(broadcast_if_small(saved(left_out, "csv-repeated")), order_col, "left_anti")


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """The table after upserting ``batch`` (first duplicate in the batch wins)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order_col))
    first = batch.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    kept = existing.join(first.select(*keys), keys, "left_anti")
    return kept.unionByName(first.select(*existing.columns))


# File-name substrings that route a dropped export to its report type.
ROUTES = [
    ("sales_itemwise", ["sales-itemwise"]),
    ("sales_billwise", ["sales-billwise"]),
    ("purchase_itemwise", ["purchase-itemwise"]),
    ("purchase_billwise", ["purchase-billwise"]),
    ("supplier_master", ["supplier-master"]),
    ("item_combinations", ["item-combination", "item-master"]),
]


def route_files(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Report type from the file's own name in lower case, blanks and ``_`` read as ``-`` (first route wins)."""
    n = F.regexp_replace(F.lower(F.element_at(F.split(F.col(name_col), "/"), -1)), "%20|[ _]", "-")
    rt = F.lit(None).cast("string")
    for report, keys in reversed(ROUTES):
        cond = F.lit(False)
        for k in keys:
            cond = cond | n.contains(k)
        rt = F.when(cond, F.lit(report)).otherwise(rt)
    return files.withColumn("report_type", rt)


# ---------------------------------------------------------------- counted quarantine
def quarantine_counts(bills: DataFrame, items: DataFrame, pbills: DataFrame, pitems: DataFrame) -> DataFrame:
    """Rows of each raw table that the derived tables leave out, by reason (table, reason, rows).

    One pass per table; every check is a conditional count, so nothing is
    dropped without a number.
    """
    from ..functions.cleaning import export_date, plain_date

    def count(df: DataFrame, table: str, **reasons: Column) -> DataFrame:
        one = df.agg(*[F.count_if(c).alias(r) for r, c in reasons.items()])
        pairs = F.map_from_arrays(F.array(*[F.lit(r) for r in reasons]), F.array(*[F.col(r) for r in reasons]))
        return one.select(F.lit(table).alias("table"), F.explode(pairs).alias("reason", "rows"))

    def dated(c: str, parse) -> dict[str, Column]:
        return {"null_date": F.col(c).isNull(), "bad_date": F.col(c).isNotNull() & parse(c).isNull()}

    no_code = {"null_barcode": F.col("barcode").isNull()}
    return (count(bills, "raw_sales_billwise", **dated("bill_datetime_raw", export_date))
            .unionByName(count(items, "raw_sales_itemwise", **dated("sale_datetime_raw", export_date), **no_code))
            .unionByName(count(pbills, "raw_purchase_billwise", **dated("purchase_date_raw", plain_date)))
            .unionByName(count(pitems, "raw_purchase_itemwise", **dated("purchase_date_raw", plain_date), **no_code)))
