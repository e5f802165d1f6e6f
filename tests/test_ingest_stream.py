"""Ingest (totals row, quarantine, dedup, upsert), calendar edges, streaming == batch."""

import datetime as dt
import os

from pyspark.sql import functions as F

from basketry.operators import calendar as cal
from basketry.sources import ingest


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_header_maps_are_whole():
    """Column counts and names that the header rule must give."""
    assert {r: len(m) for r, m in ingest.HEADER_MAP.items()} == {
        "sales_itemwise": 40, "sales_billwise": 79, "purchase_itemwise": 23, "purchase_billwise": 25, "supplier_master": 20, "item_combinations": 14}
    assert all(len(set(m.values())) == len(m) for m in ingest.HEADER_MAP.values())
    m = ingest.HEADER_MAP
    assert [m["sales_billwise"][h] for h in ("GST-0", "taxable Amt18  %", "IGST 40 %", "CGST 1.5 %", "SGST 20 %", "Cust Disc %", "Bill Discount", "Phone Pe", "Net Total")] == [
        "taxable_amt_0", "taxable_amt_18_percent", "igst_40", "cgst_1_5", "sgst_20", "cust_discount_percent", "bill_discount_amount", "phonepe_amount", "net_total"]
    assert [m["sales_itemwise"][h] for h in ("Disc1(%)", "Total Discount(Rs)", "CESS(Rs)", "GSTIN No", "Cur Stk")] == [
        "discount_percent", "total_discount_amount", "cess_amount", "gstin", "current_stock_snapshot"]
    assert [m["purchase_itemwise"][h] for h in ("GST (%)", "Free Qty- PHM", "QTY - WH", "Profit(%)", "Pur.Date")] == [
        "gst_percent", "free_qty_phm", "qty_wh", "profit_percent", "purchase_date_raw"]
    assert [m["purchase_billwise"][h] for h in ("Ref. ID", "Total Disc1(Rs)", "GST-28", "Total Tax", "Time")] == [
        "ref_id", "total_disc1_amount", "gst_28", "tax_amount", "purchase_time_raw"]
    assert [m["supplier_master"][h] for h in ("Id", "GSTIN / UID", "city", "Closing Balance")] == ["supplier_id_raw", "gstin_raw", "city_raw", "closing_balance_raw"]
    assert [m["item_combinations"][h] for h in ("Item_Id", "HsnCode", "MRP")] == ["item_id_raw", "hsn_code", "mrp"]
    assert "gst_percent" not in ingest.NUMERIC["purchase_itemwise"] and "age" in ingest.NUMERIC["purchase_billwise"]


def test_columns_match_by_name_in_every_file(spark, tmp_path):
    """Swapped columns, an NBSP header, a header with a line break, double blanks, a missing optional column, an unknown one."""
    write(tmp_path / "a.csv", "Bill No.,Date,Qty,Net Total,Cash,taxable Amt0  %\n1,04-04-2025 07:29 AM,2,100.0,7,5\n2,04-04-2025 08:00 AM,1,abc,0,\n,,3,200.0,,\n")
    write(tmp_path / "b.csv", "Cash,Net\u00a0Total,Qty,Strange,Date,\"Bill\nNo.\"\n50.5,60.5,1,zzz,05-04-2025 18:30,3\n,60.5,1,,,\n")
    write(tmp_path / "c.csv", "Net Total,Qty,Date,Bill No.\n9.12345,1,06-04-2025 18:30,4\n8.1234,1,06-04-2025 18:30,5\n,,,\n")
    rows, bad, files = ingest.read_report(spark, str(tmp_path), "sales_billwise", batch_id=7)
    got = sorted((r.bill_no, float(r.net_total), r.cash_amount and float(r.cash_amount), r.taxable_amt_0_percent and float(r.taxable_amt_0_percent)) for r in rows.collect())
    assert got == [("1", 100.0, 7.0, 5.0), ("3", 60.5, 50.5, None), ("5", 8.1234, None, None)]
    # a bad number and a fifth decimal are kept aside with their text, never rounded
    assert sorted((r.bill_no, r.net_total, r.reason) for r in bad.collect()) == [("2", "abc", "bad_numeric: net_total"), ("4", "9.12345", "bad_numeric: net_total")]
    assert {r.import_batch_id for r in rows.collect()} == {7}
    assert sorted(r.row_count for r in files.collect()) == [1, 2, 2]
    assert {os.path.basename(r.source_file_name) for r in rows.collect()} == {"a.csv", "b.csv", "c.csv"}


def test_split_files_keep_their_order(spark, tmp_path):
    """A large file is split: header and totals row are still the file's own."""
    body = "".join(f"{i},04-04-2025 07:29 AM,1,{i}.5\n" for i in range(3000))
    write(tmp_path / "x.csv", "Bill No.,Date,Qty,Net Total\n" + body + "TOTAL,,3000,1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows, _, files = ingest.read_report(spark, str(tmp_path), "sales_billwise")
        assert sorted(int(r.bill_no) for r in rows.collect()) == list(range(3000))
        assert files.first().row_count == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_missing_required_column_fails_its_file_alone(spark, tmp_path):
    write(tmp_path / "x.csv", "Bill No.,Qty\n1,2\n")
    write(tmp_path / "y.csv", "Bill No.,Qty,Date,Net Total\n1,2,d,3\n,,,\n")
    rows, _, files = ingest.read_report(spark, str(tmp_path), "sales_billwise")
    assert [r.bill_no for r in rows.collect()] == ["1"]
    try:
        ingest.require_columns(files, "sales_billwise")
    except ValueError as e:
        assert "Net Total" in str(e) and "Date" in str(e) and "x.csv" in str(e) and "y.csv" not in str(e)
    else:
        raise AssertionError("expected a missing-column error")


def test_all_79_columns_round_trip(spark, tmp_path):
    heads = ingest.HEADERS["sales_billwise"]
    values = {h: str(i) if ingest.HEADER_MAP["sales_billwise"][h] in ingest.NUMERIC["sales_billwise"] else f"t{i}" for i, h in enumerate(heads)}
    mixed = heads[40:] + heads[:40][::-1]
    write(tmp_path / "w.csv", ",".join(mixed) + "\n" + ",".join(values[h] for h in mixed) + "\n" + "," * 78 + "\n")
    row = ingest.read_report(spark, str(tmp_path), "sales_billwise")[0].first()
    for h, c in ingest.HEADER_MAP["sales_billwise"].items():
        assert (f"{row[c]:f}".rstrip("0").rstrip(".") or "0" if not isinstance(row[c], str) else row[c]) == values[h]


def test_ingest_chain_is_idempotent(spark, tmp_path):
    """Hash ledger, FAILED rows, first bill by file name, and a batch that runs twice."""
    src, table, ledger = tmp_path / "in", str(tmp_path / "raw"), str(tmp_path / "ledger")
    head = "Bill No.,Date,Qty,Net Total\n"
    write(src / "b_second.csv", head + "1,d,1,200\n2,d,1,5\n" + "9,d,1,1\n" * 3000 + ",,,\n")
    write(src / "a_first.csv", head + "1,d,1,100\n,,,\n")
    write(src / "copy.csv", head + "1,d,1,100\n,,,\n")
    write(src / "bad.csv", "Bill No.,Qty\n1,2\n")
    run = lambda n: {os.path.basename(r.file_name): (r.status, r.row_count, r.file_hash) for r in
                     ingest.ingest_batch(spark, str(src), "sales_billwise", table, ledger, n).collect()}
    first = run(1)
    assert {k: v[:2] for k, v in first.items()} == {"a_first.csv": ("SUCCESS", 1), "b_second.csv": ("SUCCESS", 3002), "bad.csv": ("FAILED", None)}
    assert all(len(v[2]) == 64 for v in first.values())
    assert run(1) == first  # the same batch again, as after a failure
    assert run(2) == {}
    got = {r.bill_no: float(r.net_total) for r in spark.read.parquet(table).collect()}
    assert got == {"1": 100.0, "2": 5.0, "9": 1.0} and spark.read.parquet(table).count() == 3


def test_load_dedup_first_wins_and_null_keys(spark):
    existing = spark.createDataFrame([("b1", "x", 0)], "bill_no string, barcode string, pos int")
    batch = spark.createDataFrame([("b1", "x", 1), ("b2", "y", 3), ("b2", "y", 2), (None, "z", 4), (None, "z", 5)],
                                  "bill_no string, barcode string, pos int")
    got = sorted(((r.bill_no or ""), r.barcode, r.pos) for r in
                 ingest.load_dedup(existing, batch, ["bill_no", "barcode"], "pos").collect())
    # b1/x already loaded; b2/y first by position; both NULL-key rows always pass
    assert got == [("", "z", 4), ("", "z", 5), ("b2", "y", 2)]


def test_upsert_replaces_and_keeps(spark):
    existing = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, o int")
    batch = spark.createDataFrame([("b", 20, 2), ("b", 21, 1), ("c", 3, 0)], "k string, v int, o int")
    got = sorted(tuple(r) for r in ingest.upsert(existing, batch, ["k"], "o").collect())
    assert got == [("a", 1, 0), ("b", 21, 1), ("c", 3, 0)]


def test_file_manifest_skips_loaded_hashes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.csv").write_text("x\n2\n")
    m = ingest.file_manifest(spark, str(tmp_path), None, "t")
    first = {os.path.basename(r.file_name): r.file_hash for r in m.collect()}
    ledger = spark.createDataFrame([(first["a.csv"], "SUCCESS")], "file_hash string, status string")
    again = {os.path.basename(r.file_name): r.is_new for r in
             ingest.file_manifest(spark, str(tmp_path), ledger, "t").collect()}
    assert again == {"a.csv": False, "b.csv": True}


def test_hash_is_sha256_of_the_bytes_at_every_size(spark, tmp_path, monkeypatch):
    """Streamed or from one row, whatever the splits; moved lines, ends of line, a byte order mark and bytes that are no text count."""
    import hashlib
    lines = [f"{i},name {i * 7919 % 1000},{i * i}" for i in range(3000)]
    text = "\n".join(lines).encode()
    contents = {"a b.csv": text + b"\n", "c.csv": text + b"\n", "cut.csv": text, "crlf.csv": text.replace(b"\n", b"\r\n"), "mark.csv": b"\xef\xbb\xbf" + text,
                "mark_end.csv": b"\xef\xbb\xbf" + text + b"\n", "raw.csv": bytes(range(256)) * 40, "moved.csv": "\n".join([lines[1], lines[0], *lines[2:]]).encode(),
                "breaks.csv": b"\n" * 500, "small.csv": b"x\n"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    want = {n: hashlib.sha256(d).hexdigest() for n, d in contents.items()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for limit, size in ((1 << 26, "64m"), (100, "2k"), (100, "64m")):
            monkeypatch.setattr(ingest, "WHOLE_FILE_BYTES", limit)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            m = ingest.file_manifest(spark, str(tmp_path), None, "t")
            assert {os.path.basename(r.file_name): r.file_hash for r in m.collect()} == want
            assert spark.conf.get("spark.sql.files.maxPartitionBytes") == size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    ledger = spark.createDataFrame([(want["c.csv"],)], "file_hash string")
    new = {os.path.basename(r.file_name): r.is_new for r in ingest.file_manifest(spark, str(tmp_path), ledger, "t").collect()}
    assert {n for n, is_new in new.items() if not is_new} == {"a b.csv", "c.csv"}


def plain_records(text):
    """Records as a character automaton finds them: a quote opens at a cell's start only, a doubled one is one."""
    out, cur, state, i = [], "", "start", 0
    while i < len(text):
        ch = text[i]
        if state == "in":
            if ch == '"' and text[i + 1:i + 2] == '"':
                cur, i = cur + '""', i + 2
                continue
            state = "plain" if ch == '"' else "in"
        elif ch == "\n":
            out.append(cur)
            cur, state, i = "", "start", i + 1
            continue
        else:
            state = "in" if ch == '"' and state == "start" else "start" if ch == "," else "plain"
        cur, i = cur + ch, i + 1
    return [r for r in [*out, cur] if r.strip(" ")], state == "in"


def test_records_with_line_breaks_split_anywhere(spark, tmp_path):
    """Cells with line breaks, quotes, commas and long runs of lines: 8 KB ranges give the same records as a character automaton."""
    import random
    from basketry.sources import records
    rnd = random.Random(4)
    cell = lambda: rnd.choice(['plain', '', '5" pipe', '"quoted"', '"a ""b"" c"', '"two\nlines"', '"x,\n""\n,y"', 'it\'s "so"', '"closed"tail', '""', '"\n"', '"' + "long\n" * rnd.randint(1, 400) + '"'])
    for k in range(3):
        text = "\n".join(",".join(cell() for _ in range(4)) if rnd.random() < 0.2 else f"{i},plain row,{i},x" for i in range(2500)) + "\n"
        (tmp_path / f"f{k}.csv").write_text(text)
    (tmp_path / "open.csv").write_text('a,b\n1,"never\nclosed\n' + "x,y\n" * 3000)
    (tmp_path / "none.csv").write_text("a,b\n" * 4000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = records.read_lines(spark, str(tmp_path))
        assert lines.select("source_file_name", "block").distinct().count() > 20
        rows, files = records.records(lines)
        got = {}
        for r in sorted(rows.collect(), key=lambda r: r._pos):
            got.setdefault(os.path.basename(r.source_file_name), []).append(r.record)
        ends = {os.path.basename(r.source_file_name): r.open for r in files.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in ("f0.csv", "f1.csv", "f2.csv", "none.csv"):
        want, is_open = plain_records((tmp_path / name).read_text())
        assert got[name] == want and not is_open and not ends[name]
    assert ends["open.csv"] and "open.csv" not in got


def test_split_cells_equal_the_unsplit_read(spark, tmp_path):
    """A report whose cells hold line breaks, in 8 KB ranges, against Spark's own unsplit reader."""
    import csv
    heads = ["Item_Id", "Item Name", "Barcode", "MRP", "Unknown", *[f"more {i}" for i in range(120)]]
    with open(tmp_path / "m.csv", "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(heads)
        for i in range(4000):
            w.writerow([i, f'Oil "A"\n{i} ml, tin' if i % 7 == 0 else f"Plain {i}", f"b{i}", f"{i}.50", "x\ny" * (i % 3)] + [""] * 120)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows, bad, files = ingest.read_report(spark, str(tmp_path), "item_combinations")
        got = sorted((int(r.item_id_raw), r.item_name_raw, r.barcode, float(r.mrp)) for r in rows.collect())
        assert bad.count() == 0 and files.first().row_count == 4000 and files.first().error_message is None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    assert got == sorted((int(r["Item_Id"]), r["Item Name"], r["Barcode"], float(r["MRP"])) for r in whole.collect())


def test_the_chain_scans_the_text_once(spark, tmp_path, monkeypatch):
    """One text scan a batch, counts observed while writing."""
    from pyspark.sql.readwriter import DataFrameReader
    scans = []
    text = DataFrameReader.text
    monkeypatch.setattr(DataFrameReader, "text", lambda self, *a, **k: scans.append(a) or text(self, *a, **k))
    monkeypatch.setattr(DataFrameReader, "csv", lambda *a, **k: scans.append(("csv", a)))
    src, table, ledger = tmp_path / "in", str(tmp_path / "raw"), str(tmp_path / "ledger")
    write(src / "a.csv", "Bill No.,Date,Qty,Net Total\n1,d,1,100\n2,d,x,5\n2,d,1,5\n2,d,1,6\n,,,\n")
    ingest.ingest_batch(spark, str(src), "sales_billwise", table, ledger, 1)
    assert len(scans) == 1
    counts = spark.read.parquet(f"{ledger}_counts").first()
    assert (counts.loaded, counts.quarantined) == (2, 1)


def test_calendar_edges(spark):
    fest = spark.createDataFrame(
        [("Dhanteras", 0, dt.date(2024, 10, 29), 3, 1), ("Diwali", 1, dt.date(2024, 10, 31), 5, 3)],
        cal.FESTIVAL_SCHEMA)
    c = {r.date: r for r in cal.calendar_dim(spark, F.lit(dt.date(2024, 10, 20)), F.lit(dt.date(2024, 11, 5)),
                                             festivals=fest).collect()}
    assert c[dt.date(2024, 10, 29)].days_to_next_festival == 0
    assert c[dt.date(2024, 10, 29)].days_since_last_festival == 0
    assert c[dt.date(2024, 10, 20)].days_since_last_festival is None
    assert c[dt.date(2024, 11, 5)].days_to_next_festival is None
    assert c[dt.date(2024, 10, 28)].festival_name == "Dhanteras"  # overlap: earlier in list wins
    assert c[dt.date(2024, 10, 26)].festival_name == "Dhanteras"
    assert c[dt.date(2024, 11, 1)].festival_name == "Diwali"
    assert c[dt.date(2024, 10, 25)].festival_name is None
    assert c[dt.date(2024, 10, 20)].dow == 0 and c[dt.date(2024, 10, 20)].is_weekend


def test_stream_daily_sales_equals_batch(spark):
    """Bills over many files without order in time: no bill is late."""
    from basketry.plans import registry as R
    from tests.conftest import SMALL
    stream = {(r.sale_date, r.total_bills, r.total_revenue) for r in
              R.QUERIES["stream_daily_sales"](spark, SMALL).collect()}
    batch = {(r.sale_date, r.total_bills, r.total_revenue) for r in
             R.QUERIES["daily_sales_summary"](spark, SMALL).filter(F.col("total_bills").isNotNull()).collect()}
    assert stream == batch


def test_stream_uses_the_batch_path(spark, tmp_path):
    """By-name columns, cleaning, quarantine, failed files, order of file names, and a second run with new files."""
    from basketry.streaming import jobs
    src, target = tmp_path / "drop", str(tmp_path / "raw")
    write(src / "b_second.csv", "Net Total,Qty,Date,Bill No.\n200,1,04-04-2025 18:30,1\n7,1,05-04-2025 18:30,2.0\n" + "3,1,05-04-2025 18:30,9\n" * 2000 + ",,,\n")
    write(src / "a_first.csv", "Bill No.,Date,Qty,Net Total\n1,04-04-2025 18:30,1,100\n,04-04-2025 18:30,1,1\n3,04-04-2025 18:30,x,1\n,,,\n")
    write(src / "bad.csv", "Bill No.,Qty\n1,2\n")
    days = str(tmp_path / "days")
    go = lambda: jobs.stream_ingest(spark, str(src), "sales_billwise", target, str(tmp_path / "ck"),
                                    after=jobs.recompute_days(target, days, jobs.daily_sales), day=jobs.export_date("bill_datetime_raw")).awaitTermination()
    rows = lambda: sorted((r.bill_no or "", float(r.net_total)) for r in spark.read.parquet(target).collect())
    go()
    assert rows() == [("", 1.0), ("1", 100.0), ("2", 7.0), ("9", 3.0)]
    assert [r.reason for r in spark.read.parquet(f"{target}_quarantine").collect()] == ["bad_numeric: total_qty"]
    assert [os.path.basename(r.source_file_name) for r in spark.read.parquet(f"{target}_failed").collect()] == ["bad.csv"]
    write(src / "c_third.csv", "Qty,Bill No.,Net Total,Date\n1,2,99,05-04-2025 18:30\n1,4,50,04-04-2025 18:30\n,,,\n")
    go()
    assert rows() == [("", 1.0), ("1", 100.0), ("2", 7.0), ("4", 50.0), ("9", 3.0)]
    got = {str(r.sale_date): (r.total_bills, r.total_revenue) for r in jobs.current_days(spark, days).collect()}
    assert got == {"2025-04-04": (3, 151.0), "2025-04-05": (2, 10.0)}


def test_dedup_over_epochs_reads_no_earlier_rows(spark, tmp_path):
    """Many epochs equal one batch, first row of a key wins, and the loaded table may be gone: keys come from the state."""
    import random
    import shutil
    from basketry.streaming import jobs
    rnd = random.Random(5)
    src, target, ck = tmp_path / "drop", str(tmp_path / "raw"), str(tmp_path / "ck")
    want = {}
    go = lambda: jobs.stream_ingest(spark, str(src), "sales_billwise", target, ck).awaitTermination()
    for epoch in range(3):
        for part in range(2):
            lines = []
            for i in range(60):
                bill, total = rnd.randint(1, 150), epoch * 1000 + part * 100 + i
                want.setdefault(str(bill), float(total))
                lines.append(f"{bill},04-04-2025 18:30,1,{total}")
            write(src / f"e{epoch}p{part}.csv", "Bill No.,Date,Qty,Net Total\n" + "\n".join(lines) + "\n,,,\n")
        go()
        if epoch == 0:  # what the first epoch loaded is moved away: later epochs must not need it
            first = {r.bill_no: float(r.net_total) for r in spark.read.parquet(target).collect()}
            shutil.copytree(target, tmp_path / "kept")
            for f in (tmp_path / "raw").rglob("*.parquet"):
                f.write_bytes(b"unreadable")
    spark.catalog.clearCache()
    later = {}
    for folder in sorted((tmp_path / "raw").glob("kind=keyed/epoch=*")):
        if all(f.read_bytes() != b"unreadable" for f in folder.glob("*.parquet")):
            later |= {r.bill_no: float(r.net_total) for r in spark.read.parquet(str(folder)).collect()}
    assert not set(first) & set(later) and first | later == want


def test_recomputed_days_open_their_folders_alone(spark, tmp_path):
    from basketry.streaming import jobs
    rows = spark.createDataFrame([(f"03-{m:02d}-2025 18:30", str(m)) for m in range(1, 13)] + [("04-04-2025 18:30", "x")], "bill_datetime_raw string, bill_no string")
    rows = jobs.by_month(rows, jobs.export_date("bill_datetime_raw"))
    rows.write.partitionBy("month").parquet(str(tmp_path / "raw" / "kind=keyed" / "epoch=0"))
    some = jobs.touched_rows(spark, str(tmp_path / "raw"), rows.schema, [dt.date(2025, 4, 3), dt.date(2025, 9, 3)])
    assert sorted(r.bill_no for r in some.collect()) == ["4", "9"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "month#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_session_names_no_master_and_no_local_checkpoint_off_a_local_master(spark, monkeypatch):
    import pytest
    from basketry import session
    assert "spark.master" not in session.DEFAULT_CONF and "spark.driver.memory" not in session.DEFAULT_CONF
    assert session.on_one_machine(spark)

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Cluster:
        sparkContext = Context()
        conf = {}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Cluster())
    for master, local in (("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("yarn", False)):
        Context.master = master
        assert session.on_one_machine(Cluster()) == local


def test_route_files(spark):
    names = {"/in/sales-itemwise-2025.csv": "sales_itemwise", "/in/Sales-Billwise_jan.csv": "sales_billwise", "/in/PURCHASE-ITEMWISE.csv": "purchase_itemwise",
             "/in/purchase_billwise 3.csv": "purchase_billwise", "/in/Supplier Master.csv": "supplier_master", "/in/item-combinations.csv": "item_combinations",
             "/sales-itemwise/notes.txt": None}
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    assert [r.report_type for r in ingest.route_files(df).collect()] == list(names.values())


def test_exports_grow_by_files_and_records_are_not_staged_again(spark, small_tables, tmp_path, monkeypatch):
    """No export file has more rows than the limit, whatever the report's size; rows and totals are those of few files."""
    from basketry import session
    from basketry.sources import fixtures, records
    read = lambda folder: ingest.read_report(spark, f"{folder}/*", "purchase_billwise")
    few = fixtures.write_export(fixtures.export_cells(small_tables, "purchase_billwise"), "purchase_billwise", str(tmp_path / "few"))
    monkeypatch.setattr(fixtures, "EXPORT_ROWS", 60)
    many = fixtures.write_export(fixtures.export_cells(small_tables, "purchase_billwise"), "purchase_billwise", str(tmp_path / "many"))
    staged, save = [], session.saved
    for m in (ingest, records):
        monkeypatch.setattr(m, "saved", lambda df, name, *a: staged.append(name) or save(df, name, *a))
    out = []
    for folder in (few, many):
        good, bad, files = read(folder)
        drop = ("source_file_name", "_order", "imported_at")
        out.append((sorted(map(str, good.drop(*drop).collect())), sorted(map(str, bad.drop(*drop).collect())), files.count()))
    assert out[0][:2] == out[1][:2] and out[0][2] == 7 < out[1][2] and len(out[0][0]) > 100
    assert "csv-records" not in staged and "csv-cells" not in staged
    assert fixtures.slices_of(36_000_000) == 600_000 and fixtures.slices_of(1) == 7


def kept(spark):
    """Names of the tables and folders in the shared folder."""
    from urllib.parse import urlparse
    return set(os.listdir(urlparse(spark.sparkContext.getCheckpointDir()).path))


def test_lines_with_breaks_are_not_staged_again_and_read_exports_go(spark, tmp_path, monkeypatch):
    from basketry import session
    from basketry.plans import registry as R
    from basketry.sources import records
    from tests.conftest import SMALL
    staged, save = [], session.saved
    for m in (ingest, records):
        monkeypatch.setattr(m, "saved", lambda df, name, *a: staged.append((name, df)) or save(df, name, *a))
    write(tmp_path / "a.csv", 'Item_Id,Item Name,Barcode,MRP\n1,"Oil\n5",b1,2.5\n2,Salt,b2,3\n')
    rows = ingest.read_report(spark, str(tmp_path), "item_combinations")[0]
    assert sorted((r.item_id_raw, r.item_name_raw) for r in rows.collect()) == [("1", "Oil\n5"), ("2", "Salt")]
    assert sorted(n for n, df in staged if "line" in df.columns or "record" in df.columns) == ["csv-files", "csv-heads", "csv-lines", "csv-spanning"]
    before = kept(spark)
    assert R.QUERIES["ingest_supplier_master"](spark, SMALL).count() > 0
    R.QUERIES["ingest_quarantine"](spark, SMALL)
    left = {n.split("-")[1] for n in kept(spark) - before if n.startswith("basketry-")}
    assert left <= {"csv", "quarantine"} and len([n for n in kept(spark) - before if n.startswith("basketry-csv-lines")]) == 1


def test_stream_dedup_deals_keys_alone_and_an_epoch_leaves_nothing_staged(spark, tmp_path):
    from basketry.streaming import jobs
    src, target = tmp_path / "drop", str(tmp_path / "raw")
    go = lambda: jobs.stream_ingest(spark, str(src), "sales_billwise", target, str(tmp_path / "ck")).awaitTermination()
    before = kept(spark)
    write(src / "a.csv", "Bill No.,Date,Qty,Net Total\n1,d,1,100\n2,d,1,5\n1,d,1,7\n,d,1,8\n,d,1,8\n3,d,x,1\n,,,\n")
    go()
    write(src / "b.csv", "Bill No.,Date,Qty,Net Total\n2,d,1,6\n4,d,1,50\n4,d,1,51\n,,,\n")
    go()
    assert sorted((r.bill_no or "", float(r.net_total)) for r in spark.read.parquet(target).collect()) == [("", 8.0), ("", 8.0), ("1", 100.0), ("2", 5.0), ("4", 50.0)]
    assert set(spark.read.parquet(f"{target}_arrivals").columns) == {"bill_no", "_order", "epoch"}
    assert not {n for n in kept(spark) - before if n.startswith("basketry-")}


def test_cells_are_cleaned_once_and_records_parsed_once(spark, tmp_path):
    write(tmp_path / "a.csv", "Bill No.,Date,Qty,Net Total\n1.0,d,1,100\n2,d,x,5\n,,,\n")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows, bad, _ = ingest.read_report(spark, str(tmp_path), "sales_billwise")
    assert plan(rows).count("regexp_replace(") == plan(bad).count("regexp_replace(") == 1
    rows, bad, _ = ingest.read_report(spark, str(tmp_path), "sales_billwise", once=True)
    assert all("from_csv" not in plan(df) and "regexp_replace" not in plan(df) for df in (rows, bad))
    assert [(r.bill_no, float(r.net_total)) for r in rows.collect()] == [("1", 100.0)] and [(r.bill_no, r.total_qty) for r in bad.collect()] == [("2", "x")]


def test_plain_numbers_are_told_as_decimals_tell_them(spark):
    from basketry.functions.numeric import MONEY
    cells = ["0", "-1", "007", "1.2345", "1.23456", "1.23450", "99999999999999", "99999999999999.9999", "100000000000000", "1e3", "1e-5", "+5", ".5", "5.", "5\n", " 5", "x", "", "-", "1,5", "١", None]
    c = F.col("c")
    wide = c.try_cast("decimal(38,18)")
    old = c.isNotNull() & (wide.isNull() | c.try_cast(MONEY).isNull() | (wide != c.try_cast(MONEY).cast("decimal(38,18)")))
    got = spark.createDataFrame([(x,) for x in cells], "c string").select(c, ingest.inexact(c).alias("a"), old.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and {r.c for r in got if not r.a} >= {"0", "1.2345", "99999999999999.9999", "1e3"}
