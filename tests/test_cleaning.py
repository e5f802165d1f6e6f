"""Literal edge rows for the column cleaners."""

import datetime as dt

from pyspark.sql import functions as F

from basketry.functions import cleaning as C
from basketry.operators import catalog, entity


def one_col(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(fn(F.col("s"))).collect()]


def test_export_date_variants(spark):
    vals = ["04-04-202507:29 AM", "04-04-2025 07:29 AM", "04-04-2025 18:30",
            "2026-01-03 18:45", None, "TOTAL", "99-04-2025 18:30"]
    got = one_col(spark, vals, C.export_date)
    d = dt.date(2025, 4, 4)
    assert got == [d, d, d, None, None, None, None]


def test_export_timestamp(spark):
    got = one_col(spark, ["04-04-202507:29 PM", "04-04-2025 18:30", "junk"], C.export_timestamp)
    assert got[0] == dt.datetime(2025, 4, 4, 19, 29)
    assert got[1] == dt.datetime(2025, 4, 4, 18, 30)
    assert got[2] is None


def test_clean_mobile(spark):
    vals = ["+91 98765-43210", "919876543210", "09876543210", "9876543210",
            "1234567890", "98765", "", None]
    assert one_col(spark, vals, C.clean_mobile) == ["9876543210"] * 4 + [None] * 4


def test_walk_in(spark):
    df = spark.createDataFrame([("9876543210", "cash"), ("9876543210", " Walk-In "), ("9876543210", "MR"),
                                ("9876543210", "Ravi Kumar"), (None, "Ravi Kumar")], "m string, n string")
    got = [r[0] for r in df.select(C.is_walk_in(F.col("m"), F.col("n"))).collect()]
    assert got == [True, True, True, False, True]


def test_clean_cell(spark):
    cells = {"2796.0": "2796", "12.5": "12.5", "00123": "00123", " x ": "x", "-3.00": "-3", "": None, "  ": None, "nan": None, "NaN": None,
             "NA": None, "N/A": None, "NULL": None, "null": None, "None": None, "#N/A": None, "<NA>": None, "Nan bread": "Nan bread", "NAN": "NAN"}
    assert one_col(spark, list(cells), C.clean_cell) == list(cells.values())


def test_title_case_literals(spark):
    titles = {"SUGAR-FREE  tea": "Sugar-Free Tea", "5KG atta": "5Kg Atta", "salt and pepper": "Salt and Pepper", "the best OF india": "the Best of India",
              "a-and-b": "a-And-B", "don't stop": "Don'T Stop", "  ": None, "rice   AND dal 1kg": "Rice and Dal 1Kg", "CAFÉS PURÉE": "Cafés Purée",
              "ÉCLAIR À LA MODE": "Éclair À La Mode", "o'neil-smith": "O'Neil-Smith", "crème-brûlée": "Crème-Brûlée"}
    assert one_col(spark, list(titles), catalog.title_case) == list(titles.values())


def test_normalize_name_literals(spark):
    names = {"SURF EXCEL 1KG": "SURF EXCEL 1 KG", "Surf Excel 1 Kg": "SURF EXCEL 1 KG", "Dettol 500ml": "DETTOL 500 ML", "Tata Salt 1kgs": "TATA SALT 1 KG",
             "ABC Co. Ltd 2pcs": "ABC 2 PCS", "Amul (India) 200gm": "AMUL 200 G", "Crème-Brûlée 5L": "CRÈME-BRÛLÉE 5 L", "Men's soap": "MEN S SOAP"}
    assert one_col(spark, list(names), entity.normalize_name) == list(names.values())


def test_block_key(spark):
    got = one_col(spark, ["SURF EXCEL 1 KG", "AB", "XYZ"], entity.block_key)
    assert got == ["SUR|1", "AB_|", "XYZ|"]


def test_hsn_category_and_type(spark):
    df = spark.createDataFrame([("200911", "orange juice"), ("0701", "potato"), ("07", "onion"),
                                ("9999", "widget"), ("", "delivery charge"), (None, "coffee")],
                               "h string, n string")
    got = df.select(catalog.hsn_category("h"), catalog.product_type("h", "n")).collect()
    assert [tuple(r) for r in got] == [("Juices", "retail"), ("Vegetables", "retail"), ("Vegetables", "retail"),
                                       (None, "retail"), (None, "service"), (None, "service")]
