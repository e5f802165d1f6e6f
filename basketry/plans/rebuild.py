"""Full rebuild in dependency order (the reference's ordered step chain).

Every derived table is written under ``<out>/<run_id>/<table>``. The raw
lines are scanned once, into product-day facts; the dense window pass is
materialised once and feeds metrics, features, signals and stock, which are
stored by month so that ``grid.rebuild_recent`` can make the last ones again;
pages and KPIs read the written tables. A run is published by adding one row to
``<out>/_PUBLISHED`` last (a file that appears by rename), so readers see the
old run or the new one, never a half-built one. Executor loss is survived by Spark's task retry plus the
reliable (shared-folder) writes; nothing is kept on a machine-local disk.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baskets, customers, daily, dims, product, restock
from ..operators import calendar as cal
from ..session import discard, saved
from . import grid


def rebuild(spark: SparkSession, raw: dict[str, DataFrame], out: str, as_of: dt.date,
            run_id: str | None = None) -> str:
    """Rebuild all derived tables from raw frames; returns the published run folder."""
    run = f"{out.rstrip('/')}/{run_id or uuid.uuid4().hex}"
    b, i = raw["raw_sales_billwise"], raw["raw_sales_itemwise"]
    pb, pi = raw["raw_purchase_billwise"], raw["raw_purchase_itemwise"]
    al, im, sm, pr = raw["product_aliases"], raw["raw_item_combinations"], raw["raw_supplier_master"], raw["products"]

    def save(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{run}/{name}")
        return spark.read.parquet(f"{run}/{name}")

    save("daily_sales_summary", daily.daily_sales_summary(b, i))
    save("daily_purchase_summary", daily.daily_purchase_summary(pb, pi))
    facts = (save("_sales_facts", product.sales_by_product_day(i, al, keep_undated=True)),
             save("_purchase_facts", product.purchases_by_product_day(pi, al)))
    start = F.lit(product.spine_start_date(b, facts[0]))
    win = saved(product.grid_runs(facts, start, as_of), "windowed")  # one grid pass, reused four times
    grid.write_months(grid.grid_tables(win, cal.calendar_dim(spark, start, F.lit(as_of))), run)
    discard(win)
    lic = save("latest_item_combinations", dims.latest_item_combinations(im))
    loc = save("supplier_location", dims.supplier_location(sm))
    psm = save("product_supplier_mapping", dims.product_supplier_mapping(pi))
    pdim = save("product_dimension", dims.product_dimension(im, i, al, pr))
    latest = save("_latest", product.latest_state(facts, start, as_of))
    rs = save("supplier_restock_recommendations", restock.restock_recommendations(latest, psm, loc, pdim))
    save("replenishment_sheet", restock.replenishment_sheet(latest, pdim, psm, loc, lic))
    save("conversion_attention_sheet", restock.conversion_attention_sheet(latest, pdim, psm, lic))
    save("supplier_purchase_sheet", restock.supplier_purchase_sheet(rs, latest, pdim, lic, psm, loc))
    save("daily_payment_breakdown", daily.daily_payment_breakdown(b))
    save("customer_dimension", customers.customer_dimension(b))
    save("customer_metrics", customers.customer_metrics(b, as_of))
    save("product_associations", baskets.product_associations(i, al))
    (spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("published_at")).coalesce(1)
     .write.mode("append").parquet(f"{out.rstrip('/')}/_PUBLISHED"))
    return run


def published_run(spark: SparkSession, out: str) -> str:
    """Folder of the newest published run."""
    marks = spark.read.parquet(f"{out.rstrip('/')}/_PUBLISHED")
    return marks.agg(F.max_by("run", "published_at").alias("run")).first()["run"]


def open_run(spark: SparkSession, out: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of the newest published run; each is one scan wherever it is used."""
    run = published_run(spark, out)
    return {n: spark.read.parquet(f"{run}/{n}").drop("month") for n in names}


def refresh(spark: SparkSession, raw: dict[str, DataFrame], out: str, as_of: dt.date, days: int = 90) -> dt.date:
    """Make the grid tables of the published run again from the month ``days`` before ``as_of`` on, from the raw frames."""
    run = published_run(spark, out)
    facts = product.product_facts(raw["raw_sales_itemwise"], raw["raw_purchase_itemwise"], raw["product_aliases"])
    start = F.lit(product.spine_start_date(raw["raw_sales_billwise"], facts[0]))
    since = grid.rebuild_recent(spark, facts, start, run, as_of, days)
    discard(*facts)
    return since
