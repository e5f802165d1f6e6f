"""Benchmark the headline queries; prints ONE JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is forced end-to-end with a ``noop`` write (full computation, no
collection to the driver). The feature rebuild also reports rows/s, the one
figure the reference publishes (~2.3M rows in ~20 s).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from basketry.session import get_spark  # noqa: E402

HEADLINE = [
    "daily_sales_summary",
    "daily_payment_breakdown",
    "product_daily_features",
    "product_health_signals",
    "product_stock_position",
    "restock_recommendations",
    "supplier_purchase_sheet",
    "customer_metrics",
    "product_associations",
    "product_associations_part",
    "recon_sales_bill_vs_item",
    "kpi_summary",
    "health_report",
    "demand_trend",
    "name_clusters",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", cpus, conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    from basketry.plans import registry as R

    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        R.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)

    # grid size = sold products x spine days (two cheap scalar queries)
    t = R.tables(spark, sf_dir)
    from basketry.operators import product
    n_products = product.sold_products(t.raw_sales_itemwise, t.product_aliases).count()
    start = product.spine_start_date(t.raw_sales_billwise, R._facts(t)[0])
    n_days = (R.AS_OF - start).days + 1
    grid_rows = n_products * n_days
    # pages as the reference serves them: tables are built once, then read
    from basketry.operators import reports
    from basketry.session import saved
    t0 = time.time()
    R._built(t)
    dss, dps, cdim, cmet = (saved(df, "daily") for df in (R._dss(t), R._dps(t), R._cdim(t), R._cmet(t)))
    rec = saved(R._restock(t, t.latest), "restock")
    build = round(time.time() - t0, 3)
    reads: dict[str, float] = {}
    for name, df in (
            ("kpi_summary", lambda: reports.kpi_summary(dss, dps, t.latest, rec, cdim, cmet, R.AS_OF)),
            ("health_report", lambda: reports.health_report(t.latest, t.pdim, t.psm)),
            ("health_signals_page", lambda: reports.health_signals_page(t.latest, t.pdim, t.psm)),
            ("replenishment_page", lambda: reports.replenishment_page(rec))):
        t0 = time.time()
        df().write.format("noop").mode("overwrite").save()
        reads[name] = round(time.time() - t0, 3)
    feat = times["product_daily_features"]
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "build_tables": build,
        "reads": reads,
        "feature_grid_rows": grid_rows,
        "feature_rows_per_sec": round(grid_rows / feat) if feat else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
