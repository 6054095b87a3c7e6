"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from rentlens.plans import load_catalog
from rentlens.session import build_session

HEADLINE = (
    "contract_risk", "deposit_limit", "what_if", "market_enrichment", "region_index_asof", "property_reference", "property_match",
    "feature_vectors", "rights_summary", "merge_dedupe", "right_evidence", "owner_evidence", "watchlist_matches", "market_comparables",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, 8)
    catalog = load_catalog()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
