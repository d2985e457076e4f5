"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "e2_role_brief", "e9_market_profile", "c1_snapshot_delta", "c2_validate_pair", "d6_release_gate", "c9_layer_reconciliation", "b5_clean_detail", "f1_match_signals", "f8_resolve_role",
    "f9_scope_decision", "h1_assign_themes", "h4_company_vectors", "h7_pair_stats", "h8_semantic_bundles", "h9_cluster_edges", "h10_related_postings", "i1_stratified_round_robin",
    "j3_output_metrics", "j8_quality_metrics", "k6_apply_decisions",
]


def many_row_groups(spark, sf: str) -> str:
    """A scratch folder with the same tables, `documents` as 32 files: one row group would leave every text expression to a single task."""
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name in os.listdir(sf):
        if name != "documents.parquet":
            os.symlink(os.path.join(sf, name), os.path.join(out, name))
    spark.read.parquet(f"{sf}/documents.parquet").repartition(32).write.parquet(f"{out}/documents.parquet")
    return out


def main() -> None:
    from hiremill.plans import catalog
    from hiremill.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    given, names = os.path.basename(sf.rstrip("/")), sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "hiremill-bench")
    spark.sparkContext.setLogLevel("ERROR")
    sf, layout = many_row_groups(spark, sf), "documents in 32 row groups"
    # One text query first, so that no headline query carries the start of the engine.
    catalog.QUERIES["b5_clean_detail"](spark, sf).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": given, "layout": layout}))
    spark.stop()


if __name__ == "__main__":
    main()
