"""Headline queries, timed one by one; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the input and the cores.
Each time covers planning and the full result, counted by a no-op write. One untimed
query warms the JVM; BENCH_ONLY=a,b limits the run. Stored tables that several queries read (the funnel by minute,
the triples, the chunks with tokens) are loaded first; ``load_sec`` reports what that took and is not part of ``value``.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark import plans

HEADLINE = """
e1_hourly_revenue e2_conversion_funnel e3_funnel_rates e4_product_ranking e5_summary_stats e7_top_categories
e8_events_per_minute e10_recent_orders e18_orders_with_items e25_percentile
w1_incremental_new w5_cdc_pass w6_upsert w8_ingest_clickstream w21_row_uid
l1_log_histogram l2_log_search l10_filter_operators l14_match_all l15_match_phrase l18_search_clauses l22_highlight
t1_trace_list t2_trace_search t10_span_metrics t11_service_graph
r2_bm25 r3_knn_l2 r5_rrf_inner r7_search_all r12_entity_index r14_structural_neighbors r19_bfs2
r20_subgraph_edges r26_reassemble
s1_stream_ingest s2_stream_minutes s5_stream_span_metrics s8_latency_percentiles
""".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    registered = plans.all_queries()
    registered["e2_conversion_funnel"](spark, sf).write.format("noop").mode("overwrite").save()
    start = time.perf_counter()
    plans.load(spark, sf)
    loaded = round(time.perf_counter() - start, 3)
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "load_sec": loaded, "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
