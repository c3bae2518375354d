"""Wall-clock seconds per query: prints one JSON line. Caches are cleared between queries; the index
of the corpus is opened or built first and shared by the searches, as in production.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated keys, or ``all``) choose what is run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from provena.plans import common, registry
from provena.session import local_session

HEADLINE = [
    "chunk_windows", "tfidf_postings", "text_search_topk", "vector_search_topk", "hashed_vectors", "rrf_hybrid_topk",
    "rrf_k_sweep", "entity_boost_rerank", "gold_chunks", "hit_rate_mrr", "bootstrap_ci", "rerank_ablation",
    "diversity_diagnostic", "prompt_assembly", "near_duplicates", "validation_flags", "document_metadata",
    "acquisition_state", "declared_format_check", "html_main_text", "content_hash_duplicates", "chunk_page_ranges",
    "circularity_filter", "citation_parse", "sourcing_footer", "claim_extract", "citation_precision", "arm_stats",
    "stratified_proportional", "largest_remainder", "release_tiers", "feedback_daily", "score_histogram",
    "stream_window_stats", "stream_ingest_chunks",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    qs = registry.queries()
    keys = list(qs) if wanted == "all" else (wanted.split(",") if wanted else HEADLINE)
    spark.range(1).count()
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    common.corpus_index(spark, sf)  # opened if this corpus has been indexed before, built if not
    times["index_open_or_build"] = round(time.perf_counter() - t0, 3)
    for key in keys:
        spark.catalog.clearCache()
        t0 = time.perf_counter()
        qs[key](spark, sf).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
        print(key, times[key], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall-clock of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf).name,
        "cpus": cpus,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
