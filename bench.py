"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from filingdelta.plans import registry
from filingdelta.session import build_session

HEADLINE = (
    "b1_validate_upload", "b10_text_sufficiency", "b12_is_numeric_table", "c1_classify_by_keywords", "c5_text_sample",
    "d1_normalise_table", "d5_overlapping_page_batches", "d6_batch_text", "d8_merge_section_candidates", "d9_section_char_count",
    "d10_rebuild_parents", "d12_exclusive_pages", "d13_section_text", "d17_conform_extracted_content", "d19_content_digest",
    "e1_normalise_company", "e3_determine_mode", "e5_map_exact", "e6_map_semantic", "e8_extract_number_unit",
    "e11_compare_tables", "e12_compare_numbers", "e13_text_match_ratio", "e14_text_line_diff", "e15_compare_kpi_series",
    "e17_compare_relations", "e18_section_review_from_reply", "e21_related_sections_topk", "e24_compare_documents",
    "f1_importance_dashboard", "f3_multi_mapping_index", "g2_latest_status",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    # Start the JVM's code paths and the Python workers before timing.
    registry.run("e1_normalise_company")(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registry.run(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
