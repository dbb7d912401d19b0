"""Time the headline plans: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the table folder and BENCH_CPUS
(default 8) the local core count. Each plan is run to completion with the noop
sink, so no result crosses to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpusloom.plans.registry import run_query  # noqa: E402
from corpusloom.session import local_session  # noqa: E402

HEADLINE = [
    "c1_removed_per_source", "c2_corpus_to_chunks", "c5_html_to_text", "c6_redacted_release",
    "s4_to_lines", "s6_layout_runs", "p4_script_share", "f6_unescape_entities", "k5_rows_to_text",
    "w1_group_rows", "w2_to_text_lines", "w4_to_blocks", "w5_paragraphs", "w6_stitch", "w7_bridge",
    "w8_classify", "w9_chunk", "w11_merge_runs", "w14_number_items", "w17_merge_rects", "w19_related",
    "j1_text_in", "j2_match_marks", "j4_hit_test", "j5_overlapping_pairs", "j11_collisions",
    "j13_resolve_styles", "j14_expand_blocks", "j15_props_at", "x1_find", "x2_hit_pages",
    "t1_replay", "t2_field_state", "t3_live_annots", "t4_changed_pages", "t6_handoff",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    run_query("s1_table_counts", spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM and workers
    timings: dict[str, float] = {}
    for name in [n for n in HEADLINE if not only or n in only]:
        t0 = time.perf_counter()
        run_query(name, spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
        print(f"{name:28s} {timings[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds over headline plans", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
