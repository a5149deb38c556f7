"""Wall time of headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (comma separated, default: the list below, "all" for every
registered query) steer the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pixquill.plans.catalog import QUERIES  # noqa: E402
from pixquill.session import build_session  # noqa: E402

HEADLINE = [
    "assign_identifier",
    "resume_anti_join",
    "image_plan",
    "download_report",
    "error_types",
    "base64_roundtrip",
    "subset_union",
    "dense_image_ids",
    "mix_prompt",
    "keep_valid",
    "normalize_conversation",
    "vqa_prompts",
    "rendered_prompts",
    "word_tokens",
    "build_vocab",
    "label_mask",
    "pad_right",
    "train_split",
    "llm_requests",
    "llm_response_structured",
    "augmentation_join",
    "zero_shot_top1",
    "zero_shot_top3",
    "pool_patches",
    "mme_scores",
    "mme_rollup",
    "confusion_overall",
    "bleu_sentence",
    "evaluate_captions",
    "metric_routing",
]


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, times = {}, {}
    for name in names:
        # the first run also plans and compiles; both are reported, the second makes up the total
        cold[name], times[name] = (round(run(QUERIES[name], spark, sf_dir), 3) for _ in range(2))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "first_run": cold,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
