"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is executed in full with the ``noop`` sink (no driver collection).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "stage_budget",      # scan -> lengths -> offsets -> split (flagship)
    "make_blocks",       # byte ids -> pieces -> fixed windows
    "mask_cost",         # segments per block
    "word_histogram",    # pretokenize + distributed word counts
    "bpe_train",         # histogram + 7 932 merges
    "bpe_encode",        # word-level encode + reassembly with that model
    "chat_template",     # conversations -> rendered chats
    "moving_average",    # run-log smoothing with halo windows
    "ema",               # chunked linear scan
    "accumulate",        # micro-step grouping
    "average_checkpoints",
    "continuation_logprob",
    "holdout_check",     # n-gram semi join
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pressline.plans.registry import QUERIES, load_all
    from pressline.session import get_spark

    spark = get_spark(f"local[{cpus}]", int(cpus) * 2)
    load_all()
    times = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
