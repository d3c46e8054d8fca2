"""Headline queries at one scale factor: one warm-up, then the median of the runs; prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS, BENCH_RUNS, BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from parlor.session import local_session  # noqa: E402
from parlor.workload import registry  # noqa: E402
from parlor.workload.fixtures import Tables  # noqa: E402

HEADLINE = (
    "unread_direct", "unread_team", "last_message", "message_page", "chat_rooms", "notification_center", "contact_list", "effective_grant",
    "index_build", "word_search", "post_messages", "apply_deletes", "stream_messages",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cpus, "bench")
    queries = registry.queries()
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for i in range(runs + 1):
            start = time.perf_counter()
            queries[name](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
