"""Look for plan shapes that do not scale, over all registered queries.

    python tools/plans.py [--sf 0.001] [name ...]
"""

from __future__ import annotations

import argparse
import importlib.util
import pathlib
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
BAD = ("BroadcastNestedLoopJoin", "CartesianProduct", "PythonUDF", "ArrowEvalPython", "BatchEvalPython")


def problems(plan: str) -> list[str]:
    return [b for b in BAD if b in plan]


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.001")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spec = importlib.util.spec_from_file_location("entry", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    from parlor.session import local_session

    spark = local_session()
    bad = 0
    for name, fn in entry.queries().items():
        if args.names and name not in args.names:
            continue
        if name.startswith("stream_") and name not in args.names:
            continue
        plan = fn(spark, f"/root/testdata/sf{args.sf}")._jdf.queryExecution().executedPlan().toString()
        found = problems(plan)
        if found:
            bad += 1
            print(name, found, flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
