"""Times every registered query and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores.
Each query is written to Spark's no-op sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from citeloom.plans import queries as q  # noqa: E402
from citeloom.session import local_session  # noqa: E402


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    found = q.queries()
    only = sys.argv[1:] or list(found)
    # Loads classes, the tables' footers and the code paths once; not part of any time.
    for name in ("library_normalize", "facet_labels", "bib_refs"):
        sink(found[name](spark, sf_dir))
    times: dict[str, float] = {}
    if not sys.argv[1:] or "builds" in only:
        only = [name for name in only if name != "builds"]
        times["records_build"] = timed(lambda: q.stored_records(spark, sf_dir))
        times["vocabulary_build"] = timed(lambda: q.stored_vocabulary(spark, sf_dir))
        times["postings_build"] = timed(lambda: q.stored_postings(spark, sf_dir))
        times["bands_build"] = timed(lambda: q.stored_bands(spark, sf_dir))
    for name in only:
        times[name] = timed(lambda: sink(found[name](spark, sf_dir)))
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    line = {
        "metric": "total time of all queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
        "cpus": int(cpus),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
