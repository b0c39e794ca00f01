"""Benchmark: headline queries on the lineitem inventory (INVL) and the archive/directory pairs.

Runs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]``; every query
is written to the ``noop`` sink (full execution, no result collection). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from lakerules.functions.rules import as_of_micros, rules_frame  # noqa: E402
from lakerules.operators import diff as D  # noqa: E402
from lakerules.operators import match as M  # noqa: E402
from lakerules.operators.naming import resolve_names  # noqa: E402
from lakerules.plans import actions as P  # noqa: E402
from lakerules.plans import decisions as Dc  # noqa: E402
from lakerules.session import get_spark  # noqa: E402
from lakerules.sources import adapters as A  # noqa: E402
from lakerules.sources import inventory as I  # noqa: E402

AS_OF = as_of_micros(A.INVL_AS_OF)

# Fixed rule set for the lineitem inventory (ship dates 1995-2001, sizes up to ~10 MB).
INVL_RULES = [
    {"name": "old tmp", "conditions": {"end": ".tmp", "older": "1000d"}, "action": {"type": "delete"}},
    {"name": "big zips", "conditions": {"regex": r"o[0-9]+_[1-3]\.zip$", "larger": "5MB"},
     "action": {"type": "move", "target": "archives"}},
    {"name": "recent parquet", "conditions": {"end": ".parquet", "newer": "365d"},
     "action": {"type": "compress", "target": "packed"}},
    {"name": "small", "conditions": {"smaller": "100KB"}, "action": {"type": "move", "target": "small"}},
    {"name": "o1 sevens", "conditions": {"start": "o1", "contain": "_7"}, "action": {"type": "delete"}},
    {"name": "bare", "conditions": {"regex": r"o[0-9]+_[0-9]+$"}, "action": {"type": "move", "target": "bare"}},
]


def generated_rules(n: int) -> list[dict]:
    """n rules built from a rule: prefix o<k>, one of four extensions, a growing size bound."""
    exts = [".zip", ".tmp", ".parquet", "_1"]
    return [{"name": f"g{k}", "conditions": {"start": f"o{k + 1}", "end": exts[k % 4], "larger": f"{(k % 50) * 20}KB"},
             "action": {"type": "move", "target": f"g{k}"}} for k in range(n)]


def queries(spark, d):
    invl = lambda: A.invl(spark, d)
    r50, r500 = generated_rules(50), generated_rules(500)

    def organize():
        inv = invl()
        matched = M.match_rules(inv, INVL_RULES, AS_OF)
        occupied = I.entry_names(inv)
        return P.plan_actions(matched, INVL_RULES, occupied, mode=Dc.AUTOMATIC, always_delete=True)

    def conflict_names():
        c = A.claim(spark, d)
        claims = c.filter(F.col("seq") % 4 != 0).select(F.col("seq").alias("claim_id"), "seq",
                                                         F.col("parent").alias("dir"), "name")
        return resolve_names(claims, c.filter(F.col("seq") % 4 == 0).select(F.col("parent").alias("dir"), "name"))

    return {
        "match_rules": lambda: M.match_rules(invl(), INVL_RULES, AS_OF),
        "match_rules_50": lambda: M.match_rules(invl(), r50, AS_OF),
        "match_rules_500": lambda: M.match_rules(invl(), r500, AS_OF),
        "match_rules_join": lambda: M.match_rules_join(invl(), rules_frame(spark, INVL_RULES), AS_OF),
        "dir_rollup": lambda: I.dir_rollup(invl()),
        "structure_diff": lambda: D.structure_diff(A.mem(spark, d), A.dirfiles(spark, d)),
        "conflict_names": conflict_names,
        "organize": organize,
    }


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [a for a in sys.argv[1:]]
    spark = get_spark(f"local[{cpus}]", max(cpus, 8))
    out = {}
    for name, build in queries(spark, sf_dir).items():
        if only and name not in only:
            continue
        times = []
        for i in range(reps + 1):  # the first run warms up
            t0 = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": sf, "cpus": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
