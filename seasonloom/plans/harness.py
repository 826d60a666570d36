"""Scaling harness: times the standard fit on one core count after another, and appends each trial to a CSV file.

    python -m seasonloom.plans.harness --data DIR --csv runs.csv --cores 1,2,4,8 --buckets 4,8 --trials 3

Every trial runs in a process and session of its own. Strong runs hold the buckets while cores grow; with --weak, a run on p
cores takes p times the buckets. Buckets come in order, so that larger problems hold the smaller ones.
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
import time

from seasonloom.schema import SCALING
from seasonloom.sources import sinks

#: Buckets that locations are dealt into.
BUCKETS = 64


def trial(data: str, cores: int, buckets: int) -> dict:
    """Seconds and locations of one fit of the first buckets."""
    from pyspark.sql import functions as F

    from seasonloom.functions.expressions import bucket_of
    from seasonloom.operators.fit import fit
    from seasonloom.plans.proxies import daily
    from seasonloom.session import get_session

    spark = get_session(f"local[{cores}]", max(8, 2 * cores), **{"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    rows = daily(spark, data).where(bucket_of(F.col("ID"), BUCKETS) < buckets).persist()
    n_ids = rows.select("ID").distinct().count()
    began = time.time()
    fit(rows).write.format("noop").mode("overwrite").save()
    return {"wall_s": round(time.time() - began, 3), "n_ids": n_ids}


def main(argv=None) -> int:
    """Runs all trials; 1 if one of them failed."""
    p = argparse.ArgumentParser(prog="harness", description=__doc__)
    p.add_argument("--data", required=True)
    p.add_argument("--csv")
    p.add_argument("--cores", default="1,2,4,8")
    p.add_argument("--buckets", default="4,8")
    p.add_argument("--trials", type=int, default=3)
    p.add_argument("--weak", action="store_true")
    p.add_argument("--one", action="store_true", help="a single trial; prints its figures")
    a = p.parse_args(argv)
    numbers = lambda s: [int(x) for x in s.split(",")]
    if a.one:
        print(json.dumps(trial(a.data, numbers(a.cores)[0], numbers(a.buckets)[0])))
        return 0
    columns = [c.split()[0] for c in SCALING.split(", ")] if isinstance(SCALING, str) else SCALING.names
    failed = 0
    for base in numbers(a.buckets):
        for cores in numbers(a.cores):
            buckets = min(BUCKETS, base * cores if a.weak else base)
            for k in range(a.trials):
                run = subprocess.run([sys.executable, "-m", "seasonloom.plans.harness", "--one", "--data", a.data, "--cores", str(cores), "--buckets", str(buckets)], capture_output=True, text=True)
                if run.returncode:
                    failed = 1
                    continue
                found = json.loads(run.stdout.strip().splitlines()[-1])
                row = {"dataset": a.data.rstrip("/").rpartition("/")[2], "mode": "weak" if a.weak else "strong", "hw": "cpu", "p": cores, "B": buckets, "phase": "train", "trial": k, **found}
                sinks.append_csv(a.csv, [row], columns)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
