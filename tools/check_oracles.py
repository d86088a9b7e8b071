"""Run registered queries against their DuckDB oracles (development aid).

usage: python tools/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from innsight import registry  # noqa: E402
from innsight.oracle import compare  # noqa: E402
from innsight.session import local_session  # noqa: E402


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(registry.queries())
    spark = local_session()
    oracles = registry.oracle_sql()
    bad = 0
    for name in names:
        t0 = time.time()
        df = registry.queries()[name](spark, sf_dir)
        if name not in oracles:
            n = df.count()
            print(f"{name:32s} rows-only {n} rows ({time.time() - t0:.1f}s)")
            continue
        try:
            ok, msg = compare(df, sf_dir, oracles[name])
        except Exception as exc:  # report and go on with the other queries
            ok, msg = False, f"error: {type(exc).__name__}: {str(exc)[:300]}"
        bad += not ok
        print(f"{name:32s} {'OK ' if ok else 'BAD'} {msg} ({time.time() - t0:.1f}s)")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
