"""Command-line differential run: python tests/run_queries.py [scale] [name prefix ...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

import __spark_entry__ as entry  # noqa: E402
from harness import difference, duck  # noqa: E402

from colloquy.session import build_session  # noqa: E402


def main() -> None:
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    base = f"/root/testdata/sf{scale}"
    spark = build_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(base)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, base)
            if name in oracles:
                verdict = difference(df, con, oracles[name]) or f"ok ({df.count()} rows)"
            else:
                verdict = f"no oracle, {len(df.collect())} rows"
        except Exception as error:  # noqa: BLE001
            verdict = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        bad += not verdict.startswith(("ok", "no oracle"))
        print(f"{time.time() - start:6.1f}s {name}: {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
