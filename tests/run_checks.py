"""Run the registered queries against their SQL: ``python tests/run_checks.py DIR [name part ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, difference  # noqa: E402
from rxspark.session import get_session  # noqa: E402


def main(sf_dir: str, parts: list[str]) -> int:
    spark = get_session(
        "rxspark-checks", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                result = difference(spark, sf_dir, name, query, oracles[name], con)
            else:
                result = None if query(spark, sf_dir).count() else f"{name}: no rows"
        except Exception as e:  # noqa: BLE001
            result = f"{name}: {type(e).__name__} {str(e)[:700]}"
        bad += result is not None
        print(f"{'ok ' if result is None else 'BAD'} {time.time() - start:6.2f}s {'' if name in oracles else '(rows only) '}"
              f"{name}" + (f"\n{result}" if result else ""), flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
