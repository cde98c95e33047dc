"""Command line check: ``python tests/check_queries.py FOLDER [NAME ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfledger.registry import QUERIES  # noqa: E402
from shelfledger.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name, query in QUERIES.items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            rows, problems = compare(spark, folder, query, connection)
        except Exception as error:  # report and go on with the next query
            rows, problems = -1, [str(error)[:1500]]
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={rows} {time.time() - started:.2f}s")
        for problem in problems:
            print("     ", problem)
        failed += bool(problems)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
