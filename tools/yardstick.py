"""Time the SQL of the headline queries in DuckDB on the same files, one line each.

    python tools/yardstick.py [sf dir] [seconds a query may take]
"""

from __future__ import annotations

import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from check import connect  # noqa: E402


def main() -> None:
    from casewright.plans import oracle

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    most = float(sys.argv[2]) if len(sys.argv) > 2 else 60.0
    for name in HEADLINE:
        con = connect(sf)
        timer = threading.Timer(most, con.interrupt)
        timer.start()
        start = time.perf_counter()
        try:
            con.execute(oracle.SQL[name]).fetchall()
            print(f"{name} {time.perf_counter() - start:.2f}", flush=True)
        except Exception as error:  # stopped, or out of memory
            print(f"{name} more than {time.perf_counter() - start:.0f} ({type(error).__name__})", flush=True)
        finally:
            timer.cancel()


if __name__ == "__main__":
    main()
