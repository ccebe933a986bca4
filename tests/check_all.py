"""Command line check of every query against its SQL: python tests/check_all.py [sf_dir] [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as e  # noqa: E402
from compare import differences, duck  # noqa: E402
from txnrisk.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(e.queries())
    spark = local_session(8)
    con, oracles, failed = duck(sf_dir), e.oracle_sql(), []
    for name in names:
        began = time.time()
        try:
            df = e.queries()[name](spark, sf_dir)
            notes = differences(df, con, oracles[name]) if name in oracles else [f"rows only: {df.count()}"]
        except Exception as error:  # report and go on
            notes = [f"error {type(error).__name__}: {str(error)[:1500]}"]
        bad = notes and not notes[0].startswith("rows only")
        failed += [name] if bad else []
        print(f"{'FAIL' if bad else 'ok':4} {name:28} {time.time() - began:6.2f}s {'; '.join(notes)}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} fine; failed: {failed}")
