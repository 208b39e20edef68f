"""Check registered queries by hand: python tests/run_queries.py [sf_dir] [name part ...]"""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from corpusflow.plans import ORACLE, QUERIES  # noqa: E402
from corpusflow.session import local_session  # noqa: E402
from tests.oracle import connect, default_sf, difference  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else default_sf()
parts = sys.argv[2:]
spark = local_session(8)
con = connect(sf)
bad = 0
for name, fn in QUERIES.items():
    if parts and not any(name.startswith(p) for p in parts):
        continue
    t = time.time()
    try:
        if name in ORACLE:
            d = difference(spark, con, sf, fn, ORACLE[name])
            note = "ok" if d is None else f"DIFF {d}"
        else:
            n = len(fn(spark, sf).collect())
            note = f"rows {n}"
    except Exception as e:
        note = "ERROR " + str(e)[:1500]
        if "-v" in parts:
            traceback.print_exc()
    bad += note.startswith(("DIFF", "ERROR"))
    print(f"{name:32s} {time.time() - t:6.1f}s {note}", flush=True)
print("failures:", bad)
