"""List columns whose Spark and SQL types differ: python tests/run_types.py [sf_dir]"""

import sys

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from corpusflow.plans import ORACLE, QUERIES  # noqa: E402
from corpusflow.session import local_session  # noqa: E402
from tests.oracle import connect, default_sf  # noqa: E402

SAME = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
        "float": "FLOAT"}
sf = sys.argv[1] if len(sys.argv) > 1 else default_sf()
spark, con = local_session(8), connect(sf)
for name, sql in ORACLE.items():
    want = dict(r[:2] for r in con.execute("DESCRIBE " + sql).fetchall())
    got = dict(QUERIES[name](spark, sf).dtypes)
    bad = {c: (t, want.get(c)) for c, t in got.items() if SAME.get(t) != want.get(c)}
    if bad:
        print(name, bad, flush=True)
print("checked", len(ORACLE))
