import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from webcorpus.session import build_session

    s = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def col(spark):
    """Evaluate a column function over literal rows."""

    def run(fn, rows, *names):
        names = names or ("x",)
        data = [r if isinstance(r, tuple) else (r,) for r in rows]
        schema = ", ".join(f"{n} string" for n in names) + ", _i int"
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], schema)
        return [r[0] for r in df.orderBy("_i").select(fn(*names).alias("y")).collect()]

    return run
