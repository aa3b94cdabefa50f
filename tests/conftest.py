import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paceline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "paceline-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply a Column function to rows of text: evaluate(fn, (a, b), ...) -> list."""

    def run(fn, *rows):
        from pyspark.sql import functions as F

        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        width = len(rows[0])
        names = [f"c{i}" for i in range(width)]
        schema = "id int, " + ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        out = df.select("id", fn(*[F.col(n) for n in names]).alias("r")).orderBy("id").collect()
        return [r["r"] for r in out]

    return run
