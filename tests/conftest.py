import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from checks.compare import session

    return session(4)


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column function over texts, in order."""

    def run(fn, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
        out = df.select("i", fn("x").alias("y")).collect()
        return [r.y for r in sorted(out)]

    return run


def write_table(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def as_table(spark, tmp_path):
    return lambda df, name="t": write_table(spark, df, tmp_path, name)
