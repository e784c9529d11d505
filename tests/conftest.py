import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def same_rows(df, sql: str, sf_dir: str) -> None:
    """Compares a DataFrame with DuckDB's answer, whatever the order of rows."""
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, got = c.execute(sql).df(), df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)

    def rows(frame):
        frame = frame[names].astype(object).where(frame[names].notna(), None)
        return sorted(map(repr, frame.itertuples(index=False, name=None)))

    assert rows(got) == rows(want)
