import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    import os

    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"
    folder = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_as_duckdb(spark):
    """Runs a query and its SQL on the same tables and compares the rows as sets with repeats."""
    import duckdb

    data = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")

    def compare(query, sql):
        df = query(spark, data)
        cols = sorted(df.columns)
        ours = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
        rel = db.sql(sql)
        theirs = sorted(repr(tuple(dict(zip(rel.columns, x))[c] for c in cols)) for x in rel.fetchall())
        assert ours == theirs

    return compare
