import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("no test tables")
    return path


@pytest.fixture(scope="session")
def oracle(small):
    import duckdb

    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return connection


def plain(value):
    """A value that compares equal across engines."""
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


@pytest.fixture(scope="session")
def same_rows(oracle):
    def check(df, sql):
        names = sorted(df.columns)
        result = oracle.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(columns) == names
        order = [columns.index(c) for c in names]
        want = sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=repr)
        got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
        assert got == want

    return check
