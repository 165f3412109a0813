import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparrowmill.session import local_session

    session = local_session(8, 8, "8g")
    session.sparkContext.setLogLevel("OFF")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return session


@pytest.fixture(scope="session")
def oracle():
    """Compares a query with its SQL statement on a data folder, columns by name and rows in any order."""
    import duckdb

    def compare(df, sql, folder=SMALL):
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for file in os.listdir(folder):
            con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        wanted = sorted(str(tuple(r)) for r in found.fetchall())
        assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == wanted

    return compare
