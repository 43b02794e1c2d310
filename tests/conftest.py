import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from riskframe.session import local_session

    s = local_session(cpus="*", shuffle_partitions=8, app_name="riskframe-tests")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from riskframe.sources.tables import BASE_TABLES, table_path

    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return con


@pytest.fixture()
def tmp_dir(spark):
    """A fresh scratch folder under the session's checkpoint dir."""
    import uuid

    from riskframe.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).replace("file:", "")
    path = os.path.join(base, "tests", uuid.uuid4().hex)
    os.makedirs(path, exist_ok=True)
    return path
