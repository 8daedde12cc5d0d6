import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lectern.session import session

    s = session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri(),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows, columns):
    """Rows as sorted strings, columns in order of their names."""
    import datetime

    def show(v):
        if isinstance(v, float):
            return repr(v + 0.0)
        if isinstance(v, list | tuple):
            return "[" + ",".join(map(show, v)) + "]"
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None).isoformat()
        return repr(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same_as_duck(spark, duck):
    def check(query, sql):
        df = query(spark, SF)
        mine = canonical(df.collect(), df.columns)
        found = duck.execute(sql)
        theirs = canonical(found.fetchall(), [d[0] for d in found.description])
        assert mine[0] == theirs[0]
        assert mine[1] == theirs[1]

    return check
