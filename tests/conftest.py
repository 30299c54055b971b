import pytest

from strandlog.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def namespaces(spark):
    from strandlog.identity import Namespaces

    rows = [("ns3", "http://x.invalid/people/", 3), ("ns7", "http://x.invalid/people/hr#", 7), ("ns5", "https://x.invalid/device#", 5)]
    return Namespaces(spark.createDataFrame(rows, "prefix string, expansion string, ord int"))


def rows_of(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def set_of(df) -> set[tuple]:
    found = rows_of(df)
    assert len(found) == len(set(found)), "repeated rows"
    return set(found)
