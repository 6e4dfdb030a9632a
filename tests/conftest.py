import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from panelweave.session import local_session

    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def split(spark):
    """Force the bucketed way of ranking, as for groups too large for a task."""
    from panelweave.operators import ordering

    spark.conf.set(ordering.ONE_TASK_KEY, "0")
    spark.conf.set(ordering.GROUP_KEY, "0")
    yield
    spark.conf.unset(ordering.ONE_TASK_KEY)
    spark.conf.unset(ordering.GROUP_KEY)


def panel(spark, wide: dict, start="2024-01-01", name="value"):
    """Long panel from {code: [values by day]}; None is missing."""
    import datetime as dt

    d0 = dt.date.fromisoformat(start)
    rows = [(d0 + dt.timedelta(days=i), c, None if v is None else float(v)) for c, vs in wide.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"date date, code string, {name} double")


def wide(df, value="value"):
    """{code: [values by day]} of a long panel."""
    out = {}
    for r in sorted(df.select("code", "date", value).collect()):
        out.setdefault(r[0], []).append(r[2])
    return out
