import contextlib
import datetime as dt
import io
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from almanac.schema import DAILY, DAILY_WITH_SNOW  # noqa: E402
from almanac.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def daily(spark):
    """Builds a daily table from dicts; absent columns are null, DATE may be ISO text."""

    def build(rows, snow=None):
        with_snow = any("SNOW" in r for r in rows) if snow is None else snow
        schema = DAILY_WITH_SNOW if with_snow else DAILY
        defaults = {"STATION": "A", "NAME": "Alpha"}

        def value(row, name):
            v = row.get(name, defaults.get(name))
            if name == "DATE" and isinstance(v, str):
                return dt.date.fromisoformat(v)
            return float(v) if isinstance(v, int) else v

        data = [tuple(value(r, f.name) for f in schema.fields) for r in rows]
        return spark.createDataFrame(data, schema)

    return build


def days(start, n):
    first = dt.date.fromisoformat(start)
    return [first + dt.timedelta(days=i) for i in range(n)]


def rows_of(df, *columns):
    """Sorted tuples of the columns, dates as ISO text."""
    picked = df.select(*columns).collect()
    out = [tuple(v.isoformat() if isinstance(v, dt.date) else v for v in r) for r in picked]
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


def plan_of(df):
    """The physical plan as text."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()
