import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ebbtide.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


SALES_SCHEMA = "client_id long, sale_date date, product string, status string, amount double"


@pytest.fixture(scope="session")
def make_sales(spark):
    def make(rows):
        """Rows (client, days relative to the cut, product, status, amount)."""
        cut = dt.date(2025, 2, 28)
        return spark.createDataFrame(
            [(c, cut + dt.timedelta(days=d), p, s, a) for c, d, p, s, a in rows], SALES_SCHEMA
        )

    return make
