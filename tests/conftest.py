import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

COLUMNS = ("InvoiceNo string, StockCode string, Description string, Quantity bigint, InvoiceDate string, "
           "UnitPrice double, CustomerID double, Country string")
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


@pytest.fixture(scope="session")
def spark():
    from assaykit import get_spark

    session = get_spark(
        "assaykit-tests", "local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Rows as dicts (or tuples in contract order) to a table; missing keys are null."""
    def make(rows, schema=COLUMNS):
        names = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame([r if isinstance(r, tuple) else tuple(r.get(n) for n in names) for r in rows],
                                     schema)
    return make


@pytest.fixture
def sale():
    return {"InvoiceNo": "536365", "StockCode": "85123A", "Description": "HEART", "Quantity": 6,
            "InvoiceDate": "12/1/2010 8:26", "UnitPrice": 2.55, "CustomerID": 17850.0, "Country": "United Kingdom"}


@pytest.fixture
def clean_rows(sale):
    return [sale, {**sale, "InvoiceNo": "536366", "StockCode": "71053", "InvoiceDate": "12/1/2010 8:28"}]
