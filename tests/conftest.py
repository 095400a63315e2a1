import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
D = dt.date.fromisoformat


@pytest.fixture(scope="session")
def spark():
    from salescope.session import build_session, checkpoint_dir
    s = build_session(master="local[4]", shuffle_partitions=4,
                      extra={"spark.driver.memory": "4g", "spark.sql.adaptive.enabled": "true"})
    checkpoint_dir(s)
    yield s
    s.stop()


SALES_SCHEMA = "id string, client_name string, client_id string, product_type string, price decimal(18,2), date date"
CLIENT_SCHEMA = "id string, name string, cif string, address string, contact_person string, email string"
LEAD_SCHEMA = ("id string, external_id string, created_at date, source string, status string, "
               "meeting_date date, client_id string")


@pytest.fixture(scope="session")
def seed(spark):
    """The reference's shared seed rows (fixed clock 2024-05-15)."""
    clients = spark.createDataFrame([
        ("C001", "TechNova", "A12345678", "Calle 1", "Juan", "juan@tech.com"),
        ("C002", "DataCorp", "B87654321", "Calle 2", "Ana", "ana@data.com"),
        ("C003", "CloudSoft", "C11223344", "Calle 3", "Pedro", "pedro@cloud.com"),
    ], CLIENT_SCHEMA)
    sales = spark.createDataFrame([
        ("1", "TechNova", "C001", "Servicio", Decimal("1000"), D("2024-05-01")),
        ("2", "TechNova", "C001", "Producto", Decimal("2000"), D("2024-05-05")),
        ("3", "DataCorp", "C002", "Servicio", Decimal("1500"), D("2024-05-10")),
        ("4", "DataCorp", "C002", "Servicio", Decimal("500"), D("2024-04-15")),
        ("5", "CloudSoft", "C003", "Producto", Decimal("3000"), D("2024-05-12")),
    ], SALES_SCHEMA)
    leads = spark.createDataFrame([
        ("L001", "EXT1", D("2024-05-01"), "meta_ads", "new", None, None),
        ("L002", "EXT2", D("2024-05-03"), "google_ads", "contacted", None, None),
        ("L003", "EXT3", D("2024-05-05"), "meta_ads", "meeting", D("2024-05-10"), None),
        ("L004", "EXT4", D("2024-04-20"), "linkedin_ads", "converted", D("2024-04-25"), "C001"),
        ("L005", "EXT5", D("2024-05-08"), "google_ads", "lost", None, None),
    ], LEAD_SCHEMA)
    spend = spark.createDataFrame([
        ("meta_ads", D("2024-05-01"), Decimal("500")),
        ("google_ads", D("2024-05-01"), Decimal("300")),
        ("linkedin_ads", D("2024-04-15"), Decimal("200")),
    ], "source string, date date, amount decimal(18,2)")
    return {"clients": clients, "sales": sales, "leads": leads, "spend": spend}


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
