from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from retentio.session import get_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="retentio-tests-")
    s = get_session("local[4]", app_name="retentio-tests", shuffle_partitions=4,
                    extra_conf={"spark.checkpoint.dir": f"{scratch}/shared",
                                "spark.sql.warehouse.dir": f"{scratch}/warehouse"})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="retentio-t-")


def make_subs(spark, rows):
    """rows: (customer_id, plan_type, payment_method, months, mrr, ltv, churned)."""
    from decimal import Decimal
    conv = [(c, p, pm, m, None if mrr is None else Decimal(str(mrr)),
             None if ltv is None else Decimal(str(ltv)), ch) for c, p, pm, m, mrr, ltv, ch in rows]
    return spark.createDataFrame(
        conv, "customer_id string, plan_type string, payment_method string, subscription_months int, "
              "monthly_mrr decimal(8,2), lifetime_value decimal(14,2), churned string")
