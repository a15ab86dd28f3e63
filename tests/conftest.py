from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pairfeat import get_spark
    s = get_spark("local[*]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def pairs_df(spark):
    def make(rows, with_label=True):
        data = [(str(i), a, b, "0") for i, (a, b) in enumerate(rows)]
        return spark.createDataFrame(data, "qid string, ql string, qr string, label string")
    return make
