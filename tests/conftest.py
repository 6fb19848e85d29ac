import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    spark = session()
    spark.conf.set("spark.sql.shuffle.partitions", "4")  # the tables of tests are small
    yield spark
    spark.stop()
