"""Helpers for the tests of the operators: small tables with awkward rows."""

import pytest


@pytest.fixture
def table(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make
