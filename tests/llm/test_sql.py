"""Every query that has SQL, against it on the smallest tables."""

import os

import pytest
from oracle import SMALL, differences

from tessera.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert differences(queries.queries()[name], queries.oracle_sql()[name], spark) == ""


@pytest.mark.parametrize("name", ["p5_text", "p5_tokens", "p6_classes", "p8_fill"])
def test_runs(spark, name):
    assert queries.queries()[name](spark, SMALL).count() > 0
