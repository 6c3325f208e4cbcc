"""The native operators run no Python on executors."""

import re

import pytest

from riskweave.llm.queries import QUERIES


@pytest.mark.parametrize("name", ["op3_secrets", "op4_fingerprints", "op6_url_filter"])
def test_plan_has_no_python(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|PythonUDF|Cartesian|NestedLoop", plan)
