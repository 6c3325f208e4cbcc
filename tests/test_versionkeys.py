"""Keys and bounds against comparisons of single versions."""

import itertools
import random

from pyspark.sql import functions as F

from riskweave.functions import versionkeys as K
from riskweave.functions import versions as V

VERSIONS = ["1", "1.0", "1.0.0", "v1.2", "=1.2.3", "1.2.10", "1.10", "2!0.1", "1.0a1", "1.0.a2", "1.0b1", "1.0rc1", "1.0.dev1", "1.0a1.dev2", "1.0.post1", "1.0-1", "1.0.post1.dev3", "1.0+abc", "1.0+abc.1", "1.0+1", "1.0+10", "1.0+2", "0", "0.0.1", "1.2.3-beta.4", "1.2.3-rc", "2.0.0-x.7.z", "release", "", "1.0.0.Final", "3.0.0.RELEASE", "2021-01-02", "99999999999999999999.1", "1..2", "-", "1.2.3+build-5"]
RANGES = ["*", ">=1.0,<2.0", ">1.0", "<1.0", "<=1.0", "==1.0", "!=1.0", "==1.*", "!=1.0.*", "~=1.0", "~=1.2.3", "~1.2", "^1.2.3", "^0.2", "^0", "1.0", "1", ">=1.0 || <0.5", "1.0 || 1.2.10", ">= 1.0a1, < 1.0", ">1.0.post0", "<1.0.post2", "==1.0+abc", "", None, " || ", "=1.2.3", "<2.0.0-x", ">=1.0,bad", "===1.0", "~", "^x", ">=1.2.3-beta.4", ">0,<=1.0.0.Final", ">1.0+1"]


def more():
    r = random.Random(3)
    num = lambda: r.choice(["0", "1", "2", "10", "3"])
    for _ in range(150):
        yield ".".join(num() for _ in range(r.randint(1, 4))) + r.choice(["", "", "a1", "rc2", ".dev1", ".post1", "-beta", "+l1", "-1.2", ".x"])


def test_key_order_is_the_order_of_versions():
    versions = VERSIONS + list(more())
    sign = lambda a, b: (a > b) - (a < b)
    for a, b in itertools.product(versions, versions):
        x, y = V.strict(a), V.strict(b)
        got = sign(K.strict_key(x), K.strict_key(y)) if x is not None and y is not None else sign(K.loose_key(a), K.loose_key(b))
        assert got == V.compare(a, b), (a, b)


def test_bounds_against_single_tests(spark):
    versions, ranges = [v for v in VERSIONS + list(more())[:60] if v], RANGES + [f"{op}{v}" for op in (">=", "<", ">", "<=", "==", "!=") for v in list(more())[60:80]]
    rows = [(f"{e}-{i}", e, [r], None, None) for i, r in enumerate(ranges) for e in ("pypi", "npm")]
    rows += [("list", "npm", None, None, ["1.0", " 1.2.10 ", "", None]), ("both", "pypi", [">=9", None], "<0.5", ["1.0a1"]), ("none", None, None, None, None)]
    bounds = K.advisory_bounds(spark.createDataFrame(rows, "advisory_id string, ecosystem string, affected_ranges array<string>, affected_range string, affected_versions array<string>"))
    keys = K.version_keys(spark.createDataFrame([(v,) for v in versions], "version string"))
    pairs = keys.select("version", F.struct(*[c for c in keys.columns if c != "version"]).alias("v")).join(F.broadcast(bounds), F.lit(True))
    got = {(x.version, x.advisory_id) for x in pairs.where(K.affected(F.col("v"), F.col("ranges"), F.col("listed"))).select("version", "advisory_id").collect()}
    want = {(v, i) for v in set(versions) for i, e, rs, one, vs in rows if V.matches(v, rs, one, vs, e)}
    assert got == want, sorted(got ^ want)[:20]
    assert len(want) > 500


def test_audit_has_no_udf_for_pairs(spark, sf):
    from riskweave.plans import registry
    from riskweave.plans import all as _  # noqa: F401

    plan = registry.QUERIES["q114_package_audit"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
