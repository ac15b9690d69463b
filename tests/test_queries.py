"""Every registered query against its SQL on the smallest dataset."""
import os

import pytest
from oracle import compare, connect

from evalspark.bindings import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no dataset")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    problem = compare(QUERIES[name](spark, FOLDER), duck, ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_collapsed_bootstrap_counts_every_pair(spark, duck):
    """The counts that its former SQL gave, next to the drawn limits."""
    from evalspark.bindings.base import PAIRS
    sql = f"WITH {PAIRS} SELECT round(avg(b - a),6) AS observed, 10000::BIGINT AS n_replicates, count(*) AS n FROM pairs WHERE model = 'm1'"
    rows = QUERIES["t02_bootstrap_collapsed"](spark, FOLDER)
    assert compare(rows.select("observed", "n_replicates", "n"), duck, sql) is None
    assert rows.where("ci_low <= observed AND observed <= ci_high").count() == 1


def test_collapsed_bootstrap_does_the_whole_job_of_its_former_sql(spark, duck):
    """All columns of that SQL, and the limits, which SQL cannot draw again, beside them."""
    from evalspark.bindings.base import PAIRS
    sql = f"WITH {PAIRS} SELECT round(avg(b - a),6) AS observed, 10000::BIGINT AS n_replicates, count(*) AS n, true AS as_expected FROM pairs WHERE model = 'm1'"
    rows = QUERIES["t02_bootstrap_collapsed"](spark, FOLDER)
    assert compare(rows.select("observed", "n_replicates", "n", "as_expected"), duck, sql) is None
    exact = QUERIES["t02_exact_interval"](spark, FOLDER).where("model = 'm1'").first()
    drawn = rows.first()
    assert drawn["n"] == exact["n"] and all(abs(drawn[c] - exact[c]) <= 2 / exact["n"] + 1e-6 for c in ("ci_low", "ci_high"))


def test_limits_that_draws_do_not_give_are_told(spark):
    from evalspark.bindings.pairs import near_normal
    rows = [(0.1, -0.096, 0.296, 100, 0.1), (0.1, 0.2, 0.3, 100, 0.1), (0.1, 0.05, 0.15, 100, 0.1), (0.1, -0.4, 0.6, 100, 0.1), (None, None, None, 0, None)]
    df = spark.createDataFrame(rows, "observed DOUBLE, ci_low DOUBLE, ci_high DOUBLE, n LONG, se DOUBLE")
    assert [r["as_expected"] for r in near_normal(df, "se").collect()] == [True, False, False, False, False]


def test_entry(spark):
    import __spark_entry__ as contract
    assert contract.entry(spark).count() == 2
    assert set(contract.oracle_sql()) <= set(contract.queries())
