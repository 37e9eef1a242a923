"""The projection of leads reads and exchanges the log once."""

from goldweave.plans import people
from goldweave.plans.registry import Tables


def test_the_log_is_made_and_exchanged_once(spark):
    df = people.j1b(Tables(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    log = plan[: plan.index("Generate inline")]
    assert plan.count("Generate inline") == 1
    # Above the log: its one exchange by cluster; aggregates before and behind it need no other.
    last = log.splitlines()[-12:]
    assert sum("Exchange hashpartitioning(cluster" in x for x in last) == 1
    assert {r["version"] for r in df.select("version").distinct().collect()} > {1, 2}
