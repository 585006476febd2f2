"""Backlogs of work against counting by hand."""

from tidemark.operators import status


def test_work_that_depends_on_nothing_is_not_joined(spark):
    rows = [(k, k % 3, ["DONE", "FAILED", "PENDING", None][k % 4], k % 6, [None, None, k - 2, 1000][k % 7 % 4]) for k in range(200)]
    work = spark.createDataFrame(rows, "job_key long, owner long, status string, attempts int, depends_on long")
    states = {r[0]: r[2] for r in rows}
    expected = {}
    for _, owner, state, attempts, before in rows:
        found = expected.setdefault(owner, [0, 0])
        waiting = before is not None and (states.get(before) is None or states[before] != "DONE")
        found[0] += state is not None and state != "DONE"
        found[1] += state == "FAILED" or (state == "PENDING" and (attempts >= 4 or waiting))
    backlog = status.work_backlog(work, 4)
    assert {r.owner: [r.remaining, r.blocked] for r in backlog.collect()} == expected
    plan = backlog._jdf.queryExecution().optimizedPlan().toString()
    left = plan.split("Join LeftOuter")[1].split("Project")[1]
    assert "isnotnull(depends_on" in left
