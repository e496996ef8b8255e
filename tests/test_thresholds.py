"""Running totals that are just a multiple of the step cross it, in the queries as in their SQL."""

import random

import duckdb
import pytest

from strandline.operators.sequence import at_thresholds
from strandline.registry import ORACLE_SQL, QUERIES


def exact_totals(users, n, goal):
    """Amounts of two places whose sum is just ``goal`` at the n-th row of each user, which binary sums miss for many."""
    r = random.Random(3)
    for u in range(users):
        cents = [r.randrange(1, goal * 100 // n) for _ in range(n - 1)]
        for k, c in enumerate([*cents, goal * 100 - sum(cents)]):
            yield u * n + k, u, c / 100


def test_a_total_of_ten_tenths_is_one(spark):
    rows = spark.createDataFrame([(1, k, 0.1) for k in range(10)] + [(2, 0, float("nan")), (2, 1, None), (2, 2, 1.5)], "u long, k long, v double")
    assert [tuple(r) for r in at_thresholds(rows, ["u"], "k", "v", 1.0).select("u", "k", "total", "bucket").orderBy("u").collect()] == [(1, 9, 1.0, 1), (2, 2, 1.5, 1)]


@pytest.mark.parametrize(("name", "goal"), [("progress_thresholds", 1000), ("cost_elasticity", 2000)])
def test_totals_at_a_multiple(spark, tmp_path, name, goal):
    events = spark.createDataFrame(list(exact_totals(300, 40, goal)), "event_id long, user_id long, value double")
    events.selectExpr("*", "timestamp'2024-01-01' AS ts", "'view' AS event_type", "'' AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = QUERIES[name](spark, str(tmp_path))
    told = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    rows = sorted(tuple(r) for r in found.select(*names).collect())
    assert len(rows) == 300 and rows == sorted(told.fetchall())
