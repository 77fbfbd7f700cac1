"""Events within a second of each other: seconds are rounded as SQL rounds them, and of equal ones the first event counts."""

import duckdb
import pytest

from tallyframe.plans import catalog


@pytest.mark.parametrize("name", ["asof_prev_event", "asof_next_event", "point_in_interval"])
def test_seconds_as_in_sql(spark, tmp_path, name):
    kinds = "['view', 'purchase', 'signup', 'click', 'purchase']"
    con = duckdb.connect()
    con.execute(f"""CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(CASE WHEN i % 5 = 0 THEN i * 500000 ELSE i * 370011 END) AS ts, i % 3 AS user_id,
      {kinds}[i * 7 % 11 % 5 + 1] AS event_type, i * 0.5 AS value, '{{}}' AS props FROM range(600) r(i) ORDER BY i""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    order = "event_id, user_id, " + ("owner" if name == "point_in_interval" else "anchor")
    want = sorted(con.execute(f"SELECT {order} FROM ({catalog.ORACLES[name]})").fetchall(), key=repr)
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).selectExpr(*order.split(", ")).collect()), key=repr) == want
