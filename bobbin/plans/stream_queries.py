"""Streaming jobs run over what has arrived, against the twins of their batch forms."""

from __future__ import annotations

from ..streaming import jobs as J
from ..views import with_views
from .registry import ORACLES, QUERIES

QUERIES["r1_dedupe_stream"] = lambda spark, sf_dir: J.drain(J.dedupe(J.submissions(spark, f"{sf_dir}/events.parquet")), "dedupe")
ORACLES["r1_dedupe_stream"] = ORACLES["r1_dedupe_submissions"]

QUERIES["r2_hourly_states_stream"] = lambda spark, sf_dir: J.drain(J.hourly_states(J.submissions(spark, f"{sf_dir}/events.parquet")), "hours")
#: A window is given out once the newest row is two hours past its end.
ORACLES["r2_hourly_states_stream"] = with_views("""WITH s AS (SELECT DATE_TRUNC('hour', ts) AS hour, state FROM v_submissions), top AS (SELECT MAX(ts) - INTERVAL 2 HOUR AS mark FROM v_submissions)
SELECT hour, state, COUNT(*) AS jobs FROM s, top WHERE hour + INTERVAL 1 HOUR <= mark GROUP BY 1, 2""")
