"""Queries of the event log: what is appended to it, and the feeds that follow it."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..session import table
from ..streaming import feeds
from .registry import query

#: Events that end a feed, hours without one that close it.
ENDS, HOURS = ["error"], 36


def log(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumnRenamed("user_id", "scan_id")


@query(
    "q309_appended_events",
    """SELECT user_id AS scan_id, event_id, substr(repeat(event_type || ' ', 300), 1, 2000) AS message FROM events e
WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'error' AND c.value > 60 AND c.event_id <= e.event_id)""",
)
def appended_events(spark, sf_dir):
    rows = log(spark, sf_dir)
    cancelled = rows.where("event_type = 'error' and value > 60").select("scan_id", "event_id")
    return feeds.appended(rows.select("scan_id", "event_id", F.repeat(F.concat("event_type", F.lit(" ")), 300).alias("message")), cancelled)


@query(
    "q311_event_feeds",
    f"""WITH g AS (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL {HOURS} HOURS, false) AS apart FROM events),
p AS (
  SELECT *, count(*) FILTER (WHERE apart) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM g),
r AS (
  SELECT *, first_value(event_id) OVER w AS feed, row_number() OVER w AS n,
    coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id, part ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over_
  FROM p WINDOW w AS (PARTITION BY user_id, part ORDER BY ts, event_id)),
f AS (
  SELECT user_id, part, any_value(feed) AS feed, count(*) AS n, max(ts) AS ts, bool_or(event_type = 'error') AS ended,
    max(part) OVER (PARTITION BY user_id) AS newest FROM r GROUP BY user_id, part)
SELECT user_id AS scan_id, feed, n::BIGINT AS n, event_id, event_type, CASE WHEN event_type = 'error' THEN 'end' ELSE 'event' END AS kind, ts FROM r WHERE NOT over_
UNION ALL
SELECT user_id, feed, n + 1, NULL, NULL, 'timeout', ts + INTERVAL {HOURS} HOURS FROM f WHERE part < newest AND NOT ended""",
)
def event_feeds(spark, sf_dir):
    return feeds.batch(log(spark, sf_dir), ENDS, datetime.timedelta(hours=HOURS))
