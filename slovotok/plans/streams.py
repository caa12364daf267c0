"""The streaming aggregates over the events table, run as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slovotok.plans import query
from slovotok.session import table
from slovotok.streaming import checks


@query(
    "events_over_time",
    "select date_trunc('hour', ts::timestamp) as window_start, event_type, count(*) as n_events, round(sum(value), 4) as total from events where ts is not null group by 1, 2",
)
def events_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    return checks.events_over_time(table(spark, sf_dir, "events").filter("ts is not null"))


@query(
    "sessions",
    """with e as (select user_id, ts::timestamp as ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events where ts is not null and user_id is not null),
    g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as g from e)
    select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n_events from g group by user_id, g""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users."""
    return checks.sessions(table(spark, sf_dir, "events").filter("ts is not null and user_id is not null"))
