"""Checking and metrics over streams. Checks look at one document at a time and need no shuffle or state, so they run on a
stream as they do on a table; metrics over time are windowed aggregates with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slovotok.operators.checking import check
from slovotok.operators.detectors import REGISTRY
from slovotok.plans.rules import RULES, RuleFilter

#: Detector levels that need no aggregation and so run on streams.
STATELESS = ("text", "token", "word", "nonspace", "fold")


def check_stream(documents: DataFrame, chosen: RuleFilter | None = None) -> DataFrame:
    """Issues of a stream of documents(doc_id, text): the rules that need no counts over a document."""
    rules = [r for r in RULES if r.kind in REGISTRY and REGISTRY[r.kind].level in STATELESS]
    return check(documents, rules, chosen or RuleFilter())


def issues_over_time(issues: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Issues by window of arrival and rule; rows later than the watermark are dropped by Spark."""
    by = issues.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "rule_id").agg(F.count("*").alias("n_issues"))
    return by.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rule_id", "n_issues")


def events_over_time(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by hour and type: count and sum of values."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: runs of events with gaps below `gap`."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"))
    return by.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")
