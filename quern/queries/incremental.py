"""Incremental operators, run over a table."""

from pyspark.sql import functions as F

from quern.queries.base import query
from quern.streaming.incremental import windowed_rewards


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1")
def x1_windowed_rewards(t):
    return windowed_rewards(t("events").withColumn("ts", F.col("ts").cast("timestamp")))
