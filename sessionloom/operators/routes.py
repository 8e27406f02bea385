"""Health of inference routes from a table of attempts.

``attempts`` has ``route``, ``ts``, ``attempt_id``, ``success`` and ``status``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import ordered

# Seconds and limits of the cooldown rule.
BASE_SECONDS = 2
RATE_LIMITED_SECONDS = 5
MAX_SECONDS = 120
MAX_EXPONENT = 4
AUTH_STATUS = (401, 403)


def failure_streaks(attempts: DataFrame) -> DataFrame:
    """Attempts with ``streak`` and ``cooldown_seconds``.

    Success ends a streak; an authorisation failure opens the circuit instead
    of counting towards the streak. A busy route is spread over many tasks.
    """
    auth = F.coalesce(F.col("status").isin(*AUTH_STATUS), F.lit(False))
    counted = ~F.col("success") & ~auth
    placed = ordered.place(attempts, ["route", "ts", "attempt_id"])
    islands = ordered.running_sums(placed, {"island": F.col("success").cast("int")}, ["route"])
    streaks = ordered.running_sums(islands, {"streak": counted.cast("int")}, ["route", "island"])
    base = F.when(F.col("status") == 429, RATE_LIMITED_SECONDS).otherwise(BASE_SECONDS)
    doubled = base * F.pow(F.lit(2), F.least(F.col("streak") - 1, F.lit(MAX_EXPONENT)))
    cooldown = F.when(counted, F.least(doubled, F.lit(float(MAX_SECONDS)))).otherwise(0.0)
    return (
        streaks.withColumn("cooldown_seconds", cooldown)
        .withColumn("streak", F.when(counted, F.col("streak")).otherwise(0))
        .drop("island", ordered.BLOCK, ordered.PLACE)
    )


def route_health(streaks: DataFrame) -> DataFrame:
    """Per route: attempts, successes, failures, total cooldown, whether the circuit is open."""
    auth = F.coalesce(F.col("status").isin(*AUTH_STATUS), F.lit(False)) & ~F.col("success")
    decisive = F.when(auth | F.col("success"), F.struct("ts", "attempt_id"))
    return streaks.groupBy("route").agg(
        F.count("*").alias("attempts"),
        F.count_if("success").alias("successes"),
        F.count_if(~F.col("success")).alias("failures"),
        F.sum("cooldown_seconds").alias("total_cooldown_seconds"),
        F.coalesce(F.max_by(auth, decisive), F.lit(False)).alias("circuit_open"),
    )
