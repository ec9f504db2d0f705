"""User feedback on detections, and counters over both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWERS = ["yes", "no"]


def join_feedback(feedback: DataFrame, detections: DataFrame) -> DataFrame:
    """Accepted entries with the url, verdict and time of their detection.

    ``feedback(id, correct, ts)``; ``detections(detection_id, url, verdict, detected_at)``,
    where ``verdict`` is the distance verdict, not the final one."""
    valid = feedback.filter(F.lower("correct").isin(ANSWERS))
    known = detections.select(F.col("detection_id").alias("id"), "url", "verdict",
                              F.col("detected_at").alias("detection_timestamp"))
    return valid.join(known, "id").select(
        "id", "url", "verdict", F.lower("correct").alias("user_feedback"),
        F.col("ts").alias("timestamp"), "detection_timestamp")


def reject_feedback(feedback: DataFrame, detections: DataFrame) -> DataFrame:
    """Entries turned away: 400 for an answer that is no yes/no, 404 for an unknown id."""
    known = detections.select(F.col("detection_id").alias("id"))
    invalid = ~F.coalesce(F.lower("correct").isin(ANSWERS), F.lit(False))
    bad = feedback.filter(invalid).withColumn("status", F.lit(400))
    unknown = feedback.filter(~invalid).join(known, "id", "left_anti").withColumn("status", F.lit(404))
    return bad.unionByName(unknown)


def detection_metrics(detections: DataFrame, feedback: DataFrame, samples: DataFrame) -> DataFrame:
    """Lookups, hits, errors, feed hits, samples loaded and feedback received, in one row."""
    counted = detections.agg(
        F.count("*").alias("lookup_count"), F.count_if(F.col("phish_id").isNotNull()).alias("hits"),
        F.count_if(F.col("source") == "error").alias("errors"),
        F.count_if(F.col("phish_id").isNotNull()).alias("db_hits"))
    one = F.lit(1).alias("_one")
    return (
        counted.select("*", one)
        .join(samples.agg(F.count("*").alias("samples_loaded")).select("*", one), "_one")
        .join(feedback.agg(F.count("*").alias("total_submissions")).select("*", one), "_one")
        .drop("_one")
    )
