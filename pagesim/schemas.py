"""Explicit schemas of the tables; nothing is inferred."""

from pyspark.sql import types as T

from .fixed_values import FEATURES

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

SAMPLE_META = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("label", T.StringType()),
])

PROTOTYPE_META = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("prototype_index", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("source", SAMPLE_META),
])

FEED_CSV = T.StructType([
    T.StructField("phish_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("phish_detail_url", T.StringType()),
    T.StructField("submission_time", T.StringType()),
    T.StructField("verified", T.StringType()),
    T.StructField("verification_time", T.StringType()),
    T.StructField("online", T.StringType()),
    T.StructField("target", T.StringType()),
])

FEED_JSON = T.StructType([
    T.StructField("phish_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("phish_detail_url", T.StringType()),
    T.StructField("submission_time", T.StringType()),
    T.StructField("verified", T.StringType()),
    T.StructField("verification_time", T.StringType()),
    T.StructField("online", T.StringType()),
    T.StructField("target", T.StringType()),
])

FEEDBACK = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("user_feedback", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("detection_timestamp", T.TimestampType()),
])

FEATURE_STRUCT = T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES])
