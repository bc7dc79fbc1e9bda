"""Queries on records that may be bad."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.plans.registry import query
from chronoframe.plans.views import table
from chronoframe.sources import records


@query("""WITH m AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) WHEN event_id % 11 = 0 THEN replace(props, '"k"', '"q"') WHEN event_id % 13 = 0 THEN regexp_replace(props, '"k": (\\d+)}', '"k": "a\\1"}') ELSE props END AS t FROM events)
SELECT event_id, CASE WHEN t IS NULL OR trim(t) = '' THEN 'empty' WHEN NOT json_valid(t) THEN 'not JSON' WHEN json_type(t, '$.k') = 'VARCHAR' THEN 'not of the schema' WHEN json_extract(t, '$.k') IS NULL THEN 'no k'
WHEN json_extract_string(t, '$.k')::INTEGER >= 90 THEN 'k too great' END AS reason, CASE WHEN json_valid(t) AND json_type(t, '$.k') <> 'VARCHAR' THEN json_extract_string(t, '$.k')::INTEGER END AS k FROM m""")
def quarantined_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' records, some cut short, some with their field renamed or made a text, and why each bad one is set aside."""
    e, at = table(spark, sf_dir, "events").select("event_id", "props"), F.col("event_id")
    cut = F.expr("left(props, length(props) - 1)")
    as_text = F.regexp_replace("props", r'"k": (\d+)}', '"k": "a$1"}')
    sent = F.when(at % 7 == 0, cut).when(at % 11 == 0, F.replace("props", F.lit('"k"'), F.lit('"q"'))).when(at % 13 == 0, as_text).otherwise(F.col("props"))
    rules = {"no k": F.col("record.k").isNull(), "k too great": F.col("record.k") >= 90}
    return records.routed(e.withColumn("line", sent), "line", "k int", rules).select("event_id", "reason", F.col("record.k").alias("k"))
