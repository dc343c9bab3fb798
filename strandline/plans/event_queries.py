"""Queries over the event log and intake forms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources import readers
from strandline.streaming import queue
from strandline.session import table


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return queue.windowed_counts(table(spark, sf, "events"))


def list_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").withColumn("cell", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('["'), "p_name", F.lit('", "'), "p_brand", F.lit('"]'))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" , "), "p_brand", F.lit(",")) ).otherwise(F.col("p_name")))
    cell = readers.list_cell(F.col("cell"), True)
    return rows.select("p_partkey", F.array_join(cell, "|").alias("items"), F.size(cell).cast("bigint").alias("n"))


def gateway_parse(spark: SparkSession, sf: str) -> DataFrame:
    crawls = table(spark, sf, "crawl_results").where("url is not null")
    item = F.struct(F.lit(None).cast("int").alias("rank"), F.lit(0.5).alias("score"), F.col("url"), F.col("title"))
    body = F.to_json(F.struct((F.col("crawl_id") % 7 != 0).alias("ok"), F.array(item, item).alias("results")))
    return readers.gateway_results(crawls.select(F.col("crawl_id").alias("query"), body.alias("body")))


QUERIES = {f.__name__: f for f in (event_windows, list_cells, gateway_parse)}
SQL = {
    "event_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "list_cells": """WITH c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [p_name, p_brand] WHEN 1 THEN list_filter([trim(p_name), trim(p_brand), ''], lambda x: x <> '') ELSE list_transform(string_split(p_name, ','), lambda x: trim(x)) END AS items FROM part)
SELECT p_partkey, array_to_string(items, '|') AS items, len(items) AS n FROM c""",
    "gateway_parse": "SELECT crawl_id AS query, CAST(1 AS INTEGER) AS rank, coalesce(nullif(title, ''), trim(url)) AS title, trim(url) AS url FROM crawl_results WHERE crawl_id % 7 <> 0 AND trim(coalesce(url, '')) <> ''",
}
