"""Readers of the intake's file forms. Search, crawling and language models stay outside: their answers come in as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import text

#: One intake row, as every reader gives it.
INTAKE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("entity_id", "name", "rita_type")]
    + [T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("source_ids", T.ArrayType(T.StringType())), T.StructField("source_count", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("extracted_at", "extraction_run_id", "ingestion_status")]
)
# Headers of sheets and the columns they mean.
HEADERS = {
    "entityid": "entity_id", "entity": "entity_id", "entity_name": "name", "entity_type": "rita_type", "type": "rita_type", "alias": "aliases", "source_id": "source_ids", "count": "source_count",
    "extracted": "extracted_at", "run_id": "extraction_run_id", "status": "ingestion_status",
}


def header(name: str) -> str:
    low = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]+", "_", name.strip().lower().replace("-", "_"))).strip("_")
    return HEADERS.get(low, low)


def list_cell(c: Column, separated: bool = False) -> Column:
    """A cell that holds a JSON list, a list with commas (if ``separated``) or one value; blanks are dropped."""
    one = F.split(c, ",") if separated else F.array(c)
    items = F.coalesce(F.from_json(c, "array<string>"), one)
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def map_cell(c: Column) -> Column:
    """A cell that holds a JSON object, or a text that becomes the value of ``value``; blank gives an empty map."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", empty).otherwise(F.coalesce(F.from_json(c, "map<string,string>"), F.create_map(F.lit("value"), c)))


def int_cell(c: Column) -> Column:
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(0)).otherwise(F.trim(c).try_cast("double").cast("int"))


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """Intake rows from CSV files with any of the known headers; a later column of a repeated header counts."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [header(c) for c in raw.columns]
    last = {n: i for i, n in enumerate(names)}
    rows = raw.toDF(*[f"c{i}" for i in range(len(names))])
    cell = lambda n: F.col(f"c{last[n]}") if n in last else F.lit(None).cast("string")
    ids = list_cell(cell("source_ids"), True)
    return rows.select(
        *[F.trim(cell(n)).alias(n) for n in ("entity_id", "name", "rita_type")], list_cell(cell("aliases")).alias("aliases"), map_cell(cell("metadata")).alias("metadata"), ids.alias("source_ids"),
        F.coalesce(F.when(ids.isNotNull(), F.size(ids)), F.lit(0)).alias("source_count"), *[F.trim(cell(n)).alias(n) for n in ("extracted_at", "extraction_run_id", "ingestion_status")],
    )


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Intake rows from JSON: lists of rows, or objects with such a list under ``entities``."""
    wrapped = T.StructType([*INTAKE.fields, T.StructField("entities", T.ArrayType(INTAKE))])
    raw = spark.read.schema(wrapped).option("multiLine", True).option("mode", "FAILFAST").json(path)
    bare = raw.where("entities is null").drop("entities")
    inner = raw.where("entities is not null").select(F.inline("entities"))
    rows = bare.unionByName(inner)
    return rows.withColumn("source_count", F.when(F.col("source_ids").isNull(), F.lit(0)).otherwise(F.size("source_ids")))


# Front-matter keys that may hold a note's title, the first that does counts.
TITLE_KEYS = ("title", "name", "entity", "entity_name", "subject")


def note_parts(value: Column) -> dict[str, Column]:
    """Columns of a Markdown text: title, entity, body, distinct links (labels of inline links, then wikilinks)."""
    heading = F.regexp_extract(value, r"(?m)^#\s+(.*)$", 1)
    title = F.coalesce(*[text.nonempty(text.front_value(value, k)) for k in TITLE_KEYS], text.nonempty(F.trim(heading)), F.lit(""))
    inline = F.filter(F.transform(F.regexp_extract_all(value, F.lit(r"(?<!\[)\[([^\]\[]+)\]\([^)]*\)"), 1), lambda x: F.trim(x)), lambda x: x != "")
    return {"title": title, "entity": text.front_value(value, "entity"), "body": text.body(value), "links": F.array_distinct(F.concat(inline, text.wikilinks(value)))}


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, entity, body, links) of the Markdown files of a folder, not of those below it."""
    raw = spark.read.option("pathGlobFilter", "*.{md,markdown}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", *[c.alias(n) for n, c in note_parts(F.col("value")).items()])


def gateway_results(responses: DataFrame, most: int = 10) -> DataFrame:
    """(query, rank, title, url) of search answers in JSON (columns query, body): the first ``most`` results,
    then one per address; refused answers, and results without an address, give nothing."""
    answer = F.from_json("body", "ok boolean, results array<struct<rank:int,score:double,url:string,title:string>>")
    rows = responses.select("query", answer.alias("a")).where("coalesce(a.ok, true)").select("query", F.posexplode(F.slice("a.results", 1, most)).alias("pos", "r"))
    rows = rows.select("query", "pos", F.trim("r.url").alias("url"), F.coalesce("r.rank", F.col("pos") + 1).alias("rank"), F.col("r.title").alias("title")).where("coalesce(url, '') <> ''")
    first = rows.groupBy("query", "url").agg(F.min_by(F.struct("rank", "title"), "pos").alias("f"))
    return first.select("query", F.col("f.rank").alias("rank"), F.coalesce(text.nonempty(F.col("f.title")), F.col("url")).alias("title"), "url")
