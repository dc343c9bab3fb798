"""Keyed deduplication and merging, where the order of rows has a meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text, urls
from strandline.seq import first_per_key, first_value, ordered


def merge_by_url(evidence: DataFrame, seq: str) -> DataFrame:
    """Evidence records merged by address: the first stays, with all queries in order, the last original
    address that differs, and the first entity that is given. Records without a web address are left out.
    """
    rows = evidence.withColumn("url_key", urls.identity(F.col("url"))).where("url_key <> ''")
    # each query once per address before lists are built, so that a hot address stays small
    asked = rows.where(F.coalesce("query", F.lit("")) != "").groupBy("url_key", "query").agg(F.min(seq).alias("at"))
    queries = asked.groupBy("url_key").agg(F.array_join(ordered(F.col("query"), F.col("at")), "|").alias("queries"))
    merged = rows.groupBy("url_key").agg(
        F.min(seq).alias("first_seq"),
        F.count(F.lit(1)).alias("n_records"),
        F.max_by(text.nonempty(F.col("original_url")), F.when(F.coalesce("original_url", F.lit("")) != "", F.col(seq))).alias("original_url"),
        first_value(text.nonempty(F.col("entity_name")), F.col(seq)).alias("entity_name"),
        first_value(text.nonempty(F.col("entity_id")), F.col(seq)).alias("entity_id"),
        F.min_by(text.fingerprint(F.coalesce(text.nonempty(F.col("content")), F.col("snippet"))), seq).alias("fingerprint"),
    )
    return merged.join(queries, "url_key", "left")


def merge_by_content(merged: DataFrame) -> DataFrame:
    """Of records with equal content the first; those without content stand for themselves."""
    key = F.when(F.col("fingerprint") == "", F.col("url_key")).otherwise(F.col("fingerprint"))
    return merged.groupBy(key.alias("content_key")).agg(
        F.min_by("url_key", "first_seq").alias("url_key"), F.min("first_seq").alias("first_seq"), F.count(F.lit(1)).alias("n_urls"),
        first_value(F.col("original_url"), F.col("first_seq")).alias("original_url"), first_value(F.col("entity_name"), F.col("first_seq")).alias("entity_name"),
    )


def claim_key(subject: Column, predicate: Column, obj: Column) -> Column:
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    return F.concat_ws("|", bare(subject), bare(predicate), bare(obj))


def strongest_claims(claims: DataFrame) -> DataFrame:
    """One claim per subject, predicate and object: most confident, direct before related, longest passage, first.

    A struct maximum, so that groups are reduced before they are shuffled.
    """
    strength = F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("a"), (F.coalesce("relevance", F.lit("")) == "DIRECT").alias("b"), F.length(F.coalesce("evidence_passage", F.lit(""))).alias("c"), (-F.col("seq")).alias("d"))
    keyed = claims.withColumn("claim_key", claim_key(F.col("subject"), F.col("predicate"), F.col("object")))
    return keyed.groupBy("claim_key").agg(F.max(strength).alias("best"), F.count(F.lit(1)).alias("n_claims")).select("claim_key", (-F.col("best.d")).alias("seq"), "n_claims")


def keep_first(df: DataFrame, key: Column, seq: str) -> DataFrame:
    return first_per_key(df.withColumn("dedup_key", key), ["dedup_key"], F.col(seq))


def search_merge(results: DataFrame) -> DataFrame:
    """Results of several providers merged by address: (url_key, first_provider, providers, ranks).

    ``results`` has provider, rank, url and seq; each provider and rank counts once per address.
    """
    rows = results.withColumn("url_key", urls.identity(F.col("url"))).where("url_key <> ''")
    once = rows.groupBy("url_key", "provider", "rank").agg(F.min("seq").alias("seq"))
    return once.groupBy("url_key").agg(
        F.min_by("provider", "seq").alias("first_provider"),
        F.array_join(ordered(F.concat_ws(":", "provider", F.col("rank").cast("string")), F.col("seq")), ",").alias("providers"),
        F.min("rank").alias("best_rank"),
    )
