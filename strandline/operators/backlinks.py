"""Mentions of texts joined to the entities they name, notes to the entity they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import resolve


def backlinks(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``mentions`` (mention and counts) with state, uid: the entity that each names; others stay to be queued.

    A mention is resolved once, however often it occurs.
    """
    found = resolve.resolve(mentions.select("mention"), nodes).select(F.col("mention").alias("_m"), "state", "uid")
    return mentions.join(found, F.col("mention") == F.col("_m")).drop("_m")


def references(body: Column, links: Column) -> Column:
    """Distinct references of a note: its links, then what follows ``references:`` on a line, by commas or semicolons."""
    lines = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?im)^[ \t]*references?:[ \t]*([^\n]*)$"), 1)
    named = F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, "[;,]"))), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.concat(links, named))


def primary_entities(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, uid, mention, position): the first candidate of each document that names one entity.

    ``candidates`` has doc_id, position and mention. Documents none of whose candidates does have a null
    uid, so that their candidates can be queued.
    """
    found = resolve.resolve(candidates.select("mention"), nodes).where("state = 'RESOLVED'").select(F.col("mention").alias("_m"), "uid")
    rows = candidates.join(found, F.col("mention") == F.col("_m"), "left")
    first = F.min_by(F.struct("uid", "mention", "position"), F.when(F.col("uid").isNotNull(), F.col("position")))
    return rows.groupBy("doc_id").agg(first.alias("f")).select("doc_id", "f.uid", "f.mention", "f.position")


def top_fuzzy(matches: DataFrame, k: int = 3) -> DataFrame:
    """(mention, place, uid, score): the ``k`` nearest entities of each mention of ``resolve.fuzzy``, ties to the smaller uid."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "uid"))
    return matches.withColumn("place", place).where(F.col("place") <= k).select("mention", "place", "uid", "score")


def parentheticals(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\(([^)]+)\)"), 1), lambda x: F.trim(x))


def acronyms(c: Column) -> Column:
    """All words of two to ten capitals, in order."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: w.rlike("^[A-Z]{2,10}$"))


def trailing_acronym(c: Column) -> Column:
    return text.nonempty(F.regexp_extract(c, r"\(([A-Z]{2,10})\)\s*$", 1))


def without_trailing_acronym(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\([A-Z]{2,10}\)\s*$", ""))
