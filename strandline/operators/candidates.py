"""Candidates for a requested entity: six weighted checks, a verdict for each, and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.backlinks import trailing_acronym
from strandline.operators.resolve import ratio

# Words of living things, of organisations, of places.
LIVING = (
    "genus", "species", "family", "order", "class", "phylum", "kingdom", "insect", "insects", "animal", "animals", "plant", "plants", "organism", "organisms", "biology", "biological", "taxonomy", "taxon", "ncbi", "taxonomic", "zoology", "botany",
)
ORGANISED = (
    "authority", "regulatory", "regulator", "commission", "agency", "government", "ministry", "department", "bureau", "office", "organization", "institution", "company", "corporation", "pool", "cooperation", "consortium", "alliance", "council",
    "committee", "board", "foundation",
)
PLACED = ("country", "nation", "state", "province", "region", "city", "town", "district", "location")
#: Least similarity of names, least confidence of an accepted candidate, and of one that is left open.
SIMILAR, ACCEPTED, OPEN = 0.8, 0.7, 0.3


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def _base(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s*\([^)]+\)\s*$", "")


def _unit(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def _count(low: Column, words) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w)))


def judged(pairs: DataFrame) -> DataFrame:
    """``pairs`` with confidence, verdict (ACCEPTED, AMBIGUOUS, REJECTED) and mismatch.

    ``pairs`` has requested, entity_type, country, name, description, instance_of and candidate_country,
    any of them null. Names equal but for punctuation are accepted; a candidate that is of another kind
    of thing is rejected, however similar its name.
    """
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    asked, other = F.lower(c("requested")), F.lower(F.concat_ws(" ", c("name"), c("description")))
    kind, instance, country = F.lower(c("entity_type")), F.lower(c("instance_of")), F.lower(c("country"))
    base_a, base_b = _base(F.lower(c("requested"))), _base(F.lower(c("name")))
    acronym = F.coalesce(trailing_acronym(c("requested")) == trailing_acronym(c("name")), F.lit(False))
    base = F.when((_bare(base_a) != "") & (_bare(base_a) == _bare(base_b)), 0.4).when((base_a != "") & (base_b != "") & (ratio(base_a, base_b) >= SIMILAR), 0.2).otherwise(0.0)
    living = F.when(kind.contains("organization"), _count(other, LIVING)).otherwise(0)
    insect, genus = other.contains("insect") & asked.contains("energy"), other.contains("genus") & asked.contains("authority")
    semantic = _unit(
        0.1 * (_count(asked, ORGANISED) + _count(other, ORGANISED)) + 0.1 * F.size(F.filter(F.array(*[F.lit(w) for w in PLACED]), lambda w: asked.contains(w) & other.contains(w)))
        + F.when((country != "") & asked.contains(country), 0.2).otherwise(0.0) + F.when((country != "") & other.contains(country), 0.2).otherwise(0.0) - 0.5 * (living + insect.cast("int") + genus.cast("int"))
    )
    theirs = F.lower(c("candidate_country"))
    metadata = _unit(
        F.when((country == "") | (theirs == ""), 0.0).when(theirs.contains(country), 0.5).otherwise(-0.3)
        + F.when(instance.rlike("organization|agency"), 0.3).when(instance.rlike("genus|taxon"), -0.5).otherwise(0.0)
    )
    other_kind = (kind != "") & (instance != "") & ~(instance.contains(kind) | kind.contains(instance))
    typed = F.when(kind == "", 0.5).when((instance != "") & ~other_kind, 0.5).otherwise(0.0)
    exact = (_bare(c("requested")) != "") & (_bare(c("requested")) == _bare(c("name")))
    score = F.when(exact, 1.0).otherwise(F.when(acronym, 0.3).otherwise(0.0) + base + 0.3 * semantic + 0.2 * metadata + 0.2 * typed)
    mismatch = F.when(exact, None).when((living > 0) | insect | genus, "semantic").when(other_kind, "type")
    rows = pairs.withColumn("confidence", F.round(score, 6)).withColumn("mismatch", mismatch)
    verdict = F.when(F.col("mismatch").isNotNull(), "REJECTED").when(F.col("confidence") >= ACCEPTED, "ACCEPTED").when(F.col("confidence") >= OPEN, "AMBIGUOUS").otherwise("REJECTED")
    return rows.withColumn("verdict", verdict)


def chosen(rows: DataFrame, ident: str) -> DataFrame:
    """(requested, status, <ident>, confidence, candidates): RESOLVED to the accepted candidate of most
    confidence, ties to the smaller id; else AMBIGUOUS if one is open, else REJECTED."""
    accepted = F.col("verdict") == "ACCEPTED"
    first = F.min(F.when(accepted, F.struct((-F.col("confidence")).alias("c"), F.col(ident).alias("i"))))
    found = rows.groupBy("requested").agg(first.alias("f"), F.max((F.col("verdict") == "AMBIGUOUS").cast("int")).alias("open"), F.count(F.lit(1)).alias("candidates"))
    status = F.when(F.col("f").isNotNull(), "RESOLVED").when(F.col("open") == 1, "AMBIGUOUS").otherwise("REJECTED")
    return found.select("requested", status.alias("status"), F.col("f.i").alias(ident), (-F.col("f.c")).alias("confidence"), "candidates")
