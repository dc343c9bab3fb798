"""Nodes and edges: claims gathered by subject, upserts that merge provenance, edges that must be valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text

#: Columns of an exported node, in order.
NODE_COLUMNS = ("uid", "entity", "aliases", "entity_type", "subtype", "country", "sector", "status", "summary", "relationships", "associations", "sources")
_LISTS = ("aliases", "relationships", "associations", "sources")


def node_drafts(claims: DataFrame) -> DataFrame:
    """One row per subject: how many claims, distinct predicates, objects and sources, most confident claim text.

    Distinct values are found before they are gathered, so a subject with a third of all claims is
    reduced on every executor first.
    """
    rows = claims.where("coalesce(subject, '') <> ''")
    counts = rows.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n_claims"),
        F.max(F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), (-F.col("seq")).alias("s"), F.col("claim_text").alias("t"))).alias("best"),
        F.countDistinct("source_url").alias("n_sources"),
    )
    predicates = rows.where("predicate is not null").select("subject", "predicate").distinct().groupBy("subject").agg(F.array_join(F.array_sort(F.collect_list("predicate")), ", ").alias("predicates"))
    return counts.join(predicates, "subject", "left").select("subject", "n_claims", "n_sources", "predicates", F.col("best.t").alias("summary"))


def merge_provenance(old: DataFrame, new: DataFrame, key: str, sources: str) -> DataFrame:
    """(key, outcome, sources): upsert of ``new`` over ``old``; new sources first, then old ones not among them."""
    a, b = new.select(F.col(key), F.col(sources).alias("n"), F.lit(True).alias("in_new")), old.select(F.col(key), F.col(sources).alias("o"), F.lit(True).alias("in_old"))
    both = a.join(b, key, "full")
    fresh, kept = F.coalesce("n", F.array().cast("array<string>")), F.coalesce("o", F.array().cast("array<string>"))
    merged = F.concat(fresh, F.array_except(kept, fresh))
    outcome = F.when(F.col("in_old").isNull(), "created").when(F.col("in_new").isNull(), "kept").when(F.size(F.array_except(fresh, kept)) > 0, "updated").otherwise("unchanged")
    return both.select(key, outcome.alias("outcome"), merged.alias("sources"))


def parsed_edges(nodes: DataFrame, column: str) -> DataFrame:
    """(uid, predicate, target) of a list column of ``predicate::[[Target]]``; other texts give no edge."""
    rows = nodes.select("uid", F.explode(column).alias("e"))
    found = rows.select("uid", F.regexp_extract("e", r"^\s*([^:]+?)\s*::\s*\[\[", 1).alias("predicate"), F.trim(F.regexp_extract("e", r"\[\[([^\]]+)\]\]", 1)).alias("target"))
    return found.where("predicate <> '' and target <> ''")


def valid_edges(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Edges with their target's uid and a verdict: accepted, unknown_target, ambiguous_target or self_edge."""
    keyed = edges.withColumn("key", text.match_form(F.col("target")))
    joined = keyed.join(index.select("key", F.col("uid").alias("target_uid"), "n_entities"), "key", "left")
    verdict = F.when(F.col("n_entities").isNull(), "unknown_target").when(F.col("n_entities") > 1, "ambiguous_target").when(F.col("target_uid") == F.col("uid"), "self_edge").otherwise("accepted")
    return joined.select("uid", "predicate", "target", F.when(F.col("n_entities") == 1, F.col("target_uid")).alias("target_uid"), verdict.alias("verdict"))


def edge_id(source: Column, target: Column, kind: Column, sources: Column) -> Column:
    """An edge's identifier, from its ends, its kind and the ids of the sources that tell of it, in their order."""
    return F.concat(F.lit("REL-"), text.short_hash([source, target, kind, F.array_join(F.coalesce(sources, F.array().cast("array<string>")), ",")]))


def csv_rows(nodes: DataFrame) -> DataFrame:
    """Nodes as flat text columns: lists joined by bars, null as nothing."""
    return nodes.select(*[(F.array_join(F.coalesce(c, F.array().cast("array<string>")), "|") if c in _LISTS else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in NODE_COLUMNS])


def json_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select("uid", F.to_json(F.struct(*NODE_COLUMNS), {"ignoreNullFields": "false"}).alias("json"))


def markdown(nodes: DataFrame) -> DataFrame:
    """A note per node: front matter, heading, summary and lists."""
    items = lambda c: F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.concat(F.lit("  - "), x)), "\n")
    head = F.concat(F.lit("---\nuid: "), "uid", F.lit("\ntitle: "), F.coalesce("entity", F.lit("")), F.lit("\naliases:\n"), items("aliases"), F.lit("\n---\n# "), F.coalesce("entity", F.lit("")), F.lit("\n\n"))
    return nodes.select("uid", F.concat(head, F.coalesce("summary", F.lit("")), F.lit("\n\n## Relationships\n"), items("relationships"), F.lit("\n\n## Sources\n"), items("sources"), F.lit("\n")).alias("note"))


def violations(nodes: DataFrame) -> DataFrame:
    """(uid, problem): what keeps a node from being exported; nodes in order have no row."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    found = F.array_compact(F.array(F.when(blank("uid"), "uid"), F.when(blank("entity"), "entity"), F.when(blank("summary"), "summary"), F.when(F.coalesce(F.size("sources"), F.lit(0)) < 1, "sources")))
    return nodes.select("uid", F.explode(found).alias("problem"))
