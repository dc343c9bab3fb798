"""Queries of the training-text operators, by name, and the SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import boilerplate, languages, mixing, names, nearcopies, packing, pages, sentences
from strandline.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.evidence_sentences(table(spark, sf_dir, "evidence"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = nearcopies.claim_and_evidence_records(table(spark, sf_dir, "atomic_claims"), table(spark, sf_dir, "evidence"))
    return nearcopies.similar_pairs(records).select(_record_table(), "id_a", "id_b")


def _record_table() -> Column:
    return F.when(F.col("tab") == 0, "atomic_claims").otherwise("evidence").alias("record_table")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with its class of equal texts, its group of near-copies and its number of links."""
    records = nearcopies.claim_and_evidence_records(table(spark, sf_dir, "atomic_claims"), table(spark, sf_dir, "evidence"))
    return nearcopies.similar_groups(records).select(_record_table(), "id", "class_id", "members", "group_id", "links")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of class representatives; with the classes of ``p3_groups`` the exact form of ``p3_found``."""
    records = nearcopies.claim_and_evidence_records(table(spark, sf_dir, "atomic_claims"), table(spark, sf_dir, "evidence"))
    return nearcopies.similar_classes(records)[0].select(_record_table(), "id_a", "id_b")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    return names.linked_records(read("rita_entities"), read("atomic_claims"), read("canonical_nodes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.residue_pages(table(spark, sf_dir, "crawl_results")).select("crawl_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.article_lines(table(spark, sf_dir, "crawl_results"), table(spark, sf_dir, "evidence"))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "canonical_nodes"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached_shares(p8_mixing(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.wrong_or_mixed(languages.language_segments(table(spark, sf_dir, "documents")))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_segments(table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_groups": p3_groups, "p3_pairs": p3_pairs, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_packing": p7_packing, "p8_mixing": p8_mixing, "p8_shares": p8_shares, "p9_found": p9_found, "p9_segments": p9_segments}
SQL: dict[str, str] = {}
