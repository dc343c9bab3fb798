"""Relevance, extraction, gate and classes of claims by literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.operators import classify, relevance

CLASSES = [
    ("Grid Board regulates the country's energy sector.", None, "regulates", "the country's energy sector", "SUMMARY", None),
    ("GRB regulates Electricity.", None, None, None, "RELATIONSHIP", None),
    ("Lithium is connected to electric vehicle supply chains.", "Lithium", "connected_to", "Electric Vehicle Supply Chain", "ASSOCIATION", None),
    ("GRB is a government agency.", "GRB", "is", "a government agency", "METADATA", "entity_type"),
    ("Some Org is related to something unclear.", "Some Org", "related_to", "something unclear", "UNCLASSIFIED", None),
    ("Neoliberal policies is an economic policy approach.", "Neoliberal policies", "is", "an economic policy approach", "METADATA", "entity_type"),
    ("", None, None, None, "UNCLASSIFIED", None), (None, None, None, None, "UNCLASSIFIED", None),
    ("The mill lies near Kenya.", "The mill", "lies near", "Kenya", "METADATA", "country"),
    ("The line is inactive since May.", "The line", "stands", "idle", "METADATA", "status"),
]


@pytest.fixture(scope="module")
def classified(spark):
    rows = [(i, *c[:4]) for i, c in enumerate(CLASSES)]
    df = spark.createDataFrame(rows, "seq int, claim_text string, subject string, predicate string, object string").withColumn("label", F.lit("clash"))
    return {r["seq"]: r["label"] for r in classify.classify(df).collect()}


@pytest.mark.parametrize("i", range(len(CLASSES)))
def test_class(classified, i):
    assert (classified[i]["category"], classified[i]["field"]) == CLASSES[i][4:]


def test_details_of_classes(classified):
    assert classified[1]["target"] == "Electricity" and classified[1]["predicate"] == "regulates"
    assert classified[5]["target"] == "an economic policy approach" and classified[5]["subtype"] == "economic_policy"
    assert "energy sector" in classified[0]["target"]


def test_routes_are_distinct(spark):
    df = spark.createDataFrame([(1, "X", "GRB regulates Electricity.", "GRB", "regulates", "Electricity"), (2, "X", "GRB regulates Electricity.", "GRB", "regulates", "Electricity")], "seq int, o string, claim_text string, subject string, predicate string, object string")
    assert [tuple(r) for r in classify.routed(df, "o", "seq").collect()] == [("X", "RELATIONSHIP", "regulates::[[Electricity]]", 1, 2)]
    assert classify.routed(df.where("false"), "o", "seq").count() == 0 and classify.selected_fields(df.where("false"), "o", "seq").count() == 0


TARGET = "Harbour College"
EVIDENCE = [
    (1, "http://a.example", "Harbour College is a training institution for seamen and pilots. It teaches navigation at sea.", "usable", "DIRECT", "target"),
    (2, "http://a.example", "ACTIVE Ministry provides support to Harbour College.", "usable", "DIRECT", "target"),
    (3, "http://a.example", "Menu Login Next Previous", "usable", "IRRELEVANT", "no_relation"),
    (4, "http://a.example", "Access denied. Harbour College is behind a wall.", "usable", "IRRELEVANT", "block_or_error"),
    (5, "http://a.example", "Nothing to see of it.", "UNUSABLE", "IRRELEVANT", "unusable"),
    (6, "http://a.example", "Harbour College trains pilots.", "UNUSABLE", "DIRECT", "target"),
    (7, None, "Harbour College trains pilots.", "usable", "IRRELEVANT", "no_url"), (8, "http://a.example", " ", "usable", "IRRELEVANT", "empty_text"), (9, "http://a.example", None, None, "IRRELEVANT", "empty_text"),
]


def evidence(spark):
    return spark.createDataFrame([(i, u, t, s, TARGET) for i, u, t, s, _, _ in EVIDENCE], "evidence_id int, url string, content string, evidence_status string, entity_name string").selectExpr("*", "content as normalized_text", "'' as snippet")


def test_relevance(spark):
    got = {r["evidence_id"]: (r["relevance"], r["reason"]) for r in relevance.label_records(evidence(spark)).collect()}
    assert got == {i: (label, why) for i, _, _, _, label, why in EVIDENCE}
    assert relevance.label_records(evidence(spark).where("false")).count() == 0


@pytest.mark.parametrize(
    "passage,want",
    [
        ("Harbour College supports Northern Port.", (TARGET, "supports", "Northern Port.", "RELATIONSHIP", "DIRECT")),
        ("Trade Ministry funds Harbour College each year.", ("Trade Ministry", "funds", TARGET, "RELATIONSHIP", "RELATED")),
        ("The pier is part of Harbour College grounds.", ("The pier is", "part_of", TARGET, "ASSOCIATION", "RELATED")),
        ("Harbour College is a training institution.", (TARGET, "is", "Training Institution", "ATTRIBUTE", "DIRECT")),
        ("Pilots of Harbour College went to Kenya.", (TARGET, "located_in", "kenya", "ATTRIBUTE", "DIRECT")),
        ("Work at Harbour College lies inactive.", (TARGET, "has_status", "inactive", "ATTRIBUTE", "DIRECT")),
        ("The roof of Harbour College leaks.", (TARGET, "describes", "The roof of Harbour College leaks.", "SUMMARY", "DIRECT")),
        ("Nothing of that name.", None),
    ],
)
def test_claim_of_a_sentence(spark, passage, want):
    rows = relevance.with_claims(spark.createDataFrame([(passage, TARGET)], "passage string, target string")).select("c.*").collect()
    assert [tuple(r[k] for k in ("subject", "predicate", "object", "evidence_type", "relevance")) for r in rows] == ([want] if want else [])


def test_gate(spark):
    good = ("Harbour College", "supports", "Northern Port", "Harbour College supports Northern Port.", "Harbour College supports Northern Port.", "http://a.example", "DIRECT", TARGET)
    cases = {
        (): good, ("no_subject", "other_subject"): (" ", *good[1:]), ("no_url",): (*good[:5], None, *good[6:]), ("long_passage",): (*good[:4], "x" * 1001, *good[5:]), ("single_letter",): (*good[:2], "B", *good[3:]),
        ("other_subject",): ("Southern Mill", *good[1:]), ("fragment",): (*good[:3], "harbour College supports all.", *good[4:]), ("no_verb",): (*good[:3], "Harbour College and its pier.", *good[4:]),
        ("call", "navigation"): (*good[:4], "Visit the home page, Harbour College supports it.", *good[5:]), ("verse",): (*good[:4], "See 2 Timothy 2:15 for that.", *good[5:]),
    }
    df = spark.createDataFrame(list(cases.values()), "subject string, predicate string, object string, claim_text string, passage string, url string, relevance string, target string")
    assert [tuple(r["failures"]) for r in relevance.judged(df).collect()] == list(cases)
    passage = good[:4] + ("x" * 1000,) + good[5:]
    assert relevance.judged(spark.createDataFrame([passage], df.schema)).collect()[0]["failures"] == []


def test_pipeline_keeps_the_strongest(spark):
    df = spark.createDataFrame(
        [(1, "http://a.example", "Harbour College supports Northern Port."), (2, "http://b.example", "Harbour College supports Northern Port. Harbour College supports northern port!"), (3, "http://c.example", "Harbour College."), (4, "http://c.example", None)],
        "evidence_id int, url string, content string",
    ).selectExpr("*", "content as normalized_text", "'' as snippet", "'usable' as evidence_status", f"'{TARGET}' as entity_name")
    assert [(r["claim_key"], r["evidence_id"], r["sentence_no"], r["n_claims"]) for r in relevance.pipeline(df, "evidence_id").collect()] == [("harbourcollege|supports|northernport", 1, 0, 3)]
