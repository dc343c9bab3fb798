"""Links' targets, rows' errors and kinds of sources by literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.operators import validate

TARGETS = {
    "Energy Regulatory Authority": None, "ministry": None, "Kenya": None, "Acme Holding": None, "hidden name": None, "": "empty", None: "empty", "x" * 101: "long", "A B C D E F G H I J K": "many_words",
    "It is open. Come in": "sentence", "the power of the many towns": "prose", "Apply Now": "call", "Home": "call", "3 John 1:4": "sentence", "B": "letter", "lower": "no_name", "River authority of the north": "prose", "River authority": None, "ZX": None,
}
NODE = "uid string, entity string, aliases array<string>, entity_type string, subtype string, country string, sector string, status string, summary string, relationships array<string>, associations array<string>, sources array<string>"


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), NODE)


def test_targets(spark):
    df = spark.createDataFrame([(t,) for t in TARGETS], "target string")
    registry = nodes(spark, ("u", "Hidden Name", ["hidden name"], None, None, None, None, None, None, [], [], []))
    assert {r["target"]: r["problem"] for r in validate.judged_targets(df, registry).collect()} == TARGETS


def test_a_good_row_has_no_errors(spark):
    good = ("water-board", "Water Board", ["WB"], "public authority", None, "Kenya", "Water Sector", "active", "Water Board manages [[Kenya]].", ["manages::[[Kenya]]"], ["part_of::[[Water Board]]"], ["https://a.example"])
    assert validate.node_errors(nodes(spark, good)).count() == 0 and validate.node_errors(nodes(spark, good).where("false")).count() == 0


@pytest.mark.parametrize(
    "field,value,want",
    [
        ("uid", "Water Board", [("uid", "format")]), ("entity_type", "a body.", [("entity_type", "sentence"), ("entity_type", "unknown")]), ("sector", "water sector", [("sector", "unknown")]), ("country", "France", [("country", "unknown")]),
        ("status", "x" * 51, [("status", "long"), ("status", "unknown")]), ("summary", None, [("summary", "missing")]), ("summary", "It waters towns.", [("summary", "no_reference"), ("summary", "no_verb")]), ("summary", "Water Board is here now.", [("summary", "call")]),
        ("summary", "WB is " + "so " * 500 + "big.", [("summary", "long")]), ("aliases", ["W", "See it.", "Click this"], [("aliases", "call"), ("aliases", "letter"), ("aliases", "sentence")]), ("sources", [], [("sources", "missing")]), ("sources", None, [("sources", "missing")]),
        ("sources", ["ftp://a"], [("sources", "no_address")]), ("relationships", ["manages Kenya", "eats::[[Kenya]]", "manages::[[B]]"], [("relationships", "format"), ("relationships", "predicate"), ("relationships", "target_letter")]),
    ],
)
def test_errors(spark, field, value, want):
    good = dict(zip([x.split()[0] for x in NODE.split(", ")], ("water-board", "Water Board", ["WB"], "public authority", None, "Kenya", "Water Sector", "active", "Water Board manages [[Kenya]].", [], [], ["https://a.example"])))
    df = nodes(spark, tuple((good | {field: value}).values()))
    assert sorted((r["field"], r["code"]) for r in validate.node_errors(df).collect()) == want


@pytest.mark.parametrize(
    "url,title,hint,want",
    [
        ("https://www.wikidata.org/wiki/Q1", None, None, "Wikidata"), ("http://x.example", None, "NEWS", "news"), ("http://mango.com/contact", "Contact", None, "search_discovered"), ("http://power.gov.example/", None, None, "government"),
        ("http://x.example/a", "Electricity Act of 1990", None, "legislation"), ("http://x.example/press/1", None, None, "news"), ("http://uni.ac.example", None, None, "academic"), (None, None, None, "search_discovered"), ("http://www.gov.zw/", None, "none such", "official"),
    ],
)
def test_source_types(spark, url, title, hint, want):
    df = spark.createDataFrame([(url, title, hint)], "u string, t string, h string")
    assert df.select(validate.source_type(F.col("u"), F.col("t"), F.col("h")).alias("k")).collect()[0]["k"] == want
