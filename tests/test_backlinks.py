"""Backlinks, notes' entities and small forms of names by literal cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import backlinks
from strandline.sources import readers

NODES = [("u1", "Alpha Water Board", ["AWB"]), ("u2", "Beta Fund", ["Twin"]), ("u3", "Gamma Fund", ["Twin"])]


def registry(spark):
    return spark.createDataFrame(NODES, "uid string, entity string, aliases array<string>")


def test_backlinks(spark):
    m = spark.createDataFrame([("Alpha Water Board", 3), ("Twin", 1), ("Nobody", 2)], "mention string, n int")
    got = {r["mention"]: (r["state"], r["uid"], r["n"]) for r in backlinks.backlinks(m, registry(spark)).collect()}
    assert got == {"Alpha Water Board": ("RESOLVED", "u1", 3), "Twin": ("AMBIGUOUS", None, 1), "Nobody": ("NEW_ENTITY", None, 2)}


def test_primary_entity_is_the_first_that_names_one(spark):
    rows = [(1, 0, "Nobody"), (1, 1, "Twin"), (1, 2, "beta fund"), (1, 3, "Alpha Water Board"), (2, 0, "Nobody")]
    got = {r["doc_id"]: (r["uid"], r["position"]) for r in backlinks.primary_entities(spark.createDataFrame(rows, "doc_id int, position int, mention string"), registry(spark)).collect()}
    assert got == {1: ("u2", 2), 2: (None, None)}


def test_references(spark):
    note = "# H\nSee [[A]] and [B](http://x) and [[A]].\nReferences: C; D , A\nreferences:"
    df = spark.createDataFrame([(note,), (None,)], "t string")
    got = [r["r"] for r in df.select(backlinks.references(F.col("t"), readers.note_parts(F.col("t"))["links"]).alias("r")).collect()]
    assert got[0] == ["B", "A", "C", "D"] and not got[1]


def test_forms_of_names(spark):
    c = F.col("n")
    row = lambda n: tuple(spark.createDataFrame([(n,)], "n string").select(backlinks.parentheticals(c), backlinks.acronyms(c), backlinks.trailing_acronym(c), backlinks.without_trailing_acronym(c)).collect()[0])
    assert row("Energy (old) Authority of ZIM (ZERA)") == (["old", "ZERA"], ["ZIM", "ZERA"], "ZERA", "Energy (old) Authority of ZIM")
    assert row("plain name") == ([], [], None, "plain name") and row("") == ([], [], None, "")


def test_top_fuzzy(spark):
    m = spark.createDataFrame([("m", f"u{i}", s) for i, s in enumerate([0.9, 0.95, 0.9, 0.86, 1.0])], "mention string, uid string, score double")
    assert [(r["place"], r["uid"]) for r in backlinks.top_fuzzy(m).orderBy("place").collect()] == [(1, "u4"), (2, "u1"), (3, "u0")]
