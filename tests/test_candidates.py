"""Candidates by literal cases."""

from __future__ import annotations

from strandline.operators import candidates

SCHEMA = "requested string, entity_type string, country string, uid string, name string, description string, instance_of string, candidate_country string"
ASKED = "Kestrel Energy Regulatory Authority (KERA)"
ROWS = [
    (ASKED, "organization", None, "a", "Kera", "genus of insects", None, None),
    (ASKED, "organization", None, "b", "kestrel energy regulatory authority (kera)", None, None, None),
    (ASKED, "organization", "Kenya", "c", "Kestrel Energy Regulatory Authority", "regulator of Kenya", "government organization", "Kenya"),
    ("Tern Fund", None, None, "d", "Tern Fond", None, None, None),
    ("Tern Fund", None, None, "e", "Some Mill", None, None, None),
    ("Gull Board", "organization", None, "f", "Gull Club", None, "taxon", None),
    (None, None, None, "g", None, None, None, None),
]


def test_verdicts(spark):
    got = {r["uid"]: (r["verdict"], r["mismatch"]) for r in candidates.judged(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == {"a": ("REJECTED", "semantic"), "b": ("ACCEPTED", None), "c": ("ACCEPTED", None), "d": ("AMBIGUOUS", None), "e": ("REJECTED", None), "f": ("REJECTED", "type"), "g": ("REJECTED", None)}


def test_choice(spark):
    df = candidates.judged(spark.createDataFrame(ROWS, SCHEMA))
    got = {r["requested"]: (r["status"], r["uid"], r["candidates"]) for r in candidates.chosen(df, "uid").collect()}
    assert got == {ASKED: ("RESOLVED", "b", 3), "Tern Fund": ("AMBIGUOUS", None, 2), "Gull Board": ("REJECTED", None, 1), None: ("REJECTED", None, 1)}
    assert candidates.chosen(df.where("false"), "uid").count() == 0
