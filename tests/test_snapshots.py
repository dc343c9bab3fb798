from __future__ import annotations

from datetime import datetime

from strandline.operators.snapshots import INTAKE_FIELDS, intake_changes, snapshot_changes

SCHEMA = "snapshot_no int, delivered_at timestamp, entity_id string, name string, rita_type string, aliases array<string>, metadata map<string,string>, source_ids array<string>, source_count int, ingestion_status string, change_type string"


def row(n, ident, name="a", at=1, **more):
    base = {"rita_type": "person", "aliases": None, "metadata": None, "source_ids": None, "source_count": 0, "ingestion_status": "NEW", "change_type": "clash"} | more
    return (n, datetime(2026, 1, at), ident, name, base["rita_type"], base["aliases"], base["metadata"], base["source_ids"], base["source_count"], base["ingestion_status"], base["change_type"])


def changes(spark, rows):
    return {tuple(r) for r in intake_changes(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_added_removed_changed_and_blanks(spark):
    rows = [row(1, "x"), row(1, "y"), row(1, "z"), row(2, " x "), row(2, "y", name="b"), row(2, "w")]
    assert changes(spark, rows) == {(2, "y", "changed"), (2, "z", "removed"), (2, "w", "added")}


def test_what_does_not_count(spark):
    before = row(1, "x", name=" a ", aliases=["p", "q"], metadata={"k": "v", "l": None}, ingestion_status=" new ", rita_type="PERSON")
    after = row(2, "x", aliases=["q", "p"], metadata={"l": "", "k": "v"}, source_ids=[])
    assert changes(spark, [before, after]) == set()


def test_last_delivery_counts_and_ties_are_settled(spark):
    rows = [row(1, "x"), row(2, "x", name="late", at=9), row(2, "x", name="early", at=2)]
    assert changes(spark, rows) == {(2, "x", "changed")}
    assert changes(spark, [row(1, "x", name="b"), row(2, "x", at=3), row(2, "x", name="b", at=3)]) == changes(spark, [row(1, "x", name="b"), row(2, "x", name="b", at=3), row(2, "x", at=3)])


def test_empty_table_nulls_and_one_snapshot(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [row(1, "x")]) == set()
    assert changes(spark, [row(1, None), row(2, "x"), row(None, "q")]) == {(2, "", "removed"), (2, "x", "added")}


def test_hot_key_and_long_text(spark):
    rows = [row(1, "x", name="n" * 100_000)] + [row(2, "x", name="n" * 100_000, at=1 + i % 20) for i in range(300)]
    assert changes(spark, rows) == set()


def test_array_elements_cannot_be_confused(spark):
    assert changes(spark, [row(1, "x", aliases=["ab", "c"]), row(2, "x", aliases=["a", "bc"])]) == {(2, "x", "changed")}


def test_general_form(spark):
    df = spark.createDataFrame([(10, 1, "k", 5.0), (20, 1, "k", 6.0)], "s int, v int, id string, amount double")
    assert [tuple(r) for r in snapshot_changes(df, "id", "s", "v", ["amount"]).collect()] == [(20, "k", "changed")]
    assert "delivered_at" not in INTAKE_FIELDS
