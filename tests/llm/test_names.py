from __future__ import annotations

import random

from strandline.llm import names

PLACES = "Ralomir Ternavo Bekulan Sidoreth Movania Kestrobal".split()
FIELDS = "Water Gas Rail Power".split()
BODIES = ["Supply Board", "Trust Fund", "Research Institute"]
GIVEN = "Elizabeth Robert Michael".split()
FAMILY = "Tarandolu Vekimora Sosterim".split()


def registry(spark):
    rows, n = [], 0
    for p in PLACES:
        for f in FIELDS:
            for b in BODIES:
                n += 1
                rows.append((f"E-{n:04d}", f"{p} {f} {b}", []))
    for g in GIVEN:
        for f in FAMILY:
            n += 1
            rows.append((f"E-{n:04d}", f"{g} {f}", []))
    return spark.createDataFrame(rows, "uid string, entity string, aliases array<string>"), {r[1]: r[0] for r in rows}


def linked(spark, typed):
    nodes, uid = registry(spark)
    links = names.link_names(spark.createDataFrame([(t,) for t in typed], "name string"), nodes)
    got = {r["name"]: r["uid"] for r in names.best_links(links, names.node_twins(links, nodes)).collect()}
    return got, uid


def test_variants_and_others(spark):
    want = {
        "RALOMIR WATER SUPPLY BOARD": "Ralomir Water Supply Board", "Ralomri Water Supply Baord": "Ralomir Water Supply Board", "Supply Board, Ternavo Gas": "Ternavo Gas Supply Board",
        "Research Institute of Bekulan Rail": "Bekulan Rail Research Institute", "Sidoreth Power Res. Instit.": "Sidoreth Power Research Institute", "The Movania-Gas Trust Fund (MGTF)": "Movania Gas Trust Fund",
        "KestrobalWater Trust Fund": "Kestrobal Water Trust Fund", "Liz Tarandolu": "Elizabeth Tarandolu", "Vekimora, Robert": "Robert Vekimora", "Hon. Mike Sosterim": "Michael Sosterim", "R. Tarandolu": "Robert Tarandolu",
    }
    other = ["Zamorik Water Supply Board", "Ralomir Ports Supply Board", "Ralomir Water Commission", "Robert Quenvaldo", "", "x", None, "###", "n" * 5000]
    got, uid = linked(spark, [*want, *other])
    assert got == {k: uid[v] for k, v in want.items()}


def test_segments_find_all_within_the_edits():
    rng = random.Random(2)
    for _ in range(400):
        core = "".join(rng.choice("abcdef") for _ in range(rng.randint(4, 15)))
        typed = list(core)
        for _ in range(names.allowed(len(core))):
            at = rng.randrange(len(typed))
            kind = rng.randrange(4)
            if kind == 0:
                typed[at] = rng.choice("abcdef")
            elif kind == 1:
                typed.insert(at, rng.choice("abcdef"))
            elif kind == 2 and len(typed) > 2:
                del typed[at]
            elif kind == 3 and at:
                typed[at - 1], typed[at] = typed[at], typed[at - 1]
        assert names.index_keys("f", core) & names.probe_keys("f", "".join(typed)), (core, typed)


def test_edits():
    assert names.edits("abcd", "abdc", 2) == 1 and names.edits("abc", "abcdef", 2) == 3 and names.edits("same", "same", 0) == 0 and names.edits("kitten", "sitting", 3) == 3


def test_records(spark):
    from datetime import datetime

    nodes, uid = registry(spark)
    twin = spark.createDataFrame([("E-9999", "Ralomir Watr Supply Board", ["Al"])], "uid string, entity string, aliases array<string>")
    nodes = nodes.unionByName(twin)
    entities = spark.createDataFrame([(1, datetime(2026, 1, 1), " 7 ", "Old"), (2, datetime(2026, 1, 2), "7", "Ralomir Water Suply Board"), (2, datetime(2026, 1, 2), "8", None), (2, None, "9", "Al")], "snapshot_no int, delivered_at timestamp, entity_id string, name string")
    claims = spark.createDataFrame([(1, "RALOMIR WATER SUPPLY BOARD"), (1 << 40, "Ralomir Water Supply Board"), (3, None), (None, "x")], "seq long, subject string")
    got = {tuple(r) for r in names.linked_records(entities, claims, nodes).collect()}
    first = uid["Ralomir Water Supply Board"]
    assert got == {("rita_entities", "7", first), ("atomic_claims", "1", first), ("canonical_nodes", first, "E-9999")}
    assert names.linked_records(entities.where("false"), claims.where("false"), nodes.where("false")).count() == 0


def test_short_and_alias_nodes_are_twins(spark):
    nodes, uid = registry(spark)
    extra = [
        ("E-9001", "R.W.S.B.", []), ("E-9002", "rgtf", ["Ralomir Gas Trust Fund."]), ("E-9003", "M. Sosterim", []), ("E-9004", "E SSosterim", ["Sosterim Elizabteh"]),
        ("E-9005", "S.S.B.", []), ("E-9006", "Old Harbour Office", ["Ternavo Rail Research Inst."]),
    ]
    nodes = nodes.union(spark.createDataFrame(extra, nodes.schema))
    claims = spark.createDataFrame([(1, "M Sosterim"), (2, "RWSB")], "seq long, subject string")
    entities = spark.createDataFrame([], "entity_id string, name string, snapshot_no int, delivered_at timestamp")
    got = {(r["record_table"], r["key_a"], r["key_b"]) for r in names.linked_records(entities, claims, nodes).collect()}
    want = {("Ralomir Water Supply Board", "E-9001"), ("Ralomir Gas Trust Fund", "E-9002"), ("Michael Sosterim", "E-9003"), ("Elizabeth Sosterim", "E-9004"), ("Ternavo Rail Research Institute", "E-9006")}
    assert got == {("canonical_nodes", uid[a], b) for a, b in want} | {("atomic_claims", "1", uid["Michael Sosterim"]), ("atomic_claims", "2", uid["Ralomir Water Supply Board"])}


def test_near_words_equal_brute_force():
    rng = random.Random(6)
    words = frozenset("".join(rng.choice("abcd") for _ in range(rng.randint(3, 10))) for _ in range(150))
    most = lambda w: 1 if len(w) < 7 else 2
    near = names.Near(words, most)
    for _ in range(400):
        x = list(rng.choice(sorted(words)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randrange(2)] = rng.choice(["", "a", "e"])
        x = "".join(x)
        assert near(x) == sorted((d, w) for w in words if (d := names.edits(x, w, most(w))) <= most(w))
