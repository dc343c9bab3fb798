from __future__ import annotations

import random

import pytest

from strandline.llm import nearcopies

LONG = " ".join(str(i * 7919) for i in range(40_000))
SCHEMA = "tab int, id bigint, text string, id_a string"


def brute(rows, threshold=0.7):
    sets = [(t, i, nearcopies.normal(x or "")) for t, i, x in rows]
    out = set()
    for n, (t, i, x) in enumerate(sets):
        for u, j, y in sets[n + 1 :]:
            if t == u and i != j and x and y and (x == y or nearcopies.similarity(nearcopies.runs_of(x), nearcopies.runs_of(y)) >= threshold):
                out.add((t, min(i, j), max(i, j)))
    return out


def made(n=60, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, ident = [], 0
    for _ in range(n):
        base = [word() for _ in range(40)]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(40)] = word()
            ident += 1
            rows.append((rng.randint(0, 1), ident, " ".join(copy)))
    return rows


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = [tuple(r) for r in nearcopies.similar_pairs(df, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force(spark):
    rows = made()
    want, got = brute(rows), found(spark, rows)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 30


def test_odd_rows(spark):
    rows = [(0, 1, None), (0, 2, ""), (0, 3, "abc"), (0, 4, "A b-c"), (0, 5, "!!!"), (1, 3, "abc"), (0, 6, "日本語のテキスト"), (0, 7, "日本語のテキスト。"), (0, 8, LONG), (0, 9, LONG + "y"), (0, 1, None)]
    assert found(spark, rows) == {(0, 3, 4), (0, 6, 7), (0, 8, 9)}
    assert found(spark, []) == set()


def test_blocks_of_hot_keys_lose_nothing(spark, monkeypatch):
    rows = made(20, 3) + [(0, 1000 + i, "the same long boiler plate text with the number at its end " * 3 + str(i)) for i in range(40)]
    whole = found(spark, rows)
    monkeypatch.setattr(nearcopies, "BLOCK", 4)
    assert found(spark, rows) == whole and len(whole) >= 40 * 39 // 2


def test_windows_of_copies(spark):
    rows = [(0, i, "one and the same text for all of them, repeated") for i in range(1, 9)] + [(0, 20 + i, "one and the same text for all of them, repeated!!1") for i in range(4)]
    whole = found(spark, rows)
    assert whole == brute(rows) and found(spark, rows, window=7) == whole
    got = found(spark, rows, window=3)
    assert got <= whole and {(0, i, j) for i in range(1, 9) for j in range(i + 1, min(9, i + 4))} <= got and {(0, i, 20 + j) for i in range(1, 4) for j in range(3)} <= got


def test_groups_equal_brute_force(spark):
    rows = made(30, 5) + [(0, 500, None), (0, 501, "alone in its class, and like no other text at all")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    root = {(t, i): (t, i) for t, i, x in rows if x}
    find = lambda v: v if root[v] == v else find(root[v])
    for t, i, j in brute(rows):
        a, b = find((t, i)), find((t, j))
        root[max(a, b)] = min(a, b)
    got = {(r["tab"], r["id"]): (r["tab"], r["group_id"]) for r in nearcopies.similar_groups(df).collect()}
    assert got == {v: find(v) for v in root}
    assert nearcopies.similar_groups(df.where("false")).count() == 0


def test_components_of_chains(spark, tmp_path):
    rng = random.Random(2)
    names = rng.sample(range(1000), 120)
    edges = list(zip(names[:60], names[1:60])) + [(names[60], x) for x in names[61:100]] + [(7, 7)]
    got = {r["v"]: r["root"] for r in nearcopies.components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path)).collect()}
    want = {v: min(names[:60]) for v in names[:60]} | {v: min(names[60:100]) for v in names[60:100]}
    assert got == want


def test_lower_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        nearcopies.similar_classes(spark.createDataFrame([], SCHEMA), 0.5)
