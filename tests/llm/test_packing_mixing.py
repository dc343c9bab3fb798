from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from strandline.llm import mixing, packing, tokens

LIMITS = "pack_id int, capacity_tokens int, separator_tokens int, slot int"


def documents(spark, n=300, seed=5):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["water", "gas", "line", "a", "board"]) for _ in range(int(rng.paretovariate(1.1) * 12) % 900 + 1)), rng.choice(["s1"] * 6 + ["s2", "s3"]), rng.choice(["en", "EN", "fra", "xx", None]), "u1") for i in range(n)]
    rows += [(1000, None, "s1", "en", None), (1001, "  ", "s1", "en", None), (1002, "", None, "en", None), (5, rows[5][1], "s1", "en", None), (1003, "y" * 30_000, "s2", "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, uid string").selectExpr("*", "7 as tokens_", "1 as pack_id")


@pytest.mark.parametrize("shard", [20_000, 40])
def test_packing_is_whole_and_fits(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD", shard)
    docs = documents(spark)
    limits = {1: (64, 0), 2: (256, 3)}
    rows = packing.packed(docs, spark.createDataFrame([(k, c, s, 1) for k, (c, s) in limits.items()] + [(3, None, 1, 1)], LIMITS)).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["doc_id"]] += 0 if not r["text"] or r["text"].isspace() else tokens.count(r["text"])
    for pack, (capacity, separator) in limits.items():
        own = [r for r in rows if r["pack_id"] == pack]
        total, bins = defaultdict(int), defaultdict(list)
        for r in own:
            total[r["doc_id"]] += r["tokens"]
            bins[r["container_id"]].append(r)
        assert dict(total) == {k: v for k, v in sizes.items() if v}
        for items in bins.values():
            assert sum(r["tokens"] for r in items) + separator * (len(items) - 1) <= capacity
            assert sorted(r["slot"] for r in items) == list(range(1, len(items) + 1))
        cut = {r["doc_id"] for r in own if r["piece_no"] > 1}
        assert all(sizes[d] > capacity for d in cut)
        # at most a fifth more containers than the tokens could fill
        need = sum(v for v in sizes.values()) / capacity
        assert len(bins) <= 1.2 * need + 3
    assert {r["pack_id"] for r in rows} == {1, 2}


def test_packing_nothing(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], LIMITS)
    assert packing.packed(docs, none).count() == 0
    assert packing.packed(docs.where("false"), spark.createDataFrame([(1, 8, 0, 1)], LIMITS)).count() == 0


def test_sum_of_squares_chooses_as_defined():
    rng = np.random.default_rng(3)
    sizes, capacity = rng.integers(1, 12, 200), 12
    container, levels = packing.sum_of_squares(sizes, capacity)
    fill: dict[int, int] = {}
    for s, c in zip(sizes.tolist(), container.tolist()):
        count = lambda f: sum(n * n for n in np.bincount([v for v in f.values() if v < capacity], minlength=capacity + 1).tolist())
        options = [count({**fill, k: v + s}) for k, v in fill.items() if v + s <= capacity] + [count({**fill, -1: s})]
        fill[c] = fill.get(c, 0) + s
        assert count(fill) == min(options)
    assert levels.tolist() == [fill[i] for i in range(len(levels))]


def test_mix_reaches_its_shares(spark):
    docs = documents(spark, 900)
    nodes = spark.createDataFrame([("u1", "Water"), (None, "x")], "uid string, sector string")
    targets = spark.createDataFrame([(1, "s1", 0.5, 1), (1, "s2", 0.3, 2), (1, "s3", 0.2, 3), (2, "s3", 1.0, None), (3, "none", 1.0, 2), (4, "s1", None, 1)], "mix_id int, source string, target_share double, max_repeats int")
    mix = mixing.mixed(docs, nodes, targets)
    rows = mix.collect()
    assert {r["mix_id"] for r in rows} == {1, 2}
    most = {"s1": 1, "s2": 2, "s3": 3}
    largest = max(r["tokens"] for r in rows)
    total = sum(r["tokens"] * r["repeats"] for r in rows if r["mix_id"] == 1)
    for source, share in (("s1", 0.5), ("s2", 0.3), ("s3", 0.2)):
        own = [r for r in rows if r["mix_id"] == 1 and r["source"] == source]
        assert max(r["repeats"] for r in own) <= most[source]
        assert abs(sum(r["tokens"] * r["repeats"] for r in own) - share * total) <= 2 * largest
        assert abs(own[0]["reached_share"] - sum(r["tokens"] * r["repeats"] for r in own) / total) < 1e-9
    report = {(r["mix_id"], r["source"]): r["reached_share"] for r in mixing.reached_shares(mix, targets).collect()}
    assert report[(3, "none")] == 0 and abs(report[(2, "s3")] - 1) < 1e-9
    assert mixing.mixed(docs.where("false"), nodes, targets).count() == 0


def test_fit_keeps_margins():
    have = np.array([100.0, 300, 50, 50, 400, 100])
    source, lang = np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 0, 1, 0, 1])
    uses = mixing.fit(have, source, [lang], np.array([0.5, 0.2, 0.3]), np.array([1.0, 3, 1]))
    got = np.bincount(source, uses * have)
    assert np.allclose(got / got.sum(), [0.5, 0.2, 0.3]) and (uses <= np.array([1, 1, 3, 3, 1, 1]) + 1e-9).all()
