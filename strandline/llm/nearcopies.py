"""Records that share most of their text: pairs with a Jaccard similarity above a threshold.

Tensored banding. A record gets two collections of small hashes, A and B, each of ``PIECES`` pieces of
``WIDTH`` minhashes. The key of table (i, j) is the pair of A's piece i and B's piece j, so
PIECES * PIECES tables need only 2 * PIECES * WIDTH minhashes. The tables aren't written out: records
are grouped by their pieces of A alone, and within a group those whose pieces of B agree are
candidates. Candidates are verified on the whole texts.

With 10 pieces of 3 a pair of similarity s is a candidate with probability (1 - (1 - s^3)^10)^2: 0.97
at 0.7, 0.992 at 0.75, 0.998 at 0.8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.seq import numbered
from strandline.session import new_folder, written

PIECES, WIDTH, RUN = 10, 3, 5
#: Groups of one key with more records than this are compared block by block, each pair of blocks in its own group.
BLOCK = 2000
#: Copies are paired with so many copies that follow them.
WINDOW = 100

_DROP = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
_RNG = np.random.default_rng(20250101)
_FACTORS = _RNG.integers(1, 2**63, 2 * PIECES * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(1, RUN + 1)], np.uint64)


def normal(text: str) -> str:
    return _DROP.sub("", text.lower())


def runs_of(text: str) -> set[str]:
    """All runs of five characters of a normalised text."""
    return {text[i : i + RUN] for i in range(len(text) - RUN + 1)}


def similarity(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a and b else 0.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minhashes(texts: list[str]) -> np.ndarray:
    """[text, function] minima over the runs of each text; texts must hold at least one run."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.empty((len(texts), len(_FACTORS)), np.uint32)
    first, step = 0, 1 << 17
    while first < len(texts):  # blocks that stay in the processor's cache
        last = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), step)) + first)
        part = texts[first:last]
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(points) - RUN + 1
        hashed = np.zeros(n, np.uint64)
        for k in range(RUN):
            hashed += (points[k : k + n] + np.uint64(1)) * _PLACES[k]
        hashed = _mix(hashed)
        size = sizes[first:last]
        starts = np.cumsum(size) - size
        # runs that reach over the end of a text take the value of the text's first run
        inner = np.arange(len(points)) - np.repeat(starts, size)
        over = (inner > np.repeat(size - RUN, size))[:n]
        hashed[over] = hashed[np.repeat(starts, size)[:n][over]]
        for j, factor in enumerate(_FACTORS):
            out[first:last, j] = np.minimum.reduceat(((hashed * factor) >> np.uint64(32)).astype(np.uint32), starts)
        first = last
    return out


SIGNED = "tab int, id bigint, f1 bigint, f2 bigint, bits bigint, a array<bigint>, b array<int>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = np.arange(1, PIECES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for batch in batches:
        tabs = batch.column(0).to_numpy(zero_copy_only=False)
        ids = batch.column(1).to_numpy(zero_copy_only=False)
        texts = [normal(t or "") for t in batch.column(2).to_pylist()]
        some = np.array([bool(t) for t in texts], bool)
        texts = [t for t in texts if t]
        if not texts:
            continue
        tabs, ids = tabs[some].astype(np.uint64), ids[some]
        prints = np.frombuffer(b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)
        signed = minhashes([t if len(t) >= RUN else t.ljust(RUN, "\0") for t in texts])
        pieces = np.zeros((len(texts), 2 * PIECES), np.uint64)
        for w in range(WIDTH):
            pieces = _mix(pieces ^ (signed[:, w::WIDTH].astype(np.uint64) + np.uint64(w << 40)))
        a = _mix(pieces[:, :PIECES] ^ seeds ^ (tabs[:, None] << np.uint64(56)))
        b = (pieces[:, PIECES:] >> np.uint64(32)).astype(np.uint32)
        bits = ((signed & np.uint32(1)).astype(np.int64) << np.arange(signed.shape[1], dtype=np.int64)).sum(axis=1)
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * PIECES), pa.array(x.reshape(-1).view(kind)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(tabs.astype(np.int32)), pa.array(ids.astype(np.int64)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(bits), lists(np.ascontiguousarray(a), np.int64), lists(np.ascontiguousarray(b), np.int32)],
            names=["tab", "id", "f1", "f2", "bits", "a", "b"],
        )


#: Of 60 bits of two records' minhashes so many must agree: at similarity 0.7 51 do on average, with a
#: deviation of 2.8, at 0.2 36. It only spares verifying.
AGREE = 40


def _pairs_of_groups(group: np.ndarray, block: np.ndarray, own: np.ndarray, ids: np.ndarray, bits: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among rows of equal (group, block): those with a piece of B in common."""
    left, right = [], []
    for j in range(PIECES):
        order = np.lexsort((b[:, j], block, group))
        g, h, v = group[order], block[order], b[order, j]
        at = np.arange(len(order) - 1)
        step = 1
        # rows of one bucket are neighbours now: compare with the next, the one after it, and so on
        while len(at):
            at = at[at + step < len(order)]
            same = (g[at] == g[at + step]) & (h[at] == h[at + step]) & (v[at] == v[at + step])
            at = at[same]
            x, y = order[at], order[at + step]
            close = np.bitwise_count((bits[x] ^ bits[y]).astype(np.uint64)) <= 2 * PIECES * WIDTH - AGREE
            # a block pair compares only rows of different blocks, except for a block with itself
            close &= (block[x] < 0) | (own[x] != own[y]) | (block[x] == own[x] * (1 << 20) + own[x])
            left.append(ids[x[close]])
            right.append(ids[y[close]])
            step += 1
    return np.concatenate(left), np.concatenate(right)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive ordered by (k, block); groups are bounded, so what is held over between batches is, too."""
    held = None

    def work(rows):
        tab, k, block, own, ids, bits, b = rows
        if len(ids) < 2:
            return
        same = (k[1:] == k[:-1]) & (block[1:] == block[:-1])
        keep = np.zeros(len(ids), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if not keep.any():
            return
        x, y = _pairs_of_groups(k[keep], block[keep], own[keep], np.flatnonzero(keep), bits[keep], b[keep])
        if len(x):
            pair = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), tab[x]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[2].astype(np.int32)), pa.array(pair[0]), pa.array(pair[1])], names=["tab", "id_a", "id_b"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)]
        lists = batch.column(6)
        columns.append(lists.flatten().to_numpy(zero_copy_only=False).reshape(n, PIECES))
        if held is not None:
            columns = [np.concatenate(p) for p in zip(held, columns)]
        k, block = columns[1], columns[2]
        cut = int(np.flatnonzero((k != k[-1]) | (block != block[-1]))[-1]) + 1 if ((k != k[-1]) | (block != block[-1])).any() else 0
        yield from work([c[:cut] for c in columns])
        held = [c[cut:] for c in columns]
    if held is not None:
        yield from work(held)


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for batch in batches:
            keep = []
            texts_a, texts_b = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for a, b in zip(texts_a, texts_b):
                if a != last:
                    last, seen = a, runs_of(normal(a))
                keep.append(similarity(seen, runs_of(normal(b))) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in range(3)], names=["tab", "id_a", "id_b"])

    return verify


def similar_classes(records: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Near-copies among the rows of ``records`` (tab int, id bigint, text string), within each ``tab``.

    Gives (pairs of class representatives, membership): a class is a set of equal normalised texts, its
    representative the smallest id; ``pairs`` has (tab, id_a, id_b) with id_a < id_b, every pair of
    representatives whose similarity is at least ``threshold`` once; ``membership`` has (tab, id,
    class_id, members) for every row with text. Null texts and texts without letters or digits are in
    neither; texts of fewer than five such characters are only like their copies. A repeated id counts
    as one row. Any number of rows may share a key: see ``BLOCK``.
    """
    spark = records.sparkSession
    if threshold < 0.7:
        raise ValueError("the tables are laid out for similarities of 0.7 and above")
    folder = new_folder(spark, "nearcopies")
    signed = written(records.where(F.col("id").isNotNull()).mapInArrow(_sign, SIGNED), folder, "signed")
    classes = signed.groupBy("tab", "f1", "f2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    membership = signed.select("tab", "f1", "f2", "id").join(classes, ["tab", "f1", "f2"]).select("tab", "id", "class_id", "members").distinct()
    first = written(
        signed.join(classes.select("tab", F.col("class_id").alias("id")), ["tab", "id"], "left_semi").select("tab", "id", "bits", "a", "b").dropDuplicates(["tab", "id"]),
        folder, "first",
    )
    keys = first.select("tab", F.explode("a").alias("k"), F.col("id"), "bits", "b")
    hot = written(keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), folder, "hot")
    hot_keys = hot.count()
    if hot_keys:
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("id"), blocks).cast("int")
        sized = keys.join(F.broadcast(hot) if hot_keys <= 100_000 else hot, "k", "left").withColumn("own", F.coalesce(own, F.lit(-1)))
        other = F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), blocks - 1))
        cell = F.when(F.col("own") < 0, F.lit(-1).cast("bigint")).otherwise(F.least("own", "other").cast("bigint") * (1 << 20) + F.greatest("own", "other"))
        rows = sized.withColumn("other", F.explode(other)).withColumn("block", cell)
    else:
        rows = keys.withColumn("own", F.lit(-1)).withColumn("block", F.lit(-1).cast("bigint"))
    rows = rows.select("tab", "k", "block", "own", "id", "bits", "b").repartition("k", "block").sortWithinPartitions("k", "block")
    candidates = rows.mapInArrow(_match, "tab int, id_a bigint, id_b bigint").distinct()
    candidates = written(candidates, folder, "candidates")
    wanted = candidates.select("tab", F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    texts = written(records.join(wanted, ["tab", "id"], "left_semi").groupBy("tab", "id").agg(F.max("text").alias("text")), folder, "texts")
    both = candidates.join(texts.select("tab", F.col("id").alias("id_a"), F.col("text").alias("text_a")), ["tab", "id_a"]).join(
        texts.select("tab", F.col("id").alias("id_b"), F.col("text").alias("text_b")), ["tab", "id_b"]
    )
    pairs = both.select("tab", "id_a", "id_b", "text_a", "text_b").mapInArrow(_verify(threshold), "tab int, id_a bigint, id_b bigint")
    return written(pairs, folder, "pairs"), membership


def similar_pairs(records: DataFrame, threshold: float = 0.7, window: int = WINDOW) -> DataFrame:
    """(tab, id_a, id_b), id_a < id_b: every pair of rows at or above the threshold, copies included.

    Copies are paired along their class: each with the ``window`` copies that follow it by id; between two
    similar classes the first ``window`` + 1 members of each are paired. So rows grow with the copies, not
    with their square, and a class of up to ``window`` + 1 copies gives all its pairs. ``similar_classes``
    is the exact form of larger ones.
    """
    pairs, membership = similar_classes(records, threshold)
    # only classes of several rows have anything to expand
    members = numbered(membership.where("members > 1").select("tab", "class_id", "id"), ["tab", "class_id"], "id", "r")
    blocks = members.withColumn("block", F.floor((F.col("r") - 1) / window))
    left = blocks.select("tab", "class_id", F.col("id").alias("id_a"), F.col("r").alias("r_a"), F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    right = blocks.select("tab", "class_id", F.col("id").alias("id_b"), F.col("r").alias("r_b"), "block")
    within = left.join(right, ["tab", "class_id", "block"]).where((F.col("r_a") < F.col("r_b")) & (F.col("r_b") - F.col("r_a") <= window)).select("tab", "id_a", "id_b")
    side = lambda c: members.where(F.col("r") <= window + 1).select("tab", F.col("class_id").alias(c), F.col("id").alias(f"{c}_member"))
    across = (
        pairs.join(side("id_a"), ["tab", "id_a"], "left").join(side("id_b"), ["tab", "id_b"], "left")
        .select("tab", F.coalesce("id_a_member", "id_a").alias("p"), F.coalesce("id_b_member", "id_b").alias("q"))
        .select("tab", F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
    )
    return across.unionByName(within)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(v, root): the smallest vertex of each vertex's component, for edges (a, b) of one comparable type.

    Large-star and small-star in turn until nothing changes, some log n rounds; every round is written to
    the folder, and only counts come to the driver. A vertex's neighbours are never gathered: their
    minimum is joined back.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        near = (e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e).distinct()  # a: the centre
        least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        linked = near.join(least, "a")
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    sums = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, "edges-0")
    before, k = None, 0
    while (held := sums(now)) != before:
        before, k = held, k + 1
        now = written(star(written(star(now, True), folder, f"large-{k}"), False), folder, f"edges-{k}")
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def similar_groups(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(tab, id, class_id, members, group_id, links): one row per record with text. Classes that are linked,
    directly or over others, are one group, named by its smallest id; ``links`` counts the other classes
    that the record's class is similar to."""
    folder = new_folder(records.sparkSession, "groups")
    pairs, membership = similar_classes(records, threshold)
    vertex = lambda c: F.struct("tab", F.col(c).alias("id"))
    roots = components(pairs.select(vertex("id_a").alias("a"), vertex("id_b").alias("b")), folder).select("v.tab", F.col("v.id").alias("class_id"), F.col("root.id").alias("group_id"))
    links = pairs.select("tab", F.explode(F.array("id_a", "id_b")).alias("class_id")).groupBy("tab", "class_id").agg(F.count(F.lit(1)).alias("links"))
    found = membership.join(roots, ["tab", "class_id"], "left").join(links, ["tab", "class_id"], "left")
    return found.select("tab", "id", "class_id", "members", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def claim_and_evidence_records(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    plain = F.lower(F.trim(F.coalesce("content_type", F.lit("")))).rlike(r"^(text/plain|application/pdf)\b")
    return claims.select(F.lit(0).alias("tab"), F.col("seq").cast("bigint").alias("id"), F.col("claim_text").alias("text")).unionByName(
        evidence.where(plain).select(F.lit(1).alias("tab"), F.col("evidence_id").cast("bigint").alias("id"), F.col("content").alias("text"))
    )
