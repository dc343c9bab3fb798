"""Registry of entities, its indexes, and the resolution of mentions against it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import text


def registry(names: DataFrame, seq: str = "seq") -> DataFrame:
    """(entity_id, canonical_name, key) of distinct names by normal form, numbered in the order of ``seq``.

    Numbers come from counts per bucket of ``seq`` order, so no window runs over all rows at once.
    """
    first = names.withColumn("key", text.match_form(F.col("name"))).where("key <> ''").groupBy("key").agg(F.min(F.struct(seq, "name")).alias("f")).select("key", F.col("f.name").alias("canonical_name"), F.col(f"f.{seq}").alias("seq"))
    bucketed = first.withColumn("bucket", F.floor(F.col("seq") / 4096))
    sizes = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = bucketed.join(before, "bucket").withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy("seq", "key")) + F.coalesce("before", F.lit(0)))
    return numbered.select(F.format_string("ENTITY-%06d", F.col("at").cast("long")).alias("entity_id"), "canonical_name", "key")


def registered_names(nodes: DataFrame) -> DataFrame:
    """(uid, name, kind): the names under which a node is known."""
    own = nodes.where("entity is not null").select("uid", F.col("entity").alias("name"), F.lit("canonical").alias("kind"))
    also = nodes.select("uid", F.explode("aliases").alias("name"), F.lit("alias").alias("kind"))
    return own.unionByName(also).where("name is not null")


def name_index(nodes: DataFrame) -> DataFrame:
    """(key, uid, n_entities): normal forms; more than one entity makes a key ambiguous."""
    keys = registered_names(nodes).select("uid", text.match_form(F.col("name")).alias("key")).where("key <> ''").distinct()
    return keys.groupBy("key").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n_entities"))


def acronym_index(nodes: DataFrame) -> DataFrame:
    """(acronym, uid, n_entities): written acronyms, and those that canonical names give."""
    written = registered_names(nodes).select("uid", text.acronym_in(F.col("name")).alias("acronym"))
    made = nodes.where("entity is not null").select("uid", text.acronym_of(text.match_form(F.col("entity"))).alias("acronym"))
    return written.unionByName(made).where("acronym is not null").distinct().groupBy("acronym").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n_entities"))


def split_form(c: Column) -> Column:
    """A name's normal form without the acronym it spells out."""
    prefix = F.regexp_extract(c, r"(?i)^\s*[A-Za-z]{2,5}\s*\((.+)\)\s*$", 1)
    bare = F.when(prefix != "", prefix).otherwise(F.regexp_replace(c, r"\([^)]*\)", " "))
    return text.match_form(F.regexp_replace(bare, r"\b[A-Z]{2,5}\b", " "))


def resolve(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(mention, state, uid, confidence) of distinct mentions: exact name, then acronym, then split name.

    Mentions are resolved once each, however often they occur; equi-joins alone decide.
    """
    names, acronyms = name_index(nodes), acronym_index(nodes)
    m = mentions.select("mention").distinct().withColumn("key", text.match_form(F.col("mention"))).withColumn("acr", F.coalesce(text.acronym_in(F.col("mention")), F.when(F.col("mention").rlike("^[A-Za-z]{2,5}$"), F.upper("mention")))).withColumn("part", split_form(F.col("mention")))
    m = m.join(names.select("key", F.col("uid").alias("u1"), F.col("n_entities").alias("n1")), "key", "left")
    m = m.join(acronyms.select(F.col("acronym").alias("acr"), F.col("uid").alias("u2"), F.col("n_entities").alias("n2")), "acr", "left")
    m = m.join(names.select(F.col("key").alias("part"), F.col("uid").alias("u3"), F.col("n_entities").alias("n3")), "part", "left")
    rule = F.when(F.coalesce("key", F.lit("")) == "", 0).when(F.col("n1") > 1, 1).when(F.col("n1") == 1, 2).when(F.col("n2") == 1, 3).when(F.col("n2") > 1, 4).when(F.col("n3") == 1, 5).otherwise(6)
    m = m.withColumn("rule", rule)
    state = F.when(F.col("rule").isin(1, 4), "AMBIGUOUS").when(F.col("rule").isin(2, 3, 5), "RESOLVED").otherwise("NEW_ENTITY")
    uid = F.when(F.col("rule") == 2, F.col("u1")).when(F.col("rule") == 3, F.col("u2")).when(F.col("rule") == 5, F.col("u3"))
    confidence = F.when(F.col("rule").isin(1, 2), 1.0).when(F.col("rule") == 3, 0.95).when(F.col("rule").isin(4, 5), 0.9).otherwise(0.0)
    return m.select("mention", state.alias("state"), uid.alias("uid"), confidence.alias("confidence"))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of matching blocks of two strings, in the order given."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def _segments(n: int, threshold: float) -> list[tuple[int, int]]:
    """(place, size) of the even segments of a name of length n, one more than any partner can harm."""
    longest = int(n * (2 - threshold) / threshold + 1e-9)
    parts = min(n, int((1 - threshold) * (n + longest) + 1e-9) + 1)
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _index_keys(b: str, threshold: float) -> list[str]:
    return [f"{len(b)} {k} {b[at : at + size]}" for k, (at, size) in enumerate(_segments(len(b), threshold))]


def _probe_keys(a: str, threshold: float) -> list[str]:
    """The keys of every name that can be so similar to ``a``."""
    n, out = len(a), set()
    for m in range(math.ceil(n * threshold / (2 - threshold) - 1e-9), int(n * (2 - threshold) / threshold + 1e-9) + 1):
        common = math.ceil(threshold * (n + m) / 2 - 1e-9)
        for k, (at, size) in enumerate(_segments(m, threshold)):
            for start in range(max(0, at - (m - common)), min(n - size, at + n - common) + 1):
                out.add(f"{m} {k} {a[start : start + size]}")
    return sorted(out)


def fuzzy(mentions: DataFrame, nodes: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(mention, uid, score): registered names at least so similar to a mention's normal form.

    Every such pair is found: of two names of lengths a and b, at most (1 - threshold) * (a + b)
    characters are outside the matching blocks, and each harms one segment of the registered name at
    most. That is cut into one more, so one lies whole within a block, shifted by no more than the
    characters outside. Names of fewer than four characters are left to ``resolve``.
    """

    def keyed(names: DataFrame, make: Callable[[str, float], list[str]]) -> DataFrame:
        column = names.columns[0]

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    k = [xxhash.xxh64_intdigest(x) - (1 << 63) for x in make(name, threshold)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k, pa.int64())], names=[column, "k"])

        return names.distinct().mapInArrow(each, f"{column} string, k bigint")

    left = mentions.select("mention").distinct().withColumn("a", text.match_form(F.col("mention"))).where("length(a) > 3")
    right = registered_names(nodes).select("uid", text.match_form(F.col("name")).alias("b")).where("length(b) > 3").distinct()
    probes = keyed(left.select("a"), _probe_keys)
    index = keyed(right.select("b"), _index_keys)
    pairs = probes.join(index, "k").select("a", "b")
    la, lb = F.length("a"), F.length("b")
    # the blocks that don't match are at least the edit distance, so no pair of the ratio is lost here
    near = F.levenshtein("a", "b") <= (1 - threshold) * (la + lb) + 1e-9
    pairs = pairs.where(near).distinct().withColumn("score", ratio("a", "b")).where(F.col("score") >= threshold)
    return left.join(pairs, "a").join(right, "b").groupBy("mention", "uid").agg(F.max("score").alias("score"))
