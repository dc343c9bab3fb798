"""Texts of varying length in containers of fixed capacity.

Sum-of-squares packing: containers in use are counted by their fill level, and each item goes to the
level that leaves the least sum of squared counts. The documents are cut into shards of bounded size
that are packed side by side, after pieces that fill a container by themselves; what each shard leaves partly filled is packed once more, as items, with
that of other shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.tokens import with_tokens
from strandline.session import new_folder, written

#: Items of a shard, about, and shards whose leftovers are packed together.
SHARD, TOGETHER = 20_000, 64
#: Kinds of containers that one literal list names.
KINDS_AT_ONCE = 200


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, fill level of each container). Sizes lie between 1 and ``capacity``.

    N[h] counts the containers with fill level h; moving one from h to h + s changes the sum of
    squares by 2 (N[h + s] - N[h]) + 2, a new container by 2 N[s] + 1, a filled one by 1 - 2 N[h].
    Ties go to the fullest level.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    container = np.empty(len(sizes), np.int64)
    levels: list[int] = []
    for i, s in enumerate(sizes.tolist()):
        if s == capacity:
            container[i] = len(levels)
            levels.append(s)
            continue
        # levels 1 .. capacity - s can take the item; the last of them is filled by it
        room = counts[1 : capacity - s + 1]
        change = 2 * (counts[1 + s : capacity + 1] - room) + 2
        change[-1] -= 2 * counts[capacity] + 1
        change[room == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(change[::-1].argmin())
        if change[best] <= 2 * counts[s] + 1:
            h = best + 1
            at = open_at[h].pop()
            counts[h] -= 1
        else:
            h, at = 0, len(levels)
            levels.append(0)
        container[i], levels[at] = at, h + s
        if h + s < capacity:
            open_at[h + s].append(at)
            counts[h + s] += 1
    return container, np.array(levels, np.int64)


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    """Packs one group: columns limit (capacity with one separator), size (with one separator) and order."""
    frame = frame.sort_values(["order", "item", "piece"], kind="stable")
    container, levels = sum_of_squares(frame["size"].to_numpy(), int(frame["limit"].iloc[0]))
    return frame.assign(bin=container, level=levels[container])


def packed(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_id, container_id, slot, doc_id, piece_no, token_start, tokens): where each text goes.

    ``documents`` has doc_id and text, ``limits`` pack_id, capacity_tokens and separator_tokens. A text
    that exceeds a container is cut into pieces of the capacity, the last one shorter; nothing else is
    cut. Between two items of a container its separators fit, too. Null, empty and blank texts have no
    tokens and are not packed; repeated rows are packed as often as they occur. Limits that are null or
    below one token take nothing.
    """
    spark = documents.sparkSession
    folder = new_folder(spark, "packing")
    sizes = written(with_tokens(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).where("tokens > 0"), folder, "sizes")
    # tells repeated rows apart; it only has to be unique
    sizes = sizes.withColumn("item", F.monotonically_increasing_id())
    shards = max(1, round(sizes.count() / SHARD))
    kinds = limits.where("capacity_tokens >= 1 and pack_id is not null").select(F.col("pack_id").cast("bigint").alias("pack_id"), F.col("capacity_tokens").cast("bigint").alias("capacity"), F.coalesce(F.col("separator_tokens"), F.lit(0)).cast("bigint").alias("separator"))
    kinds = [tuple(k) for k in kinds.collect()]  # one row per kind of container
    each = sizes.where("false").select("doc_id", "tokens", "item", *[F.lit(0).cast("bigint").alias(c) for c in ("pack_id", "capacity", "separator")])
    for at in range(0, len(kinds), KINDS_AT_ONCE):
        some = F.array(*[F.struct(*[F.lit(x).cast("bigint").alias(c) for c, x in zip(("pack_id", "capacity", "separator"), k)]) for k in kinds[at : at + KINDS_AT_ONCE]])
        each = each.unionByName(sizes.select("doc_id", "tokens", "item", F.inline(some)))
    each = each.withColumn("pack_id", F.col("pack_id").cast("int")).withColumn("whole", F.floor(F.col("tokens") / F.col("capacity")))
    # pieces that fill a container need no packing
    full = each.where("whole > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)))
    full = full.select("pack_id", "doc_id", (F.col("piece") + 1).cast("int").alias("piece_no"), (F.col("piece") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("tokens"))
    full = written(full, folder, "full").select("pack_id", (F.lit(-1) - F.monotonically_increasing_id()).alias("container_id"), F.lit(1).alias("slot"), "doc_id", "piece_no", "token_start", "tokens")
    pieces = (
        each.withColumn("held", F.col("tokens") - F.col("whole") * F.col("capacity")).where("held > 0")
        .select(
            "pack_id", "doc_id", "item", F.col("whole").cast("int").alias("piece"), (F.col("whole") * F.col("capacity")).alias("token_start"), "held", "separator", (F.col("capacity") + F.col("separator")).alias("limit"),
            F.xxhash64("doc_id", "item").alias("order"), (F.col("held") + F.col("separator")).alias("size"), F.pmod(F.xxhash64("item", F.lit(7)), F.lit(shards)).cast("int").alias("shard"),
        )
    )
    kept = "pack_id int, shard int, bin bigint, level bigint, limit bigint, order bigint, doc_id bigint, piece int, token_start bigint, held bigint"
    names = [x.split()[0] for x in kept.split(", ")]
    first = written(pieces.groupBy("pack_id", "shard").applyInPandas(lambda f: _pack(f)[names], kept), folder, "first")
    # what is partly filled after the shards is an item of the second round
    left = first.where("level < limit").select("pack_id", "shard", "bin", F.col("level").alias("size"), "limit").distinct()
    again = "pack_id int, shard int, bin bigint, container bigint"

    def repack(frame: pd.DataFrame) -> pd.DataFrame:
        lead = int(frame["shard"].min())
        out = _pack(frame.assign(order=-frame["size"], item=frame["shard"], piece=frame["bin"]).rename(columns={"bin": "own"}))
        return pd.DataFrame({"pack_id": out["pack_id"], "shard": out["shard"], "bin": out["own"], "container": (lead << 33) + (1 << 32) + out["bin"]})

    second = left.withColumn("together", (F.col("shard") / TOGETHER).cast("int")).groupBy("pack_id", "together").applyInPandas(lambda f: repack(f.drop(columns=["together"])), again) if shards > 1 else None
    if second is not None:
        first = first.join(second, ["pack_id", "shard", "bin"], "left")
    else:
        first = first.withColumn("container", F.lit(None).cast("bigint"))
    own = F.col("shard").cast("bigint") * F.lit(1 << 33) + F.col("bin")
    placed = first.withColumn("container_id", F.coalesce("container", own))
    order = Window.partitionBy("pack_id", "container_id").orderBy("shard", "bin", "order", "doc_id", "piece")
    return placed.select("pack_id", "container_id", F.row_number().over(order).alias("slot"), "doc_id", (F.col("piece") + 1).alias("piece_no"), "token_start", F.col("held").alias("tokens")).unionByName(full)
