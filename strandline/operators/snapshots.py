"""What changed between consecutive full snapshots of a keyed table.

``EXCEPT ALL`` in both directions removes the rows that are equal in two consecutive snapshots; only
the residues are joined in full by key, and the side that is missing labels the change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of any script, as it surrounds typed values.
BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def clean(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c.cast("string"), BLANKS, ""), F.lit(""))


def canonical(df: DataFrame, name: str, fold_case: bool = False) -> Column:
    """One string for all values of a column that count as the same.

    Text loses blanks around it (and case if asked), arrays and maps lose their order, null equals
    empty. Elements are length-prefixed, so no two different arrays or maps give one string.
    """
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    marked = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    if isinstance(kind, T.ArrayType):
        parts = F.array_sort(F.transform(c, lambda x: marked(text(x))))
        return F.coalesce(F.array_join(parts, ""), F.lit(""))
    if isinstance(kind, T.MapType):
        parts = F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(marked(text(e["key"])), marked(text(e["value"])))))
        return F.coalesce(F.array_join(parts, ""), F.lit(""))
    if isinstance(kind, T.StringType):
        return F.lower(clean(c)) if fold_case else clean(c)
    return text(c)


def latest_states(df: DataFrame, key: str, snapshot: str, version: str, fields: Sequence[str], folded: Sequence[str] = ()) -> DataFrame:
    """One row per snapshot and key: its state as the last delivered row has it.

    Of rows of one key with the same last ``version`` the greatest state counts, so that the result
    does not depend on row order; a null version is older than any. Blank and null keys are one key
    ``''``; rows whose snapshot is null belong to no snapshot and are left out.
    """
    state = F.sha2(F.to_json(F.struct(*[canonical(df, f, f in folded).alias(f"f{i}") for i, f in enumerate(fields)])), 256)
    rows = df.where(F.col(snapshot).isNotNull()).select(
        F.col(snapshot).alias("_snap"),
        clean(F.col(key)).alias("_key"),
        F.struct(F.col(version).isNotNull().alias("known"), F.col(version).alias("at"), state.alias("state")).alias("_last"),
    )
    return rows.groupBy("_snap", "_key").agg(F.max("_last").alias("_last")).select("_snap", "_key", F.col("_last.state").alias("_state"))


def snapshot_changes(df: DataFrame, key: str, snapshot: str, version: str, fields: Sequence[str], folded: Sequence[str] = ()) -> DataFrame:
    """(snapshot, key, change_type): ``added``, ``removed`` or ``changed`` against the snapshot before.

    Consecutive are the snapshot numbers that occur, in order; the first has nothing before it. An
    empty table and a single snapshot give no rows. Columns of ``df`` outside the arguments, also such
    as are named like the result's, play no part.
    """
    states = latest_states(df, key, snapshot, version, fields, folded)
    numbers = df.where(F.col(snapshot).isNotNull()).groupBy(F.col(snapshot).alias("_snap")).agg(F.lit(1).alias("_one"))
    # One row per snapshot of the table: a handful of numbers, so the unpartitioned order is harmless.
    steps = numbers.groupBy().agg(F.array_sort(F.collect_list("_snap")).alias("_all")).select(
        F.explode(F.arrays_zip(F.slice("_all", 1, F.greatest(F.size("_all") - 1, F.lit(0))).alias("before"), F.slice("_all", 2, F.size("_all")).alias("now"))).alias("_step")
    )
    now = states.join(F.broadcast(steps.select(F.col("_step.now").alias("_snap"))), "_snap", "left_semi")
    before = states.join(F.broadcast(steps.select(F.col("_step.before").alias("_snap"), F.col("_step.now").alias("_next"))), "_snap").select(F.col("_next").alias("_snap"), "_key", "_state")
    left = now.exceptAll(before).alias("n")
    right = before.exceptAll(now).alias("b")
    both = left.join(right, (F.col("n._snap") == F.col("b._snap")) & (F.col("n._key") == F.col("b._key")), "full")
    kind = F.when(F.col("b._key").isNull(), "added").when(F.col("n._key").isNull(), "removed").otherwise("changed")
    return both.select(F.coalesce("n._snap", "b._snap").alias(snapshot), F.coalesce("n._key", "b._key").alias(key), kind.alias("change_type"))


#: Fields of an intake entity whose change counts, and those whose letter case does not.
INTAKE_FIELDS = ("name", "rita_type", "aliases", "metadata", "source_ids", "source_count", "ingestion_status")
INTAKE_FOLDED = ("rita_type", "ingestion_status")


def intake_changes(entities: DataFrame) -> DataFrame:
    return snapshot_changes(entities, "entity_id", "snapshot_no", "delivered_at", INTAKE_FIELDS, INTAKE_FOLDED)
