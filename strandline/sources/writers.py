"""Writers of the exported forms. Each validates first and writes a folder of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import graph


def bundle(nodes: DataFrame, folder: str, overwrite: bool = False) -> None:
    """``csv``, ``json`` and ``notes`` under a folder. Nodes without uid, entity, summary or source stop the export."""
    bad = graph.violations(nodes).limit(5).collect()
    if bad:
        raise ValueError(f"nodes that can't be exported: {[tuple(r) for r in bad]}")
    mode = "overwrite" if overwrite else "errorifexists"
    graph.csv_rows(nodes).write.mode(mode).option("header", True).option("escape", '"').csv(f"{folder}/csv")
    nodes.select(*graph.NODE_COLUMNS).write.mode(mode).option("ignoreNullFields", False).json(f"{folder}/json")
    graph.markdown(nodes).select("note").write.mode(mode).option("lineSep", "\n\n").text(f"{folder}/notes")


def snapshot(entities: DataFrame, path: str) -> None:
    """Intake rows as JSON lines in the order of their ids, so that equal tables give equal files."""
    entities.withColumn("_id", F.col("entity_id").cast("string")).repartitionByRange("_id").sortWithinPartitions("_id").drop("_id").write.mode("overwrite").json(path)
