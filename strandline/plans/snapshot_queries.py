"""The query over the intake snapshots, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.snapshots import intake_changes
from strandline.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intake_changes(table(spark, sf_dir, "rita_entities"))
    return found.select(F.col("snapshot_no").cast("int").alias("snapshot_no"), "entity_id", "change_type")


QUERIES = {"p1_found": p1_found}

SQL = {
    "p1_found": r"""
WITH s AS (
  SELECT snapshot_no, regexp_replace(coalesce(entity_id, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS entity_id, delivered_at,
    regexp_replace(coalesce(name, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS f1,
    lower(regexp_replace(coalesce(rita_type, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS f2,
    list_sort(list_transform(coalesce(aliases, []), lambda x: coalesce(x, ''))) AS f3,
    list_sort(list_transform(coalesce(map_entries(metadata), []), lambda e: [e.key, coalesce(e.value, '')])) AS f4,
    list_sort(list_transform(coalesce(source_ids, []), lambda x: coalesce(x, ''))) AS f5,
    coalesce(CAST(source_count AS VARCHAR), '') AS f6,
    lower(regexp_replace(coalesce(ingestion_status, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS f7
  FROM rita_entities),
l AS (SELECT *, row_number() OVER (PARTITION BY snapshot_no, entity_id ORDER BY delivered_at DESC NULLS LAST) AS rn FROM s),
d AS (SELECT * FROM l WHERE rn = 1),
n AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS nxt FROM (SELECT DISTINCT snapshot_no FROM d)),
cur AS (SELECT d.* FROM d JOIN n ON d.snapshot_no = n.nxt),
old AS (SELECT n.nxt AS snapshot_no, d.* EXCLUDE (snapshot_no) FROM d JOIN n ON d.snapshot_no = n.snapshot_no WHERE n.nxt IS NOT NULL)
SELECT coalesce(c.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(c.entity_id, o.entity_id) AS entity_id,
  CASE WHEN o.entity_id IS NULL THEN 'added' WHEN c.entity_id IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM cur c FULL JOIN old o ON c.snapshot_no = o.snapshot_no AND c.entity_id = o.entity_id
WHERE o.entity_id IS NULL OR c.entity_id IS NULL
  OR (c.f1, c.f2, c.f3, c.f4, c.f5, c.f6, c.f7) IS DISTINCT FROM (o.f1, o.f2, o.f3, o.f4, o.f5, o.f6, o.f7)
""",
}
