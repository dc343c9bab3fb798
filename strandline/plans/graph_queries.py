"""Queries over names, claims, nodes and edges, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import dedup, graph, resolve
from strandline.plans import sql
from strandline.seq import first_per_key, numbered, ordered
from strandline.session import table
from strandline.sources import readers
from strandline.streaming import queue

QUERIES, SQL = {}, {}


def query(statement: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


_ALL_NAMES = "(SELECT uid, entity AS name FROM canonical_nodes WHERE entity IS NOT NULL UNION ALL SELECT uid, unnest(aliases) AS name FROM canonical_nodes)"
_INDEX = f"(SELECT key, min(uid) AS uid, count(*) AS n_entities FROM (SELECT DISTINCT uid, {sql.match_form('name')} AS key FROM {_ALL_NAMES} WHERE name IS NOT NULL) WHERE key <> '' GROUP BY key)"
_ACR = f"(SELECT acronym, min(uid) AS uid, count(*) AS n_entities FROM (SELECT uid, {sql.acronym_in('name')} AS acronym FROM {_ALL_NAMES} WHERE name IS NOT NULL UNION SELECT uid, {sql.acronym_of(sql.match_form('entity'))} FROM canonical_nodes WHERE entity IS NOT NULL) WHERE acronym IS NOT NULL GROUP BY acronym)"


@query(f"SELECT * FROM {_INDEX}")
def name_index(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.name_index(table(spark, sf, "canonical_nodes"))


@query(f"SELECT * FROM {_ACR}")
def acronym_index(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.acronym_index(table(spark, sf, "canonical_nodes"))


@query(f"""SELECT format('ENTITY-{{:06d}}', row_number() OVER (ORDER BY seq, key)) AS entity_id, canonical_name, key FROM
 (SELECT key, arg_min(s_name, s_suppkey) AS canonical_name, min(s_suppkey) AS seq FROM (SELECT s_suppkey, s_name, {sql.match_form('s_name')} AS key FROM supplier) WHERE key <> '' GROUP BY key)""")
def registry_build(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.registry(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name")))


_MENTIONS = "(SELECT DISTINCT subject AS mention FROM atomic_claims WHERE subject IS NOT NULL)"


def _split(x: str) -> str:
    prefix = f"regexp_extract({x}, '(?i)^\\s*[A-Za-z]{{2,5}}\\s*\\((.+)\\)\\s*$', 1)"
    bare = f"(CASE WHEN {prefix} <> '' THEN {prefix} ELSE regexp_replace({x}, '\\([^)]*\\)', ' ', 'g') END)"
    return sql.match_form(f"regexp_replace({bare}, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z]{{2,5}}($|[^\\p{{L}}\\p{{N}}_])', ' ', 'g')")


def resolved_sql(mentions: str) -> str:
    """SQL of ``resolve.resolve`` over a relation of distinct ``mention``."""
    return f"""WITH m AS (SELECT mention, {sql.match_form('mention')} AS key, coalesce({sql.acronym_in('mention')}, CASE WHEN regexp_full_match(mention, '[A-Za-z]{{2,5}}') THEN upper(mention) END) AS acr, {_split('mention')} AS part FROM {mentions}),
n AS (SELECT * FROM {_INDEX}), a AS (SELECT * FROM {_ACR}),
j AS (SELECT m.mention, m.key, n1.uid AS u1, n1.n_entities AS c1, a.uid AS u2, a.n_entities AS c2, n3.uid AS u3, n3.n_entities AS c3 FROM m LEFT JOIN n n1 ON m.key = n1.key LEFT JOIN a ON m.acr = a.acronym LEFT JOIN n n3 ON m.part = n3.key),
r AS (SELECT *, CASE WHEN coalesce(key, '') = '' THEN 0 WHEN c1 > 1 THEN 1 WHEN c1 = 1 THEN 2 WHEN c2 = 1 THEN 3 WHEN c2 > 1 THEN 4 WHEN c3 = 1 THEN 5 ELSE 6 END AS rule FROM j)
SELECT mention, CASE WHEN rule IN (1, 4) THEN 'AMBIGUOUS' WHEN rule IN (2, 3, 5) THEN 'RESOLVED' ELSE 'NEW_ENTITY' END AS state, CASE rule WHEN 2 THEN u1 WHEN 3 THEN u2 WHEN 5 THEN u3 END AS uid,
 CAST(CASE WHEN rule IN (1, 2) THEN 1.0 WHEN rule = 3 THEN 0.95 WHEN rule IN (4, 5) THEN 0.9 ELSE 0.0 END AS DOUBLE) AS confidence FROM r"""


@query(resolved_sql(_MENTIONS))
def resolve_cascade(spark: SparkSession, sf: str) -> DataFrame:
    mentions = table(spark, sf, "atomic_claims").where("subject is not null").select(F.col("subject").alias("mention"))
    return resolve.resolve(mentions, table(spark, sf, "canonical_nodes"))


@query()
def resolve_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.fuzzy(table(spark, sf, "rita_entities").where("name is not null").select(F.col("name").alias("mention")), table(spark, sf, "canonical_nodes"))


_CLAIM_KEY = "concat_ws('|', " + ", ".join(f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')" for c in ("subject", "predicate", "object")) + ")"


@query(f"SELECT {_CLAIM_KEY} AS claim_key, arg_max(seq, (coalesce(confidence, -1), coalesce(relevance, '') = 'DIRECT', length(coalesce(evidence_passage, '')), -seq)) AS seq, count(*) AS n_claims FROM atomic_claims GROUP BY 1")
def claim_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.strongest_claims(table(spark, sf, "atomic_claims"))


@query("SELECT subject, seq, 'claim_' || lpad(CAST(row_number() OVER (PARTITION BY subject ORDER BY seq) AS VARCHAR), 6, '0') AS claim_no FROM atomic_claims WHERE coalesce(subject, '') <> ''")
def claim_sequence_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "atomic_claims").where("coalesce(subject, '') <> ''")
    return numbered(rows.select("subject", "seq"), ["subject"], "seq", "n").select("subject", "seq", F.concat(F.lit("claim_"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("claim_no"))


@query("""WITH r AS (SELECT * FROM atomic_claims WHERE coalesce(subject, '') <> '')
SELECT subject, count(*) AS n_claims, count(DISTINCT source_url) AS n_sources, array_to_string(list_sort(list(DISTINCT predicate) FILTER (predicate IS NOT NULL)), ', ') AS predicates, arg_max(coalesce(claim_text, ''), (coalesce(confidence, -1), -seq)) AS summary FROM r GROUP BY subject""")
def node_draft(spark: SparkSession, sf: str) -> DataFrame:
    return graph.node_drafts(table(spark, sf, "atomic_claims").withColumn("claim_text", F.coalesce("claim_text", F.lit(""))))


def _snapshot(n: int) -> str:
    return f"(SELECT trim(entity_id) AS id, list_distinct(flatten(list(coalesce(source_ids, [])))) AS s FROM rita_entities WHERE snapshot_no = {n} GROUP BY 1)"


@query(f"""SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'created' WHEN n.id IS NULL THEN 'kept' WHEN len(list_filter(n.s, lambda x: NOT list_contains(o.s, x))) > 0 THEN 'updated' ELSE 'unchanged' END AS outcome,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(n.s, []), coalesce(o.s, [])))), ',') AS sources FROM {_snapshot(6)} n FULL JOIN {_snapshot(5)} o ON n.id = o.id""")
def node_upsert(spark: SparkSession, sf: str) -> DataFrame:
    def at(n: int) -> DataFrame:
        rows = table(spark, sf, "rita_entities").where(F.col("snapshot_no") == n).select(F.trim("entity_id").alias("id"), F.explode_outer("source_ids").alias("s"))
        return rows.groupBy("id").agg(F.collect_set("s").alias("s"))

    merged = graph.merge_provenance(at(5), at(6), "id", "s")
    return merged.select("id", "outcome", F.array_join(F.array_sort("sources"), ",").alias("sources"))


_EDGES = """(SELECT uid, regexp_extract(e, '^\\s*([^:]+?)\\s*::\\s*\\[\\[', 1) AS predicate, trim(regexp_extract(e, '\\[\\[([^\\]]+)\\]\\]', 1)) AS target FROM
 (SELECT uid, unnest(list_concat(coalesce(relationships, []), coalesce(associations, []))) AS e FROM canonical_nodes))"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "canonical_nodes")
    return graph.parsed_edges(nodes, "relationships").unionByName(graph.parsed_edges(nodes, "associations"))





@query(f"""SELECT e.uid, e.predicate, e.target, CASE WHEN i.n_entities = 1 THEN i.uid END AS target_uid, CASE WHEN i.key IS NULL THEN 'unknown_target' WHEN i.n_entities > 1 THEN 'ambiguous_target' WHEN i.uid = e.uid THEN 'self_edge' ELSE 'accepted' END AS verdict
 FROM {_EDGES} e LEFT JOIN {_INDEX} i ON {sql.match_form('e.target')} = i.key WHERE e.predicate <> '' AND e.target <> ''""")
def edge_insert(spark: SparkSession, sf: str) -> DataFrame:
    return graph.valid_edges(_edges(spark, sf), resolve.name_index(table(spark, sf, "canonical_nodes")))


@query(f"""SELECT source_uid, target_uid, predicate, 'REL-' || left(sha256(source_uid || '|' || target_uid || '|' || predicate || '|' || array_to_string(coalesce(sources, []), ',')), 16) AS edge_id FROM (SELECT DISTINCT e.uid AS source_uid, i.uid AS target_uid, e.predicate
 FROM {_EDGES} e JOIN {_INDEX} i ON {sql.match_form('e.target')} = i.key AND i.n_entities = 1 WHERE e.predicate <> '' AND e.target <> '' AND i.uid <> e.uid) d JOIN (SELECT uid, sources FROM canonical_nodes) s ON s.uid = d.source_uid""")
def edge_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.valid_edges(_edges(spark, sf), resolve.name_index(table(spark, sf, "canonical_nodes"))).where("verdict = 'accepted'")
    rows = rows.select(F.col("uid").alias("source_uid"), "target_uid", "predicate").distinct()
    told = table(spark, sf, "canonical_nodes").select(F.col("uid").alias("source_uid"), "sources")
    return rows.join(told, "source_uid").withColumn("edge_id", graph.edge_id(F.col("source_uid"), F.col("target_uid"), F.col("predicate"), F.col("sources"))).drop("sources")


_LIST = lambda c: f"array_to_string(coalesce({c}, []), '|') AS {c}"


@query("SELECT " + ", ".join(_LIST(c) if c in ("aliases", "relationships", "associations", "sources") else f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in graph.NODE_COLUMNS) + " FROM canonical_nodes")
def export_csv(spark: SparkSession, sf: str) -> DataFrame:
    return graph.csv_rows(table(spark, sf, "canonical_nodes"))


@query("SELECT uid, json_object(" + ", ".join(f"'{c}', {c}" for c in graph.NODE_COLUMNS) + ")::VARCHAR AS json FROM canonical_nodes")
def export_json(spark: SparkSession, sf: str) -> DataFrame:
    return graph.json_rows(table(spark, sf, "canonical_nodes"))


_ITEMS = lambda c: f"array_to_string(list_transform(coalesce({c}, []), lambda x: '  - ' || x), chr(10))"


@query(f"""SELECT uid, '---' || chr(10) || 'uid: ' || uid || chr(10) || 'title: ' || coalesce(entity, '') || chr(10) || 'aliases:' || chr(10) || {_ITEMS('aliases')} || chr(10) || '---' || chr(10) || '# ' || coalesce(entity, '') || chr(10) || chr(10)
 || coalesce(summary, '') || chr(10) || chr(10) || '## Relationships' || chr(10) || {_ITEMS('relationships')} || chr(10) || chr(10) || '## Sources' || chr(10) || {_ITEMS('sources')} || chr(10) AS note FROM canonical_nodes""")
def render_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return graph.markdown(table(spark, sf, "canonical_nodes"))


@query(f"""WITH r AS (SELECT evidence_id AS seq, source AS provider, coalesce(TRY_CAST(metadata['rank'] AS INTEGER), 0) AS rank, {sql.identity('url')} AS url_key FROM evidence),
o AS (SELECT url_key, provider, rank, min(seq) AS seq FROM r WHERE url_key <> '' GROUP BY ALL)
SELECT url_key, arg_min(provider, seq) AS first_provider, string_agg(concat_ws(':', provider, CAST(rank AS VARCHAR)), ',' ORDER BY seq, provider) AS providers, min(rank) AS best_rank FROM o GROUP BY url_key""")
def search_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "evidence").select(F.col("evidence_id").alias("seq"), F.col("source").alias("provider"), F.coalesce(F.try_element_at("metadata", F.lit("rank")).try_cast("int"), F.lit(0)).alias("rank"), "url")
    return dedup.search_merge(rows)


@query("SELECT evidence_id, source, query, row_number() OVER (PARTITION BY source, query ORDER BY evidence_id) AS rank FROM evidence")
def provider_rank(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(table(spark, sf, "evidence").select("evidence_id", "source", "query"), ["source", "query"], "evidence_id", "rank")


@query("""WITH v AS (SELECT uid, entity AS q, 1.0 AS w, 1 AS o FROM canonical_nodes UNION ALL SELECT uid, entity || ' ' || country, 0.8, 2 FROM canonical_nodes UNION ALL SELECT uid, entity || ' ' || sector, 0.7, 3 FROM canonical_nodes
 UNION ALL SELECT uid, a, 0.6, 4 FROM (SELECT uid, unnest(aliases) AS a FROM canonical_nodes) UNION ALL SELECT uid, entity || ' official website', 0.5, 5 FROM canonical_nodes),
d AS (SELECT uid, trim(q) AS q, w, o FROM v WHERE trim(coalesce(q, '')) <> '' QUALIFY row_number() OVER (PARTITION BY uid, lower(trim(q)) ORDER BY o, trim(q)) = 1)
SELECT uid, q AS variation, CAST(w AS DOUBLE) AS weight, row_number() OVER (PARTITION BY uid ORDER BY w DESC, o, q) AS position FROM d QUALIFY position <= 8""")
def query_variations(spark: SparkSession, sf: str) -> DataFrame:
    """Search phrases for each node, weighed; at most eight, without repeats."""
    nodes = table(spark, sf, "canonical_nodes")
    with_word = lambda c: F.array(F.concat("entity", F.lit(" "), c))
    made = [(F.array("entity"), 1.0), (with_word(F.col("country")), 0.8), (with_word(F.col("sector")), 0.7), (F.col("aliases"), 0.6), (with_word(F.lit("official website")), 0.5)]

    def weighed(names, weight: float, origin: int):
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda q: F.struct(F.trim(q).alias("q"), F.lit(weight).alias("w"), F.lit(origin).alias("o")))

    each = F.flatten(F.array(*[weighed(names, w, o) for o, (names, w) in enumerate(made, 1)]))
    rows = nodes.select("uid", F.explode(each).alias("v")).select("uid", "v.*").where("coalesce(q, '') <> ''")
    rows = first_per_key(rows.withColumn("low", F.lower("q")), ["uid", "low"], F.col("o"), F.col("q"))
    at = Window.partitionBy("uid").orderBy(F.desc("w"), "o", "q")
    return rows.withColumn("position", F.row_number().over(at).cast("bigint")).where("position <= 8").select("uid", F.col("q").alias("variation"), F.col("w").alias("weight"), "position")


@query("SELECT entity_id, evidence_id, position FROM (SELECT entity_id, evidence_id, row_number() OVER (PARTITION BY entity_id ORDER BY normalized_length DESC NULLS LAST, evidence_id) AS position FROM evidence WHERE entity_id IS NOT NULL) WHERE position <= 3")
def rank_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The three longest records of each entity; a top-k report."""
    rows = table(spark, sf, "evidence").where("entity_id is not null")
    at = Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("normalized_length"), "evidence_id")
    return rows.select("entity_id", "evidence_id", F.row_number().over(at).cast("bigint").alias("position")).where("position <= 3")


@query("SELECT source, count(*) AS n, count(*) FILTER (evidence_status = 'usable') AS usable, count(DISTINCT entity_id) AS entities, CAST(sum(raw_length - normalized_length) AS BIGINT) AS dropped_chars FROM evidence GROUP BY source")
def stage_accounting(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "evidence")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("evidence_status") == "usable", 1)).alias("usable"), F.countDistinct("entity_id").alias("entities"), F.sum(F.col("raw_length") - F.col("normalized_length")).alias("dropped_chars"))


@query(f"SELECT name AS queued, min(id) AS first_id FROM (SELECT trim(entity_id) AS id, name, {sql.match_form('name')} AS key FROM rita_entities) r WHERE key <> '' AND NOT EXISTS (SELECT 1 FROM {_INDEX} i WHERE i.key = r.key) GROUP BY name")
def queue_new_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names that the registry doesn't have, for discovery."""
    rows = table(spark, sf, "rita_entities").select(F.trim("entity_id").alias("id"), "name", text.match_form(F.col("name")).alias("key")).where("key <> ''")
    new = rows.join(resolve.name_index(table(spark, sf, "canonical_nodes")).select("key"), "key", "left_anti")
    return new.groupBy(F.col("name").alias("queued")).agg(F.min("id").alias("first_id"))


#: States of a queue that the events' types stand for.
_STATE_OF = dict(zip(("view", "click", "signup", "purchase", "error"), ("PENDING", "PROCESSING", "COMPLETED", "SKIPPED", "ERROR")))


@query("WITH s AS (SELECT user_id AS key, ts, CASE event_type " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in _STATE_OF.items()) + f" END AS state FROM events) SELECT key, arg_max(state, (ts, list_position({list(queue.STATES)}, state))) AS state, max(ts) AS ts FROM s GROUP BY key")
def queue_state_latest(spark: SparkSession, sf: str) -> DataFrame:
    known = F.create_map(*[F.lit(x) for pair in _STATE_OF.items() for x in pair])
    return queue.last_states(table(spark, sf, "events").select(F.col("user_id").alias("key"), known[F.col("event_type")].alias("state"), "ts"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(len(json_keys(props)) AS INTEGER) AS n_keys FROM events")
def intake_map_cell(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", readers.map_cell(F.col("props")).alias("cell"))
    return rows.select("event_id", F.try_element_at("cell", F.lit("k")).try_cast("bigint").alias("k"), F.size("cell").alias("n_keys"))


@query("SELECT trim(entity_id) AS id, snapshot_no, len(coalesce(source_ids, [])) AS n_sources, len(coalesce(source_ids, [])) IS DISTINCT FROM source_count AS corrected, coalesce(TRY_CAST(replace(replace(extracted_at, 'T', ' '), 'Z', '') AS TIMESTAMP), NULL) AS extracted FROM rita_entities")
def intake_cast(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "rita_entities")
    n = F.coalesce(F.size("source_ids"), F.lit(0)).cast("bigint")
    n = F.when(F.col("source_ids").isNull(), F.lit(0).cast("bigint")).otherwise(n)
    return rows.select(F.trim("entity_id").alias("id"), "snapshot_no", n.alias("n_sources"), (~n.eqNullSafe(F.col("source_count").cast("bigint"))).alias("corrected"), F.regexp_replace(F.regexp_replace("extracted_at", "T", " "), "Z", "").try_cast("timestamp_ntz").alias("extracted"))


@query("SELECT url FROM evidence EXCEPT SELECT url FROM crawl_results")
def uncrawled_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence").select("url").subtract(table(spark, sf, "crawl_results").select("url"))


@query("SELECT uid, string_agg(source, '|' ORDER BY source) AS sources, count(*) AS n FROM (SELECT DISTINCT uid, source FROM documents WHERE uid IS NOT NULL) GROUP BY uid")
def sources_of_nodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("uid is not null").select("uid", "source").distinct()
    return rows.groupBy("uid").agg(F.array_join(ordered(F.col("source"), F.col("source")), "|").alias("sources"), F.count(F.lit(1)).alias("n"))


@query("SELECT c.entity_id, c.entity_name, CAST(contains(lower(e.content), lower(c.entity_name)) AS BOOLEAN) AS named, e.evidence_id FROM evidence e JOIN (SELECT evidence_id, entity_id, entity_name FROM evidence WHERE coalesce(entity_name, '') <> '') c USING (evidence_id) WHERE e.content IS NOT NULL")
def entity_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a record's text names the entity that it was searched for."""
    rows = table(spark, sf, "evidence").where("coalesce(entity_name, '') <> '' and content is not null")
    return rows.select("entity_id", "entity_name", F.contains(F.lower("content"), F.lower("entity_name")).alias("named"), "evidence_id")
