"""Queries over backlinks, notes' entities, queues and small text forms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import backlinks, candidates, quality, resolve
from strandline.plans import sql, text_queries
from strandline.plans.graph_queries import QUERIES as _GRAPH
from strandline.plans.graph_queries import SQL as _GRAPH_SQL
from strandline.plans.graph_queries import resolved_sql
from strandline.session import table
from strandline.sources import readers

QUERIES, SQL = {}, {}


def query(statement: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


_MENTIONED = f"({text_queries.SQL['mention_extract']})"


@query(f"SELECT m.mention, state, uid, n, claims, first_seq FROM {_MENTIONED} m JOIN ({resolved_sql(f'(SELECT mention FROM {_MENTIONED})')}) r ON m.mention = r.mention")
def mention_backlinks(spark: SparkSession, sf: str) -> DataFrame:
    """Which entity each mention of the claims names; NEW_ENTITY ones are to be queued."""
    return backlinks.backlinks(text_queries.mentions(table(spark, sf, "atomic_claims")), table(spark, sf, "canonical_nodes")).select("mention", "state", "uid", "n", "claims", "first_seq")


_LINKED = r"list_concat(list_filter(list_transform(regexp_extract_all(text, '(?:^|[^\[])\[([^\]\[]+)\]\([^)]*\)', 1), lambda x: trim(x)), lambda x: x <> ''), list_filter(list_transform(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1), lambda x: trim(x)), lambda x: x <> ''))"
_NAMED = r"list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, '(?im)^[ \t]*references?:[ \t]*([^\n]*)$', 1), lambda x: regexp_split_to_array(x, '[;,]'))), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT DISTINCT doc_id, reference FROM (SELECT doc_id, unnest(list_concat({_LINKED}, {_NAMED})) AS reference FROM documents WHERE text IS NOT NULL)")
def note_references(spark: SparkSession, sf: str) -> DataFrame:
    """What each note refers to, each once."""
    rows = table(spark, sf, "documents").where("text is not null")
    return rows.select("doc_id", F.explode(backlinks.references(F.col("text"), readers.note_parts(F.col("text"))["links"])).alias("reference"))


_KEYS = ("entity", "entity_name", "name", "title", "subject")
_CANDIDATES = (
    "(SELECT doc_id, position, trim(mention) AS mention FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, {i} AS position, {sql.front_value('text', k)} AS mention FROM documents" for i, k in enumerate(_KEYS))
    + f" UNION ALL SELECT doc_id, 10, regexp_extract(text, '(?m)^#\\s+(.*)$', 1) FROM documents UNION ALL SELECT doc_id, 11 + generate_subscripts(l, 1), unnest(l) FROM (SELECT doc_id, {_LINKED} AS l FROM documents WHERE text IS NOT NULL)) WHERE trim(coalesce(mention, '')) <> '')"
)


@query(f"""SELECT c.doc_id, arg_min(uid, position) FILTER (uid IS NOT NULL) AS uid, arg_min(c.mention, position) FILTER (uid IS NOT NULL) AS mention FROM {_CANDIDATES} c
 LEFT JOIN (SELECT mention, uid FROM ({resolved_sql(f'(SELECT DISTINCT mention FROM {_CANDIDATES})')}) WHERE state = 'RESOLVED') r ON c.mention = r.mention GROUP BY c.doc_id""")
def note_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The entity that each note is about: the first of its front matter, heading and links that names one."""
    rows = table(spark, sf, "documents").where("text is not null")
    parts = [F.struct(F.lit(i).alias("position"), text.front_value(F.col("text"), k).alias("mention")) for i, k in enumerate(_KEYS)]
    heading = F.struct(F.lit(10).alias("position"), F.regexp_extract("text", r"(?m)^#\s+(.*)$", 1).alias("mention"))
    links = F.transform(readers.note_parts(F.col("text"))["links"], lambda x, i: F.struct((i + 12).alias("position"), x.alias("mention")))
    candidates = rows.select("doc_id", F.inline(F.concat(F.array(*parts, heading), links))).withColumn("mention", F.trim("mention")).where("coalesce(mention, '') <> ''")
    return backlinks.primary_entities(candidates, table(spark, sf, "canonical_nodes")).select("doc_id", "uid", "mention")


@query(f"SELECT state, count(*) AS n FROM ({_GRAPH_SQL['queue_state_latest']}) GROUP BY state")
def queue_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many queued names are in each state."""
    return _GRAPH["queue_state_latest"](spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT key, ts FROM ({_GRAPH_SQL['queue_state_latest']}) WHERE state = 'PENDING' ORDER BY ts, key LIMIT 1")
def queue_next(spark: SparkSession, sf: str) -> DataFrame:
    """The name that waits longest."""
    return _GRAPH["queue_state_latest"](spark, sf).where("state = 'PENDING'").select("key", "ts").orderBy("ts", "key").limit(1)


_ALL = "(SELECT DISTINCT name FROM (SELECT name FROM rita_entities UNION ALL SELECT entity FROM canonical_nodes UNION ALL SELECT unnest(aliases) FROM canonical_nodes) WHERE name IS NOT NULL)"


@query(f"""SELECT name, array_to_string(list_transform(regexp_extract_all(name, '\\(([^)]+)\\)', 1), lambda x: trim(x)), '|') AS parentheticals,
 array_to_string(list_filter(regexp_extract_all(name, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,10}}')), '|') AS acronyms, nullif(regexp_extract(name, '\\(([A-Z]{{2,10}})\\)\\s*$', 1), '') AS trailing,
 trim(regexp_replace(name, '\\s*\\([A-Z]{{2,10}}\\)\\s*$', '')) AS bare FROM {_ALL}""")
def name_parts(spark: SparkSession, sf: str) -> DataFrame:
    """What stands in parentheses in each name, its acronyms, the last one apart, and the name without that."""
    names = table(spark, sf, "rita_entities").select("name").unionByName(resolve.registered_names(table(spark, sf, "canonical_nodes")).select("name")).where("name is not null").distinct()
    c = F.col("name")
    return names.select("name", F.array_join(backlinks.parentheticals(c), "|").alias("parentheticals"), F.array_join(backlinks.acronyms(c), "|").alias("acronyms"), backlinks.trailing_acronym(c).alias("trailing"), backlinks.without_trailing_acronym(c).alias("bare"))


@query("SELECT snapshot_no, count(*) AS n, count(DISTINCT trim(entity_id)) AS entities, min(delivered_at) AS first_at, max(delivered_at) AS last_at FROM rita_entities GROUP BY snapshot_no")
def snapshot_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Size and deliveries of each snapshot."""
    return table(spark, sf, "rita_entities").groupBy("snapshot_no").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.trim("entity_id")).alias("entities"), F.min("delivered_at").alias("first_at"), F.max("delivered_at").alias("last_at"))


@query(f"SELECT evidence_id, quality, quality NOT IN ('empty', 'block_page', 'error_page') AS passed FROM (SELECT evidence_id, {text_queries._QUALITY_SQL} AS quality FROM evidence)")
def model_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    """Which records a model would be asked about: not empty, block and error pages."""
    rows = table(spark, sf, "evidence").select("evidence_id", quality.extraction_quality(F.col("content")).alias("quality"))
    return rows.withColumn("passed", ~F.col("quality").isin("empty", "block_page", "error_page"))


@query("SELECT lower(trim(claim_text)) AS folded, min(seq) AS seq, arg_min(trim(claim_text), seq) AS claim_text, count(*) AS n FROM atomic_claims WHERE trim(coalesce(claim_text, '')) <> '' GROUP BY 1")
def claim_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Claim texts once each without regard to case, as first written."""
    rows = table(spark, sf, "atomic_claims").where("trim(coalesce(claim_text, '')) <> ''").withColumn("folded", F.lower(F.trim("claim_text")))
    return rows.groupBy("folded").agg(F.min("seq").alias("seq"), F.min_by(F.trim("claim_text"), "seq").alias("claim_text"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT evidence_id, entity_name AS subject, 'describes' AS predicate, substr(x, 1, 200) AS object, substr(x, 1, 500) AS passage FROM (SELECT evidence_id, entity_name, {sql.squeeze('content')} AS x FROM evidence WHERE content IS NOT NULL) WHERE length(x) >= 10 AND trim(coalesce(entity_name, '')) <> ''")
def fallback_claims(spark: SparkSession, sf: str) -> DataFrame:
    """One summary of each record with a text, for when no claim is found in it."""
    rows = table(spark, sf, "evidence").where("content is not null and trim(coalesce(entity_name, '')) <> ''").select("evidence_id", F.col("entity_name").alias("subject"), text.squeeze(F.col("content")).alias("x")).where("length(x) >= 10")
    return rows.select("evidence_id", "subject", F.lit("describes").alias("predicate"), F.substring("x", 1, 200).alias("object"), F.substring("x", 1, 500).alias("passage"))


@query("SELECT predicate || ' → ' || target AS shown, count(*) AS n FROM (SELECT regexp_extract(x, '^(.*?)::\\[\\[(.*)\\]\\]$', 1) AS predicate, regexp_extract(x, '^(.*?)::\\[\\[(.*)\\]\\]$', 2) AS target FROM (SELECT unnest(list_concat(coalesce(relationships, []), coalesce(associations, []))) AS x FROM canonical_nodes) WHERE regexp_matches(x, '^(.*?)::\\[\\[(.*)\\]\\]$')) GROUP BY 1")
def route_arrows(spark: SparkSession, sf: str) -> DataFrame:
    """Links as they are shown to readers."""
    none = F.array().cast("array<string>")
    rows = table(spark, sf, "canonical_nodes").select(F.explode(F.concat(F.coalesce("relationships", none), F.coalesce("associations", none))).alias("x")).where(F.col("x").rlike(r"^(.*?)::\[\[(.*)\]\]$"))
    return rows.groupBy(F.regexp_replace("x", r"^(.*?)::\[\[(.*)\]\]$", "$1 → $2").alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@query()
def fuzzy_top(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest registered entities of each name of the intake."""
    return backlinks.top_fuzzy(_GRAPH["resolve_fuzzy"](spark, sf))


@query()
def candidate_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The registry's candidates of each name of the intake, those whose words have the same initials, and the choice among them."""
    initials = lambda c: text.acronym_of(text.match_form(c))
    asked = table(spark, sf, "rita_entities").where("name is not null").groupBy(F.col("name").alias("requested")).agg(F.max("rita_type").alias("entity_type")).withColumn("k", initials(F.col("requested"))).where("k is not null")
    nodes = table(spark, sf, "canonical_nodes").where("entity is not null").select("uid", F.col("entity").alias("name"), F.col("summary").alias("description"), F.lit(None).cast("string").alias("instance_of"), F.col("country").alias("candidate_country"), initials(F.col("entity")).alias("k"))
    pairs = asked.join(nodes, "k").withColumn("country", F.lit(None).cast("string"))
    return candidates.chosen(candidates.judged(pairs), "uid")
