"""Queries over evidence texts, claims and model answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import text, urls
from strandline.operators import resolve
from strandline.plans import sql
from strandline.seq import first_per_key, ordered
from strandline.session import table

QUERIES, SQL = {}, {}


def query(statement: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


@query(r"SELECT DISTINCT subject, array_to_string(list_transform(regexp_extract_all(subject, '\p{L}[\p{L}\p{M}]*|\P{L}+'), lambda x: upper(x[1:1]) || lower(x[2:])), '') AS titled FROM atomic_claims WHERE subject IS NOT NULL")
def title_targets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "atomic_claims").where("subject is not null").select("subject").distinct()
    return rows.select("subject", text.title_case(F.col("subject")).alias("titled"))


@query("""SELECT evidence_id, i AS chunk_index, n + 1 AS total_chunks, length(substring(content, i * 900 + 1, 1000)) AS n_chars, sha256(substring(content, i * 900 + 1, 1000)) AS digest FROM
 (SELECT evidence_id, content, n, unnest(generate_series(0, n)) AS i FROM (SELECT evidence_id, content, CAST(CASE WHEN length(content) <= 1000 THEN 0 ELSE ceil((length(content) - 1000) / 900.0) END AS BIGINT) AS n FROM evidence WHERE trim(coalesce(content, '')) <> '' AND coalesce(evidence_status, '') <> 'unusable'))""")
def evidence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Usable records in overlapping chunks, with their number."""
    rows = table(spark, sf, "evidence").where("trim(coalesce(content, '')) <> '' and coalesce(evidence_status, '') <> 'unusable'").withColumn("c", text.chunks(F.col("content"), 1000, 100))
    rows = rows.select("evidence_id", F.size("c").cast("bigint").alias("total_chunks"), F.explode("c").alias("c"))
    return rows.select("evidence_id", F.col("c.chunk_index").cast("bigint").alias("chunk_index"), "total_chunks", F.length("c.chunk").cast("bigint").alias("n_chars"), F.sha2("c.chunk", 256).alias("digest"))


_WINDOWS = "list_concat(list_filter(string_split(k, ' '), lambda w: length(w) > 3), [string_split(k, ' ')[i] || ' ' || string_split(k, ' ')[i + 1] for i in generate_series(1, greatest(len(string_split(k, ' ')) - 1, 0))])"


@query(f"SELECT evidence_id, contains(t, k) AS whole, len(list_filter({_WINDOWS}, lambda w: contains(t, w))) AS windows FROM (SELECT evidence_id, {sql.match_form('entity_name')} AS k, lower(strip_accents(content)) AS t FROM evidence WHERE content IS NOT NULL) WHERE k <> ''")
def name_windows(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the entity's name a record holds: the whole of it, and its words and pairs of words."""
    rows = table(spark, sf, "evidence").where("content is not null").select("evidence_id", text.match_form(F.col("entity_name")).alias("k"), F.lower(text.unaccented(F.col("content"))).alias("t")).where("k <> ''")
    words = F.split("k", " ")
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    windows = F.concat(F.filter(words, lambda w: F.length(w) > 3), pairs)
    return rows.select("evidence_id", F.contains("t", "k").alias("whole"), F.size(F.filter(windows, lambda w: F.contains(F.col("t"), w))).cast("bigint").alias("windows"))


_GATE = ["CASE WHEN coalesce(trim(subject), '') = '' THEN 'subject' END", "CASE WHEN coalesce(trim(predicate), '') = '' THEN 'predicate' END", "CASE WHEN coalesce(trim(object), '') = '' THEN 'object' END", "CASE WHEN coalesce(trim(evidence_passage), '') = '' THEN 'passage' END",
         "CASE WHEN length(evidence_passage) > 1000 THEN 'long_passage' END", "CASE WHEN coalesce(trim(source_url), '') = '' THEN 'url' END", "CASE WHEN length(trim(object)) = 1 THEN 'single_letter' END", "CASE WHEN regexp_matches(claim_text, '^\\p{Ll}') THEN 'fragment' END"]


@query("""WITH r AS (SELECT subject, claim_text, row_number() OVER (PARTITION BY subject ORDER BY coalesce(confidence, 0) DESC, length(claim_text) DESC, seq) AS k FROM atomic_claims WHERE coalesce(subject, '') <> '' AND claim_text IS NOT NULL)
SELECT subject, string_agg(claim_text, '. ' ORDER BY k) AS summary FROM r WHERE k <= 3 GROUP BY subject""")
def summary_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The three best claims of each subject as its summary; a top-k report."""
    rows = table(spark, sf, "atomic_claims").where("coalesce(subject, '') <> '' and claim_text is not null")
    at = Window.partitionBy("subject").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), F.desc(F.length("claim_text")), "seq")
    top = rows.select("subject", "claim_text", F.row_number().over(at).alias("k")).where("k <= 3")
    return top.groupBy("subject").agg(F.array_join(ordered(F.col("claim_text"), F.col("k")), ". ").alias("summary"))


@query("SELECT entity_id, name, snapshot_no FROM (SELECT *, row_number() OVER (PARTITION BY lower(coalesce(nullif(trim(entity_id), ''), name)) ORDER BY snapshot_no, delivered_at, name) AS k FROM rita_entities) WHERE k = 1")
def batch_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Each entity of a batch once, the first delivered; keyed by id, or by name where there is none."""
    rows = table(spark, sf, "rita_entities").withColumn("k", F.lower(F.coalesce(text.nonempty(F.trim("entity_id")), F.col("name"))))
    return first_per_key(rows, ["k"], F.col("snapshot_no"), F.col("delivered_at"), F.col("name")).select("entity_id", "name", "snapshot_no")


@query("SELECT seq, position AS found_at, substring(evidence_passage, greatest(position - 80, 1), length(object) + 160) AS context FROM (SELECT seq, evidence_passage, object, strpos(evidence_passage, object) AS position FROM atomic_claims WHERE coalesce(object, '') <> '' AND evidence_passage IS NOT NULL) WHERE position > 0")
def mention_context(spark: SparkSession, sf: str) -> DataFrame:
    """Where a passage first holds its claim's object, and the text around."""
    rows = table(spark, sf, "atomic_claims").where("coalesce(object, '') <> '' and evidence_passage is not null").withColumn("at", F.position("object", "evidence_passage")).where("at > 0")
    return rows.select("seq", F.col("at").cast("bigint").alias("found_at"), F.substr("evidence_passage", F.greatest(F.col("at") - 80, F.lit(1)), F.length("object") + 160).alias("context"))


@query("SELECT crawl_id, array_to_string(list_sort(list_transform(map_entries(metadata), lambda e: e.key || '=' || CASE WHEN regexp_matches(lower(e.key), 'token|password|secret|authorization|credential|api_key|provider') THEN '[REDACTED]' ELSE e.value END)), ',') AS shown FROM crawl_results WHERE metadata IS NOT NULL")
def redact_map(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata without the values of secret keys (``provider`` stands for one here)."""
    hidden = F.transform_values("metadata", lambda k, v: F.when(F.lower(k).rlike("token|password|secret|authorization|credential|api_key|provider"), "[REDACTED]").otherwise(v))
    rows = table(spark, sf, "crawl_results").where("metadata is not null")
    return rows.select("crawl_id", F.array_join(F.array_sort(F.transform(F.map_entries(hidden), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("shown"))


_ALLOWED = ("page", "q", "id")


@query(f"""SELECT evidence_id, {sql.url_part('original_url', 1)} || '://' || {sql.url_part('original_url', 2)} || {sql.url_part('original_url', 3)} || CASE WHEN {sql.url_part('original_url', 4)} = '' THEN '' ELSE '?' || array_to_string(list_transform(list_filter(string_split({sql.url_part('original_url', 4)}, '&'), lambda p: p <> ''),
 lambda p: CASE WHEN lower(split_part(p, '=', 1)) IN {_ALLOWED} OR NOT contains(p, '=') THEN p ELSE split_part(p, '=', 1) || '=<redacted>' END), '&') END AS logged FROM evidence WHERE original_url IS NOT NULL""")
def log_url(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses for logs: only the values of known harmless parameters are shown."""
    rows, u = table(spark, sf, "evidence").where("original_url is not null"), F.col("original_url")
    shown = F.array_join(F.transform(F.filter(F.split(urls.part(u, 4), "&"), lambda p: p != ""), lambda p: F.when(F.lower(F.substring_index(p, "=", 1)).isin(*_ALLOWED) | ~p.contains("="), p).otherwise(F.concat(F.substring_index(p, "=", 1), F.lit("=<redacted>")))), "&")
    base = F.concat(urls.part(u, 1), F.lit("://"), urls.part(u, 2), urls.part(u, 3))
    return rows.select("evidence_id", F.when(urls.part(u, 4) == "", base).otherwise(F.concat(base, F.lit("?"), shown)).alias("logged"))


@query("SELECT seq, CASE seq % 3 WHEN 0 THEN claim_text WHEN 1 THEN claim_text || chr(10) || predicate ELSE object END AS content FROM atomic_claims")
def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The text of model answers that come as a string, a list of blocks or an object."""
    rows = table(spark, sf, "atomic_claims")
    block = lambda c: F.struct(F.lit("text").alias("type"), F.col(c).alias("text"))
    third = F.col("seq") % 3
    raw = F.when(third == 0, F.to_json(F.struct(F.col("claim_text").alias("content")))).when(third == 1, F.to_json(F.struct(F.array(block("claim_text"), block("predicate")).alias("content")))).otherwise(F.to_json(F.struct(F.struct(F.col("object").alias("text")).alias("content"))))
    body = F.get_json_object(raw, "$.content")
    blocks = F.from_json(body, "array<struct<type:string,text:string>>")
    answer = F.when(body.startswith("["), F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")).when(body.startswith("{"), F.get_json_object(body, "$.text")).otherwise(body)
    return rows.select("seq", answer.alias("content"))


@query(f"SELECT evidence_id, k AS shown_at FROM (SELECT evidence_id, row_number() OVER (ORDER BY score DESC, evidence_id) AS k, score FROM (SELECT evidence_id, coalesce(TRY_CAST(metadata['rank'] AS INTEGER), 0) * -1.0 AS score, relevance FROM (SELECT *, CASE WHEN evidence_status = 'usable' THEN 'high' ELSE 'low' END AS relevance FROM evidence)) WHERE relevance = 'high') WHERE k <= 25")
def ranked_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 best usable records by rank; a top-k report (a bounded heap, not a sort of all rows)."""
    rows = table(spark, sf, "evidence").where("evidence_status = 'usable'").select("evidence_id", F.coalesce(F.try_element_at("metadata", F.lit("rank")).try_cast("int"), F.lit(0)).alias("rank"))
    top = rows.orderBy("rank", "evidence_id").limit(25)
    return top.select("evidence_id", F.row_number().over(Window.orderBy("rank", "evidence_id")).cast("bigint").alias("shown_at"))


_LIST_TEXT = "coalesce(entity, '') || '; ' || array_to_string(coalesce(aliases, []), ', ') || '; ' || coalesce(country, '')"


@query(f"""WITH p AS (SELECT uid, trim(unnest(regexp_split_to_array({_LIST_TEXT}, '[;,]'))) AS item FROM canonical_nodes),
k AS (SELECT DISTINCT uid, item, {sql.match_form('item')} AS key FROM p WHERE item <> ''),
i AS (SELECT key, min(u) AS u, count(*) AS n FROM (SELECT DISTINCT uid AS u, {sql.match_form('name')} AS key FROM (SELECT uid, entity AS name FROM canonical_nodes UNION ALL SELECT uid, unnest(aliases) FROM canonical_nodes) WHERE name IS NOT NULL) WHERE key <> '' GROUP BY key),
l AS (SELECT k.uid, CASE WHEN i.n = 1 THEN '[[' || c.entity || ']]' ELSE k.item END AS shown FROM k LEFT JOIN i ON k.key = i.key AND k.key <> '' LEFT JOIN canonical_nodes c ON i.u = c.uid)
SELECT uid, string_agg(shown, ', ' ORDER BY shown) AS backlinked FROM (SELECT DISTINCT uid, shown FROM l WHERE shown IS NOT NULL) GROUP BY uid""")
def backlink_list(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of names with the names that are one entity's turned into links to it, each once."""
    nodes = table(spark, sf, "canonical_nodes")
    whole = F.concat(F.coalesce("entity", F.lit("")), F.lit("; "), F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), ", "), F.lit("; "), F.coalesce("country", F.lit("")))
    items = nodes.select("uid", F.explode(F.split(whole, "[;,]")).alias("item")).select("uid", F.trim("item").alias("item")).where("item <> ''").withColumn("key", text.match_form(F.col("item")))
    index = resolve.name_index(nodes).where("n_entities = 1").select("key", F.col("uid").alias("u")).join(nodes.select(F.col("uid").alias("u"), F.col("entity").alias("canonical")), "u")
    shown = items.join(index.select("key", "canonical"), "key", "left").select("uid", F.when(F.col("canonical").isNotNull(), F.concat(F.lit("[["), "canonical", F.lit("]]"))).otherwise(F.col("item")).alias("shown")).distinct()
    return shown.groupBy("uid").agg(F.array_join(F.array_sort(F.collect_list("shown")), ", ").alias("backlinked"))
