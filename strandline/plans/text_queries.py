"""Queries over addresses, texts, pages and notes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text, urls
from strandline.operators import dedup, quality
from strandline.plans import sql
from strandline.seq import first_per_key, ordered
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


@query(f"SELECT evidence_id, {sql.identity('url')} AS url_a, {sql.identity('original_url')} AS original_a FROM evidence")
def url_identity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence").select("evidence_id", urls.identity(F.col("url")).alias("url_a"), urls.identity(F.col("original_url")).alias("original_a"))


@query(f"SELECT crawl_id, {sql.fetchable('final_url')} AS url_b, {sql.host('final_url')} AS host FROM crawl_results")
def url_fetch(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "crawl_results").select("crawl_id", urls.fetchable(F.col("final_url")).alias("url_b"), urls.host(F.col("final_url")).alias("host"))


@query(f"SELECT url_b, min(crawl_id) AS crawl_id, count(*) AS n FROM (SELECT crawl_id, {sql.fetchable('url')} AS url_b FROM crawl_results) WHERE url_b <> '' GROUP BY url_b")
def url_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "crawl_results").select("crawl_id", urls.fetchable(F.col("url")).alias("url_b")).where("url_b <> ''")
    return rows.groupBy("url_b").agg(F.min("crawl_id").alias("crawl_id"), F.count(F.lit(1)).alias("n"))


_SECRETS = ", ".join(f"'{s}'" for s in urls.SECRET)
_REDACTED_QUERY = f"array_to_string(list_transform(list_filter(string_split({sql.url_part('u', 4)}, '&'), lambda p: p <> ''), lambda p: CASE WHEN contains(p, '=') AND lower(split_part(p, '=', 1)) IN ({_SECRETS}) THEN split_part(p, '=', 1) || '=[REDACTED]' ELSE p END), '&')"


@query(f"""WITH s AS (SELECT crawl_id, final_url || CASE WHEN contains(final_url, '?') THEN '&' ELSE '?' END || 'token=' || crawl_id || '&q=1#part' AS u FROM crawl_results)
SELECT crawl_id, {sql.url_part('u', 1)} || '://' || {sql.url_part('u', 2)} || {sql.url_part('u', 3)} || CASE WHEN {_REDACTED_QUERY} = '' THEN '' ELSE '?' || {_REDACTED_QUERY} END || CASE WHEN {sql.url_part('u', 5)} = '' THEN '' ELSE '#[REDACTED_FRAGMENT]' END AS redacted FROM s""")
def redact_url(spark: SparkSession, sf: str) -> DataFrame:
    u = F.concat(F.col("final_url"), F.when(F.col("final_url").contains("?"), "&").otherwise("?"), F.lit("token="), F.col("crawl_id").cast("string"), F.lit("&q=1#part"))
    return table(spark, sf, "crawl_results").select("crawl_id", urls.redacted(u).alias("redacted"))


@query(f"""SELECT content_type, regexp_matches(coalesce(lower({sql.url_part('url', 3)}), ''), '\\.(?:{'|'.join(urls.NO_TEXT)})$') AS no_text,
 (contains(coalesce(content_type, ''), 'text/html') OR contains(coalesce(content_type, ''), 'text/plain') OR contains(coalesce(content_type, ''), 'application/json') OR contains(coalesce(content_type, ''), 'application/xml')
 OR NOT regexp_matches(coalesce(content_type, ''), 'application/pdf|application/msword|application/vnd|image/|audio/|video/|application/zip|application/x-')) AS worth, count(*) AS n FROM evidence GROUP BY ALL""")
def content_type_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "evidence").select("content_type", F.coalesce(urls.no_text(F.col("url")), F.lit(False)).alias("no_text"), urls.worth_fetching(F.col("content_type")).alias("worth"))
    return rows.groupBy("content_type", "no_text", "worth").agg(F.count(F.lit(1)).alias("n"))


_MARKUP_SQL = f"(coalesce(contains(lower(content_type), 'html'), false) OR coalesce(regexp_matches(left(content, 4096), '{text.HTML_HINT}'), false))"


@query(f"SELECT crawl_id, {_MARKUP_SQL} AS is_markup, sha256(CASE WHEN {_MARKUP_SQL} THEN {sql.markup_text('content')} ELSE content END) AS text_hash, length(CASE WHEN {_MARKUP_SQL} THEN {sql.markup_text('content')} ELSE content END) AS n_chars FROM crawl_results")
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "crawl_results").withColumn("m", text.is_markup(F.col("content"), F.col("content_type")))
    plain = F.when(F.col("m"), text.markup_text(F.col("content"))).otherwise(F.col("content"))
    return rows.select("crawl_id", F.col("m").alias("is_markup"), F.sha2(plain, 256).alias("text_hash"), F.length(plain).cast("bigint").alias("n_chars"))


@query(f"SELECT fp AS fingerprint, count(*) AS n, min(doc_id) AS doc_id FROM (SELECT doc_id, {sql.fingerprint('text')} AS fp FROM documents) GROUP BY fp")
def content_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint")).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))


_MERGED = f"""
k AS (SELECT *, {sql.identity('url')} AS url_key, {sql.fingerprint("coalesce(nullif(content, ''), snippet)")} AS fp FROM evidence),
r AS (SELECT * FROM k WHERE url_key <> ''),
q AS (SELECT url_key, string_agg(query, '|' ORDER BY first_at, query) AS queries FROM (SELECT url_key, query, min(evidence_id) AS first_at FROM r WHERE coalesce(query, '') <> '' GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT url_key, min(evidence_id) AS first_seq, count(*) AS n_records, arg_max(original_url, evidence_id) FILTER (coalesce(original_url, '') <> '') AS original_url,
  arg_min(entity_name, evidence_id) FILTER (coalesce(entity_name, '') <> '') AS entity_name, arg_min(entity_id, evidence_id) FILTER (coalesce(entity_id, '') <> '') AS entity_id, arg_min(fp, evidence_id) AS fingerprint FROM r GROUP BY url_key)"""


@query(f"WITH {_MERGED.strip()} SELECT m.*, q.queries FROM m LEFT JOIN q ON m.url_key = q.url_key")
def evidence_dedup_url(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.merge_by_url(table(spark, sf, "evidence"), "evidence_id")


@query(f"""WITH {_MERGED.strip()} SELECT CASE WHEN fingerprint = '' THEN url_key ELSE fingerprint END AS content_key, arg_min(url_key, first_seq) AS url_key, min(m.first_seq) AS first_seq, count(*) AS n_urls,
 arg_min(original_url, m.first_seq) FILTER (original_url IS NOT NULL) AS original_url, arg_min(entity_name, m.first_seq) FILTER (entity_name IS NOT NULL) AS entity_name FROM m GROUP BY 1""")
def evidence_dedup_content(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.merge_by_content(dedup.merge_by_url(table(spark, sf, "evidence"), "evidence_id"))


def _any_sql(x: str, phrases: tuple[str, ...]) -> str:
    joined = "|".join(p.replace(".", "\\.").replace("'", "''") for p in phrases)
    return f"regexp_matches({x}, '{joined}')"


_WORDS = "list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> '')"
_QUALITY_SQL = f"""CASE WHEN coalesce(trim(content), '') = '' THEN 'empty' WHEN {_any_sql('lower(content)', quality.BLOCK)} THEN 'block_page' WHEN {_any_sql('lower(content)', quality.ERROR)} THEN 'error_page'
 WHEN len(regexp_extract_all(lower(content), '<script')) > 2 AND length(trim(content)) < 200 THEN 'js_shell'
 WHEN length(trim(content)) < 100 AND len(list_filter({_WORDS}, lambda w: {_any_sql('w', quality.NAVIGATION)})) > len({_WORDS}) * 0.5 THEN 'navigation'
 WHEN length(trim(content)) < 150 AND {_any_sql('lower(content)', quality.SERVER)} THEN 'soft_404' WHEN length(trim(content)) < 200 THEN 'thin' ELSE 'substantive' END"""
_STATUS_SQL = f"CASE WHEN retrieval_status IN {quality.FAILED} THEN 'unusable' WHEN quality IN {quality.UNUSABLE} THEN 'unusable' WHEN quality = 'thin' THEN 'thin' ELSE 'usable' END"


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "crawl_results").withColumn("quality", quality.extraction_quality(F.col("content")))
    return rows.select("crawl_id", "quality", quality.evidence_status(F.col("quality"), F.col("retrieval_status")).alias("status"))


@query(f"SELECT crawl_id, quality, {_STATUS_SQL} AS status FROM (SELECT crawl_id, retrieval_status, {_QUALITY_SQL} AS quality FROM crawl_results)")
def extraction_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _rated(spark, sf)


@query(f"SELECT {_STATUS_SQL} AS status, quality, count(*) AS n FROM (SELECT crawl_id, retrieval_status, {_QUALITY_SQL} AS quality FROM crawl_results) GROUP BY ALL")
def quality_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_counts(_rated(spark, sf))


@query(f"""WITH p AS (SELECT crawl_id, {sql.identity('final_url')} AS url_key, {sql.fingerprint('content')} AS fp, {_QUALITY_SQL} AS quality, retrieval_status FROM crawl_results),
u AS (SELECT * FROM p WHERE url_key <> '' AND {_STATUS_SQL} <> 'unusable'),
f AS (SELECT url_key, min(crawl_id) AS crawl_id, arg_min(fp, crawl_id) AS fingerprint FROM u GROUP BY url_key)
SELECT fingerprint, min(crawl_id) OVER (PARTITION BY fingerprint) AS page_id, count(*) OVER (PARTITION BY fingerprint) AS n_urls, crawl_id, url_key FROM f""")
def distinct_usable_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct usable pages, one row per address that each was found under; ``page_id`` is the first discovery."""
    rows = table(spark, sf, "crawl_results").withColumn("quality", quality.extraction_quality(F.col("content")))
    rows = rows.select("crawl_id", urls.identity(F.col("final_url")).alias("url_key"), text.fingerprint(F.col("content")).alias("fp"), quality.evidence_status(F.col("quality"), F.col("retrieval_status")).alias("status"))
    first = rows.where("url_key <> '' and status <> 'unusable'").groupBy("url_key").agg(F.min("crawl_id").alias("crawl_id"), F.min_by("fp", "crawl_id").alias("fingerprint"))
    pages = first.groupBy("fingerprint").agg(F.min("crawl_id").alias("page_id"), F.count(F.lit(1)).alias("n_urls"))
    return first.join(pages, "fingerprint").select("fingerprint", "page_id", "n_urls", "crawl_id", "url_key")


@query(f"SELECT name, {sql.match_form('name')} AS match_form, {sql.name_form('name')} AS form FROM (SELECT DISTINCT name FROM rita_entities)")
def name_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "rita_entities").select("name").distinct()
    return rows.select("name", text.match_form(F.col("name")).alias("match_form"), text.name_form(F.col("name")).alias("form"))


_NAMES_SQL = "(SELECT DISTINCT name FROM (SELECT entity AS name FROM canonical_nodes UNION ALL SELECT unnest(aliases) FROM canonical_nodes) WHERE name IS NOT NULL)"


@query(f"SELECT name, {sql.acronym_in('name')} AS written, {sql.acronym_of(sql.match_form('name'))} AS made, regexp_full_match(trim(name), '[A-Za-z]{{2,5}}') AS is_acronym FROM {_NAMES_SQL}")
def acronyms(spark: SparkSession, sf: str) -> DataFrame:
    from strandline.operators.resolve import registered_names

    rows = registered_names(table(spark, sf, "canonical_nodes")).select("name").distinct()
    return rows.select("name", text.acronym_in(F.col("name")).alias("written"), text.acronym_of(text.match_form(F.col("name"))).alias("made"), F.trim("name").rlike("^[A-Za-z]{2,5}$").alias("is_acronym"))


@query(f"""SELECT uid, {sql.slug('entity')} AS slug, 'NODE-' || upper(left(sha256(uid || '|' || coalesce(entity, '')), 12)) AS node_id FROM canonical_nodes""")
def node_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "canonical_nodes").select("uid", text.slug(F.col("entity")).alias("slug"), F.concat(F.lit("NODE-"), F.upper(text.short_hash([F.col("uid"), F.col("entity")], 12))).alias("node_id"))


@query("SELECT seq, left(sha256(concat_ws('|', coalesce(subject, ''), coalesce(predicate, ''), coalesce(object, ''), coalesce(source_url, ''))), 16) AS made_id, left(sha256(concat_ws('|', coalesce(subject, ''), coalesce(predicate, ''), coalesce(object, ''), coalesce(source_url, ''))), 16) IS NOT DISTINCT FROM claim_id AS same FROM atomic_claims")
def claim_ids(spark: SparkSession, sf: str) -> DataFrame:
    made = text.short_hash([F.col(c) for c in ("subject", "predicate", "object", "source_url")])
    return table(spark, sf, "atomic_claims").select("seq", made.alias("made_id"), made.eqNullSafe(F.col("claim_id")).alias("same"))


_STRIPPED = sql.replaced("text", (r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
_SENTENCES_SQL = f"(SELECT doc_id, unnest(list_filter(string_split(regexp_replace({_STRIPPED}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS sentence FROM documents)"


@query(f"SELECT doc_id, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS chars, md5(string_agg(md5(sentence), '' ORDER BY md5(sentence))) AS digest FROM {_SENTENCES_SQL} GROUP BY doc_id")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.explode(text.pieces(F.col("text"))).alias("sentence"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("chars"), F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("sentence"))), "")).alias("digest"))


@query(f"SELECT (len(regexp_split_to_array(trim(sentence), '\\s+')) < 3 OR regexp_matches(sentence, '^\\p{{Ll}}')) AS is_fragment, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {_SENTENCES_SQL} GROUP BY 1")
def sentence_fragments(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.explode(text.pieces(F.col("text"))).alias("sentence"))
    return rows.groupBy(text.fragment(F.col("sentence")).alias("is_fragment")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("""SELECT doc_id, i AS chunk_index, md5(substring(text, i * 3800 + 1, 4000)) AS digest, length(substring(text, i * 3800 + 1, 4000)) AS n_chars, CAST(n + 1 AS INTEGER) AS total FROM
 (SELECT doc_id, text, n, unnest(generate_series(0, n)) AS i FROM (SELECT doc_id, text, CAST(CASE WHEN length(text) <= 4000 THEN 0 ELSE ceil((length(text) - 4000) / 3800.0) END AS INTEGER) AS n FROM documents WHERE trim(text) <> ''))""")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("trim(text) <> ''").withColumn("c", text.chunks(F.col("text")))
    rows = rows.select("doc_id", F.size("c").alias("total"), F.explode("c").alias("c"))
    return rows.select("doc_id", F.col("c.chunk_index").cast("bigint").alias("chunk_index"), F.md5("c.chunk").alias("digest"), F.length("c.chunk").cast("bigint").alias("n_chars"), "total")


_REDACTED = "text || ' api_key=' || doc_id || ' Bearer abc' || doc_id || ' password: x' || doc_id"


@query("SELECT doc_id, md5(r) AS digest, length(r) AS n_chars FROM (SELECT doc_id, " + sql.replaced(f"({_REDACTED})", *[(p, ("\\1" if keeps else "") + w) for p, w, keeps in text.SECRETS]) + " AS r FROM documents)")
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    r = text.redacted(F.concat(F.col("text"), F.lit(" api_key="), n, F.lit(" Bearer abc"), n, F.lit(" password: x"), n))
    return table(spark, sf, "documents").select("doc_id", F.md5(r).alias("digest"), F.length(r).cast("bigint").alias("n_chars"))


_FRONT_SQL = ", ".join(f"{sql.front_value('text', k)} AS fm_{k}" for k in readers.TITLE_KEYS)
_TITLE_SQL = ", ".join(f"nullif(fm_{k}, '')" for k in readers.TITLE_KEYS)


@query(f"""SELECT doc_id, coalesce({_TITLE_SQL}, nullif(trim(regexp_extract(text, '(?m)^#\\s+(.*)$', 1)), ''), '') AS title, fm_entity AS entity, length({sql.body('text')}) AS body_chars,
 list_distinct(list_concat(list_filter(list_transform(regexp_extract_all(text, '(?:^|[^\\[])\\[([^\\]\\[]+)\\]\\([^)]*\\)', 1), lambda x: trim(x)), lambda x: x <> ''), list_filter(list_transform(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1), lambda x: trim(x)), lambda x: x <> ''))).len() AS n_links
 FROM (SELECT doc_id, text, {_FRONT_SQL} FROM documents WHERE text IS NOT NULL)""")
def markdown_parse(spark: SparkSession, sf: str) -> DataFrame:
    """What every note says of itself: title, entity, size of its body, number of distinct links."""
    parts = readers.note_parts(F.col("text"))
    rows = table(spark, sf, "documents").where("text is not null")
    return rows.select("doc_id", parts["title"].alias("title"), parts["entity"].alias("entity"), F.length(parts["body"]).cast("bigint").alias("body_chars"), F.size(parts["links"]).cast("bigint").alias("n_links"))


@query(f"""WITH l AS (SELECT DISTINCT source_key, {sql.match_form('target')} AS target_key FROM (SELECT {sql.match_form(sql.front_value('text', 'entity'))} AS source_key, trim(unnest(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1))) AS target FROM documents)),
i AS (SELECT key, min(uid) AS uid, count(*) AS n FROM (SELECT DISTINCT uid, {sql.match_form('name')} AS key FROM (SELECT uid, entity AS name FROM canonical_nodes UNION ALL SELECT uid, unnest(aliases) FROM canonical_nodes) WHERE name IS NOT NULL) WHERE key <> '' GROUP BY key HAVING count(*) = 1)
SELECT source_key, target_key, s.uid AS source_uid, t.uid AS target_uid, 'REL-' || left(sha256(source_key || '|' || target_key || '|references'), 16) AS edge_id
FROM l LEFT JOIN i s ON l.source_key = s.key LEFT JOIN i t ON l.target_key = t.key WHERE source_key <> '' AND target_key <> '' AND source_key <> target_key""")
def reference_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from the entity that a note is about to those that its links name, with uids where a name is one entity's."""
    from strandline.operators.resolve import name_index

    index = name_index(table(spark, sf, "canonical_nodes")).where("n_entities = 1").select("key", "uid")
    notes = table(spark, sf, "documents")
    links = notes.select(text.match_form(text.front_value(F.col("text"), "entity")).alias("source_key"), F.explode(text.wikilinks(F.col("text"))).alias("target")).select("source_key", text.match_form(F.col("target")).alias("target_key")).distinct()
    links = links.where("source_key <> '' and target_key <> '' and source_key <> target_key")
    found = links.join(index.select(F.col("key").alias("source_key"), F.col("uid").alias("source_uid")), "source_key", "left").join(index.select(F.col("key").alias("target_key"), F.col("uid").alias("target_uid")), "target_key", "left")
    return found.select("source_key", "target_key", "source_uid", "target_uid", F.concat(F.lit("REL-"), text.short_hash([F.col("source_key"), F.col("target_key"), F.lit("references")])).alias("edge_id"))


# Function words that are no mentions.
_SKIP = ("The", "A", "An", "And", "Or", "But", "In", "On", "At", "By", "For", "Of", "To", "With", "Is", "Are", "Was", "Were", "Been", "Be", "Have", "Has", "Had", "Do", "Does", "Did")


#: A capital and small letters of any script, each with its combining marks; white space as both engines know it.
_MENTION = r"[\p{Lu}\p{Lt}]\p{M}*\p{Ll}[\p{Ll}\p{M}]*(?:[\s\p{Z}]+[\p{Lu}\p{Lt}]\p{M}*\p{Ll}[\p{Ll}\p{M}]*)*"


def mentions(claims: DataFrame) -> DataFrame:
    """Capitalised phrases of claims, in whatever script, and how often they occur; function words are no mentions."""
    rows = claims.select("seq", F.explode(F.regexp_extract_all("claim_text", F.lit(f"({_MENTION})"), 1)).alias("mention")).where((F.length("mention") > 2) & ~F.col("mention").isin(*_SKIP))
    return rows.groupBy("mention").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("claims"), F.min("seq").alias("first_seq"))


@query(f"SELECT mention, count(*) AS n, count(DISTINCT seq) AS claims, min(seq) AS first_seq FROM (SELECT seq, unnest(regexp_extract_all(claim_text, '{_MENTION}')) AS mention FROM atomic_claims) WHERE length(mention) > 2 AND mention NOT IN {_SKIP} GROUP BY mention")
def mention_extract(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(table(spark, sf, "atomic_claims"))


@query(f"SELECT evidence_id, url, {sql.fingerprint('content')} AS fp FROM evidence QUALIFY row_number() OVER (PARTITION BY {sql.fingerprint('content')} ORDER BY evidence_id) = 1")
def keep_first_content(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "evidence").select("evidence_id", "url", text.fingerprint(F.col("content")).alias("fp"))
    return first_per_key(rows, ["fp"], F.col("evidence_id"))
