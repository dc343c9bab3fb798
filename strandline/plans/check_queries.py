"""Queries over the registry's errors, its links and the kinds of sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import vocabulary as v
from strandline.operators import validate
from strandline.operators.relevance import _EDGE, _SHUT
from strandline.plans import sql
from strandline.plans.claim_queries import _match, _q
from strandline.session import table

QUERIES, SQL = {}, {}


def query(statement: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


def _in(x: str, words) -> str:
    return f"{x} IN ({', '.join(map(_q, words))})"


_TITLE = r"regexp_full_match(w, '\p{Lu}[^\p{Lu}]*')"
_ALPHA = r"regexp_full_match(w, '\p{L}+')"
_FORM = f"""CASE WHEN x = '' THEN 'empty' WHEN length(x) > {validate.LONGEST_TARGET} THEN 'long' WHEN len(ws) > {validate.MOST_WORDS} THEN 'many_words' WHEN known THEN NULL WHEN {_in('lower(x)', validate.CONCEPTS)} THEN NULL WHEN regexp_matches(x, '[.!?;:]') THEN 'sentence'
 WHEN len(ws) > 2 AND len(list_filter(ws, lambda w: regexp_matches(w, '\\p{{L}}') AND lower(w) = w)) > 0.7 * len(ws) THEN 'prose' WHEN {_match('lower(x)', v.any_word(validate.TARGET_WORDS))} THEN 'call' WHEN {_match('x', validate.VERSE)} THEN 'verse' WHEN regexp_full_match(x, '\\p{{L}}') THEN 'letter'
 WHEN len(list_filter(ws, lambda w: {_ALPHA} AND NOT {_TITLE} AND upper(w) <> w)) = 0 THEN NULL WHEN len(list_filter(ws[1:1], lambda w: {_TITLE})) = 1 AND len(list_filter(ws[2:], lambda w: {_ALPHA} AND lower(w) <> w)) = 0 THEN NULL ELSE 'no_name' END"""
_SHAPE = r"^\s*(.*?)::\[\[(.*)\]\]\s*$"
_LINKS = f"""(SELECT uid, field, item, nullif(lower(trim(regexp_extract(item, {_q(_SHAPE)}, 1))), '') AS predicate, CASE WHEN regexp_matches(item, {_q(_SHAPE)}) THEN trim(regexp_extract(item, {_q(_SHAPE)}, 2)) END AS target
 FROM (SELECT uid, 'relationships' AS field, unnest(relationships) AS item FROM canonical_nodes UNION ALL SELECT uid, 'associations', unnest(associations) FROM canonical_nodes) WHERE trim(item) <> ''
 UNION ALL SELECT uid, 'summary', t, NULL, t FROM (SELECT uid, unnest(regexp_extract_all(coalesce(summary, ''), '\\[\\[(.+?)\\]\\]', 1)) AS t FROM canonical_nodes))"""
_JUDGED = f"""(SELECT uid, field, item, predicate, target, {_FORM} AS problem FROM (SELECT *, trim(coalesce(target, '')) AS x, list_filter(regexp_split_to_array(trim(coalesce(target, '')), '\\s+'), lambda w: w <> '') AS ws,
 lower(trim(target)) IN (SELECT lower(name) FROM (SELECT entity AS name FROM canonical_nodes UNION SELECT unnest(aliases) FROM canonical_nodes) WHERE name IS NOT NULL) AS known FROM {_LINKS}))"""


@query(f"SELECT uid, field, item, predicate, target, problem FROM {_JUDGED}")
def backlink_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Every link of the registry's rows, and why its target can't stand."""
    nodes = table(spark, sf, "canonical_nodes")
    return validate.judged_targets(validate.links_of(nodes), nodes).select("uid", "field", "item", "predicate", "target", "problem")


_BLANK = lambda x: f"trim(coalesce({x}, '')) = ''"
_WITHIN = lambda x, words: _in(f"lower(trim({x}))", sorted({w.lower() for w in words}))
_STOP = lambda x: f"regexp_matches({x}, '[.!?]')"
_CHECKS = (
    ("uid", "missing", _BLANK("uid")), ("uid", "format", f"NOT {_BLANK('uid')} AND uid <> {sql.slug('entity')}"),
    ("entity", "missing", _BLANK("entity")), ("entity", "sentence", "regexp_matches(trim(entity), '[.!?]$')"), ("entity", "long", f"length(trim(entity)) > {validate.LONGEST_NAME}"), ("entity", "lines", "contains(trim(entity), chr(10))"),
    ("entity_type", "unknown", f"NOT {_BLANK('entity_type')} AND NOT {_WITHIN('entity_type', v.KINDS)}"), ("entity_type", "sentence", _STOP("entity_type")), ("entity_type", "long", f"length(trim(entity_type)) > {validate.LONGEST_TYPE}"),
    ("sector", "unknown", f"NOT {_BLANK('sector')} AND NOT {_in('trim(sector)', v.SECTORS)}"), ("sector", "sentence", _STOP("sector")),
    ("country", "unknown", f"NOT {_BLANK('country')} AND NOT {_WITHIN('country', v.REGIONS + v.COUNTRIES)}"),
    ("status", "unknown", f"NOT {_BLANK('status')} AND NOT {_WITHIN('status', v.STATUSES)}"), ("status", "long", f"length(trim(status)) > {validate.LONGEST_STATUS}"), ("status", "sentence", _STOP("status")),
    ("summary", "missing", "s = ''"),
    ("summary", "no_reference", f"s <> '' AND len(list_filter(list_concat([entity], coalesce(aliases, [])), lambda a: coalesce(a, '') <> '' AND regexp_matches(lower(s), {_q(_EDGE)} || '\\Q' || lower(a) || '\\E' || {_q(_SHUT)}))) = 0"),
    ("summary", "long", f"len(regexp_split_to_array(s, '\\s+')) > {validate.SUMMARY_LENGTH}"), ("summary", "call", _match("lower(s)", v.any_word(validate.SUMMARY_WORDS))), ("summary", "no_verb", f"s <> '' AND NOT {_match('lower(s)', validate.VERBS)}"),
    ("sources", "missing", "coalesce(len(sources), 0) = 0"),
)
_ALIAS = f"CASE WHEN regexp_matches(trim(x), '[.!?]$') THEN 'sentence' WHEN length(trim(x)) > {validate.LONGEST_NAME} THEN 'long' WHEN regexp_full_match(trim(x), '\\p{{L}}') THEN 'letter' WHEN {_match('trim(x)', validate.VERSE)} THEN 'verse' WHEN {_match('lower(trim(x))', v.any_word(validate.ALIAS_WORDS))} THEN 'call' END"
_ERRORS = (
    " UNION ALL ".join(f"SELECT uid, '{f}' AS field, '{code}' AS code FROM n WHERE coalesce({bad}, false)" for f, code, bad in _CHECKS)
    + f" UNION ALL SELECT uid, 'aliases', {_ALIAS} FROM (SELECT uid, unnest(aliases) AS x FROM canonical_nodes) WHERE trim(x) <> ''"
    + " UNION ALL SELECT uid, 'sources', CASE WHEN NOT regexp_matches(trim(x), '(?i)^https?://') THEN 'no_address' END FROM (SELECT uid, unnest(sources) AS x FROM canonical_nodes) WHERE trim(x) <> ''"
    + f" UNION ALL SELECT uid, field, CASE WHEN target IS NULL THEN 'format' ELSE 'target_' || problem END FROM {_JUDGED}"
    + f" UNION ALL SELECT uid, field, CASE WHEN (field = 'relationships' AND NOT coalesce({_in('predicate', v.RELATIONSHIPS)}, false)) OR (field = 'associations' AND NOT coalesce({_in('predicate', v.ASSOCIATIONS)}, false)) THEN 'predicate' END FROM {_LINKS} WHERE target IS NOT NULL"
)


@query(f"WITH n AS (SELECT *, trim(coalesce(summary, '')) AS s FROM canonical_nodes), e AS ({_ERRORS}) SELECT uid, field, code, count(*) AS n FROM e WHERE code IS NOT NULL GROUP BY ALL")
def row_validate(spark: SparkSession, sf: str) -> DataFrame:
    """What each row of the registry breaks, and how often."""
    return validate.node_errors(table(spark, sf, "canonical_nodes")).groupBy("uid", "field", "code").agg(F.count(F.lit(1)).alias("n"))


def _kinds() -> str:
    out = f"CASE WHEN {_in('hint', [t.lower() for t in validate.TYPES])} THEN list_filter({[*validate.TYPES]}, lambda t: lower(t) = hint)[1]"
    for part, kind in validate.ENCYCLOPEDIAS.items():
        out += f" WHEN contains(low, '{part}') THEN '{kind}'"
    for part in validate.OFFICIAL:
        out += f" WHEN contains(low, '{part}') THEN 'official'"
    for kind, parts, words in validate.KINDS:
        either = " OR ".join(_match("low", f"(?:^|[^a-z0-9]){p.replace('.', '[.]')}" + ("" if p.endswith(".") else "(?:$|[^a-z0-9])")) for p in parts)
        out += f" WHEN {either}" + (f" OR {_match('name', v.any_word(words))}" if words else "") + f" THEN '{kind}'"
    return out + " ELSE 'search_discovered' END"


@query(f"SELECT evidence_id, {_kinds()} AS source_type FROM (SELECT evidence_id, lower(coalesce(url, '')) AS low, lower(coalesce(title, '')) AS name, lower(metadata['source_type']) AS hint FROM evidence)")
def source_types(spark: SparkSession, sf: str) -> DataFrame:
    """What kind of source each record comes from."""
    return table(spark, sf, "evidence").select("evidence_id", validate.source_type(F.col("url"), F.col("title"), F.try_element_at("metadata", F.lit("source_type"))).alias("source_type"))
