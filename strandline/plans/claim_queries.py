"""Queries over relevance, extracted claims, their gate and their classes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import vocabulary as v
from strandline.operators import classify, quality, relevance
from strandline.plans import sql
from strandline.seq import bound
from strandline.session import table

QUERIES, SQL = {}, {}


def query(statement: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


# ---------------------------------------------------------------------------------------------
# Pieces of SQL.


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(phrases) -> str:
    return "[" + ", ".join(map(_q, phrases)) + "]"


def _has(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(p)})" for p in phrases) + ")"


def _first(x: str, phrases) -> str:
    return f"list_filter({_list(phrases)}, lambda w: contains({x}, w))[1]"


def _match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern)})"


def _title(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}[\p{{L}}\p{{M}}]*|\P{{L}}+'), lambda t: upper(t[1:1]) || lower(t[2:])), '')"


_QUOTED = r"'\Q' || replace(name, '\E', '') || '\E'"
_WORDS = r"list_filter(regexp_split_to_array(name, '\s+'), lambda w: w <> '')"
_REFERS = f"(name <> '' AND (contains(low, name) OR (len({_WORDS}) > 1 AND len(list_filter(list_concat({_WORDS}, list_transform(range(1, len({_WORDS})), lambda i: {_WORDS}[i] || ' ' || {_WORDS}[i + 1])), lambda w: contains(low, w))) > 0)))"
_BODY = "coalesce(nullif(normalized_text, ''), nullif(content, ''), snippet, '')"
_RECORDS = f"""(SELECT evidence_id, url, body, target, CASE WHEN trim(coalesce(url, '')) = '' THEN 'no_url' WHEN trim(body) = '' THEN 'empty_text' WHEN {_has('low', quality.BLOCK)} OR {_has('low', quality.ERROR)} THEN 'block_or_error'
 WHEN {_REFERS} THEN 'target' WHEN upper(trim(coalesce(evidence_status, ''))) = 'UNUSABLE' THEN 'unusable' ELSE 'no_relation' END AS reason
 FROM (SELECT *, lower(body) AS low, lower(trim(coalesce(entity_name, ''))) AS name, entity_name AS target FROM (SELECT *, {_BODY} AS body FROM evidence)))"""
_STRIPPED = sql.replaced("body", (r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
_SENTENCES = f"""(SELECT evidence_id, url, target, CAST(i - 1 AS INTEGER) AS sentence_no, l[i] AS passage FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM
 (SELECT evidence_id, url, target, list_filter(string_split(regexp_replace({_STRIPPED}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS l FROM {_RECORDS} WHERE reason = 'target')))"""
_FRAGMENT = lambda x: rf"(len(regexp_split_to_array(trim({x}), '\s+')) < 3 OR regexp_matches({x}, '^\p{{Ll}}'))"
_NAMED = f"(SELECT *, lower(passage) AS low, lower(trim(coalesce(target, ''))) AS name FROM {_SENTENCES})"
_SPACED = tuple(dict.fromkeys(p.replace("_", " ") for p in relevance.PREDICATES))


@query(f"SELECT evidence_id, CASE WHEN reason = 'target' THEN 'DIRECT' ELSE 'IRRELEVANT' END AS relevance, reason FROM {_RECORDS}")
def evidence_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each record tells of its entity, and why not."""
    return relevance.label_records(table(spark, sf, "evidence")).select("evidence_id", "relevance", "reason")


@query(f"""SELECT evidence_id, sentence_no, CASE WHEN name <> '' AND contains(low, name) AND (regexp_matches(low, {_q(relevance._EDGE)} || {_QUOTED} || '\\s+[a-z]+\\s') OR instr(low, name) <= 50) THEN 'DIRECT'
 WHEN name <> '' AND contains(low, name) AND {_has('low', _SPACED)} THEN 'RELATED' WHEN {_REFERS} THEN 'DIRECT' ELSE 'IRRELEVANT' END AS label, {_match('low', relevance.BOILERPLATE)} OR {_FRAGMENT('passage')} AS dropped FROM {_NAMED}""")
def sentence_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Each sentence of the relevant records: about the entity, related to it or neither, and whether it is boilerplate."""
    rows = relevance.label_records(table(spark, sf, "evidence")).where("relevance <> 'IRRELEVANT'")
    rows = rows.select("evidence_id", F.col("entity_name").alias("target"), F.posexplode(relevance.text.pieces(F.col("body"))).alias("sentence_no", "s"))
    return rows.select("evidence_id", "sentence_no", relevance.sentence_label(F.col("s"), F.col("target")).alias("label"), relevance.irrelevant_sentence(F.col("s")).alias("dropped"))


_SP = "replace(p, '_', ' ')"
_LEADS = lambda p: f"(starts_with(low, name || ' ' || replace({p}, '_', ' ') || ' ') AND length(low) > length(name) + length({p}) + 2)"
_AT = lambda p: f"instr(substr(low, 2), ' ' || replace({p}, '_', ' ') || ' ' || name)"
_KINDS = rf"(?:is|are|was|were)\s+(?:a|an|the)\s+([a-z0-9\s-]+)"
def _claims(source: str) -> str:
    """SQL of the claims of ``source``, a relation with evidence_id, sentence_no, target, passage and url."""
    return f"""(SELECT evidence_id, sentence_no, target, passage, url,
 CASE WHEN p IS NOT NULL THEN CASE WHEN leads THEN substr(s, 1, length(name)) ELSE substr(s, 1, pos_) END ELSE t END AS subject,
 CASE WHEN p IS NOT NULL THEN p WHEN value <> '' THEN 'is' WHEN sector IS NOT NULL THEN 'operates_in' WHEN place IS NOT NULL THEN 'located_in' WHEN state IS NOT NULL THEN 'has_status' ELSE 'describes' END AS predicate,
 CASE WHEN p IS NOT NULL THEN CASE WHEN leads THEN substr(s, length(name) + length(p) + 3) ELSE substr(s, pos_ + length(p) + 3, length(name)) END WHEN value <> '' THEN value WHEN sector IS NOT NULL THEN {_title('sector')} WHEN place IS NOT NULL THEN place WHEN state IS NOT NULL THEN state ELSE s END AS object,
 CASE WHEN p IS NOT NULL THEN CASE WHEN leads THEN substr(s, 1, length(name)) || ' ' || {_SP} || ' ' || substr(s, length(name) + length(p) + 3) ELSE substr(s, 1, pos_) || ' ' || {_SP} || ' ' || substr(s, pos_ + length(p) + 3, length(name)) END
  WHEN value <> '' THEN t || ' is ' || value WHEN sector IS NOT NULL THEN t || ' operates in ' || {_title('sector')} WHEN place IS NOT NULL THEN t || ' is located in ' || place WHEN state IS NOT NULL THEN t || ' has status ' || state ELSE s END AS claim_text,
 CASE WHEN p IS NOT NULL AND NOT leads THEN 'RELATED' ELSE 'DIRECT' END AS relevance,
 CASE WHEN p IS NOT NULL THEN CASE WHEN p IN ({', '.join(map(_q, v.RELATIONSHIPS))}) THEN 'RELATIONSHIP' ELSE 'ASSOCIATION' END WHEN value <> '' OR sector IS NOT NULL OR place IS NOT NULL OR state IS NOT NULL THEN 'ATTRIBUTE' ELSE 'SUMMARY' END AS evidence_type,
 CAST(CASE WHEN p IS NOT NULL THEN 0.8 WHEN value <> '' OR sector IS NOT NULL OR place IS NOT NULL OR state IS NOT NULL THEN 0.9 WHEN told THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence,
 CASE WHEN p IS NULL AND value = '' AND sector IS NULL AND place IS NULL AND state IS NULL AND NOT told THEN 'NEEDS_REVIEW' ELSE 'VALID' END AS quality_status,
 CASE WHEN p IS NOT NULL THEN 'pattern_match' WHEN value <> '' OR sector IS NOT NULL OR place IS NOT NULL OR state IS NOT NULL THEN 'attribute_extraction' WHEN told THEN 'summary_extraction' ELSE 'fallback' END AS method
 FROM (SELECT *, coalesce({_LEADS('p')}, false) AS leads, {_AT('p')} AS pos_,
  {_title(f"trim(coalesce(nullif(regexp_extract(low, {_q(relevance._EDGE)} || {_QUOTED} || {_q(chr(92) + 's+' + _KINDS)}, 1), ''), nullif(regexp_extract(low, {_q(_KINDS + chr(92) + 's+')} || {_QUOTED}, 1), ''), ''))")} AS value,
  {_first('low', [x.lower() for x in v.longest_first(v.SECTORS)])} AS sector, {_first('low', v.longest_first(v.REGIONS + v.COUNTRIES))} AS place, {_first('low', v.longest_first(v.STATUSES))} AS state,
  regexp_matches(low, {_q(relevance._EDGE)} || {_QUOTED} || '\\s+(?:is|are|was|were|{'|'.join(v.TOLD)})\\s') AS told
  FROM (SELECT *, list_filter({_list(relevance.PREDICATES)}, lambda x: {_LEADS('x')} OR {_AT('x')} > 0)[1] AS p FROM
   (SELECT *, lower(s) AS low, lower(t) AS name FROM (SELECT *, {sql.squeeze('passage')} AS s, trim(coalesce(target, '')) AS t FROM {source} WHERE NOT ({_match('lower(passage)', relevance.BOILERPLATE)} OR {_FRAGMENT('passage')})))
   WHERE name <> '' AND contains(low, name))))"""


_CLAIMS = _claims(_SENTENCES)
_OF_CLAIMS = _claims("(SELECT seq AS evidence_id, 0 AS sentence_no, subject AS target, claim_text AS passage, source_url AS url FROM atomic_claims WHERE claim_text IS NOT NULL)")


@query(f"SELECT evidence_id, sentence_no, subject, predicate, object, claim_text, relevance, evidence_type, confidence, quality_status, method FROM {_CLAIMS}")
def sentence_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The claim that each sentence about its record's entity makes."""
    return relevance.claims_of(relevance.label_records(table(spark, sf, "evidence")), "evidence_id").drop("target", "passage", "url")


@query(f"SELECT evidence_id AS seq, subject, predicate, object, claim_text, relevance, evidence_type, confidence, quality_status, method FROM {_OF_CLAIMS}")
def claim_extract(spark: SparkSession, sf: str) -> DataFrame:
    """What the claims' own texts say of their subjects, extracted again."""
    rows = table(spark, sf, "atomic_claims").where("claim_text is not null").select("seq", F.col("subject").alias("target"), F.col("claim_text").alias("passage"))
    rows = relevance.with_claims(rows.where(~relevance.irrelevant_sentence(F.col("passage"))))
    return rows.select("seq", "c.*")


def _blank(x: str) -> str:
    return f"trim(coalesce({x}, '')) = ''"


_BOTH = "lower(concat_ws(chr(10), claim_text, passage))"
_FAILURES = (
    "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {bad} THEN '{code}' END" for code, bad in {
            "no_subject": _blank("subject"), "no_predicate": _blank("predicate"), "no_object": _blank("object"), "no_passage": _blank("passage"), "no_url": _blank("url"), "long_passage": f"length(passage) > {relevance.LONGEST_PASSAGE}",
            "other_subject": "relevance = 'DIRECT' AND NOT contains(lower(subject), lower(trim(target)))", "call": _match(_BOTH, relevance.CALLS), "navigation": _match(_BOTH, relevance.NAVIGATION), "fragment": _FRAGMENT("claim_text"),
            "verse": _match(_BOTH, relevance.VERSE), "single_letter": r"regexp_full_match(trim(subject), '\p{L}') OR regexp_full_match(trim(object), '\p{L}')", "no_verb": f"NOT {_match('lower(claim_text)', relevance.FACTUAL)}",
        }.items()
    ) + "], lambda x: x IS NOT NULL), ' ')"
)


@query(f"SELECT evidence_id, sentence_no, {_FAILURES} AS failures FROM {_CLAIMS}")
def claim_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The gate's checks that each extracted claim fails."""
    rows = relevance.judged(relevance.claims_of(relevance.label_records(table(spark, sf, "evidence")), "evidence_id"))
    return rows.select("evidence_id", "sentence_no", F.array_join("failures", " ").alias("failures"))


@query(f"SELECT seq, {_FAILURES} AS failures FROM (SELECT seq, subject, predicate, object, claim_text, evidence_passage AS passage, source_url AS url, relevance, coalesce(subject, '') AS target FROM atomic_claims)")
def claim_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The gate's checks that each claim at hand fails; its subject is its target."""
    rows = table(spark, sf, "atomic_claims").select("seq", "subject", "predicate", "object", "claim_text", F.col("evidence_passage").alias("passage"), F.col("source_url").alias("url"), "relevance", F.coalesce("subject", F.lit("")).alias("target"))
    return relevance.judged(rows).select("seq", F.array_join("failures", " ").alias("failures"))


_KEY = "concat_ws('|', " + ", ".join(f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')" for c in ("subject", "predicate", "object")) + ")"


@query(f"""WITH good AS (SELECT *, {_KEY} AS claim_key FROM {_CLAIMS} WHERE {_FAILURES} = '')
SELECT claim_key, evidence_id, sentence_no, subject, predicate, object, relevance, evidence_type, n_claims FROM
 (SELECT *, count(*) OVER (PARTITION BY claim_key) AS n_claims, row_number() OVER (PARTITION BY claim_key ORDER BY confidence DESC, relevance = 'DIRECT' DESC, length(passage) DESC, evidence_id, sentence_no) AS r FROM good) WHERE r = 1""")
def evidence_claims(spark: SparkSession, sf: str) -> DataFrame:
    """From records to the strongest valid claims in one: relevance, extraction, gate, deduplication."""
    return relevance.pipeline(table(spark, sf, "evidence"), "evidence_id")


# ---------------------------------------------------------------------------------------------
# Classes.

_CLEAN = lambda x: rf"nullif(regexp_replace({x}, '^[\s.]+|[\s.]+$', '', 'g'), '')"
_REL, _ASSOC = v.longest_first(v.RELATIONSHIPS), v.longest_first(v.ASSOCIATIONS)
_SECTOR_WORDS = [x.lower() for x in v.longest_first(v.SECTORS)]


def _triples(source: str) -> str:
    """SQL of the subject, predicate and object of ``source``, a relation with seq, owner, said, subject, predicate and object."""
    shape = " ".join(f"WHEN {_match('said', s)} THEN {i}" for i, s in enumerate(classify.shapes(), 1))
    part = lambda k: "CASE k " + " ".join(f"WHEN {i} THEN regexp_extract(said, {_q(s)}, {k})" for i, s in enumerate(classify.shapes(), 1)) + " END"
    given = "coalesce(nullif(subject, ''), nullif(predicate, ''), nullif(object, '')) IS NOT NULL"
    return f"""(SELECT seq, owner, said, lower(said) AS low, {_CLEAN(f"CASE WHEN {given} THEN subject ELSE {part(1)} END")} AS s, {_CLEAN(f"CASE WHEN {given} THEN predicate ELSE lower({part(2)}) END")} AS p0, {_CLEAN(f"CASE WHEN {given} THEN object ELSE {part(3)} END")} AS o
 FROM (SELECT *, CASE {shape} END AS k FROM {source}))"""


def _classes(source: str) -> str:
    """SQL that classifies ``source``, a relation as ``_triples`` has it."""
    triple = _triples(source)
    at = lambda b, x: f"instr(sq, {b} || ' ' || {x} || ' ')"
    rest = lambda b, x: f"trim(regexp_extract(substr(sq, {at(b, x)} + length({b}) + length({x}) + 2), '^([^.]*)', 1))"
    fit = lambda b, least: f"list_filter({_list(_REL)}, lambda x: {at(b, 'x')} > {least} AND {rest(b, 'x')} <> '' AND {rest(b, 'x')} <> who)[1]"
    named = "CASE WHEN contains(lt, 'cooperation') OR contains(lt, 'pool') THEN 'cooperation' WHEN contains(lt, 'authority') THEN 'regulatory authority' WHEN contains(lt, 'development') AND contains(lt, 'community') THEN 'development community' ELSE 'organization' END"
    kind = f"coalesce({_first('lt', v.longest_first(v.CONCEPTS))}, {_first('lt', v.longest_first(v.KINDS))}, CASE WHEN {_match('lt', v.any_word(['body']))} THEN 'Body' END, CASE WHEN {_has('lt', classify.NAME_WORDS)} THEN {named} END)"
    place = "coalesce(" + ", ".join(f"CASE WHEN contains(low, {_q(k)}) THEN {_q(n)} END" for k, n in classify._PLACES.items()) + f", {_first('low', [x for x in v.longest_first(v.REGIONS + v.COUNTRIES) if x not in classify._PLACES])}, nullif({_title(f'trim(regexp_extract(said, {_q(classify.PLACED)}, 1))')}, ''))"
    sector = f"coalesce({_title(_first('low', _SECTOR_WORDS))}, " + ", ".join(f"nullif({_title(f'trim(regexp_extract(low, {_q(s)}, 1))')}, '')" for s in (classify.IN_SECTOR, classify.IN_INDUSTRY)) + ")"
    field = f"CASE WHEN {_match('low', classify.IS_A)} AND {_has('low', v.KINDS)} THEN 'entity_type' WHEN {_has('low', v.PLACE_WORDS)} THEN 'country' WHEN {_has('low', _SECTOR_WORDS)} THEN 'sector' WHEN {_match('low', v.any_word(v.STATUSES))} THEN 'status' END"
    sub = "CASE " + " ".join(f"WHEN contains(both_, {_q(k)}) THEN {_q(v.SUBTYPES[k])}" for k in v.longest_first(v.SUBTYPES)) + " END"
    dt = f"trim(regexp_extract(low, {_q(classify.DESCRIBED)}, 1))"
    cols = f"""(SELECT *, coalesce(p IN ({', '.join(map(_q, v.RELATIONSHIPS))}), false) AS related, {_has('low', classify.UNCLEAR)} AS unclear, {kind} AS kind, {place} AS place, {sector} AS sector, {field} AS field_, {sub} AS sub, {dt} AS dt,
 CASE WHEN who <> '' THEN {fit('who', 0)} END AS v1, {fit("''", 1)} AS v2 FROM
 (SELECT *, lower(p0) AS p, lower(o) AS lt, lower(coalesce(s, '')) AS who, {sql.squeeze('low')} AS sq, lower(concat_ws(chr(10), o, said)) AS both_ FROM {triple}))"""
    rules = f"""CASE WHEN low = '' THEN 'empty' WHEN p IN ('is', 'is_a', 'is_an') AND kind IS NOT NULL THEN 'is_a'
 WHEN related AND o IS NOT NULL AND NOT {_match('low', v.any_word(classify.ACTIVITIES))} AND lt NOT IN ('in', 'a', 'an', 'the', 'is', 'was', 'are', 'were') THEN 'direct'
 WHEN {_has('low', v.SUMMARIES)} OR {_match('low', classify.REGULATES)} OR (coalesce(p IN ('regulates', 'manages', 'oversees'), false) AND {_match('low', v.any_word([*classify.ACTIVITIES[:4], 'system', 'licensing']))}) THEN 'summary'
 WHEN NOT unclear AND {_has('low', v.ASSOCIATIONS)} THEN 'association' WHEN unclear THEN 'unclear' WHEN NOT related AND field_ IS NOT NULL THEN 'field' WHEN place IS NOT NULL THEN 'place' WHEN sector IS NOT NULL AND NOT related THEN 'sector'
 WHEN v1 IS NOT NULL OR v2 IS NOT NULL THEN 'verb' WHEN s IS NOT NULL AND ((contains(low, lower(s)) AND {_has('low', v.DESCRIPTIVE)}) OR {_has('low', classify.GENERAL)}) THEN 'described' WHEN {_has('dt', classify.TYPED)} THEN 'described_type' ELSE 'none' END"""
    return f"""(SELECT seq, owner, said, rule,
 CASE WHEN rule IN ('is_a', 'field', 'place', 'sector', 'described_type') THEN 'METADATA' WHEN rule IN ('direct', 'verb') THEN 'RELATIONSHIP' WHEN rule IN ('summary', 'described') THEN 'SUMMARY' WHEN rule = 'association' THEN 'ASSOCIATION' ELSE 'UNCLASSIFIED' END AS category,
 CASE rule WHEN 'empty' THEN NULL WHEN 'place' THEN place WHEN 'sector' THEN sector WHEN 'verb' THEN CASE WHEN v1 IS NOT NULL THEN {rest('who', 'v1')} ELSE {rest("''", 'v2')} END WHEN 'described' THEN s WHEN 'described_type' THEN upper(dt[1:1]) || dt[2:] ELSE o END AS target,
 CASE rule WHEN 'empty' THEN NULL WHEN 'is_a' THEN 'is' WHEN 'direct' THEN p WHEN 'summary' THEN coalesce(p0, {_first('low', _REL)}, {_first('low', _ASSOC)}, 'describes') WHEN 'association' THEN coalesce(p, 'connected_to') WHEN 'field' THEN coalesce(p0, 'is')
  WHEN 'place' THEN 'located_in' WHEN 'sector' THEN 'operates_in' WHEN 'verb' THEN coalesce(v1, v2) WHEN 'described' THEN 'describes' WHEN 'described_type' THEN 'is' ELSE p0 END AS predicate,
 CASE rule WHEN 'is_a' THEN 'entity_type' WHEN 'field' THEN field_ WHEN 'place' THEN 'country' WHEN 'sector' THEN 'sector' WHEN 'described_type' THEN 'entity_type' END AS field,
 CASE WHEN rule = 'is_a' OR rule = 'field' AND field_ = 'entity_type' THEN sub END AS subtype FROM (SELECT *, {rules} AS rule FROM {cols}))"""


_GIVEN_ROWS = "(SELECT seq, subject AS owner, trim(coalesce(claim_text, '')) AS said, subject, predicate, object FROM atomic_claims)"
_SPOKEN_ROWS = "(SELECT seq, subject AS owner, trim(coalesce(claim_text, '')) AS said, NULL::VARCHAR AS subject, NULL::VARCHAR AS predicate, NULL::VARCHAR AS object FROM atomic_claims)"
_GIVEN, _SPOKEN = _classes(_GIVEN_ROWS), _classes(_SPOKEN_ROWS)


@query(f"SELECT seq, s AS subject, p0 AS predicate, md5(o) AS object FROM {_triples(_SPOKEN_ROWS)} WHERE s IS NOT NULL")
def triplet_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Subject, predicate and object of each claim's text, by the first shape that it has."""
    none, said = F.lit(None).cast("string"), F.trim(F.coalesce("claim_text", F.lit("")))
    rows = table(spark, sf, "atomic_claims").select("seq", said.alias("said"))
    return bound(rows, "t", classify.triplet(F.col("said"), none, none, none)).where("t.s is not null").select("seq", F.col("t.s").alias("subject"), F.col("t.p").alias("predicate"), F.md5("t.o").alias("object"))


_COLUMNS = "seq, category, target, predicate, field, subtype, rule"


@query(f"SELECT {_COLUMNS} FROM {_GIVEN}")
def claim_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of each claim, by its given parts first."""
    return classify.classify(table(spark, sf, "atomic_claims")).select("seq", "label.*")


@query(f"SELECT {_COLUMNS} FROM {_SPOKEN}")
def claim_text_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of each claim by its text alone."""
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "atomic_claims").select("seq", "claim_text", none.alias("subject"), none.alias("predicate"), none.alias("object"))
    return classify.classify(rows).select("seq", "label.*")


_ITEM = "CASE category WHEN 'METADATA' THEN coalesce(field, 'metadata') || '::' || coalesce(target, said) WHEN 'RELATIONSHIP' THEN predicate || '::[[' || target || ']]' WHEN 'ASSOCIATION' THEN predicate || '::[[' || target || ']]' ELSE said END"


@query(f"SELECT owner AS subject, category, item, min(seq) AS first_seq, count(*) AS n FROM (SELECT *, {_ITEM} AS item FROM {_GIVEN}) WHERE coalesce(item, '') <> '' GROUP BY ALL")
def claim_route(spark: SparkSession, sf: str) -> DataFrame:
    """What each subject's claims add to its row, by category, each item once."""
    return classify.routed(table(spark, sf, "atomic_claims"), "subject", "seq")


@query("SELECT owner AS subject, " + ", ".join(f"arg_min(target, seq) FILTER (field = '{f}' AND target IS NOT NULL) AS {f}" for f in ("entity_type", "country", "sector", "status")) + f", arg_min(subtype, seq) FILTER (subtype IS NOT NULL) AS subtype FROM {_GIVEN} WHERE category = 'METADATA' GROUP BY owner")
def field_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The first value of each field that a subject's claims give."""
    return classify.selected_fields(table(spark, sf, "atomic_claims"), "subject", "seq")
