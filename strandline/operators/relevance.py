"""Which evidence tells of an entity, the claims that its sentences make, and the gate that claims pass.

Everything is a label or a struct made by column expressions, one row per record, sentence or claim;
phrases are looked for in lower-case text with even blanks. Where several phrases fit, the longest
counts, then the first by the alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text, vocabulary as v
from strandline.operators import dedup
from strandline.operators.quality import BLOCK, ERROR
from strandline.seq import bound

PREDICATES = v.longest_first(v.RELATIONSHIPS + v.ASSOCIATIONS)
#: Longest passage that a claim may rest on.
LONGEST_PASSAGE = 1000
_EDGE, _SHUT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
BOILERPLATE = v.any_word(v.BOILERPLATE) + r"|[0-9]+%|" + _EDGE + r"[0-9]+\s+[a-z]+\s+[0-9]+:[0-9]+" + _SHUT
CALLS, NAVIGATION, FACTUAL = v.any_word(v.CALLS), v.any_word(v.NAVIGATION), v.any_word(v.FACTUAL)
VERSE = _EDGE + r"[0-9]+\s+[A-Za-z]+\s+[0-9]+:[0-9]+" + _SHUT
_ARE = "(?:is|are|was|were)"
_AN = "(?:a|an|the)"


def quoted(c: Column) -> Column:
    """A text as a pattern that finds it literally."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))


def _has_any(c: Column, phrases) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: c.contains(p))


def _first_of(c: Column, phrases) -> Column:
    """The first of the phrases that the text holds; null for none."""
    return F.try_element_at(F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: c.contains(p)), F.lit(1))


def refers(low: Column, target: Column) -> Column:
    """Does a lower-case text hold the target's name, or one or two neighbouring words of it?"""
    words = F.filter(F.split(target, r"\s+"), lambda w: w != "")
    pairs = F.transform(words, lambda w, i: F.concat_ws(" ", F.slice(words, i + 1, F.lit(2))))
    return (target != "") & (low.contains(target) | (F.size(words) > 1) & (F.exists(words, lambda w: low.contains(w)) | F.exists(pairs, lambda p: low.contains(p))))


def mostly(low: Column, words) -> Column:
    """More than half of a text's words are of a list."""
    given = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    return F.coalesce(F.size(F.filter(given, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]+", "").isin(*words))) * 2 > F.size(given), F.lit(False))


def authoritative(normalized: Column, content: Column, snippet: Column) -> Column:
    return F.coalesce(text.nonempty(normalized), text.nonempty(content), snippet, F.lit(""))


def record_label(url: Column, low: Column, name: Column, unusable: Column) -> Column:
    """(label, reason) of a record, from its text and target in lower case: DIRECT, or IRRELEVANT and why."""
    reason = (
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "no_url").when(F.trim(low) == "", "empty_text").when(_has_any(low, BLOCK) | _has_any(low, ERROR), "block_or_error")
        .when(refers(low, name), "target").when(F.coalesce(unusable, F.lit(False)), "unusable").otherwise("no_relation")
    )
    return F.struct(F.when(reason == "target", "DIRECT").otherwise("IRRELEVANT").alias("label"), reason.alias("reason"))


def label_records(evidence: DataFrame) -> DataFrame:
    """``evidence`` with body, relevance and reason. Null texts are empty ones, null targets never referred to."""
    body = authoritative(F.col("normalized_text"), F.col("content"), F.col("snippet"))
    rows = bound(evidence, "body", body)
    rows = bound(rows, "_n", F.struct(F.lower("body").alias("low"), F.lower(F.trim(F.coalesce("entity_name", F.lit("")))).alias("name")))
    label = record_label(F.col("url"), F.col("_n.low"), F.col("_n.name"), F.upper(F.trim("evidence_status")) == "UNUSABLE")
    return bound(rows, "_r", label).withColumn("relevance", F.col("_r.label")).withColumn("reason", F.col("_r.reason")).drop("_r", "_n")


def sentence_label(sentence: Column, target: Column) -> Column:
    """DIRECT, RELATED or IRRELEVANT: a sentence about the target, one with a predicate beside it, any other."""
    low, name = F.lower(sentence), F.lower(F.trim(F.coalesce(target, F.lit(""))))
    whole = (name != "") & low.contains(name)
    spaced = tuple(dict.fromkeys(p.replace("_", " ") for p in PREDICATES))
    about = F.regexp_like(low, F.concat(F.lit(_EDGE), quoted(name), F.lit(r"\s+[a-z]+\s"))) | (F.position(name, low) <= 50)
    return (
        F.when(whole & about, "DIRECT").when(whole & _has_any(low, spaced), "RELATED").when(refers(low, name), "DIRECT").otherwise("IRRELEVANT")
    )


def irrelevant_sentence(sentence: Column) -> Column:
    return F.lower(sentence).rlike(BOILERPLATE) | text.fragment(sentence)


CLAIM = "subject predicate object claim_text relevance evidence_type confidence quality_status method".split()


def _spaced(p: Column) -> Column:
    return F.replace(p, F.lit("_"), F.lit(" "))


def _leads(low: Column, name: Column, p: Column) -> Column:
    """A text begins with the name and the predicate, and goes on."""
    return F.startswith(low, F.concat(name, F.lit(" "), _spaced(p), F.lit(" "))) & (F.length(low) > F.length(name) + F.length(p) + 2)


def _before_name(low: Column, name: Column, p: Column) -> Column:
    """Length of what stands before the predicate and the name; 0 if they don't follow anything."""
    return F.position(F.concat(F.lit(" "), _spaced(p), F.lit(" "), name), F.substr(low, F.lit(2)))


def with_claims(sentences: DataFrame) -> DataFrame:
    """``sentences`` (passage, target) with ``c``, the one claim of each about the target; others are left out.

    A predicate beside the name comes first, then what the target is, its sector, place or state, then a
    description; any other sentence is kept for review.
    """
    rows = bound(sentences, "_s", F.struct(text.squeeze(F.col("passage")).alias("s"), F.trim(F.coalesce("target", F.lit(""))).alias("t")))
    rows = bound(rows, "_l", F.struct(F.lower("_s.s").alias("low"), F.lower("_s.t").alias("name"))).where("_l.name <> '' and contains(_l.low, _l.name)")
    low, name = F.col("_l.low"), F.col("_l.name")
    rows = bound(rows, "_p", F.try_element_at(F.filter(F.array(*[F.lit(x) for x in PREDICATES]), lambda x: _leads(low, name, x) | (_before_name(low, name, x) > 0)), F.lit(1)))
    rows = bound(rows, "_w", F.struct(_leads(low, name, F.col("_p")).alias("first"), _before_name(low, name, F.col("_p")).alias("at")))
    s, t, p, first, at = F.col("_s.s"), F.col("_s.t"), F.col("_p"), F.col("_w.first"), F.col("_w.at")
    kind = F.when(p.isin(*v.RELATIONSHIPS), "RELATIONSHIP").otherwise("ASSOCIATION")
    made = lambda *c: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in zip(c, CLAIM)])
    subject = F.when(first, F.substr(s, F.lit(1), F.length(name))).otherwise(F.substr(s, F.lit(1), at))
    obj = F.when(first, F.substr(s, F.length(name) + F.length(p) + 3)).otherwise(F.substr(s, at + F.length(p) + 3, F.length(name)))
    triple = made(subject, p, obj, F.concat_ws(" ", subject, _spaced(p), obj), F.when(first, "DIRECT").otherwise("RELATED"), kind, 0.8, "VALID", "pattern_match")
    group = lambda pattern: F.call_function("regexp_extract", low, pattern, F.lit(1))
    after = group(F.concat(F.lit(_EDGE), quoted(name), F.lit(rf"\s+{_ARE}\s+{_AN}\s+([a-z0-9\s-]+)")))
    before = group(F.concat(F.lit(rf"{_ARE}\s+{_AN}\s+([a-z0-9\s-]+)\s+"), quoted(name)))
    value = text.title_case(F.trim(F.coalesce(text.nonempty(after), text.nonempty(before))))
    sector, place, state = _first_of(low, [x.lower() for x in v.longest_first(v.SECTORS)]), _first_of(low, v.longest_first(v.REGIONS + v.COUNTRIES)), _first_of(low, v.longest_first(v.STATUSES))
    fact = lambda pred, said, x: made(t, pred, x, F.concat_ws(" ", t, F.lit(said), x), "DIRECT", "ATTRIBUTE", 0.9, "VALID", "attribute_extraction")
    told = F.regexp_like(low, F.concat(F.lit(_EDGE), quoted(name), F.lit(rf"\s+(?:is|are|was|were|{'|'.join(v.TOLD)})\s")))
    note = lambda confidence, status, method: made(t, "describes", s, s, "DIRECT", "SUMMARY", confidence, status, method)
    claim = (
        F.when(p.isNotNull(), triple).when(F.coalesce(value, F.lit("")) != "", fact("is", "is", value)).when(sector.isNotNull(), fact("operates_in", "operates in", text.title_case(sector)))
        .when(place.isNotNull(), fact("located_in", "is located in", place)).when(state.isNotNull(), fact("has_status", "has status", state))
        .when(told, note(0.8, "VALID", "summary_extraction")).otherwise(note(0.5, "NEEDS_REVIEW", "fallback"))
    )
    return bound(rows, "c", claim).drop("_s", "_l", "_p", "_w")


def claims_of(labelled: DataFrame, ident: str) -> DataFrame:
    """Claims of the sentences of relevant records: (ident, sentence_no, target, passage, url, and the claim's fields)."""
    sentences = labelled.where("relevance <> 'IRRELEVANT'").select(F.col(ident), F.col("entity_name").alias("target"), F.col("url"), F.posexplode(text.pieces(F.col("body"))).alias("sentence_no", "passage"))
    return with_claims(sentences.where(~irrelevant_sentence(F.col("passage")))).select(ident, "sentence_no", "target", F.col("passage"), "url", "c.*")


def gate_failures(subject: Column, predicate: Column, obj: Column, claim: Column, passage: Column, url: Column, relevance: Column, target: Column) -> Column:
    """Codes of the checks that a claim fails, in order; an empty list lets it pass."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    low = F.lower(F.concat_ws("\n", claim, passage))
    single = lambda c: F.trim(c).rlike(r"^\p{L}$")
    own = F.lower(F.trim(target))
    checks = {
        "no_subject": blank(subject), "no_predicate": blank(predicate), "no_object": blank(obj), "no_passage": blank(passage), "no_url": blank(url), "long_passage": F.length(passage) > LONGEST_PASSAGE,
        "other_subject": (relevance == "DIRECT") & ~F.lower(subject).contains(own), "call": low.rlike(CALLS), "navigation": low.rlike(NAVIGATION), "fragment": text.fragment(claim), "verse": low.rlike(VERSE),
        "single_letter": single(subject) | single(obj), "no_verb": ~F.lower(claim).rlike(FACTUAL),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in checks.items()]))


def judged(claims: DataFrame) -> DataFrame:
    """``claims`` with the checks that each fails."""
    c = F.col
    return bound(claims, "failures", gate_failures(c("subject"), c("predicate"), c("object"), c("claim_text"), c("passage"), c("url"), c("relevance"), c("target")))


def pipeline(evidence: DataFrame, ident: str) -> DataFrame:
    """Relevance, claims, gate and deduplication in one: the strongest valid claim of each subject, predicate and object.

    Per claim key: the row of most confidence, direct before related, then the longest passage, then the
    first. Rows are reduced before they are shuffled.
    """
    good = judged(claims_of(label_records(evidence), ident)).where("size(failures) = 0")
    keyed = good.withColumn("claim_key", dedup.claim_key(F.col("subject"), F.col("predicate"), F.col("object")))
    strength = F.struct("confidence", (F.col("relevance") == "DIRECT").alias("direct"), F.length("passage").alias("n"), (-F.col(ident)).alias("i"), (-F.col("sentence_no")).alias("k"))
    best = F.max_by(F.struct(ident, "sentence_no", "subject", "predicate", "object", "relevance", "evidence_type"), strength)
    return keyed.groupBy("claim_key").agg(best.alias("b"), F.count(F.lit(1)).alias("n_claims")).select("claim_key", "b.*", "n_claims")
