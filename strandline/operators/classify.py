"""Claims sorted into what they say of an entity: a field of its row, a relationship, an association, a
summary, or nothing that the rules know. Column expressions only; the order of the rules is the order below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text, vocabulary as v
from strandline.operators.relevance import _first_of, _has_any
from strandline.seq import bound

# Words of activities that are regulated, not entities; verbs that regulate; unclear words.
ACTIVITIES = ("sector", "industry", "market", "activity", "supply chain", "system", "policy")
REGULATING = ("regulates", "manages", "oversees")
UNCLEAR = ("unclear", "various", "miscellaneous")
# Words of a name that make it an organisation's; phrases that describe.
NAME_WORDS = ("power", "electricity", "energy", "development", "community", "southern", "african", "regulatory", "authority")
GENERAL = ("is a", "are a", "was a", "were a", "is an", "are an", "functions as", "operates as", "serves as", "acts as", "provides", "supports", "coordinates", "manages")
TYPED = ("cooperation", "pool", "authority", "agency", "organization", "company", "institution", "body", "commission", "council")
_PLACES = {"southern africa": "Southern Africa", "sadc": "SADC", "southern african development community": "Southern African Development Community", "africa": "Africa"}
_STOP = ("in", "a", "an", "the", "is", "was", "are", "were")
IS_A = r"(?i)(?:^|[^\p{L}\p{N}_])(?:is|are|was|were)\s+(?:a|an)\s+"
REGULATES = r"(?:^|[^\p{L}\p{N}_])(?:regulates|manages|oversees)\s+(?:the\s+)?[a-z0-9\s'\-]+(?:sector|industry|market|activity|licensing|system)(?:$|[^\p{L}\p{N}_])"
PLACED = r"(?i)(?:located|based|situated|operates|headquartered|registered|incorporated)\s+(?:in\s+)?([a-z][a-z\s-]+)"
_WITHIN = r"(?:in the|works in|active in|focused on|specializes in|operates in|involved in|participates in)\s+"
IN_SECTOR, IN_INDUSTRY = _WITHIN + r"([a-z0-9_\s-]+\s+sector)", _WITHIN + r"([a-z0-9_]+)\s+industry"
DESCRIBED = r"(?:^|[^\p{L}\p{N}_])(?:(?:is|are|was|were|functions as|operates as|acts as|serves as)\s+(?:a|an|the)|known as|referred to as|called|also known as)\s+([a-z0-9\s-]+)"
FIELDS = "category target predicate field subtype rule".split()


def _alternatives(phrases) -> str:
    return "|".join(v.longest_first(phrases))


def shapes() -> list[str]:
    """Patterns of a claim's text, tried in this order: is-a, relationship, association, place, sector."""
    middle = [
        "is a|is an|is|are a|are an|are", _alternatives(v.RELATIONSHIPS), _alternatives(v.ASSOCIATIONS), _alternatives(v.PLACE_WORDS),
    ]
    sectors = _alternatives([x.lower() for x in v.SECTORS])
    return [rf"(?i)^(.+?)\s+({m})\s+(.+)$" for m in middle] + [rf"(?i)^(.+?)\s+(operates in|in the|works in|active in|focused on)\s+({sectors}|[a-z0-9_]+ sector|[a-z0-9_]+ industry)"]


def cleaned(c: Column) -> Column:
    """Without blanks and full stops around it; null if nothing is left."""
    return text.nonempty(F.regexp_replace(c, r"^[\s.]+|[\s.]+$", ""))


def triplet(claim: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    """(subject, predicate, object): as given if any is, else by the first shape that the text has."""
    given = F.coalesce(text.nonempty(subject), text.nonempty(predicate), text.nonempty(obj)).isNotNull()
    out = F.when(given, F.struct(cleaned(subject).alias("s"), cleaned(predicate).alias("p"), cleaned(obj).alias("o")))
    for shape in shapes():
        part = lambda i, shape=shape: F.regexp_extract(claim, shape, i)
        out = out.when(claim.rlike(shape), F.struct(cleaned(part(1)).alias("s"), F.lower(cleaned(part(2))).alias("p"), cleaned(part(3)).alias("o")))
    return out.otherwise(F.struct(*[F.lit(None).cast("string").alias(n) for n in "spo"]))


def entity_type_of(low: Column) -> Column:
    """The kind that an is-a claim's target, in lower case, names: a concept, another kind, a body, or by the words of a name."""
    named = (
        F.when(low.contains("cooperation") | low.contains("pool"), "cooperation").when(low.contains("authority"), "regulatory authority")
        .when(low.contains("development") & low.contains("community"), "development community").otherwise("organization")
    )
    return F.coalesce(_first_of(low, v.longest_first(v.CONCEPTS)), _first_of(low, v.longest_first(v.KINDS)), F.when(low.rlike(v.any_word(["body"])), "Body"), F.when(_has_any(low, NAME_WORDS), named))


def location_of(claim: Column, low: Column) -> Column:
    """``low``: the claim in lower case, a column of its own, as every phrase is looked for in it."""
    fixed = F.coalesce(*[F.when(low.contains(k), name) for k, name in _PLACES.items()])
    others = [x for x in v.longest_first(v.REGIONS + v.COUNTRIES) if x not in _PLACES]
    return F.coalesce(fixed, _first_of(low, others), text.nonempty(text.title_case(F.trim(F.regexp_extract(claim, PLACED, 1)))))


def sector_of(low: Column) -> Column:
    found = _first_of(low, [x.lower() for x in v.longest_first(v.SECTORS)])
    within = [text.nonempty(text.title_case(F.trim(F.regexp_extract(low, shape, 1)))) for shape in (IN_SECTOR, IN_INDUSTRY)]
    return F.coalesce(text.title_case(found), *within)


def verb_relation(low: Column, who: Column) -> Column:
    """(predicate, target) of the longest relationship verb after the subject ``who``, else after anything.

    ``low`` is the claim in lower case with even blanks; both are columns of their own.
    """
    verbs = F.array(*[F.lit(p) for p in v.longest_first(v.RELATIONSHIPS)])

    def found(before: Column, least: int) -> Column:
        places = F.transform(verbs, lambda p: F.struct(p.alias("p"), F.position(F.concat(before, F.lit(" "), p, F.lit(" ")), low).alias("at")))
        rest = lambda x: F.trim(F.regexp_extract(F.substr(low, x["at"] + F.length(before) + F.length(x["p"]) + 2), r"^([^.]*)", 1))
        told = F.transform(F.filter(places, lambda x: x["at"] > least), lambda x: F.struct(x["p"].alias("p"), rest(x).alias("t")))
        return F.try_element_at(F.filter(told, lambda x: (x["t"] != "") & (x["t"] != who)), F.lit(1))

    return F.coalesce(F.when(who != "", found(who, 0)), found(F.lit(""), 1))


def described_type(claim: Column) -> Column:
    x = F.trim(F.regexp_extract(F.lower(claim), DESCRIBED, 1))
    return F.when(_has_any(x, TYPED), F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))


def subtype_of(claim: Column, target: Column) -> Column:
    both = F.lower(F.concat_ws("\n", target, claim))
    return F.coalesce(*[F.when(both.contains(k), v.SUBTYPES[k]) for k in v.longest_first(v.SUBTYPES)])


def metadata_field(low: Column) -> Column:
    return (
        F.when(low.rlike(IS_A) & _has_any(low, v.KINDS), "entity_type").when(_has_any(low, v.PLACE_WORDS), "country")
        .when(_has_any(low, [x.lower() for x in v.SECTORS]), "sector").when(low.rlike(v.any_word(v.STATUSES)), "status")
    )


def spoken_predicate(low: Column) -> Column:
    return F.coalesce(_first_of(low, v.longest_first(v.RELATIONSHIPS)), _first_of(low, v.longest_first(v.ASSOCIATIONS)))


def classify(claims: DataFrame) -> DataFrame:
    """``claims`` (claim_text, subject, predicate, object) with category, target, predicate, field, subtype, rule in ``label``.

    Null or blank texts are UNCLASSIFIED. Columns of the claims are kept; one called ``label`` is replaced.
    """
    rows = bound(claims.drop("label"), "_said", F.trim(F.coalesce("claim_text", F.lit(""))))
    rows = bound(rows, "_t", triplet(F.col("_said"), F.col("subject"), F.col("predicate"), F.col("object")))
    low = F.lower("_said")
    rows = bound(rows, "_x", F.struct(low.alias("low"), text.squeeze(low).alias("even"), F.lower("_t.p").alias("p"), F.lower(F.coalesce("_t.s", F.lit(""))).alias("who"), F.lower("_t.o").alias("to")))
    said, s, p, o, low = F.col("_said"), F.col("_t.s"), F.col("_x.p"), F.col("_t.o"), F.col("_x.low")
    related = F.coalesce(p.isin(*v.RELATIONSHIPS), F.lit(False))
    active = low.rlike(v.any_word(ACTIVITIES))
    unclear, sector, place, field = _has_any(low, UNCLEAR), sector_of(low), location_of(said, low), metadata_field(low)
    direct = related & o.isNotNull() & ~active & ~F.lower(o).isin(*_STOP)
    summary = _has_any(low, v.SUMMARIES) | low.rlike(REGULATES) | (F.coalesce(p.isin(*REGULATING), F.lit(False)) & low.rlike(v.any_word([*ACTIVITIES[:4], "system", "licensing"])))
    verb = verb_relation(F.col("_x.even"), F.col("_x.who"))
    described = s.isNotNull() & ((low.contains(F.lower(s)) & _has_any(low, v.DESCRIPTIVE)) | _has_any(low, GENERAL))
    made = lambda *c: F.struct(*[(x if isinstance(x, Column) else F.lit(x).cast("string")).alias(n) for x, n in zip(c, FIELDS)])
    label = (
        F.when(low == "", made("UNCLASSIFIED", None, None, None, None, "empty"))
        .when(p.isin("is", "is_a", "is_an") & entity_type_of(F.col("_x.to")).isNotNull(), made("METADATA", o, "is", "entity_type", subtype_of(said, o), "is_a"))
        .when(direct, made("RELATIONSHIP", o, p, None, None, "direct"))
        .when(summary, made("SUMMARY", o, F.coalesce(F.col("_t.p"), spoken_predicate(low), F.lit("describes")), None, None, "summary"))
        .when(~unclear & _has_any(low, v.ASSOCIATIONS), made("ASSOCIATION", o, F.coalesce(p, F.lit("connected_to")), None, None, "association"))
        .when(unclear, made("UNCLASSIFIED", o, F.col("_t.p"), None, None, "unclear"))
        .when(~related & field.isNotNull(), made("METADATA", o, F.coalesce(F.col("_t.p"), F.lit("is")), field, F.when(field == "entity_type", subtype_of(said, o)), "field"))
        .when(place.isNotNull(), made("METADATA", place, "located_in", "country", None, "place"))
        .when(sector.isNotNull() & ~related, made("METADATA", sector, "operates_in", "sector", None, "sector"))
        .when(verb.isNotNull(), made("RELATIONSHIP", verb["t"], verb["p"], None, None, "verb"))
        .when(described, made("SUMMARY", s, "describes", None, None, "described"))
        .when(described_type(said).isNotNull(), made("METADATA", described_type(said), "is", "entity_type", None, "described_type"))
        .otherwise(made("UNCLASSIFIED", o, F.col("_t.p"), None, None, "none"))
    )
    return bound(rows, "label", label).drop("_said", "_t", "_x")


def rendered(label: Column, claim: Column) -> Column:
    """A claim as its row holds it: ``field::value``, ``predicate::[[target]]``, or its text."""
    target, said = F.coalesce(label["target"], F.trim(claim)), F.trim(claim)
    route = F.concat(label["predicate"], F.lit("::[["), label["target"], F.lit("]]"))
    return F.when(label["category"] == "METADATA", F.concat(F.coalesce(label["field"], F.lit("metadata")), F.lit("::"), target)).when(label["category"].isin("RELATIONSHIP", "ASSOCIATION"), route).otherwise(said)


def routed(claims: DataFrame, owner: str, seq: str) -> DataFrame:
    """(owner, category, item, first_seq, n): the distinct items of each category of each owner, in order of ``first_seq``."""
    rows = bound(classify(claims), "item", rendered(F.col("label"), F.col("claim_text"))).select(owner, F.col("label.category").alias("category"), "item", seq)
    return rows.where("coalesce(item, '') <> ''").groupBy(owner, "category", "item").agg(F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("n"))


def selected_fields(claims: DataFrame, owner: str, seq: str) -> DataFrame:
    """(owner, entity_type, country, sector, status, subtype): per field the first value that a claim gives."""
    rows = classify(claims).where("label.category = 'METADATA'")
    first = lambda f: F.min_by(F.col("label.target"), F.when((F.col("label.field") == f) & F.col("label.target").isNotNull(), F.col(seq))).alias(f)
    return rows.groupBy(owner).agg(*[first(f) for f in ("entity_type", "country", "sector", "status")], F.min_by("label.subtype", F.when(F.col("label.subtype").isNotNull(), F.col(seq))).alias("subtype"))
