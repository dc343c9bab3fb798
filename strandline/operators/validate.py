"""What is wrong with the rows of the registry, which links may stand in them, and what kind of source an address is.

Each check is a code; a row's codes come as rows of their own, so that bad rows can be set aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text, vocabulary as v
from strandline.operators.relevance import _EDGE, _SHUT, quoted

# Words that no link's target, alias or summary has.
TARGET_WORDS = ("now", "open", "apply", "click", "here", "more", "read", "learn", "join", "sign", "up", "register", "home", "about", "contact", "menu", "back", "next", "previous")
ALIAS_WORDS = ("now", "open", "apply", "click", "here")
SUMMARY_WORDS = ("now", "apply", "click", "here", "more", "register", "sign")
# Verbs of which a summary has one, beside the predicates of relationships.
SUMMARY_VERBS = ("is", "are", "was", "were")
VERSE = r"[0-9]\s+[A-Za-z]+\s+[0-9]+:[0-9]+"
LONGEST_TARGET, MOST_WORDS, LONGEST_NAME, LONGEST_TYPE, LONGEST_STATUS, SUMMARY_LENGTH = 100, 10, 200, 100, 50, 500
CONCEPTS = tuple(sorted({x.lower() for x in v.KINDS + v.SECTORS + v.REGIONS + v.COUNTRIES + v.STATUSES}))
PREDICATES_OF = {"relationships": v.RELATIONSHIPS, "associations": v.ASSOCIATIONS}
VERBS = v.any_word(SUMMARY_VERBS + tuple(p.replace("_", " ") for p in v.RELATIONSHIPS))


def known_names(nodes: DataFrame) -> DataFrame:
    """(name): lower-case names and aliases of all nodes, each once."""
    names = nodes.select(F.col("entity").alias("name")).unionByName(nodes.select(F.explode("aliases").alias("name")))
    return names.where("name is not null").select(F.lower("name").alias("name")).distinct()


def target_form(target: Column) -> Column:
    """Why a link's target can't stand by its form alone, null if it can: too long, a sentence, prose, a call or menu word, a verse, one letter, no name."""
    x = F.trim(F.coalesce(target, F.lit("")))
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    lower = F.filter(words, lambda w: w.rlike(r"\p{L}") & (F.lower(w) == w))
    alphabetic = lambda w: w.rlike(r"^\p{L}+$")
    title = lambda w: w.rlike(r"^\p{Lu}[^\p{Lu}]*$")
    proper = ~F.exists(words, lambda w: alphabetic(w) & ~title(w) & (F.upper(w) != w))
    headed = title(F.element_at(words, 1)) & ~F.exists(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: alphabetic(w) & (F.lower(w) != w))
    return (
        F.when(x == "", "empty").when(F.length(x) > LONGEST_TARGET, "long").when(F.size(words) > MOST_WORDS, "many_words").when(F.lower(x).isin(*CONCEPTS), None).when(x.rlike("[.!?;:]"), "sentence")
        .when((F.size(words) > 2) & (F.size(lower) > 0.7 * F.size(words)), "prose").when(F.lower(x).rlike(v.any_word(TARGET_WORDS)), "call").when(x.rlike(VERSE), "verse").when(x.rlike(r"^\p{L}$"), "letter")
        .when(proper | headed, None).otherwise("no_name")
    )


def judged_targets(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``targets`` with ``problem``: null for the known names of nodes that aren't too long, else as ``target_form`` says."""
    low = F.lower(F.trim("target"))
    known = known_names(nodes).withColumn("known", F.lit(True)).withColumnRenamed("name", "_name")
    rows = targets.join(known, low == F.col("_name"), "left").withColumn("_form", target_form(F.col("target")))
    return rows.withColumn("problem", F.when(F.col("known") & ~F.col("_form").isin("empty", "long", "many_words"), None).otherwise(F.col("_form"))).drop("_name", "known", "_form")


def links_of(nodes: DataFrame) -> DataFrame:
    """(uid, field, item, predicate, target) of every link: relationships and associations, and those in summaries."""
    routes = None
    for field in PREDICATES_OF:
        rows = nodes.select("uid", F.lit(field).alias("field"), F.explode(field).alias("item")).where("trim(item) <> ''")
        routes = rows if routes is None else routes.unionByName(rows)
    shape = r"^\s*(.*?)::\[\[(.*)\]\]\s*$"
    routes = routes.select("uid", "field", "item", text.nonempty(F.lower(F.trim(F.regexp_extract("item", shape, 1)))).alias("predicate"), F.when(F.col("item").rlike(shape), F.trim(F.regexp_extract("item", shape, 2))).alias("target"))
    said = nodes.select("uid", F.lit("summary").alias("field"), F.explode(F.regexp_extract_all(F.coalesce("summary", F.lit("")), F.lit(r"\[\[(.+?)\]\]"), 1)).alias("target"))
    return routes.unionByName(said.select("uid", "field", F.col("target").alias("item"), F.lit(None).cast("string").alias("predicate"), "target"))


def node_errors(nodes: DataFrame) -> DataFrame:
    """(uid, field, code): what each row breaks. A row without an error has no rows; one row per failed check and item."""
    c, blank = F.col, lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    stop = lambda x: x.rlike("[.!?]")
    within = lambda x, words: F.lower(F.trim(x)).isin(*[w.lower() for w in words])
    summary = F.trim(F.coalesce("summary", F.lit("")))
    refers = F.exists(F.filter(F.concat(F.array("entity"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: F.coalesce(a, F.lit("")) != ""), lambda a: F.regexp_like(F.lower(summary), F.concat(F.lit(_EDGE), quoted(F.lower(a)), F.lit(_SHUT))))
    checks = [
        ("uid", "missing", blank(c("uid"))), ("uid", "format", ~blank(c("uid")) & (c("uid") != text.slug(c("entity")))),
        ("entity", "missing", blank(c("entity"))), ("entity", "sentence", F.trim("entity").rlike("[.!?]$")), ("entity", "long", F.length(F.trim("entity")) > LONGEST_NAME), ("entity", "lines", F.trim("entity").contains("\n")),
        ("entity_type", "unknown", ~blank(c("entity_type")) & ~within(c("entity_type"), v.KINDS)), ("entity_type", "sentence", stop(c("entity_type"))), ("entity_type", "long", F.length(F.trim("entity_type")) > LONGEST_TYPE),
        ("sector", "unknown", ~blank(c("sector")) & ~F.trim("sector").isin(*v.SECTORS)), ("sector", "sentence", stop(c("sector"))),
        ("country", "unknown", ~blank(c("country")) & ~within(c("country"), v.REGIONS + v.COUNTRIES)),
        ("status", "unknown", ~blank(c("status")) & ~within(c("status"), v.STATUSES)), ("status", "long", F.length(F.trim("status")) > LONGEST_STATUS), ("status", "sentence", stop(c("status"))),
        ("summary", "missing", summary == ""), ("summary", "no_reference", (summary != "") & ~refers), ("summary", "long", F.size(F.split(summary, r"\s+")) > SUMMARY_LENGTH),
        ("summary", "call", F.lower(summary).rlike(v.any_word(SUMMARY_WORDS))), ("summary", "no_verb", (summary != "") & ~F.lower(summary).rlike(VERBS)),
        ("sources", "missing", F.coalesce(F.size("sources"), F.lit(0)) <= 0),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(code).alias("code"))) for f, code, bad in checks]))
    own = nodes.select("uid", F.inline(found))
    alias = F.trim("x")
    of_alias = F.when(alias.rlike("[.!?]$"), "sentence").when(F.length(alias) > LONGEST_NAME, "long").when(alias.rlike(r"^\p{L}$"), "letter").when(alias.rlike(VERSE), "verse").when(F.lower(alias).rlike(v.any_word(ALIAS_WORDS)), "call")
    aliases = nodes.select("uid", F.explode("aliases").alias("x")).where("trim(x) <> ''").select("uid", F.lit("aliases").alias("field"), of_alias.alias("code"))
    sources = nodes.select("uid", F.explode("sources").alias("x")).where("trim(x) <> ''").select("uid", F.lit("sources").alias("field"), F.when(~F.trim("x").rlike("(?i)^https?://"), "no_address").alias("code"))
    links = judged_targets(links_of(nodes), nodes)
    of_link = F.when(F.col("target").isNull(), "format").when(F.col("problem").isNotNull(), F.concat(F.lit("target_"), F.col("problem")))
    targets = links.select("uid", "field", of_link.alias("code"))
    unknown = F.lit(False)
    for field, predicates in PREDICATES_OF.items():
        unknown = unknown | ((F.col("field") == field) & ~F.coalesce(F.col("predicate").isin(*predicates), F.lit(False)))
    predicates = links.where("target is not null").select("uid", "field", F.when(unknown, "predicate").alias("code"))
    return own.unionByName(aliases).unionByName(sources).unionByName(targets).unionByName(predicates).where("code is not null")


# Kinds of sources, by what an address or title holds, in this order.
KINDS = (
    ("government", ("gov.", "go.", "parliament.", "ministry.", "department."), ()),
    ("regulator", ("regulatory", "authority", "commission", "regulator"), ("regulatory", "authority", "commission", "regulator")),
    ("legislation", ("act", "law", "statute", "gazette", "legislation"), ("act", "law", "statute", "gazette", "legislation")),
    ("institutional", ("worldbank.org", "imf.org", "afdb.org", "sadc.int", "au.int", "un.org"), ()),
    ("academic", ("edu.", "ac.", "university", "research", "institute"), ()),
    ("news", ("news", "article", "press", "media", "journal"), ("news", "article", "press", "media", "journal")),
    ("directory", ("directory", "listing", "yellow pages", "business directory"), ("directory", "listing", "yellow pages", "business directory")),
)
ENCYCLOPEDIAS = {"wikidata.org": "Wikidata", "wikipedia.org": "Wikipedia"}
TYPES = ("official", "government", "regulator", "legislation", "institutional", "academic", "industry", "news", "directory", "search_discovered", "Wikipedia", "Wikidata", "other")
#: Addresses of official bodies; a call may name others.
OFFICIAL = ("gov.zw", "go.zw")


def source_type(url: Column, title: Column, hint: Column, official: tuple[str, ...] = OFFICIAL) -> Column:
    """What kind of source an address is: as its metadata say, else by the first kind that fits.

    Parts that end in a dot are labels of the host and words are whole words, so that ``act`` isn't
    found in ``contact``, nor ``go.`` in ``mango.com``.
    """
    low, name = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    known = F.create_map(*[F.lit(x) for t in TYPES for x in (t.lower(), t)])
    out = F.when(F.try_element_at(known, F.lower(hint)).isNotNull(), F.try_element_at(known, F.lower(hint)))
    for part, kind in ENCYCLOPEDIAS.items():
        out = out.when(low.contains(part), kind)
    for part in official:
        out = out.when(low.contains(part), "official")
    for kind, parts, words in KINDS:
        fits = low.rlike("|".join(rf"(?:^|[^a-z0-9]){p.replace('.', '[.]')}" + ("" if p.endswith(".") else "(?:$|[^a-z0-9])") for p in parts))
        out = out.when(fits | name.rlike(v.any_word(words)) if words else fits, kind)
    return out.otherwise("search_discovered")
