"""Fixed tables of entity research: kinds of entities, predicates, places, sectors, states and phrases."""

from __future__ import annotations

# Kinds of organisations.
ORGANISATIONS = (
    "government agency", "government body", "public authority", "state-owned enterprise", "regulatory authority", "ministry", "department", "bureau", "office", "commission", "council", "committee", "board",
    "international organization", "regional organization", "development bank", "multilateral institution", "private company", "non-profit", "organization", "authority", "agency", "company", "institution",
    "corporation", "enterprise", "firm", "utility", "station", "plant", "consortium", "alliance", "pool", "cooperation", "cooperative", "network", "association", "foundation", "institute", "center", "service",
    "program", "initiative", "project", "task force", "working group",
)
# Kinds of concepts.
CONCEPTS = (
    "concept", "economic policy approach", "policy approach", "ideological framework", "economic framework", "political concept", "strategy", "approach", "methodology", "framework", "doctrine", "principle", "theory",
)
# Kinds of documents.
DOCUMENTS = ("document", "memorandum of understanding", "mou", "agreement", "treaty", "contract", "report", "white paper", "policy document", "legislation", "regulation", "directive")
# Concepts that have a subtype.
SUBTYPES = {
    "economic policy approach": "economic_policy", "policy approach": "policy", "ideological framework": "ideological_framework", "economic framework": "economic_framework", "political concept": "political_concept",
}
# Predicates that make a relationship.
RELATIONSHIPS = (
    "regulates", "manages", "oversees", "supports", "supported_by", "operates", "provides", "governs", "controls", "establishes", "requires", "enforces", "includes", "covers", "monitors", "administers", "coordinates",
    "maintains", "owns", "leads", "founded_in", "created", "funds", "licenses", "authorizes", "approved", "signed", "built", "develops", "implements", "executes", "advises", "consults", "represents", "participates",
    "collaborates", "partners", "has",
)
# Predicates that make an association.
ASSOCIATIONS = (
    "connected_to", "relevant_to", "related_to", "associated_with", "linked_to", "relevant to", "connected to", "associated with", "affiliated_with", "partnered_with", "collaborates_with", "works_with", "member_of", "part_of",
)
# Words that tell of a place.
PLACE_WORDS = (
    "located in", "based in", "situated in", "operates in", "headquartered in", "registered in", "incorporated in", "in africa", "southern africa", "sadc", "southern african development community", "eastern africa", "western africa", "north africa",
)
# Regions and countries.
REGIONS = ("southern africa", "sadc", "southern african development community", "eastern africa", "western africa", "north africa", "africa")
COUNTRIES = ("zimbabwe", "south africa", "mozambique", "kenya", "nigeria", "ghana", "uganda", "tanzania", "zambia", "malawi", "botswana", "namibia", "angola")
# Sectors, as they are written in a row.
SECTORS = (
    "Energy Sector", "Power Sector", "Electricity Sector", "Water Sector", "Transport Sector", "Telecommunications Sector", "Mining Sector", "Agriculture Sector", "Technology Sector", "Financial Sector", "Health Sector",
    "Education Sector", "Infrastructure", "Energy", "Power", "Electricity", "Renewable Energy", "Sustainable Energy",
)
# States of an entity.
STATUSES = (
    "active", "inactive", "proposed", "approved", "operational", "closed", "pending", "draft", "published", "implemented", "established", "founded", "launched", "running", "functional",
)
# Phrases that make a claim a summary.
SUMMARIES = (
    "is used in", "used in", "generates", "produces", "supplies", "powers", "operates", "functions", "delivers", "supports", "responsible for", "facilitates", "enables", "provides", "is designed to", "aims to", "seeks to",
    "works to", "strives to", "helps", "promotes", "encourages", "coordinates", "manages", "oversees",
)
# Verbs that describe.
DESCRIPTIVE = (
    "is", "are", "was", "were", "be", "being", "been", "has", "have", "had", "having", "was founded", "was established", "was created", "functions", "operates", "works", "provides", "supports", "coordinates", "manages",
    "oversees", "creates", "maintains", "develops", "facilitates",
)
# Phrases of pages that say nothing of an entity, as whole words.
BOILERPLATE = (
    "welcome to", "about us", "our mission", "our vision", "our values", "our history", "who we are", "what we do", "contact us", "get in touch", "connect with us", "join us", "discover your", "take the first step",
    "make a difference", "your journey", "start today", "apply now", "sign up", "register now", "learn more", "click here", "more information", "copyright", "privacy policy", "terms of service", "cookie policy",
    "disclaimer", "footer", "home", "about", "programs", "services", "courses", "admissions", "apply", "students", "faculty", "staff", "events", "news", "gallery", "testimonial", "review", "quote", "we provide",
    "we offer", "we support", "we believe", "we are", "page not found", "error", "loading", "under construction", "repeated", "duplicate",
)
# Words of calls to action, and of navigation.
CALLS = ("now", "today", "apply", "click", "here", "more", "learn", "join", "sign", "up", "register", "start", "begin", "take", "get", "call", "email", "contact", "visit", "download")
NAVIGATION = ("home", "about", "contact", "menu", "back", "next", "previous", "top", "bottom", "scroll", "login", "logout", "sign in", "sign out", "search")
# Verbs of which a factual claim has one; verbs after a name that is a sentence's subject.
FACTUAL = ("is", "are", "was", "were", "has", "have", "had", "does", "do", "did", "provides", "offers", "supports", "regulates", "manages", "operates", "oversees")
TOLD = ("provides", "offers", "supports", "delivers", "coordinates", "manages", "regulates", "oversees", "functions", "operates", "works", "specializes", "focuses")

KINDS = ORGANISATIONS + CONCEPTS + DOCUMENTS


def longest_first(words) -> tuple[str, ...]:
    """The order in which phrases are looked for: longer ones first, equally long ones by the alphabet."""
    return tuple(sorted(dict.fromkeys(words), key=lambda w: (-len(w), w)))


def any_word(words) -> str:
    """A pattern that finds one of the phrases as whole words, in Java's and RE2's syntax alike."""
    return r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(w.replace("-", "[-]") for w in longest_first(words)) + r")(?:$|[^\p{L}\p{N}_])"
