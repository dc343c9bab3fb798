"""Text functions as column expressions. All run in the JVM."""

from __future__ import annotations

import html.entities
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the regular expressions of most languages have it, no-break blanks included.
WS = r"[\s\p{Z}]"


def _accent_table() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to a base letter, and those base letters."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(unicodedata.normalize("NFD", chr(i))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BASE = _accent_table()


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    """White space runs become one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def unaccented(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _BASE), "[̀-ͯ]", "")


def _entities() -> dict[str, str]:
    return {f"&{name};": chr(code) for name, code in html.entities.name2codepoint.items()} | {"&apos;": "'"}


def decoded(c: Column) -> Column:
    """HTML entities as the characters they stand for, by name or number; others stay as they are."""
    # one literal, as a map of literals would be walked by every rule of the optimizer
    known = F.str_to_map(F.lit("\x01".join(f"{name}\x02{char}" for name, char in _entities().items())), F.lit("\x01"), F.lit("\x02"))

    def one(t: Column) -> Column:
        digits = F.regexp_extract(t, "^&#[xX]?([0-9a-fA-F]{1,6});$", 1)
        code = F.when(t.rlike("^&#[xX]"), F.conv(digits, 16, 10).try_cast("bigint")).when(t.rlike("^&#[0-9]{1,6};"), digits.try_cast("bigint"))
        char = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.try_element_at(known, t), char, t)

    tokens = F.regexp_extract_all(c, F.lit("(&#?[0-9a-zA-Z]+;|[^&]+|&)"), 1)
    return F.when(c.contains("&"), F.array_join(F.transform(tokens, one), "")).otherwise(c)


def name_form(c: Column) -> Column:
    """An entity name's normal form: entities decoded, accents dropped; dashes, quotation marks, possessives,
    blanks and closing punctuation evened out, lower case. Null gives an empty string."""
    x = unaccented(decoded(F.coalesce(c, F.lit(""))))
    x = F.regexp_replace(x, "[-–—]+", "-")
    x = F.regexp_replace(x, "^[\\s\"“”'’ʼ]+|[\\s\"“”'’ʼ]+$", "")
    x = F.regexp_replace(x, '["“”]', "")
    x = F.regexp_replace(x, r"(?i)['’ʼ]s\b", "")
    x = squeeze(x)
    x = F.regexp_replace(x, "[.,;:!?]+$", "")
    return F.lower(F.trim(x))


def match_form(c: Column) -> Column:
    """The form in which names are compared: normal form with blanks for what is in parentheses and for punctuation."""
    x = F.regexp_replace(name_form(c), r"\([^)]+\)", " ")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first letter, also after hyphens and apostrophes; marks belong to the letter before them."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}[\p{L}\p{M}]*|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")


def nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def acronym_in(c: Column) -> Column:
    """The acronym that a name spells out: two to five letters in parentheses, else in capitals."""
    return F.coalesce(nonempty(F.upper(F.regexp_extract(c, r"\(\s*([A-Za-z]{2,5})\s*\)", 1))), nonempty(F.regexp_extract(c, r"(?:^|[^\p{L}\p{N}_])([A-Z]{2,5})(?:$|[^\p{L}\p{N}_])", 1)))


#: Words that give no letter to an acronym.
SMALL_WORDS = ("a", "an", "the", "of", "and", "or", "in", "on", "at", "by")


def acronym_of(form: Column) -> Column:
    """Initials of a normal form's words of two letters and more; null for fewer than two."""
    words = F.filter(F.split(form, " "), lambda w: (F.length(w) > 1) & ~w.isin(*SMALL_WORDS))
    return F.when(F.size(words) >= 2, F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")))


def slug(c: Column) -> Column:
    x = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(x == "", "entity").otherwise(x)


def short_hash(parts: list[Column], n: int = 16, sep: str = "|") -> Column:
    return F.substring(F.sha2(F.concat_ws(sep, *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, n)


def fingerprint(content: Column) -> Column:
    """SHA-256 of the text with even white space; an empty string for no text."""
    x = squeeze(F.coalesce(content, F.lit("")))
    return F.when(x == "", "").otherwise(F.sha2(x, 256))


def pieces(c: Column) -> Column:
    """A plain cut after full stops, exclamation and question marks, as claim extraction uses it."""
    return F.filter(F.split(strip(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def fragment(sentence: Column) -> Column:
    return (F.size(F.split(F.trim(sentence), r"\s+")) < 3) | sentence.rlike(r"^\p{Ll}")


def chunks(c: Column, size: int = 4000, overlap: int = 200) -> Column:
    """Overlapping pieces of a text as (chunk_index, chunk), the last one reaching its end."""
    step = size - overlap
    n = F.when(F.length(c) <= size, F.lit(0)).otherwise(F.ceil((F.length(c) - size) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("chunk_index"), F.substring(c, i * step + 1, F.lit(size)).alias("chunk")))


#: What a secret looks like, and what takes its place.
SECRETS = (
    (r"(?i)(bearer\s+)[a-zA-Z0-9\-_]+", "[REDACTED]", True),
    (r"(?i)(authorization:\s*)[a-zA-Z0-9\-_.]+", "[REDACTED]", True),
    (r"(?i)(api[_-]?key\s*[:=]\s*)[a-zA-Z0-9\-_]+", "[REDACTED]", True),
    (r"(?i)(token\s*[:=]\s*)[a-zA-Z0-9\-_.]+", "[REDACTED]", True),
    (r"(?i)(password\s*[:=]\s*)[^\s\n]+", "[REDACTED]", True),
    (r"(?i)(secret\s*[:=]\s*)[^\s\n]+", "[REDACTED]", True),
    (r"(?i)(private[_-]?key\s*[:=]\s*)[^\s\n]+", "[REDACTED]", True),
    (r"(sk-[a-zA-Z0-9\-_]+)", "[REDACTED]", False),
    (r"([A-Za-z0-9+/=]{40,})", "[REDACTED_LONG]", False),
)


def redacted(c: Column) -> Column:
    for pattern, instead, keeps in SECRETS:
        c = F.regexp_replace(c, pattern, ("$1" if keeps else "") + instead)
    return c


#: Elements that hold no text for readers.
HIDDEN = ("script", "style", "noscript", "template", "head", "iframe", "svg")
HTML_HINT = r"(?i)<\s*/?\s*(?:html|head|body|script|style|div|p|article|section|main|table|span|a|img|br|hr|ul|ol|li|h[1-6]|blockquote|pre|code)\b"


def is_markup(content: Column, content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("html"), F.lit(False)) | F.coalesce(F.substring(content, 1, 4096).rlike(HTML_HINT), F.lit(False))


def markup_text(content: Column) -> Column:
    """The readable text of marked-up content, by blocks in order."""
    x = F.regexp_replace(content, r"(?s)<!--.*?-->", " ")
    for name in HIDDEN:
        x = F.regexp_replace(x, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))


def front_matter(c: Column) -> Column:
    """The block between two lines of dashes at a note's start; null without one."""
    return nonempty(F.regexp_extract(c, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1))


def body(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", ""))


def front_value(c: Column, key: str) -> Column:
    """A front-matter value, the last one if repeated, without quotation marks around it; null words are empty."""
    found = F.regexp_extract_all(F.coalesce(front_matter(c), F.lit("")), F.lit(rf"(?m)^[ \t]*{key}[ \t]*:[ \t]*([^\n]*?)[ \t]*$"), 1)
    raw = F.when(F.size(found) > 0, F.element_at(found, -1))
    return F.when(raw.isin("null", "Null", "NULL"), "").otherwise(F.regexp_replace(raw, "^[\"']+|[\"']+$", ""))


def wikilinks(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda x: F.trim(x)), lambda x: x != "")
