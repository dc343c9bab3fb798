"""Pieces of SQL that several of the comparison queries share."""

from __future__ import annotations

from strandline.functions import text, urls


def replaced(x: str, *pairs: tuple[str, str]) -> str:
    for pattern, instead in pairs:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{instead.replace(chr(39), chr(39) * 2)}', 'g')"
    return x


def squeeze(x: str) -> str:
    return f"trim({replaced(x, (r'[\s\p{Z}]+', ' '))})"


def name_form(x: str) -> str:
    x = f"strip_accents({replaced(f"coalesce({x}, '')", ('&apos;|&#39;', "'"), ('&quot;', '"'), ('&nbsp;', ' '), ('&amp;', '&'))})"
    x = replaced(x, ("[-–—]+", "-"), ("^[\\s\"“”'’ʼ]+|[\\s\"“”'’ʼ]+$", ""), ('["“”]', ""), ("(?i)['’ʼ]s\\b", ""))
    return f"lower(trim({replaced(squeeze(x), ('[.,;:!?]+$', ''))}))"


def match_form(x: str) -> str:
    return f"trim({replaced(name_form(x), (r'\([^)]+\)', ' '), ('[^a-z0-9]+', ' '))})"


def acronym_in(x: str) -> str:
    return f"coalesce(nullif(upper(regexp_extract({x}, '\\(\\s*([A-Za-z]{{2,5}})\\s*\\)', 1)), ''), nullif(regexp_extract({x}, '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z]{{2,5}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1), ''))"


def acronym_of(form: str) -> str:
    small = ", ".join(f"'{w}'" for w in text.SMALL_WORDS)
    words = f"list_filter(string_split({form}, ' '), lambda w: length(w) > 1 AND w NOT IN ({small}))"
    return f"CASE WHEN len({words}) >= 2 THEN upper(array_to_string(list_transform({words}, lambda w: w[1:1]), '')) END"


def slug(x: str) -> str:
    return f"coalesce(nullif(trim({replaced(f'lower({x})', ('[^a-z0-9]+', '-'))}, '-'), ''), 'entity')"


def fingerprint(x: str) -> str:
    s = squeeze(f"coalesce({x}, '')")
    return f"CASE WHEN {s} = '' THEN '' ELSE sha256({s}) END"


_SHAPE = "^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$"


def url_part(x: str, n: int) -> str:
    return f"regexp_extract(trim({x}), '{_SHAPE}', {n})"


def host(x: str) -> str:
    return f"lower(regexp_extract({url_part(x, 2)}, '^(?:[^@]*@)?([^:]*)', 1))"


def _kept(query: str, dropped: tuple[str, ...], valueless: bool) -> str:
    names = ", ".join(f"'{d}'" for d in dropped)
    extra = " OR NOT contains(p, '=')" if valueless else ""
    return f"array_to_string(list_filter(string_split({query}, '&'), lambda p: p <> '' AND (lower(split_part(p, '=', 1)) NOT IN ({names}){extra})), '&')"


def identity(x: str) -> str:
    path = f"CASE WHEN {url_part(x, 3)} IN ('', '/') THEN '/' ELSE regexp_replace({url_part(x, 3)}, '/$', '') END"
    query = _kept(url_part(x, 4), urls.TRACKING, False)
    return f"CASE WHEN lower({url_part(x, 1)}) IN ('http', 'https') AND {host(x)} <> '' THEN lower({url_part(x, 1)}) || '://' || {host(x)} || {path} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END ELSE '' END"


def fetchable(x: str) -> str:
    given = f"trim(coalesce({x}, ''))"
    whole = f"(CASE WHEN regexp_matches({given}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {given} ELSE 'https://' || {given} END)"
    scheme, path, query = f"lower({url_part(whole, 1)})", url_part(whole, 3), _kept(url_part(whole, 4), urls.TRACKING_FETCH, True)
    authority = f"CASE {scheme} WHEN 'http' THEN regexp_replace(lower({url_part(whole, 2)}), ':80$', '') WHEN 'https' THEN regexp_replace(lower({url_part(whole, 2)}), ':443$', '') ELSE lower({url_part(whole, 2)}) END"
    squeezed = f"CASE WHEN {path} IN ('', '/') THEN {path} ELSE lower(regexp_replace(regexp_replace({path}, '/+', '/', 'g'), '(.)/$', '\\1')) END"
    return f"CASE WHEN {given} = '' THEN '' WHEN {scheme} IN ('http', 'https') THEN {scheme} || '://' || {authority} || {squeezed} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END ELSE {given} END"


def markup_text(x: str) -> str:
    x = replaced(x, (r"(?s)<!--.*?-->", " "), *[(rf"(?is)<{n}\b[^>]*>.*?</{n}\s*>", " ") for n in text.HIDDEN], (r"(?s)<[^>]*>", " "))
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim({replaced(x, (r'[ \t\n\r\f]+', ' '))})"


FRONT = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)"


def front_value(x: str, key: str) -> str:
    found = f"regexp_extract_all(coalesce(regexp_extract({x}, '{FRONT}', 1), ''), '(?m)^[ \\t]*{key}[ \\t]*:[ \\t]*([^\\n]*?)[ \\t]*$', 1)"
    quotes = "^[\"'']+|[\"'']+$"
    return f"(CASE WHEN len({found}) > 0 THEN (CASE WHEN {found}[-1] IN ('null', 'Null', 'NULL') THEN '' ELSE regexp_replace({found}[-1], '{quotes}', '', 'g') END) END)"


def body(x: str) -> str:
    return replaced(f"regexp_replace({x}, '{FRONT.replace('(.*?)', '.*?')}', '')", (r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
