"""Addresses: the two normal forms, redaction, and what is worth fetching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track, for identity and for fetching.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid")
TRACKING_FETCH = TRACKING + ("_ga", "_gid", "_gl", "_hsenc", "_openstat", "__s", "click_id", "cust", "ref", "source", "campaign")
#: Parameters that hold secrets; endings of files that hold no text.
SECRET = ("api_key", "token", "password", "secret", "key", "access_token")
NO_TEXT = ("css", "js", "png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf", "eot", "mp3", "mp4", "avi", "mov", "wmv", "flv", "zip", "tar", "gz", "rar")

_SHAPE = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty where there is none."""
    return F.regexp_extract(F.trim(url), _SHAPE, n)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:[^@]*@)?([^:]*)", 1))


def _kept(query: Column, dropped: tuple[str, ...], valueless: bool) -> Column:
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    keep = lambda p: (p != "") & (~name(p).isin(*dropped) | (F.lit(valueless) & ~p.contains("=")))
    return F.array_join(F.filter(F.split(query, "&"), keep), "&")


def _joined(base: Column, query: Column) -> Column:
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def identity(url: Column) -> Column:
    """The form under which two addresses are one source: no port, fragment, tracking or closing slash.

    Only http and https have one; other texts, null and blank ones give an empty string.
    """
    scheme, path = F.lower(part(url, 1)), part(url, 3)
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))
    whole = _joined(F.concat(scheme, F.lit("://"), host(url), path), _kept(part(url, 4), TRACKING, False))
    return F.when(scheme.isin("http", "https") & (host(url) != ""), whole).otherwise("")


def fetchable(url: Column) -> Column:
    """The form under which a page is fetched once: https if no scheme is given, path in lower case."""
    given = F.trim(F.coalesce(url, F.lit("")))
    whole = F.when(given.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), given).otherwise(F.concat(F.lit("https://"), given))
    scheme, authority, path = F.lower(part(whole, 1)), F.lower(part(whole, 2)), part(whole, 3)
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    path = F.when(path.isin("", "/"), path).otherwise(F.lower(F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(?<=.)/+$", "")))
    out = _joined(F.concat(scheme, F.lit("://"), authority, path), _kept(part(whole, 4), TRACKING_FETCH, True))
    return F.when(given == "", "").when(scheme.isin("http", "https"), out).otherwise(given)


def redacted(url: Column) -> Column:
    """The address without the values of secret parameters and without its fragment's text."""
    hide = lambda p: F.when(p.contains("=") & F.lower(F.substring_index(p, "=", 1)).isin(*SECRET), F.concat(F.substring_index(p, "=", 1), F.lit("=[REDACTED]"))).otherwise(p)
    query = F.array_join(F.transform(F.filter(F.split(part(url, 4), "&"), lambda p: p != ""), hide), "&")
    out = _joined(F.concat(part(url, 1), F.lit("://"), part(url, 2), part(url, 3)), query)
    return F.when(part(url, 5) == "", out).otherwise(F.concat(out, F.lit("#[REDACTED_FRAGMENT]")))


def no_text(url: Column) -> Column:
    return F.lower(part(url, 3)).rlike(r"\.(?:" + "|".join(NO_TEXT) + ")$")


def worth_fetching(content_type: Column) -> Column:
    """Is text to be expected of a content type? Unknown types are tried."""
    c = F.coalesce(content_type, F.lit(""))
    yes = c.contains("text/html") | c.contains("text/plain") | c.contains("application/json") | c.contains("application/xml")
    return yes | ~c.rlike(r"application/pdf|application/msword|application/vnd|image/|audio/|video/|application/zip|application/x-")
