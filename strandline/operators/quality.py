"""How usable a fetched page is, from its text and markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of block pages, of error pages, of navigation, of servers' own pages.
BLOCK = (
    "access denied", "forbidden", "you do not have permission", "permission denied", "not authorized", "unauthorized", "blocked", "cloudflare", "bot detected", "are you a robot",
    "please verify you are human", "captcha", "security check", "access temporarily blocked", "sorry, you have been blocked", "please turn on javascript", "javascript is required",
    "enable cookies", "browser verification", "our systems have detected unusual traffic", "unusual traffic from your computer network", "please try your request again", "verify you are not a robot",
)
ERROR = ("internal server error", "500 error", "404 not found", "page not found", "the page you are looking for", "this page doesn't exist", "error 404", "error 500", "error 502", "error 503", "service unavailable", "server error", "application error")
NAVIGATION = ("navigation", "menu", "home", "about", "contact", "login", "sign in", "register")
SERVER = ("welcome", "hello", "index of", "apache", "nginx", "iis", "web server")
FAILED = ("http_error", "timeout", "connection_error", "redirect_loop")
UNUSABLE = ("empty", "block_page", "js_shell", "error_page", "navigation", "soft_404")


def _any(c: Column, phrases: tuple[str, ...]) -> Column:
    """Searches for plain substrings; a regular expression of alternatives tries each at every place."""
    found = c.contains(phrases[0])
    for p in phrases[1:]:
        found = found | c.contains(p)
    return found


def extraction_quality(content: Column, markup: Column | None = None) -> Column:
    """A page's quality; without ``markup`` the content itself is searched for scripts.

    The lower-case text is bound once, by a transform of a one-element array: written out, every
    search would make it anew.
    """
    seen = F.struct(F.lower(F.coalesce(content, F.lit(""))).alias("low"), F.length(F.trim(F.coalesce(content, F.lit("")))).alias("n"), F.lower(F.coalesce(markup, F.lit(""))).alias("markup") if markup is not None else F.lit("").alias("markup"))

    def label(x: Column) -> Column:
        low, n, source = x["low"], x["n"], x["markup"] if markup is not None else x["low"]
        blocked, broken = _any(low, BLOCK), _any(low, ERROR)
        if markup is not None:
            blocked, broken = blocked | _any(source, BLOCK), broken | _any(source, ERROR)
        scripts = F.size(F.regexp_extract_all(source, F.lit("(<script)"), 1))
        words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
        nav = F.filter(words, lambda w: _any(w, NAVIGATION))
        return (
            F.when(n == 0, "empty").when(blocked, "block_page").when(broken, "error_page").when((n < 200) & (scripts > 2), "js_shell")
            .when((n < 100) & (F.size(nav) > F.size(words) * 0.5), "navigation").when((n < 150) & _any(low, SERVER), "soft_404").when(n < 200, "thin").otherwise("substantive")
        )

    return F.element_at(F.transform(F.array(seen), label), 1)


def evidence_status(quality: Column, retrieval: Column) -> Column:
    return F.when(retrieval.isin(*FAILED), "unusable").when(quality.isin(*UNUSABLE), "unusable").when(quality == "thin", "thin").otherwise("usable")


def quality_counts(rated: DataFrame) -> DataFrame:
    """Rows per status and quality."""
    return rated.groupBy("status", "quality").agg(F.count(F.lit(1)).alias("n"))
