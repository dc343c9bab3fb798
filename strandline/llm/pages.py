"""Web pages by lines: markup, the lines that recur on a host or everywhere, template residue and
error pages."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import new_folder, written

# ---------------------------------------------------------------------------------------------
# Lines of a page.

_TAG = re.compile(r"<(/?)([a-zA-Z!][\w-]*)([^<>]*)>")
_COMMENT = re.compile(r"<!--.*?(?:-->|$)", re.S)
_CLASS = re.compile(r"(?:class|id|role)\s*=\s*[\"']?([\w\s-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
_ENTITY = re.compile(r"&(#?\w+);")
_CODE = ("script", "style", "template", "svg", "head")


class Line:
    __slots__ = ("no", "tags", "marks", "link", "text", "code", "gap")

    def __init__(self, no, tags, marks, link, text, code, gap):
        self.no, self.tags, self.marks, self.link, self.text, self.code, self.gap = no, tags, marks, link, text, code, gap


def lines_of(content: str) -> list[Line]:
    """The lines of a page that hold anything, with the tags around their text."""
    out, inside, stack, gap = [], None, [], False
    for no, raw in enumerate(content.split("\n"), 1):
        if not raw.strip():
            gap = True
            continue
        if "<" not in raw:
            out.append(Line(no, tuple(stack), "", False, raw.strip(), inside is not None, gap))
            gap = False
            continue
        text, at, tags, marks, link, code = [], 0, list(stack), [], False, inside is not None
        for m in _TAG.finditer(_COMMENT.sub("", raw)):
            source = m.string
            if inside is None:
                text.append(source[at : m.start()])
            at = m.end()
            name = m[2].lower()
            if m[1]:
                if inside == name:
                    inside = None
                if name in stack:
                    while stack.pop() != name:
                        pass
                continue
            if inside is None:
                if name in _CODE:
                    inside, code = name, True
                elif name in ("div", "ul", "ol", "nav", "footer", "header", "aside", "article", "main", "section", "form", "table", "body"):
                    stack.append(name)
                tags.append(name)
                marks += _CLASS.findall(m[3])
                link = link or name == "a" and bool(_HREF.search(m[3]))
        rest = _COMMENT.sub("", raw)[at:]
        if inside is None:
            text.append(rest)
        joined = "".join(text).strip()
        out.append(Line(no, tuple(tags), " ".join(marks).lower(), link, joined, code and not joined, gap))
        gap = False
    return out


_MARKS = re.compile("[\u0300-\u036f]+")


def fold(text: str) -> str:
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text))


_SITE = re.compile(r"[^\W\d_]{3,}")


@lru_cache(maxsize=4096)
def masker(host: str):
    """Normalises a line: the name of the site gives way to a mark; case, accents and blanks don't count."""
    words = [w for w in _SITE.findall(host.lower().removeprefix("www.").split(".")[0])]
    site = re.compile(r"\b" + re.escape(words[0]) + r"\b(?: [A-Z][\w’-]*)*", re.I) if words else None

    def mask(text: str) -> str:
        text = fold(text)
        if site:
            text = site.sub("§", text)
        return " ".join(text.lower().split())

    return mask


def key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_END = ".!?…。！？।؟"
_WIDE = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_THAI = re.compile(r"[฀-๿]{12,}")
_BULLET = re.compile(r"^\s*(?:[-–—•*·▪◦]|\d{1,2}[.)])\s+\S")
_PARTS = re.compile(r"\s[|·>»/]\s|\s{2,}")


def wide(text: str) -> bool:
    return len(_WIDE.findall(text)) * 3 > len(text)


def sentence_like(text: str) -> bool:
    """Long enough for a sentence, and closed like one (Thai has no end marks)."""
    if len(text) < (12 if wide(text) else 34):
        return False
    last = text.rstrip("”»\"'’)」』“ ")[-1:]
    return last in _END or bool(_THAI.search(text)) and len(text) > 25


# ---------------------------------------------------------------------------------------------
# Parsed pages: every page is parsed once; what follows works on its lines' keys, weights, words and marks.

#: Per line: its number, key, weight as part of an article, bits (see below), and, where wanted, its words.
PARSED = "record_table string, id bigint, host string, page bigint, title string, no array<int>, k array<bigint>, w array<int>, bits array<bigint>, box array<bigint>, words array<string>"
#: Bits that do not depend on other pages. The others belong to ``boilerplate``.
TAIL_BIT, PLACEHOLDER_BIT, TITLE_BIT = 1 << 40, 1 << 41, 1 << 42

# Letters with their marks; Thai, kana and Chinese characters by runs, which are cut into short pieces.
_WORDS = re.compile(
    r"[^\W\d_\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff](?:[^\W\d_\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]|[\u0610-\u065f\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963])*"
    r"|[\u0e00-\u0e7f]+|[\u3040-\u30ff\u3400-\u9fff]+"
)


def words_in(masked: str) -> str:
    """The distinct words of a normalised line, between blanks."""
    if masked.isascii():
        return " ".join(set(_ASCII_WORDS.findall(masked)))
    out = set()
    for x in _WORDS.findall(masked):
        c = x[0]
        if c < "\u0e00" or "\u0e80" <= c < "\u3040" or c > "\u9fff":
            out.add(x)
        else:
            n = 3 if c <= "\u0e7f" else 2
            out.update([x[i : i + n] for i in range(len(x) - n + 1)] or [x])
    return " ".join(out)


_ASCII_WORDS = re.compile("[a-z]+")


def article_weight(text: str) -> int:
    """Characters of a line that may be an article's: sentences and list items, not menus. Scripts without blanks count three times."""
    if not (sentence_like(text) or _BULLET.match(text) and len(text) > 12):
        return 0
    parts = [p for p in _PARTS.split(text) if p]
    if len(parts) > 1 and sum(map(len, parts)) < 40 * len(parts):
        return 0
    return len(text) * (3 if wide(text) else 1)


@lru_cache(maxsize=1 << 16)
def facts(host: str, text: str, worded: bool) -> tuple[str, int, int, bool, str]:
    """A line's normal form, key, weight, whether it heads the tail, and its words. Furniture recurs, so these are kept."""
    masked = masker(host)(text)
    return masked, key(masked), article_weight(text), tail_heading(text), words_in(masked) if worded else ""


def _parse(marks):
    """``marks``: gives a page's line bits from (lines, masked texts, title, mask), or None where not wanted."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, ids, hosts, pages_, titles, contents = (batch.column(i).to_pylist() for i in range(6))
            columns = [[] for _ in range(6)]
            for t, h, title, content in zip(tables, hosts, titles, contents):
                crawled = t == "crawl_results"
                raw = content.split("\n")
                lines = lines_of(content)
                spoken = [x for x in lines if x.text and not x.code]
                head = next((x for x in spoken if "h1" in x.tags), spoken[0] if spoken else None)
                known = [facts(h or "", x.text, crawled) for x in spoken]
                bits = marks(spoken, [f[0] for f in known], title or "", masker(h or "")) if marks else [0] * len(spoken)
                weight, words, tail = [], [], False
                for i, x in enumerate(spoken):
                    tail = tail or known[i][3]
                    weight.append(0 if tail else known[i][2])
                    if tail:
                        bits[i] |= TAIL_BIT
                    if crawled:
                        words.append("" if tail else known[i][4])
                        source = raw[x.no - 1]
                        if "<script" not in source and "<style" not in source and placeholder(_MARKUP.sub(" ", source) if "<" in source else source):
                            bits[i] |= PLACEHOLDER_BIT
                        if x is head and 6 < len(x.text) < 60 and DEFAULT_TITLE.match(x.text) and not _SITE_WORD.match(x.text):
                            bits[i] |= TITLE_BIT
                # placeholders that the markup hides stand for themselves
                extra = [x for x in lines if crawled and not x.text and not x.code and placeholder(_MARKUP.sub(" ", raw[x.no - 1]))]
                box = [hash_of(x.tags) if x.tags else 0 for x in spoken]
                columns[0].append([x.no for x in spoken] + [x.no for x in extra])
                columns[1].append([f[1] for f in known] + [key(raw[x.no - 1]) for x in extra])
                columns[2].append(weight + [0] * len(extra))
                columns[3].append(bits + [PLACEHOLDER_BIT] * len(extra))
                columns[4].append([b * 2 + x.gap for b, x in zip(box, spoken)] + [0] * len(extra))
                columns[5].append(words + [""] * len(extra) if crawled else None)
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["record_table", "id", "host", "page", "title", "no", "k", "w", "bits", "box", "words"])

    return parse


@lru_cache(maxsize=4096)
def hash_of(tags: tuple[str, ...]) -> int:
    return xxhash.xxh32_intdigest("\0".join(tags))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def page_of(url: Column) -> Column:
    """A page under all its addresses: no scheme, no query, no fragment."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"[?#].*$", ""), r"^[a-z]+://|/+$", ""))


def page_rows(df: DataFrame, name: str, ident: str) -> DataFrame:
    """(record_table, id, host, page, title, content) of the rows with an id and a content."""
    url = F.coalesce(F.col("final_url"), F.col("url"))
    return df.where(F.col(ident).isNotNull() & F.col("content").isNotNull()).select(F.lit(name).alias("record_table"), F.col(ident).cast("bigint").alias("id"), host_of(url).alias("host"), page_of(url).alias("page"), "title", "content")


def parsed(pages: DataFrame, folder: str, marks=None) -> DataFrame:
    """Every page parsed once, into the shared folder."""
    return written(pages.mapInArrow(_parse(marks), PARSED), folder, "parsed")


# ---------------------------------------------------------------------------------------------
# Recurrent lines.

#: A line recurs on a host if it is on this share of the host's pages, and on four at least; anywhere,
#: if it is on this share of all pages, and on eight at least.
HOST_SHARE, ALL_SHARE, LEAST_HOST, LEAST_ALL = 0.05, 0.004, 4, 8
#: Hosts' lists of recurrent lines are broadcast up to this many bytes; beyond, they are joined by salted keys.
BROADCAST_BYTES, SALTS = 32 << 20, 32


def recurrent_lines(pages: DataFrame, folder: str) -> tuple[set[int], DataFrame]:
    """Keys of the lines that recur anywhere, and (host, k) of those that recur on a host.

    A page counts once, however often it was fetched. The first is bounded by the mean number of lines
    of a page divided by ALL_SHARE, a host's keys by that divided by HOST_SHARE; only the first comes
    to the driver. Lines are counted before they are shuffled by host, so a large host is no hot key.
    """
    once = pages.select("host", "page", F.explode(F.array_distinct("k")).alias("k")).distinct()
    by_host = written(once.groupBy("host", "k").agg(F.count(F.lit(1)).alias("n")), folder, "by_host")
    sizes = pages.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    total = pages.agg(F.countDistinct("page")).collect()[0][0]
    frequent = by_host.groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= max(LEAST_ALL, ALL_SHARE * total))
    everywhere = {r["k"] for r in frequent.select("k").collect()}
    of_hosts = by_host.join(sizes, "host").where(F.col("n") >= F.greatest(F.lit(LEAST_HOST), HOST_SHARE * F.col("pages"))).select("host", "k")
    return everywhere, written(of_hosts, folder, "of_hosts")


def with_recurrent(pages: DataFrame, of_hosts: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with ``recurrent``, those of its keys that recur on its host. Lists of a checked size are
    broadcast; longer ones are joined key by key, in salted groups, and only ids and keys are shuffled with them."""
    known = of_hosts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("host")).alias("s")).collect()[0]
    if 8 * known["n"] + (known["s"] or 0) <= most:
        lists = of_hosts.groupBy("host").agg(F.collect_set("k").alias("recurrent"))
        return pages.join(F.broadcast(lists), "host", "left").withColumn("recurrent", F.array_intersect("k", "recurrent"))
    salted = of_hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = pages.select("record_table", "id", "host", F.explode(F.array_distinct("k")).alias("k")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    found = keys.join(salted, ["host", "k", "salt"]).groupBy("record_table", "id").agg(F.collect_set("k").alias("recurrent"))
    return pages.join(found, ["record_table", "id"], "left")


# ---------------------------------------------------------------------------------------------
# Template residue and error pages.

# The ways in which template languages write placeholders.
_NAME = r"[A-Za-z][\w. -]{1,40}?"
PLACEHOLDER = re.compile(
    r"\{\{\s*" + _NAME + r"\s*\}\}|\{%\s*" + _NAME + r"\s*%\}|\$\{\s*" + _NAME + r"\s*\}|<%=?\s*" + _NAME + r"\s*%>|\[\[\s*(?:[A-Z][A-Z_ -]+|[a-z]+(?:[._][a-z_]+)*)\s*\]\]"
    r"|%%" + _NAME + r"%%|@@" + _NAME + r"@@|__[A-Z][A-Z_-]+__|(?<![\w#])#[A-Z][A-Z_-]{2,}#|(?<![\[\w])\[[A-Z][A-Z]*(?:[_ -][A-Z]+)*\](?![\](])|(?<![\{$\w])\{[A-Z][A-Z_ -]+\}(?!\})"
    r"|<[A-Z]{3,}(?:_[A-Z]+)*>|&lt;[A-Z]{3,}(?:_[A-Z]+)*&gt;"
)
_BRACKETED_WORDS = re.compile(r"\[(?:SIC|PDF|VIDEO|PHOTO|AUDIO|MAP|UPDATE|UPDATED|NEW|LIVE|AP|AFP|RELATED|ED|TV|EN|FR|PT|ES|DE|SW|RU|AR|HI|ZH|JA|TH)\]")
# Titles that editors and programs give until there is one.
DEFAULT_TITLE = re.compile(
    r"^\W*(?:untitled(?: (?:document|page|post|draft))?(?: ?\d+)?|new (?:page|post|document|article)(?: ?\d+)?|(?:insert|enter|your|page|document|article|post|site) title(?: goes)?(?: here)?|title|document ?\d*|page ?\d*|index(?: of .*|\.html?)?"
    r"|home ?page|default(?: page| title)?|lorem ipsum.*|test(?: page)?|sample (?:page|title)|hello world!?|loading(?:…|\.\.\.)?|portal|website|coming soon|under construction|headline(?: goes)? here|no title|sans titre|sem título|sin título|unbenannt(?:es dokument)?|ohne titel|без названия|безымянный|بدون عنوان|शीर्षक रहित|无标题(?:文档)?|無題|ไม่มีชื่อ|bila kichwa|hakuna kichwa)\W*$",
    re.I,
)
# Headings of what follows the article: other articles, comments, tags.
TAIL = frozenset(
    """most read|related stories|related articles|related|you may also like|more from this desk|editor’s picks|editor's picks|read also|read more|comments|what readers say|popular|trending|tags|recommended
mais lidas|leia também|comentários|veja também|lo más leído|te puede interesar|comentarios|lea también|relacionados|les plus lus|à lire aussi|sur le même sujet|commentaires|lire aussi|meistgelesen|das könnte sie auch interessieren|kommentare|lesen sie auch|mehr zum thema
habari zinazosomwa zaidi|maoni|soma pia|самое читаемое|читайте также|комментарии|الأكثر قراءة|اقرأ أيضا|اقرأ أيضاً|التعليقات|تعليقات|यह भी पढ़ें|टिप्पणियाँ|सबसे अधिक पढ़े गए|सर्वाधिक पढ़ा गया|热门文章|相关阅读|延伸阅读|评论|関連記事|人気記事|コメント|よく読まれている記事|อ่านมากที่สุด|ความคิดเห็น|บทความที่เกี่ยวข้อง|อ่านเพิ่มเติม|อ่านต่อ""".replace("\n", "|").split("|")
)
_COUNTER = re.compile(r"\s*[(（]\s*[\d.,\s]+[)）]\s*$")


def tail_heading(text: str) -> bool:
    return len(text) < 48 and _COUNTER.sub("", text).rstrip(" :：").lower() in TAIL


_MAY_HOLD = re.compile(r"[{\[<%@_#]")


def placeholder(text: str) -> bool:
    return bool(_MAY_HOLD.search(text)) and any(not _BRACKETED_WORDS.fullmatch(m[0]) for m in PLACEHOLDER.finditer(text))


_MARKUP = re.compile(r"</?[a-z][^<>]*>")
_SITE_WORD = re.compile(r"^\W*(?:portal|home ?page|website)", re.I)


#: A page has an article if its residual lines weigh this much, none if less than the other; between, its class is open.
ARTICLE, NO_ARTICLE = 400, 150
#: A word is evidence only if it is on this share of the pages without an article, and on three at least.
SUPPORT, LEAST = 0.0005, 3
#: Log-odds of a line's words: up to the first it may be an article's; above the second it is evidence. In the last
#: round a word's odds count only if it tells an article, or a page without one by this much.
ARTICLE_ODDS, EVIDENCE_ODDS, TELLING = 1.0, 2.0, 1.5
ROUNDS = 2
#: A page with so much of an article beside the evidence is a page.
ENOUGH = 40


def _score(words: str, odds: dict[str, float]) -> float:
    return sum(map(odds.get, words.split(" "), _ZEROS)) if odds else 0.0


_ZEROS = repeat(0.0)


def article_of(weights: list[int], words: list[str], odds: dict[str, float], enough: int) -> int:
    """Weight of the lines that may be an article's; no more is looked at once it is ``enough``."""
    total = 0
    for w, x in zip(weights, words):
        if w and _score(x, odds) <= ARTICLE_ODDS:
            total += w
            if total >= enough:
                break
    return total


def _words_without_article(odds):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, words = [], []
            for p, w, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if article_of(w, x, odds.value, NO_ARTICLE) < NO_ARTICLE:
                    found = {y for line in x for y in line.split(" ")}
                    words += found
                    page += [p] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(words, pa.string())], names=["page", "word"])

    return emit


def _words_beside_article(odds, wanted):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for batch in batches:
            for w, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if article_of(w, x, odds.value, ARTICLE) >= ARTICLE:
                    n += 1
                    counts.update(wanted.value.intersection(" ".join(x).split(" ")))
        yield pa.RecordBatch.from_arrays([pa.array(["", *counts], pa.string()), pa.array([n, *counts.values()], pa.int64())], names=["word", "n"])

    return emit


def evidence_words(residual: DataFrame) -> dict[str, float]:
    """Log-odds of words: how much likelier a word is on pages without an article than beside one.

    ``residual`` has page, w and words of the lines left when recurrent ones are subtracted. Nothing is
    given but what an article weighs: messages of errors and blocks, notices that scripts are needed and
    filler recur on pages without an article, in any language. A second round moves pages whose long
    lines turned out to be made of such words (filler) to the others. Every page is counted; the words
    that come to the driver are at most a page's mean number of words divided by SUPPORT.
    """
    sc = residual.sparkSession.sparkContext
    odds: dict[str, float] = {}
    for last in [False] * (ROUNDS - 1) + [True]:
        known = sc.broadcast(odds)
        without = residual.mapInArrow(_words_without_article(known), "page bigint, word string").distinct().persist(StorageLevel.DISK_ONLY)
        pages = without.select("page").distinct().count()
        rows = without.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(LEAST, SUPPORT * pages)).collect()
        without.unpersist()
        here = {r["word"]: r["n"] for r in rows}
        wanted = sc.broadcast(frozenset(here))
        beside = {r["word"]: r["n"] for r in residual.mapInArrow(_words_beside_article(known, wanted), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
        articles = beside.get("", 0)
        odds = {x: math.log((n + 0.5) / (pages + 1)) - math.log((beside.get(x, 0) + 0.5) / (articles + 1)) for x, n in sorted(here.items())}
        if last:
            odds = {x: v for x, v in odds.items() if v < 0 or v > TELLING}
    return odds


def reason(title: str | None, bits: list[int], weights: list[int], words: list[str], odds: dict[str, float]) -> str | None:
    """Why a page isn't one, from its title and the lines of its residual; None for pages with an article."""
    title = (title or "").strip()
    if title:
        if placeholder(title):
            return "placeholder"
        if DEFAULT_TITLE.match(title) or DEFAULT_TITLE.match(re.split(r"\s+[-–|]\s+", title)[0]):
            return "title"
    every = 0
    for b in bits:
        every |= b
    if every & PLACEHOLDER_BIT:
        return "placeholder"
    if every & TITLE_BIT:
        return "title"
    if article_of(weights, words, odds, ENOUGH) >= ENOUGH:
        return None
    return "evidence" if any(_score(x, odds) > EVIDENCE_ODDS for x in words) else None


def _judge(odds):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            why = [reason(*row, odds.value) for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)))]
            keep = pa.array([w is not None for w in why])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array([w for w in why if w], pa.string())], names=["crawl_id", "reason"])

    return judge


def residual_of(pages: DataFrame, everywhere: set[int]) -> DataFrame:
    """(id, page, title, w, words, bits) of parsed pages with ``recurrent``, without the recurrent lines."""
    sc = pages.sparkSession.sparkContext
    general = sc.broadcast(frozenset(everywhere))

    def subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for ks, w, words, bits, own in zip(*(batch.column(i).to_pylist() for i in range(3, 8))):
                gone = general.value.union(own or ()) if own else general.value
                left = [i for i, k in enumerate(ks) if k not in gone]
                out[0].append([w[i] for i in left])
                out[1].append([words[i] for i in left])
                out[2].append([bits[i] for i in left])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.list_(pa.int64()))], names=["id", "page", "title", "w", "words", "bits"])

    return pages.select("id", "page", "title", "k", "w", "words", "bits", "recurrent").mapInArrow(subtract, "id bigint, page bigint, title string, w array<int>, words array<string>, bits array<bigint>")


def residue_of(pages: DataFrame, folder: str) -> DataFrame:
    """(crawl_id, reason) of parsed crawled pages. Boilerplate is what recurs beside articles, so that the
    message of an error is left however many of a host's pages are errors."""
    articles = pages.where(F.aggregate("w", F.lit(0), lambda a, x: a + x) >= ARTICLE)
    everywhere, of_hosts = recurrent_lines(articles, folder)
    residual = written(residual_of(with_recurrent(pages, of_hosts), everywhere), folder, "residual")
    odds = residual.sparkSession.sparkContext.broadcast(evidence_words(residual.select("page", "w", "words")))
    return residual.select("id", "title", "bits", "w", "words").mapInArrow(_judge(odds), "crawl_id bigint, reason string")


def residue_pages(crawls: DataFrame) -> DataFrame:
    """(crawl_id, reason) of pages that are template residue, filler, errors, blocks or script notices.

    Null or empty content is judged by its title alone. Rows with a null crawl_id are left out; a
    repeated crawl_id gives one row per reason. In small tables words with fewer than ``LEAST`` pages
    are no evidence, so the few errors that they hold may stay.
    """
    folder = new_folder(crawls.sparkSession, "pages")
    filled = crawls.withColumn("content", F.coalesce("content", F.lit("")))
    return residue_of(parsed(page_rows(filled, "crawl_results", "crawl_id"), folder), folder).distinct()
