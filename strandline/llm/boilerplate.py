"""The article of a page apart from its furniture, as a minimum cut over the page's lines.

Each line is a node. A classifier's costs of calling it furniture, or content, are the capacities to
the two terminals; neighbouring lines, and lines of one parent element, are joined by smoothness
edges. A minimum cut, found by maximum flow, is the cheapest labelling of all lines together.

The classifier is a logistic regression over a line's marks. It is fitted on pages whose elements and
classes tell furniture from content, once with those marks and once without them, so that it judges
plain text, too. Stated weights are the mean of its prior: they decide where no such pages exist.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.pages import _BULLET, _PARTS, TAIL, article_weight, page_rows, parsed, recurrent_lines, residue_of, sentence_like, tail_heading, wide, with_recurrent
from strandline.session import new_folder

# Elements, and words in class names, of a page's furniture.
ELEMENTS = frozenset("nav footer aside form button select noscript figcaption header menu".split())
CLASSES = frozenset("nav navbar menu foot footer share sharing social tags tag cookie cookies consent rel related byline author ad ads advert advertisement sponsor sponsored comment comments sidebar breadcrumb breadcrumbs newsletter subscribe promo teaser teasers widget banner".split())
# Words before a colon that announce other articles, tags and advertisements.
ANNOUNCE = TAIL | frozenset(
    """in pictures|see more|see also|sponsored|advertisement|watch|video|photos|gallery|don’t miss|etiquetas|mots-clés|schlagwörter|schlagworte|теги|метки|الوسوم|وسوم|टैग|标签|タグ|แท็ก|lebo|vitambulisho|publicité|publicidade|publicidad|anzeige|реклама|tangazo|إعلان|विज्ञापन|广告|広告|โฆษณา|share this|share|partilhar|partager|teilen|compartir|поделиться|shiriki|شارك|साझा करें|分享|共有|แชร์|text size|sede|siège|head office|sitz""".split("|")
)
_COPYRIGHT = re.compile(r"^\W*(?:©|\(c\)\s|copyright\b)", re.I)
_HASHES = re.compile(r"(?:^|\s)#\s?\w")
_YEAR = re.compile(r"\b(?:1[89]|2[0-6])\d\d(?!\d)|(?:19|20|25)\d\d年|\b25\d\d\b")
_SCRIPTED = re.compile(r"java ?script|\bscripts?\b|noscript", re.I)

#: Smoothness: neighbours in one run of lines, neighbours across a gap or another element, second neighbours of one element.
NEAR, ACROSS, SECOND = 0.8, 0.5, 0.3

#: Marks of a line, and the mean of each one's weight before any page is seen: above 0 for content.
MARKS = {
    "element": -5.0, "class": -5.0, "link": -3.0, "h1": 5.0, "h2": 2.5, "h3": 0.5, "li": 0.5, "h2 in tail": 2.0,
    "heading of tail": -6.0, "tail": -4.0, "menu": -4.0, "two parts": -4.0, "arrow": -4.0, "site": -4.0, "copyright": -5.0, "announced": -5.0, "hashes": -3.0, "scripted": -4.0,
    "title": 6.0, "sentence": 3.0, "long": 1.0, "item": 2.2, "other before text": 0.8, "other before others": -1.5, "everywhere": -4.0, "on host": -2.5,
}
BIT = {name: 1 << i for i, name in enumerate(MARKS)}
_MARKUP_BITS = sum(BIT[x] for x in ("element", "class", "link", "h1", "h2", "h3", "li", "h2 in tail"))
_TAGS = {"h1": BIT["h1"], "h2": BIT["h2"], "h3": BIT["h3"], "li": BIT["li"]}
#: Notices that scripts are needed are shorter than this; a longer line may mention them.
SHORT = 160
#: A page of the sample: its elements or classes call so many lines furniture.
TELLING_LINES = 2
#: The classifier is fitted on about so many pages, drawn by a hash of their ids.
SAMPLE = 3000
#: How strongly the prior holds: as that many nats for a weight one off its mean.
PRIOR = 0.5
#: A line that the sample's markup calls content, or furniture.
CONTENT_BIT, FURNITURE_BIT = 1 << 43, 1 << 44


def marks_of(lines: list, masked: list[str], title: str, mask) -> list[int]:
    """The bits of a page's lines that need no other page."""
    title = title.strip()
    wanted = {mask(t) for t in (title, re.split(r"\s+[-–|]\s+", title)[0]) if t}
    furniture = [bool(x.tags and ELEMENTS.intersection(x.tags)) for x in lines]
    classes = [bool(x.marks and CLASSES.intersection(x.marks.replace("-", " ").split())) for x in lines]
    telling = sum(furniture) + sum(classes) >= TELLING_LINES
    body = [article_weight(x.text) > 0 for x in lines]
    out, tail = [], False
    for i, x in enumerate(lines):
        text, m = x.text, masked[i]
        heading = tail_heading(text)
        tail = tail or heading
        bits = BIT["element"] * furniture[i] | BIT["class"] * classes[i] | BIT["link"] * x.link
        if x.tags:
            last = x.tags[-1]
            bits |= _TAGS.get(last, 0)
            if telling:
                if furniture[i] or classes[i] or x.link or tail or last not in ("h1", "h2", "p", "li"):
                    bits |= FURNITURE_BIT
                elif last != "p" or body[i]:  # a short paragraph may be a sub-heading or a teaser
                    bits |= CONTENT_BIT
        if heading:
            bits |= BIT["heading of tail"]
        elif tail:
            bits |= BIT["tail"] | BIT["h2 in tail"] * ("h2" in x.tags)
        parts = [p for p in _PARTS.split(text) if p]
        if len(parts) >= 3 and sum(map(len, parts)) < 26 * len(parts):
            bits |= BIT["menu"]
        elif len(parts) == 2 and len(text) < 90 and (" | " in text and _YEAR.search(parts[1]) or " > " in text or " · " in text or " | " in text and not sentence_like(text)):
            bits |= BIT["two parts"]
        if text.endswith((" >", "›")) or text.count(" > ") > 1:
            bits |= BIT["arrow"]
        if m == "§":  # the site's name and nothing else
            bits |= BIT["site"]
        if _COPYRIGHT.match(text):
            bits |= BIT["copyright"]
        before, colon, _ = text.replace("：", ":").partition(":")
        if (before if colon else text).strip().lower() in ANNOUNCE:
            bits |= BIT["announced"]
        if text.startswith("#") and not text.startswith("##") and _HASHES.search(text):
            bits |= BIT["hashes"]
        if len(text) < SHORT and _SCRIPTED.search(text):
            bits |= BIT["scripted"]
        if not tail and m in wanted:
            bits |= BIT["title"]
        if sentence_like(text):
            bits |= BIT["sentence"] | BIT["long"] * (len(text) > (35 if wide(text) else 110))
        elif _BULLET.match(text):
            bits |= BIT["item"]
        elif len(parts) < 2 and not bits & BIT["title"]:
            # a sub-heading has text below it, a teaser another teaser or the end
            bits |= BIT["other before text"] if i + 1 < len(lines) and body[i + 1] else BIT["other before others"]
        out.append(bits)
    return out


def fit(bits: np.ndarray, content: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Weights of the marks and a constant: a logistic regression by Newton's method, with a Gaussian prior about MARKS."""
    mean = np.array([*MARKS.values(), 0.0])
    w = mean.copy()
    if not len(bits):
        return w
    x = np.concatenate([(bits[:, None] >> np.arange(len(MARKS))) & 1, np.ones((len(bits), 1), np.int64)], axis=1).astype(np.float64)
    kinds, at = np.unique(x, axis=0, return_inverse=True)
    n, good = np.bincount(at.ravel(), minlength=len(kinds)), np.bincount(at.ravel(), content, len(kinds))

    def loss(w: np.ndarray) -> float:
        z = kinds @ w
        return float(n @ np.logaddexp(0, z) - good @ z + prior / 2 * ((w - mean) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(kinds @ w, -30, 30)))
        slope = kinds.T @ (good - n * p) - prior * (w - mean)
        curve = (kinds * (n * p * (1 - p))[:, None]).T @ kinds + prior * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-6:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def trained(pages: DataFrame, everywhere: set[int]) -> np.ndarray:
    """The classifier, from a sample of at most about SAMPLE telling pages; only bits of its lines come to the driver."""
    label = F.lit(CONTENT_BIT | FURNITURE_BIT)
    telling = pages.where(F.exists("bits", lambda b: b.bitwiseAND(label) != 0))
    share = min(1.0, SAMPLE / max(1, telling.count()))
    drawn = telling.where(F.pmod(F.xxhash64("record_table", "id", F.lit(7)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = drawn.select("k", "bits", "recurrent").collect()
    bits = sorted(b for r in rows for b in with_bits(r["k"], r["bits"], r["recurrent"], everywhere) if b & (CONTENT_BIT | FURNITURE_BIT))
    both = np.array(bits, np.int64)
    content = (both & CONTENT_BIT != 0).astype(np.float64)
    return fit(np.concatenate([both, both & ~np.int64(_MARKUP_BITS)]), np.concatenate([content, content]))


def with_bits(keys: list[int], bits: list[int], recurrent: list[int] | None, everywhere: set[int]) -> list[int]:
    """Bits with what other pages tell: lines that recur."""
    own = set(recurrent or ())
    return [b | (BIT["everywhere"] if k in everywhere else BIT["on host"] if k in own else 0) for k, b in zip(keys, bits)]


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: a node against its score costs |score|, an edge cut its weight.

    A node whose score outweighs all its edges keeps its side in every minimum cut; the flow is run
    over the rest only.
    """
    n = len(scores)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    score, fixed = list(scores), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if fixed[i] is None and abs(score[i]) >= sum(w for j, w in near[i] if fixed[j] is None):
            fixed[i] = score[i] > 0
            for j, w in near[i]:
                if fixed[j] is None:
                    score[j] += w if fixed[i] else -w
                    todo.append(j)
    free = [i for i in range(n) if fixed[i] is None]
    if not free:
        return [bool(x) for x in fixed]
    at = {i: p for p, i in enumerate(free)}
    source, sink = len(free), len(free) + 1
    cap: list[dict[int, float]] = [{} for _ in range(len(free) + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        cap[a][b] = cap[a].get(b, 0.0) + forth
        cap[b][a] = cap[b].get(a, 0.0) + back

    for i in free:
        join(source, at[i], max(score[i], 0.0), 0.0)
        join(at[i], sink, max(-score[i], 0.0), 0.0)
        for j, w in near[i]:
            if j in at and i < j:
                join(at[i], at[j], w, w)
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b, c in cap[a].items():
                if c > 1e-9 and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            break
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        flow = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= flow
            cap[b][a] += flow
    for i in free:
        fixed[i] = at[i] in came
    return [bool(x) for x in fixed]


def kept_lines(numbers: list[int], bits: list[int], boxes: list[int], weights: np.ndarray, known: dict[int, float]) -> list[int]:
    """Numbers of the lines of the article. ``known`` holds the scores of the bits met so far."""
    if not numbers:
        return []
    scores = []
    for b in bits:
        b &= (1 << len(MARKS)) - 1
        s = known.get(b)
        if s is None:
            s = known[b] = float(weights[-1] + sum(weights[i] for i in range(len(MARKS)) if b >> i & 1))
        scores.append(s)
    edges = []
    for i in range(len(numbers) - 1):
        same = boxes[i] >> 1 == boxes[i + 1] >> 1
        edges.append((i, i + 1, NEAR if same and not boxes[i + 1] & 1 else ACROSS))
        if i + 2 < len(numbers) and boxes[i] >> 1 and boxes[i] >> 1 == boxes[i + 2] >> 1:
            edges.append((i, i + 2, SECOND))
    return [no for no, keep in zip(numbers, min_cut(scores, edges)) if keep]


def _keep(everywhere, weights: np.ndarray):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, float] = {}
        for batch in batches:
            tables, ids, numbers, keys, bits, boxes, own = (batch.column(i).to_pylist() for i in range(7))
            out_table, out_id, out_line = [], [], []
            for t, i, no, k, b, x, r in zip(tables, ids, numbers, keys, bits, boxes, own):
                lines = kept_lines(no, with_bits(k, b, r, everywhere.value), x, weights, known)
                out_table += [t] * len(lines)
                out_id += [i] * len(lines)
                out_line += lines
            yield pa.RecordBatch.from_arrays([pa.array(out_table, pa.string()), pa.array(out_id, pa.int64()), pa.array(out_line, pa.int32())], names=["record_table", "record_id", "line_no"])

    return keep


def article_lines(crawls: DataFrame, evidence: DataFrame) -> DataFrame:
    """(record_table, record_id, line_no): the lines to keep of every text/html row.

    Crawled pages that are no pages (see ``pages.residue_of``) are left out, as are null and empty
    contents and rows with a null id. Every page is parsed once.
    """
    folder = new_folder(crawls.sparkSession, "boilerplate")
    html = F.coalesce(F.lower(F.trim("content_type")).startswith("text/html"), F.lit(False))
    filled = crawls.withColumn("content", F.coalesce("content", F.lit("")))
    rows = page_rows(filled, "crawl_results", "crawl_id").unionByName(page_rows(evidence.where(html), "evidence", "evidence_id"))
    pages = parsed(rows, folder, marks_of)
    crawled = pages.where("record_table = 'crawl_results'")
    no_pages = residue_of(crawled, f"{folder}/residue").select(F.lit("crawl_results").alias("record_table"), F.col("crawl_id").alias("id"))
    marked = crawls.where(html & F.col("crawl_id").isNotNull()).select(F.lit("crawl_results").alias("record_table"), F.col("crawl_id").cast("bigint").alias("id"))
    everywhere, of_hosts = recurrent_lines(pages, folder)
    judged = with_recurrent(pages.where(F.size("no") > 0), of_hosts)
    weights = trained(judged, everywhere)
    wanted = judged.where("record_table = 'evidence'").unionByName(judged.where("record_table = 'crawl_results'").join(marked.distinct(), ["record_table", "id"], "left_semi"), allowMissingColumns=True).join(no_pages, ["record_table", "id"], "left_anti")
    general = pages.sparkSession.sparkContext.broadcast(frozenset(everywhere))
    return wanted.select("record_table", "id", "no", "k", "bits", "box", "recurrent").mapInArrow(_keep(general, weights), "record_table string, record_id bigint, line_no int")
