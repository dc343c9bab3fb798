"""The language of each document and of each segment of a document in several languages.

One interpolated Kneser-Ney model of characters per language; the models' n-grams are merged into
sorted arrays whose rows hold the logarithms for all languages. A segment gets the language of the
lowest length-normalised cross-entropy, unless that is higher than the language's own sentences have it
(rejected as ``und``). The models are fitted on a bounded sample of labelled documents, whose wrong
labels they outvote: each passage of the sample is given the language that the models find, and the
models are fitted again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import sentences

LANGUAGES = ("en", "fr", "pt", "es", "de", "sw", "ru", "ar", "hi", "zh", "ja", "th")
# Three-letter codes of those languages.
THREE = dict(x.split("=") for x in "eng=en fra=fr fre=fr por=pt spa=es deu=de ger=de swa=sw rus=ru ara=ar hin=hi zho=zh chi=zh jpn=ja tha=th".split())
#: Of each label about this many documents of at most so many characters are fitted on, in so many rounds.
SAMPLE, LONGEST, ROUNDS = 400, 20_000, 3
ORDER, DISCOUNT = 4, 0.75
#: Nats by which another language must be ahead for a change of language between sentences.
SWITCH = 6.0
#: One document of so many of the sample is held out: rejection and confidence are set by these alone.
HELD_OUT = 5
#: A text is rejected if its cross-entropy is further from its language's than halfway between that of all
#: but this share of held-out texts in it, and that of all but this share of those in the other languages,
#: which stand for languages unknown; more letters than SETTLED say no more of a text's deviation.
REJECTED, UNKNOWN, SETTLED = 0.001, 0.05, 200
#: Letters of the pieces of held-out texts on which confidence is fitted.
PIECES = (3, 6, 12, 24, 48)

_LETTER = np.zeros(1 << 16, bool)
_UPPER = np.array([chr(i).isupper() for i in range(1 << 16)])
_CASED = np.array([chr(i).isupper() or chr(i).islower() for i in range(1 << 16)])
_CODE = np.full(1 << 16, 32, np.uint64)
for _i in range(1 << 16):
    _c = chr(_i)
    if _c.isalpha() or 0x900 <= _i < 0xE80 and not _c.isdigit() and not _c.isspace() and _c not in "।॥฿":
        _low = _c.lower()
        _CODE[_i] = ord(_low) if len(_low) == 1 and ord(_low) < 1 << 16 else _i
        _LETTER[_i] = True

# Scripts by first and last code point, and those that each language is written in.
SCRIPTS = {"latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "cyrillic": [(0x400, 0x52F)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFEFC)], "devanagari": [(0x900, 0x97F)], "thai": [(0xE00, 0xE7F)], "han": [(0x3400, 0x9FFF)], "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)]}
WRITTEN = {"ru": ["cyrillic"], "ar": ["arabic"], "hi": ["devanagari"], "zh": ["han"], "ja": ["han", "kana"], "th": ["thai"]}
#: Nats that a letter of another script costs; less for Latin, in which all languages write foreign names.
FOREIGN, FOREIGN_LATIN = 6.0, 1.2
_SCRIPT = np.zeros(1 << 16, np.int64)
for _n, _ranges in enumerate(SCRIPTS.values(), 1):
    for _from, _to in _ranges:
        _SCRIPT[_from : _to + 1] = np.where(_LETTER[_from : _to + 1], _n, 0)
_COST = np.zeros((len(SCRIPTS) + 1, len(LANGUAGES)), np.float32)
for _n, _name in enumerate(SCRIPTS, 1):
    for _k, _l in enumerate(LANGUAGES):
        if _name not in WRITTEN.get(_l, ["latin"]):
            _COST[_n, _k] = FOREIGN_LATIN if _name == "latin" else FOREIGN
# Japanese is seldom written in Chinese characters alone
_COST[list(SCRIPTS).index("han") + 1, LANGUAGES.index("ja")] = 0.5

_FRONT = re.compile(r"\A\s*---[^\S\n]*\n.*?\n---[^\S\n]*(?:\n|\Z)", re.S)
_ASIDE = re.compile(r"\[\[[^\]\n]*\]\]|\]\([^)\n]*\)|(?:https?://|www\.)\S+|\S+@\S+\.\S+")
_NAMES = re.compile(r"(?<!\w)[A-ZÀ-Þ][\w’.-]*(?:\s(?:[A-ZÀ-Þ][\w’.-]*|&)){2,}")
_PIECES = re.compile(r"[.!?…。！？।؟\n]+\s*")
# where any sentence may end: also at the blanks of Thai
_THAI = re.compile(r"[\u0e00-\u0e7f]")
_ENDS = re.compile(_PIECES.pattern + r"|(?<=[\u0e00-\u0e7f])\s+|\s+(?=[\u0e00-\u0e7f])")


def label_of(label: str | None) -> str | None:
    """The language that a label names, in two letters; None if it names none of those known."""
    m = re.fullmatch(r"([A-Za-z]{2,3})(?:[-_][A-Za-z0-9]+)*", (label or "").strip())
    code = m[1].lower() if m else None
    return code if code in LANGUAGES else THREE.get(code)


def codes_of(text: str) -> np.ndarray:
    """One code per character: letters in lower case, all else blank; so are front matter, links, addresses and long names."""
    low = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    if len(low) != len(text):  # characters beyond the first plane tell no language
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.where(points < 1 << 16, points, 32).astype(np.uint16)
    codes = _CODE[low]
    if text.lstrip()[:3] == "---" and (m := _FRONT.match(text)):
        codes[: m.end()] = 32
    if "[" in text or "@" in text or "www" in text or "://" in text or "](" in text:
        for m in _ASIDE.finditer(text):
            codes[m.start() : m.end()] = 32
    upper = np.count_nonzero(_UPPER[low])
    if upper and upper < 0.6 * np.count_nonzero(_CASED[low]):
        for m in _NAMES.finditer(text):
            codes[m.start() : m.end()] = 32
    return codes


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each position, 16 bits a character; blanks stand before the first."""
    out = codes.copy()
    for k in range(1, n):
        before = np.full(len(codes), 32, np.uint64)
        before[k:] = codes[:-k] if k < len(codes) else 0
        out |= before << np.uint64(16 * k)
    return out


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(keys, return_counts=True)
    return keys, counts.astype(np.float64)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each wanted key, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class KneserNey:
    """An interpolated model: the highest order counts occurrences, the lower ones distinct predecessors."""

    def __init__(self, codes: np.ndarray, order: int = ORDER):
        self.orders = []
        types = None
        for n in range(order, 0, -1):
            if n == order:
                every = grams(codes, n)
                every = every[_speaks(every)]
                keys, counts = _counted(every)
            else:
                keys, counts = _counted(types & np.uint64((1 << (16 * n)) - 1))
            types = keys
            contexts, first = np.unique(keys >> np.uint64(16), return_index=True)
            sums = np.add.reduceat(counts, first) if len(first) else counts
            kinds = np.diff(np.append(first, len(keys))).astype(np.float64)
            self.orders.append((n, keys, counts, contexts, sums, kinds))

    def rest(self, contexts: np.ndarray, n: int) -> np.ndarray:
        """What order n leaves to the next lower one after each context."""
        _, _, _, known, sums, kinds = next(o for o in self.orders if o[0] == n)
        at, there = _at(known, contexts)
        return np.where(there, DISCOUNT * kinds[at] / sums[at], 1.0) if len(known) else np.ones(len(contexts))

    def chance(self, keys: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full(len(keys), 1.0 / 20_000)
        _, known, counts, contexts, sums, _ = next(o for o in self.orders if o[0] == n)
        at, there = _at(known, keys)
        ctx = keys >> np.uint64(16)
        where, seen = _at(contexts, ctx)
        mine = np.where(there & seen, np.maximum(counts[at] - DISCOUNT, 0.0) / np.maximum(sums[where], 1.0), 0.0) if len(known) else np.zeros(len(keys))
        return mine + self.rest(ctx, n) * self.chance(keys & np.uint64((1 << (16 * (n - 1))) - 1), n - 1)


def _speaks(keys: np.ndarray) -> np.ndarray:
    """N-grams whose last or last but one character is a letter; the others tell nothing."""
    return ((keys & np.uint64(0xFFFF)) != 32) | (((keys >> np.uint64(16)) & np.uint64(0xFFFF)) != 32)


@dataclass
class Models:
    """Sorted n-gram arrays of all languages; ``rows`` [n-gram, language] are logarithms."""

    keys: np.ndarray
    rows: np.ndarray
    lower_keys: np.ndarray
    lower_rows: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray
    single_keys: np.ndarray
    single_rows: np.ndarray
    mean: np.ndarray  # cross-entropy of held-out texts of each language
    limit: np.ndarray  # deviation from it, per root of a letter, beyond which a text is rejected
    slope: np.ndarray  # confidence: constant, and weight of the root of the lead in nats

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """[position, language] log chances of each character after its three predecessors."""
        every = grams(codes, ORDER)
        keys, back = np.unique(every, return_inverse=True)
        at, there = _at(self.keys, keys)
        out = self.rows[at]
        miss = np.flatnonzero(~there)
        if len(miss):
            lower = keys[miss] & np.uint64((1 << 48) - 1)
            p, ok = _at(self.lower_keys, lower)
            q, _ = _at(self.single_keys, lower & np.uint64(0xFFFF))
            found = self.single_keys[q] == (lower & np.uint64(0xFFFF))
            single = np.where(found[:, None], self.single_rows[q], np.float32(-12.0))
            c, known = _at(self.contexts, keys[miss] >> np.uint64(16))
            out[miss] = np.where(ok[:, None], self.lower_rows[p], single) + np.where(known[:, None], self.rest[c], np.float32(0))
        out[~_speaks(keys)] = 0
        out -= _COST[_SCRIPT[(keys & np.uint64(0xFFFF)).astype(np.int64)]]
        return out[back]


def fit(samples: dict[str, np.ndarray]) -> Models:
    """Models from the codes of each language's passages."""
    models = {l: KneserNey(samples.get(l, np.zeros(0, np.uint64))) for l in LANGUAGES}

    def union(n: int, what: int) -> np.ndarray:
        return np.unique(np.concatenate([next(o for o in m.orders if o[0] == n)[what] for m in models.values()]))

    log = lambda keys, n: np.stack([np.log(m.chance(keys, n)) for m in models.values()], axis=1).astype(np.float32)
    keys, lower, single, contexts = union(4, 1), union(3, 1), union(1, 1), union(4, 3)
    rest = np.stack([np.log(m.rest(contexts, 4)) for m in models.values()], axis=1).astype(np.float32)
    if not len(keys):
        keys = lower = single = contexts = np.zeros(1, np.uint64)
        flat = np.full((1, len(LANGUAGES)), -12.0, np.float32)
        return Models(keys, flat, lower, flat, contexts, flat * 0, single, flat, np.full(len(LANGUAGES), 99.0), np.full(len(LANGUAGES), np.inf), np.array([0.0, 1.0]))
    return Models(keys, log(keys, 4), lower, log(lower, 3), contexts, rest, single, log(single, 1), np.full(len(LANGUAGES), 99.0), np.full(len(LANGUAGES), np.inf), np.array([0.0, 1.0]))


def pieces_of(text: str) -> np.ndarray:
    """Starts of short passages: a cheap cut at every end mark and line end."""
    starts, last = [0], 0
    for m in _PIECES.finditer(text):
        if m.end() - last >= 24 and m.end() < len(text):
            last = m.end()
            starts.append(last)
    return np.array(starts, np.int64)


def ends_of(text: str) -> np.ndarray:
    """Starts of the smallest passages of which sentences are made."""
    marks = _ENDS if _THAI.search(text) else _PIECES
    return np.array([0, *(m.end() for m in marks.finditer(text) if m.end() < len(text))], np.int64)


def _summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0) if len(starts) else values[:0]


def _parts(rows: list[tuple[str, str]]) -> tuple[list[np.ndarray], list[int], list[int]]:
    """Passages of labelled texts in a script of the label's, their labels' languages and their rows."""
    parts, owners, of = [], [], []
    for n, (label, text) in enumerate(rows):
        codes = codes_of(text)
        starts = pieces_of(text)
        for a, b in zip(starts, [*starts[1:], len(codes)]):
            piece = codes[a:b]
            script = _SCRIPT[piece.astype(np.int64)]
            # a label is taken at its word only for passages in one of its scripts
            kana = (script == list(SCRIPTS).index("kana") + 1).sum()
            if label == "ja" and kana < 0.15 * (script > 0).sum() or label == "zh" and kana:
                continue
            if (piece != 32).sum() >= 6 and (_COST[script, LANGUAGES.index(label)] > 0).sum() < 0.4 * (script > 0).sum():
                parts.append(np.append(piece, np.uint64(32)))
                owners.append(LANGUAGES.index(label))
                of.append(n)
    return parts, owners, of


def train(rows: list[tuple[str, str]]) -> Models:
    """Models from (language, text) pairs, some of them wrong; every fifth pair calibrates and is not fitted on."""
    models = fit({})
    parts, owners, _ = _parts([r for n, r in enumerate(rows) if n % HELD_OUT])
    if not parts:
        return models
    owner = np.array(owners, np.int64)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    whole = np.concatenate(parts)
    for _ in range(ROUNDS):
        models = fit({l: np.concatenate([parts[i] for i in np.flatnonzero(owner == k)]) for k, l in enumerate(LANGUAGES) if (owner == k).any()})
        owner = _totals(models, whole, starts).argmax(axis=1)
    calibrate(models, *held_out(rows, models))
    return models


def _totals(models: Models, whole: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.concatenate([_summed(models.scores(whole[a:b]), starts[i:j] - a) for i, j, a, b in _blocks(starts, len(whole))])


def held_out(rows: list[tuple[str, str]], models: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores by position, letters by position, language by position) of the held-out texts that are in one language.

    What language that is, the whole text tells; texts of which a passage tells another are left out.
    """
    none = np.zeros((0, len(LANGUAGES)), np.float32), np.zeros(0, bool), np.zeros(0, np.int64)
    parts, _, of = _parts([r for n, r in enumerate(rows) if n % HELD_OUT == 0])
    if not parts:
        return none
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    whole = np.concatenate(parts)
    value = np.concatenate([models.scores(whole[a:b]) for _, _, a, b in _blocks(starts, len(whole))])
    each = _summed(value, starts)
    at = np.array(of)
    totals = np.zeros((at.max() + 1, len(LANGUAGES)))
    np.add.at(totals, at, each)
    main = totals.argmax(axis=1)
    mixed = np.zeros(len(totals), bool)
    np.logical_or.at(mixed, at, each.max(axis=1) - each[np.arange(len(at)), main[at]] > SWITCH)
    keep = np.repeat(~mixed[at], sizes)
    return (value[keep], (whole != 32)[keep], np.repeat(main[at], sizes)[keep]) if keep.any() else none


def _cuts(letters: np.ndarray, language: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Starts of runs of about so many letters in turn, each within one language."""
    count = np.cumsum(letters)
    ends, total, k = [0], 0, 0
    while total < count[-1]:
        total += sizes[k % len(sizes)]
        ends.append(int(np.searchsorted(count, total)) + 1)
        k += 1
    return np.unique(np.concatenate([[e for e in ends if e < len(letters)], np.flatnonzero(np.diff(language)) + 1])).astype(np.int64)


def pieces_told(value: np.ndarray, letters: np.ndarray, language: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """For pieces of the texts: leads in nats, whether the leader is right, letters, true language, cross-entropy in each."""
    starts = _cuts(letters, language, sizes)
    total, n, true = _summed(value.astype(np.float64), starts), _summed(letters.astype(np.float64), starts), language[starts]
    some = n >= 2
    total, n, true = total[some], n[some], true[some]
    ordered = np.sort(total, axis=1)
    return ordered[:, -1] - ordered[:, -2], total.argmax(axis=1) == true, n, true, -total / n[:, None]


def calibrate(models: Models, value: np.ndarray, letters: np.ndarray, language: np.ndarray) -> None:
    """Sets what is rejected, and how sure a lead is, by held-out texts."""
    if not len(value):
        return
    _, _, n, true, entropy = pieces_told(value, letters, language, (20, 40, 80, SETTLED))
    long = n >= 20
    n, true, entropy = n[long], true[long], entropy[long]
    for k in range(len(LANGUAGES)):
        own = true == k
        if own.sum() < 20 or (~own).sum() < 20:
            continue
        models.mean[k] = np.average(entropy[own, k], weights=n[own])
        far = (entropy[:, k] - models.mean[k]) * np.sqrt(np.minimum(n, SETTLED))
        most = max(np.quantile(far[own], 1 - REJECTED), 0.0)
        models.limit[k] = max(most, (most + np.quantile(far[~own], UNKNOWN)) / 2)
    lead, right, *_ = pieces_told(value, letters, language, PIECES)
    x = np.stack([np.ones(len(lead)), np.sqrt(lead)], axis=1)
    w = np.array([0.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (right - p) - 1e-3 * (w - [0.0, 1.0]))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    models.slope = w


def confidence_of(lead: np.ndarray, models: Models) -> np.ndarray:
    """The share of right answers among held-out pieces with such a lead."""
    return 1 / (1 + np.exp(-np.clip(models.slope[0] + models.slope[1] * np.sqrt(np.maximum(lead, 0)), -30, 30)))


def _blocks(starts: np.ndarray, end: int, size: int = 1 << 20) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, from, to): runs of passages of about ``size`` positions."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + size)))
        a, b = int(starts[i]), int(starts[j]) if j < len(starts) else end
        yield i, j, a, b
        i = j


def path(total: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The likeliest language of each sentence, a change costing ``switch``."""
    n, k = total.shape
    best, came = total[0].astype(np.float64), np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        came[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - switch) + total[i]
    out = np.empty(n, np.int64)
    out[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = came[i, out[i]]
    return out


def segments_of(texts: list[str], models: Models) -> list[list[tuple[int, int, str, float]]]:
    """For each text its segments: (start, end, language, confidence).

    A path that changes language gains more than ``SWITCH`` on the text's best language. No path gains
    more than each smallest passage does in its own best language, so only texts in which these gains
    sum up to that, and in which the best path over the smallest passages changes, are cut into sentences;
    the others would come out in one language.
    """
    codes = [codes_of(t) for t in texts]
    pieces = [ends_of(t) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    todo = np.flatnonzero(sizes)
    i = 0
    while i < len(todo):
        j, held = i, 0
        while j < len(todo) and (j == i or held + sizes[todo[j]] <= 1 << 20):
            held += int(sizes[todo[j]])
            j += 1
        part = todo[i:j]
        i = j
        whole = np.concatenate([codes[d] for d in part])
        value = models.scores(whole)
        letter = (whole != 32).astype(np.float32)
        first = np.cumsum(sizes[part]) - sizes[part]
        doc_total, doc_letters = _summed(value, first), _summed(letter, first)
        starts = np.concatenate([pieces[d] + f for d, f in zip(part, first)])
        of = np.repeat(np.arange(len(part)), [len(pieces[d]) for d in part])
        total = _summed(value, starts)
        main = doc_total.argmax(axis=1)
        ahead = total.max(axis=1) - total[np.arange(len(of)), main[of]]
        several = np.bincount(of, ahead, len(part)) > SWITCH - 0.01
        bounds = np.searchsorted(of, np.arange(len(part) + 1))
        for m in np.flatnonzero(several):
            # a path over sentences is one over their passages, too: if the best of those doesn't change, none does;
            # it changes only if some run of passages gains more than a change costs in another language
            own = total[bounds[m] : bounds[m + 1]]
            run = np.cumsum(own - own[:, main[m] : main[m] + 1], axis=0, dtype=np.float64)
            least = np.minimum.accumulate(np.concatenate([np.zeros((1, run.shape[1])), run[:-1]]), axis=0)
            several[m] = bool(((run - least).max(axis=0) > SWITCH - 0.01).any())
            if several[m]:
                lang = path(own)
                several[m] = bool((lang != lang[0]).any())
        mixed = np.flatnonzero(several)
        which, a, b = sentences.spans([texts[part[m]] for m in mixed]) if len(mixed) else (np.zeros(0, np.int64),) * 3
        for p, d in enumerate(part):
            if doc_letters[p] < 2:
                continue
            if not several[p]:
                k = int(main[p])
                out[d] = [(0, len(texts[d]), *_verdict(doc_total[p], doc_letters[p], k, models))]
        for n, m in enumerate(mixed):
            d, lo = part[m], int(first[m])
            own = which == n
            spans = np.stack([a[own], b[own]], axis=1)
            sums = np.add.reduceat(value[lo : lo + sizes[d]], spans[:, 0], axis=0) if len(spans) else None
            count = np.add.reduceat(letter[lo : lo + sizes[d]], spans[:, 0]) if len(spans) else None
            told = np.flatnonzero(count >= 3)
            lang = path(sums[told]) if len(told) else main[m : m + 1]
            if (lang == lang[0]).all():
                if doc_letters[m] >= 2:
                    out[d] = [(0, len(texts[d]), *_verdict(doc_total[m], doc_letters[m], int(main[m]), models))]
                continue
            at = 0
            for cut in [*np.flatnonzero(np.diff(lang)) + 1, len(told)]:
                run = told[at:cut]
                out[d].append((int(spans[run[0], 0]), int(spans[run[-1], 1]), *_verdict(sums[run].sum(axis=0), count[run].sum(), int(lang[at]), models)))
                at = cut
    return out


def _verdict(total: np.ndarray, letters: float, k: int, models: Models) -> tuple[str, float]:
    """Language and confidence; ``und`` for a text further from its language than held-out texts are."""
    entropy = -float(total[k]) / max(float(letters), 1.0)
    lead = float(total[k] - np.delete(total, k).max())
    far = (entropy - models.mean[k]) * np.sqrt(min(float(letters), SETTLED)) > models.limit[k]
    return ("und" if letters >= 20 and far else LANGUAGES[k]), float(confidence_of(lead, models))


def sample_of(documents: DataFrame) -> list[tuple[str, str]]:
    """About SAMPLE labelled texts of each language, drawn by a hash of the text: at most 12 * 2 * SAMPLE rows."""
    short = F.lower(F.regexp_extract(F.trim(F.coalesce("lang", F.lit(""))), r"^([A-Za-z]{2,3})(?:[-_][A-Za-z0-9]+)*$", 1))
    known = F.create_map(*[F.lit(x) for pair in THREE.items() for x in pair])
    named = documents.withColumn("_l", F.coalesce(known[short], short)).where(F.col("_l").isin(*LANGUAGES))
    sizes = {r["_l"]: r["count"] for r in named.groupBy("_l").count().collect()}
    if not sizes:
        return []
    share = F.create_map(*[x for l, n in sizes.items() for x in (F.lit(l), F.lit(min(1.0, SAMPLE / n)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = named.where(draw < share[F.col("_l")]).where(F.length("text") <= LONGEST).select("_l", "text").limit(2 * SAMPLE * len(LANGUAGES)).collect()
    return sorted((r["_l"], r["text"]) for r in drawn if r["text"])


SEGMENTS = "doc_id bigint, label string, seg_no int, char_start int, char_end int, lang string, confidence double, n_segments int"


def language_segments(documents: DataFrame) -> DataFrame:
    """(doc_id, label, seg_no, char_start, char_end, lang, confidence, n_segments) of every segment of every document.

    A document in one language is one segment; ``und`` is a text in none of the languages known. Null and
    blank texts, and texts without letters outside front matter, links and names, have no segments;
    rows with a null doc_id are left out.
    """
    spark = documents.sparkSession
    models = spark.sparkContext.broadcast(train(sample_of(documents)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, texts = (batch.column(i).to_pylist() for i in range(3))
            rows = [(i, label, n, *s, len(found)) for i, label, found in zip(ids, labels, segments_of([t or "" for t in texts], models.value)) for n, s in enumerate(found, 1)]
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    return documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").alias("label"), "text").mapInArrow(cut, SEGMENTS)


def wrong_or_mixed(segments: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang) of documents in several languages, and of those whose label is not their language's.

    A document's first segment tells whether there are others: ``segments`` has ``n_segments``.
    """
    short = F.lower(F.regexp_extract(F.trim(F.coalesce("label", F.lit(""))), r"^([A-Za-z]{2,3})(?:[-_][A-Za-z0-9]+)*$", 1))
    known = F.create_map(*[F.lit(x) for pair in THREE.items() for x in pair])
    return segments.where((F.col("n_segments") > 1) | (F.coalesce(known[short], short) != F.col("lang"))).where("lang <> 'und'").select("doc_id", "seg_no", "lang")
