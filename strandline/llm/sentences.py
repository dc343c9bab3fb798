"""Sentence boundaries for texts of many languages and scripts.

A lexer turns each text into a stream of symbols: hard breaks, opening and closing quotation marks,
end marks by what stands before and after them, blanks between Thai phrases, and runs of other text.
The rules that need memory (inside a quotation, did it open the sentence, is all so far a date) are a
finite transducer over those symbols; see ``transducer.run`` for how long texts are processed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import transducer

# Abbreviations after which a sentence goes on, whatever follows.
GOES_ON = """
mr mrs ms dr prof st gen col capt lt sgt rev hon pres gov sen rep eng ing arch fr jas chas wm geo thos jos edw robt
no nos nr num núm art arts sec secs fig figs vol vols pp p par para paras ch chap ref refs ed eds cf e.g i.e eg ie vs v approx
incl excl esp viz dept mt ft ave av blvd rd sq gen.-secr
jan feb mar apr jun jul aug sep sept oct nov dec
mme mlle mm env h ex p.ex c.-à-d réf chap éd n°
ee sr sra srta dra d dña dn ud uds exmo exma ilmo ilma aprox apdo pág págs tel cap eng.º
mio mrd z.b d.h u.a z.t bzw ca vgl abb abs bd hr fr str dipl.-ing bzgl ggf inkl evtl sog tab kap anm
dkt bw bi na uk k.m yaani taz mh
напр т.е т.к т.н им ул пр д рис стр табл гл ст п пп проф акад см ср г-н г-жа тел обл р-н
डॉ सं श्री श्रीमती प्रो पृ क्र रु
د أ م ص
ดร นาย พ.ศ ค.ศ
""".split()
# Abbreviations that may end a sentence; what follows decides.
MAY_END = """
etc al ltd co corp inc plc bros jr sr esq a.m p.m hrs hr u.s u.k u.n e.u
usw u.s.w
ee.uu uu
n.k
г гг млн млрд долл руб тыс др пр т.д т.п
""".split()
# Words before a German ordinal, and months after it.
ORDINAL_BEFORE = "am|vom|zum|beim|den|dem|der|des|im|die|das|ab|seit|bis|und"
MONTH_AFTER = "Januar|Jänner|Februar|März|Marz|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
# Verbs of speech after a quotation that closes on an exclamation or question mark.
SPEECH = "told|said|says|asked|asks|replied|repeated|added|warned|cried|shouted|insisted|wrote|declared|claimed|répond|répét|déclar|demand|affirm|ajout|disse|respondeu|repetiu|perguntou|afirmou|dijo|respondió|repitió|preguntó|afirmó|sagte|fragte|antwortete|wiederholte|erklärte|rief|alisema|alijibu|alirudia|aliuliza|сказал|ответил|повторил|спросил|заявил|说|表示|回答|重申|问|称"
# Thai words that carry a phrase on after a blank.
THAI_GOES_ON = "ซึ่ง|หรือ|ประมาณ|โดย|และ|แต่|ที่|ว่า|เพื่อ|จึง|ดังนั้น|เพราะ|รวม|ทั้ง|กับ|ของ|ใน|จาก|ถึง|ตั้งแต่|เมื่อวันที่|คือ|เช่น|เป็น|ได้|เหลือ|คน|บาท|ล้าน|เมกะวัตต์|เมตร|ครัวเรือน"

OPENERS = "«“„‹「『《〈\"([{¿¡‘'"
CLOSERS = "»”›」』》〉\"’')]}“"
_ENDS = ".!?…。！？．｡।॥؟۔"
_QUOTES = "“”„«»「」『』\""

GOES_ON_SET, MAY_END_SET = frozenset(GOES_ON), frozenset(MAY_END)

#: The lexer: one alternative per kind of symbol; runs of other text are one match.
LEXER = re.compile(
    r"(?P<end>[" + _ENDS + r"]+)(?P<shut>[\s  ]?[»›]|[”\"“」』’')\]}»]+)?"
    r"|(?P<line>[^\S\n]*\n\s*)"
    r"|(?P<date>(?<!\w)\d{1,2} [а-я]+ \d{4} г\.(?=\s+[А-ЯA-Z«]))"
    r"|(?P<thai>(?<=[฀-๿\d%a-zA-Z])[^\S\n]+(?=[เ-๿ก-฿A-Z\d“]))"
    r"|(?P<quote>[" + _QUOTES + r"])"
    r"|(?P<text>[^" + _ENDS + _QUOTES + r"\n\d  ]+(?:[  ]+(?![฀-๿])[^" + _ENDS + _QUOTES + r"\n\d  ]+)*(?<![฀-๿]))"
    r"|(?P<other>.)",
    re.S,
)
_WORD_BEFORE = re.compile(r"(?<!\w)(?:[^\W\d_]\.[  ]?){0,3}[^\W\d_][\w’°ºऀ-ॿ-]*$")
_TOKEN_AFTER = re.compile(r"(\s*)([—–•*#-]*\s*[" + re.escape(OPENERS) + r"]*\s?)(\S?)(\S?)(\S?)")
_ORDINAL = re.compile(r"(?:^|\s)(?:" + ORDINAL_BEFORE + r")\s\d{1,2}$", re.I)
_NUMBER = re.compile(r"(?<![\d.,/])\d{1,2}$")
_MONTH = re.compile(r"\s+(?:" + MONTH_AFTER + r")\b", re.I)
_SPEECH = re.compile(SPEECH, re.I)
_THAI_ON = re.compile(r"(?:" + THAI_GOES_ON + r")")
_THAI_NUMBER = re.compile(r"[฀-๿]\s*(?:19|20|24|25|26)\d\d$|ร้อยละ\s*[\d.,]+$")
_SHORT_AFTER = re.compile(r"\s*[^\W\d_]{1,2}\.")
_YEAR_BEFORE = re.compile(r"[^\W\d_]{2,} (?:19|20)\d\d$")
_UNIT_BEFORE = re.compile(r"\d[^\W\d_]{1,3}$")
_CUT_OFF = re.compile(r"[^.!?…]*(?:\b[^\W\d_]{1,4}\.[^.!?…]*){0,5}(?:…|\.\.\.)$")
_COUNT_AFTER = re.compile(r"\d[\d,.  ]*\s[^\W\d_]")
_LATIN_PHRASE = re.compile(r"(?:[“«]?[A-Z][\w’'-]*|\d[\d.,]*)(?:\s+\S+){0,5}?\s+[a-z]{2,}\s+(?:\S+\s+){0,3}[a-z]{2,}")
_URL_BEFORE = re.compile(r"(?:www\.|://|@)\S*$", re.I)

# ---------------------------------------------------------------------------------------------
# The transducer.

_KINDS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", '"': '"'}
_OPEN = list(_KINDS)
#: Symbols. End marks: B ends a sentence outside quotations, N never does. X*_k: an end mark with the
#: closing mark k; p after a full stop, s after an exclamation or question mark with speech following,
#: n where the sentence goes on. Q_k: a quotation mark alone; QT_k: one before a new Thai phrase.
SYMBOLS = ["reset", "break", "text", "B", "N", "D", "T"] + [f"{x}_{k}" for x in ("Xp", "Xs", "Xn", "Q", "QT") for k in "“”„«»「」『』\""]
SYMBOL = {s: i for i, s in enumerate(SYMBOLS)}
FRESH, MID = 0, 1
#: 0: at a sentence's start; 1: within it; then for each kind of quotation: it opened the sentence, or not.
STATES = 2 + 2 * len(_OPEN)


def _compile() -> tuple[np.ndarray, np.ndarray]:
    table = np.zeros((STATES, len(SYMBOLS)), np.int16)
    emits = np.zeros((STATES, len(SYMBOLS)), np.int8)
    for state in range(STATES):
        kind = _OPEN[(state - 2) // 2] if state >= 2 else None
        opened_it = state >= 2 and state % 2 == 0
        for symbol, i in SYMBOL.items():
            what, _, mark = symbol.partition("_")
            closes = kind is not None and (mark == _KINDS[kind] or kind == "„" and mark == "”")
            to, out = state, 0
            if what == "reset":
                to = FRESH
            elif what == "break":
                to, out = FRESH, 1
            elif what in ("B", "T", "D") and kind is None:
                to, out = (MID, 0) if what == "D" and state == FRESH else (FRESH, 1)
            elif what in ("text", "N") and kind is None:
                to = MID
            elif what[0] == "X":
                if closes or kind is None:
                    if what == "Xp" or what == "Xs" and not (closes and opened_it):
                        to, out = FRESH, 1
                    else:
                        to = MID
            elif what[0] == "Q":
                if closes:
                    to, out = (FRESH, 1) if what == "QT" and not opened_it else (MID, 0)
                elif kind is None and mark in _KINDS:
                    to = 2 + 2 * _OPEN.index(mark) + (state != FRESH)
                elif kind is None:
                    to = MID
            table[state, i], emits[state, i] = to, out
    return table, emits


TABLE, EMITS = _compile()


def _follows(text: str, at: int) -> tuple[str, bool]:
    """Class of what stands after a position (end, upper, lower, digit, caseless) and whether blanks come first."""
    m = _TOKEN_AFTER.match(text, at)
    blank, ch = bool(m[1]), m[3]
    if not ch:
        return "end", blank
    if ch in ",;:%":
        return "lower", blank
    if ch.isdigit():
        return "digit", blank
    if ch.islower():
        # words such as e-mail or iPhone are written so at a sentence's start, too
        return ("upper" if m[4] == "-" and m[5].isalpha() or blank and m[4].isupper() else "lower"), blank
    if ch.isupper() or ch.istitle():
        return "upper", blank
    if ch.isalpha():
        return "caseless", blank
    return "other", blank


def _full_stop(text: str, start: int, after: int) -> bool:
    """Does the full stop at ``start`` end its sentence, seen by its neighbours alone?"""
    follows, blank = _follows(text, after)
    if follows == "end":
        return True
    if follows == "lower":
        return False
    before = text[max(0, start - 28) : start]
    word = _WORD_BEFORE.search(before)
    if word:
        last = word[0]
        bare = last.lower().replace(" ", "").replace(" ", "")
        bare = re.split("[’']", bare)[-1] or bare
        tail = bare.rsplit(".", 1)[-1]
        if len(tail) == 1 and last[-1].isupper():
            return False  # an initial
        if bare in GOES_ON_SET and (len(bare) > 1 or last.islower() is False or follows == "digit" or bare in ("v", "p", "т", "п", "д")):
            return False
        if bare in MAY_END_SET or tail in MAY_END_SET:
            # in a text in capitals what follows doesn't tell
            return (not last.isupper() or "." in last or tail == "uu") and blank and follows in ("upper", "digit", "caseless", "other")
        if tail in GOES_ON_SET and len(tail) > 1:
            return False
        if len(tail) == 1 and _SHORT_AFTER.match(text, after):
            return False  # the first part of an abbreviation in two parts
        if len(tail) == 1 and "." in bare:
            return False  # dotted abbreviations
        if not blank:
            # a lost blank, unless the dot is inside a name or an address
            if follows == "digit":
                return len(tail) > 3 and bool(_COUNT_AFTER.match(text, after)) and not _URL_BEFORE.search(before)
            return follows in ("upper", "caseless") and len(tail) > 1 and not _URL_BEFORE.search(before)
        return True
    if not blank and follows == "upper" and _UNIT_BEFORE.search(before):
        return True
    if not blank and _YEAR_BEFORE.search(before) and _COUNT_AFTER.match(text, after):
        return True
    if not blank:
        return follows in ("upper", "caseless") and bool(before) and before[-1] in "%»”\")°" or (follows == "upper" and before[-1:].isdigit() and not _URL_BEFORE.search(before))
    if _NUMBER.search(before) and (_ORDINAL.search(before) or _MONTH.match(text, after)):
        return False
    return True


def _break_lines(text: str) -> set[int] | None:
    """Positions of the line breaks that only wrap a sentence; None if no line is wrapped.

    A line filled up to a width w is at most w long and would exceed w with the next word; the width
    is the one that most lines agree on.
    """
    lines = text.split("\n")
    if not 40 <= max(map(len, lines)) <= 140:
        return None
    filled, at = [], 0
    for line, after in zip(lines, lines[1:]):
        at += len(line)
        first = after.split(None, 1)[0] if after.strip() else ""
        if first and line.strip():
            n = len(line.rstrip())
            filled.append((at, n, n + (len(first) if first[0] < "฀" else 1)))
        at += 1
    widths = sorted({n for _, n, _ in filled if n >= 40})
    if not widths:
        return None
    votes, width = max((sum(n <= w <= m for _, n, m in filled), -w) for w in widths)
    slack = 12 if votes > 1 else 0  # blanks lost or doubled later move a line's end
    return {at for at, _, m in filled if m >= -width - slack}


def symbols_of(text: str) -> tuple[list[int], list[int]]:
    """The symbols of a text and, for each, the position at which a sentence would end."""
    out, ends = [SYMBOL["reset"]], [0]
    wraps = _break_lines(text) if "\n" in text else None
    add, end = out.append, ends.append
    low = False  # inside „...“
    for m in LEXER.finditer(text):
        kind, s, e = m.lastgroup, m.start(), m.end()
        if kind == "text" or kind == "other":
            if kind == "other" and text[s].isspace():
                continue
            if out[-1] != 2:
                add(2)
                end(e)
            continue
        if kind == "line":
            if text.count("\n", s, e) > 1:
                add(1)
                end(s)
            else:
                nl = text.index("\n", s)
                wrapped = wraps is not None and nl in wraps
                after = text[e : e + 1]
                before = text[s - 1 : s]
                if not wrapped and not (after.islower() and before not in _ENDS) and before not in ",;:-–—" and after and after not in _ENDS and after not in CLOSERS + "%,;:":
                    add(1)
                    end(s)
                elif "฀" <= before <= "๿" or "฀" <= after <= "๿":
                    if _thai_blank(text, s, e):
                        add(6)
                        end(s)
            continue
        if kind == "date":
            add(SYMBOL["D"])
            end(e)
            continue
        if kind == "thai":
            if _thai_blank(text, s, e):
                add(6)
                end(s)
            continue
        if kind == "quote":
            mark = text[s]
            low = mark == "„" or low and mark not in "“”"
            rest = text[e : e + 12]
            new = rest[:1].isspace() and "฀" <= rest.lstrip()[:1] <= "๿" and not _THAI_ON.match(rest.lstrip())
            add(SYMBOL[("QT_" if new else "Q_") + mark])
            end(e)
            continue
        # an end mark, with any closing marks
        marks, shut = m["end"], m["shut"]
        if shut and "“" in shut and not low:
            shut = shut[: shut.index("“")] or None
            e = m.end("end") + len(shut or "")
            opens_after = True
        else:
            opens_after = False
        stop = m.end("end")
        if shut:
            close = shut.strip()
            quote = next((c for c in close if c in "”»“」』\""), None)
            stop = e
        else:
            quote = None
        first = marks[-1] if marks[-1] not in ".…" else marks[0]
        loud = any(c in "!?！？؟" for c in marks)
        if len(marks) > 1 and set(marks) <= {"."} or "…" in marks:
            follows, blank = _follows(text, stop)
            ends_it = follows in ("end", "upper") or follows == "digit" and blank
            if ends_it and follows != "end" and m.start() and text[m.start() - 1].isspace():
                ends_it = False
        elif first == ".":
            if quote:
                follows, blank = _follows(text, stop)
                ends_it = follows != "lower"
            else:
                ends_it = _full_stop(text, s, stop)
        else:
            follows, blank = _follows(text, stop)
            ends_it = follows != "lower" and (blank or follows != "digit" or first not in "!?") and not (follows == "other" and not blank)
            if first in "。！？｡" and not quote:
                ends_it = True
            if quote and text[stop : stop + 1] in "とっなのはでにがをも":
                ends_it = False
        # an ellipsis that follows belongs to the sentence before
        if ends_it and not quote:
            rest = text[stop:].lstrip() if len(text) - stop < 8 else text[stop : stop + 8].lstrip()
            if rest[:1] == "…" or rest[:3] == "...":
                ends_it = False
        if quote:
            if not ends_it:
                name = "Xn_"
            elif loud and (_SPEECH.search(text, stop, stop + 90) or _CUT_OFF.fullmatch(text[stop : stop + 90].strip())):
                name = "Xs_"
            else:
                name = "Xp_"
            add(SYMBOL[name + quote])
        else:
            add(SYMBOL["B" if ends_it else "N"])
        end(stop)
        if opens_after:
            add(SYMBOL["Q_“"])
            end(m.end())
        elif shut and "“" in shut:
            low = False
    return out, ends


def _thai_blank(text: str, s: int, e: int) -> bool:
    """Is the blank between two Thai phrases, or between a Thai and a Latin one, the end of a sentence?

    Names in Latin letters are written without blanks inside Thai, so a Latin phrase that follows a
    blank counts as a sentence if it holds words in lower case.
    """
    before, after = text[max(0, s - 40) : s], text[e : e + 12]
    thai_before = "฀" <= before[-1:] <= "๿"
    if not "฀" <= after[:1] <= "๿":
        return (thai_before or bool(_THAI_NUMBER.search(before))) and bool(_LATIN_PHRASE.match(text, e, e + 120))
    if _THAI_ON.match(after):
        return False
    if before[-1:].isdigit():
        return bool(_THAI_NUMBER.search(before))
    return thai_before or before[-1:].isalpha() or before[-1:] == "%"


def spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, end) of every sentence of every text, in order.

    White space around a sentence is left out; every other character is in exactly one sentence.
    """
    symbols: list[int] = []
    ends: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text and not text.isspace():
            a, b = symbols_of(text)
            symbols += a
            ends += b
            sizes[i] = len(a)
    emitted = transducer.run(TABLE, EMITS, np.array(symbols, np.int64), FRESH).astype(bool)
    owner = np.repeat(np.arange(len(texts)), sizes)[emitted]
    cuts = np.array(ends, np.int64)[emitted]
    which, start, stop = [], [], []
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        if not sizes[i]:
            continue
        at = 0
        for cut in [*cuts[first[i] : first[i + 1]].tolist(), len(text)]:
            piece = text[at:cut]
            bare = piece.strip()
            if bare:
                lead = at + len(piece) - len(piece.lstrip())
                which.append(i)
                start.append(lead)
                stop.append(lead + len(bare))
            at = cut
    return np.array(which, np.int64), np.array(start, np.int64), np.array(stop, np.int64)


SCHEMA = "evidence_id bigint, field_name string, char_start int, char_end int"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for field in (1, 2):
            texts = batch.column(field).to_pylist()
            which, start, stop = spans([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[which], pa.int64()), pa.array([batch.schema.field(field).name] * len(which), pa.string()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())],
                names=["evidence_id", "field_name", "char_start", "char_end"],
            )


def evidence_sentences(evidence: DataFrame) -> DataFrame:
    """One row per sentence of ``content`` (plain and PDF text only) and of ``snippet``.

    Null and blank texts give no rows; other columns play no part; rows with a null id are kept out,
    as nothing could refer to them.
    """
    plain = F.lower(F.trim(F.coalesce("content_type", F.lit("")))).rlike(r"^(text/plain|application/pdf)\b")
    return evidence.where(F.col("evidence_id").isNotNull()).select(F.col("evidence_id").cast("bigint").alias("evidence_id"), F.when(plain, F.col("content")).alias("content"), "snippet").mapInArrow(_cut, SCHEMA)
